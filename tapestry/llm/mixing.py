"""Mixing to target weights by soft membership, in Spark SQL functions alone.

1. A labelled table (id, domain) trains a naive Bayes classifier: word counts by
   domain over a bounded sample of labelled texts, for the ``VOCABULARY`` most
   frequent words of the sample.
2. Every text gets domain posteriors: the domains' log likelihoods of its known
   words, averaged over them and weighted as ``EVIDENCE`` words (a long text
   would otherwise have no soft membership left), plus the log priors.
   Posteriors are kept to 1 / ``GRID``.
3. Document rates r >= floor are fitted so that the expected tokens of each
   domain, the sum of n * p * r, match the targets in the least-squares sense.
   A projected-gradient step lowers each rate by its posteriors' product with
   the scaled residual and projects it onto r >= floor; the scaling is the
   inverse Gram matrix of the rates that are free to move, so few steps do.
   Only the residual (a number for each domain) passes through the driver.
   Rates depend on the posteriors alone, so the steps run over one row for each
   distinct posterior vector with its token total.

Every stage aggregates by domain, word or posterior before it shuffles, so a
hot source or a group of copies does not gather anywhere.

Edge cases: a NULL or empty text has no tokens and the prior as posterior; a
text without known words too; without labelled rows all domains are alike; a
domain without tokens cannot reach its target and is left out of the fit;
targets are scaled to sum to one; rows that share an id are rated each; NULL
ids are rated, but never labelled; a label with a NULL domain, or one without
a target, is ignored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapestry.llm.common import SPACE, lower_ascii, stage

MAX_LABELLED = 8_000
VOCABULARY = 4_000
EVIDENCE = 20.0
GRID = 200
STEPS, CLOSE = 40, 1e-7


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), f"[{SPACE}]+"), lambda w: w != "")


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str) -> tuple[DataFrame, list[float]]:
    """The model (word, one log likelihood a domain) and the log priors."""
    known = labelled.where(F.col(id_col).isNotNull() & F.col("domain").isin(domains)).select(id_col, "domain").distinct()
    sample = known.orderBy(F.xxhash64(id_col), id_col, "domain").limit(MAX_LABELLED)
    seen = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(seen.values())
    priors = [math.log((seen.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    texts = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)  # at most MAX_LABELLED ids
    counts = texts.select("domain", F.explode(words(F.col(text_col))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)]
    )
    counts = stage(counts.orderBy(F.desc("n"), "word").limit(VOCABULARY), "words")
    sums = counts.agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(domains))]).first()
    likely = [F.log((F.col(f"n{k}") + 1) / F.lit((sums[k] or 0) + VOCABULARY)).alias(f"l{k}") for k in range(len(domains))]
    return counts.select("word", *likely), priors


def posteriors(docs: DataFrame, model: DataFrame, priors: list[float], id_col: str, text_col: str) -> DataFrame:
    """One row per row: doc_id, n_tokens and p (posteriors on the grid)."""
    ks = range(len(priors))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("words"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("n_tokens", F.size("words").cast("long"))
    each = rows.select("row", "doc_id", "n_tokens", F.explode_outer("words").alias("word"))
    met = each.join(F.broadcast(model), "word", "left")  # at most VOCABULARY words
    sums = met.groupBy("row", "doc_id", "n_tokens").agg(F.count("l0").alias("known"), *[F.sum(f"l{k}").alias(f"l{k}") for k in ks])
    mean = [F.coalesce(F.col(f"l{k}") / F.col("known"), F.lit(0.0)) * EVIDENCE + priors[k] for k in ks]
    sums = sums.select("doc_id", "n_tokens", *[m.alias(f"m{k}") for k, m in enumerate(mean)])
    top = F.greatest(*[F.col(f"m{k}") for k in ks], F.lit(-1e300))
    sums = sums.select("doc_id", "n_tokens", *[F.exp(F.col(f"m{k}") - top).alias(f"e{k}") for k in ks])
    whole = sum((F.col(f"e{k}") for k in ks), F.lit(0.0))
    # grid cells, the last domain takes what rounding leaves
    cells = [F.round(F.col(f"e{k}") / whole * GRID) for k in ks[:-1]]
    cells = sums.select("doc_id", "n_tokens", *[c.alias(f"c{k}") for k, c in enumerate(cells)])
    rest = F.greatest(F.lit(0.0), F.lit(float(GRID)) - sum((F.col(f"c{k}") for k in ks[:-1]), F.lit(0.0)))
    return cells.select("doc_id", "n_tokens", F.array(*[F.col(f"c{k}") / GRID for k in ks[:-1]], rest / GRID).alias("p"))


def dot(p: Column, v: list[float]) -> Column:
    return sum((p[k] * F.lit(float(x)) for k, x in enumerate(v)), F.lit(0.0))


def rate_of(p: Column, steps: list[list[float]], floor: float) -> Column:
    """The rate after some projected steps, each given by its scaled residual."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    step = lambda r, s: F.greatest(F.lit(floor), r - F.aggregate(F.zip_with(p, s, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x))
    return F.aggregate(moves, F.lit(1.0), step)


def fit_rates(groups: DataFrame, targets: list[float], floor: float = 0.0) -> list[list[float]]:
    """The steps that bring the token shares of (p, tokens) rows to the targets
    (shares of the tokens there are: targets need not sum to one)."""
    ks, steps = range(len(targets)), []
    weight, total = F.col("tokens").cast("double"), groups.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return steps
    want, best = np.array(targets), (math.inf, 0)
    for _ in range(STEPS + 1):
        r = rate_of(F.col("p"), steps, floor)
        free = (F.col("r") > floor).cast("double")
        got = groups.select("p", "tokens", r.alias("r")).agg(
            *[F.sum(weight * F.col("p")[k] * F.col("r")).alias(f"e{k}") for k in ks],
            *[F.sum(weight * F.col("p")[k] * F.col("p")[j] * free).alias(f"g{k}_{j}") for k in ks for j in ks],
        ).first()
        have = np.array([got[f"e{k}"] for k in ks]) / total
        gram = np.array([[got[f"g{k}_{j}"] for j in ks] for k in ks]) / total
        there = have + np.diag(gram) > 0
        miss = np.where(there, have - want, 0.0)
        size = float(np.abs(miss).max())
        if size < best[0]:
            best = (size, len(steps))
        if size < CLOSE or len(steps) == STEPS:
            break
        scale = np.linalg.pinv(gram, rcond=1e-8, hermitian=True) if gram.any() else np.eye(len(targets))
        steps.append((scale @ miss).tolist())
    return steps[: best[1]]


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    floor: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row: doc_id, n_tokens, p (posteriors in the order of the
    targets) and rate, how often the document should come.

    The mixed corpus is as large as the given one if ``floor`` is 0; with a
    higher floor it is the smallest that still holds every domain's tokens
    ``floor`` times.
    """
    domains = list(targets)
    share = [targets[d] / sum(targets.values()) for d in domains]
    model, priors = train(docs, labelled, domains, id_col, text_col)
    rated = stage(posteriors(docs, model, priors, id_col, text_col), "posteriors")
    groups = stage(rated.groupBy("p").agg(F.sum("n_tokens").alias("tokens")), "groups")
    if floor > 0:
        now = groups.agg(F.sum("tokens"), *[F.sum(F.col("p")[k] * F.col("tokens")) for k in range(len(domains))]).first()
        if now[0]:
            more = max(floor * now[k + 1] / now[0] / s for k, s in enumerate(share) if s > 0)
            share = [s * max(1.0, more) for s in share]
    return rated.withColumn("rate", rate_of(F.col("p"), fit_rates(groups, share, floor), floor))


def copies(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as its rate says: the whole part
    always, the fraction by a hash of the id.  ``rates`` has an id once."""
    chance = F.pmod(F.xxhash64(id_col, F.lit(77)), F.lit(1_000_000)) / 1e6
    n = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    often = rates.select(F.col("doc_id").alias(id_col), "rate").select(id_col, n.alias("_copies")).where("_copies > 0")
    turns = F.explode(F.sequence(F.lit(1), F.col("_copies")))
    return docs.join(often, id_col).withColumn("_copies", turns).select(docs.columns)
