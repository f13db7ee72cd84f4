"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained in numpy from confirmed toxic texts (P) and
unlabelled text (U).  With the class prior pi and the logistic loss l, the risk

    pi * R_P(+)  +  max(0, R_U(-) - pi * R_P(-))

estimates the risk on fully labelled text: the unlabelled texts count as
negative, less what the hidden positives among them contribute.  Where a
minibatch drives that part below zero (overfitting of the unlabelled texts),
the step goes up its gradient instead.

A text's features are, for each of its distinct words (lower-case A-Z, signs at
either end stripped), the word and its first four and five characters, hashed
to ``FEATURES`` slots and counted.  Only slots that are clearly more frequent
in P than in U (``SCREEN`` deviations) get a weight.  So a word's contribution
is a sum of three weights, remembered in a bounded table while scoring.

The cut between the classes minimises the same prior-corrected risk for the
0-1 loss; the score is the logistic function of the distance from it, shifted
so that the cut lies at ``THRESHOLD``.

Training reads at most ``MAX_POSITIVE`` toxic and ``MAX_UNLABELLED`` other
texts (the first by a hash of the id), in one task; only the weights, of fixed
size, reach the driver.  Labels say which texts are confirmed toxic and, by
their share, the class prior; labels of 0 are not used as negatives.

Edge cases: a NULL or empty text has no features and scores by the bias alone;
without any confirmed toxic text every score is 0; a NULL id is never a
training row; rows that share an id are scored each, and count as toxic if any
label of the id says so; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapestry.llm.common import release, words_of

FEATURES = 1 << 18
PREFIXES = (4, 5)
SIGNS = b".,;:!?\"'()[]{}%&$*#|-_/"
MAX_POSITIVE, MAX_UNLABELLED = 2_000, 6_000
EPOCHS, BATCH, RATE, DECAY, SEED = 20, 64, 0.02, 1e-3, 7
SCREEN, SHARPNESS, SLACK = 5.0, 2.0, 0.002
THRESHOLD = 0.3
REMEMBER = 200_000


def slots_of(word: bytes) -> list[int]:
    """Feature slots of a word: itself and its prefixes in characters."""
    text = word.strip(SIGNS).decode()
    grams = [f"w {text}", *(f"{n} {text[:n]}" for n in PREFIXES)]
    return [xxhash.xxh32_intdigest(g) % FEATURES for g in grams]


def features(text: str | None) -> np.ndarray:
    """The slots of a text's distinct words, one after the other."""
    words = sorted(set(words_of(text, lower=True)))
    return np.array(list(chain.from_iterable(map(slots_of, words))), np.int32)


class Rows:
    """Sparse rows of slots (a slot that comes twice counts twice)."""

    def __init__(self, slots: list[np.ndarray], keep: np.ndarray):
        slots = [s[keep[s]] for s in slots]
        self.n = np.array([len(s) for s in slots], np.int64)
        self.slots = np.concatenate([*slots, np.empty(0, np.int32)])
        self.starts = np.cumsum(self.n) - self.n

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the rows, and the place in ``rows`` each belongs to."""
        n = self.n[rows]
        place = np.repeat(np.arange(len(rows)), n)
        return self.slots[np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[rows], n)], place

    def margin(self, rows: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
        slots, place = self.pick(rows)
        return np.bincount(place, weights=w[slots], minlength=len(rows)) + bias

    def spread(self, rows: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The gradient with respect to the weights, given that of the margins."""
        slots, place = self.pick(rows)
        return np.bincount(slots, weights=g[place], minlength=FEATURES)


def screen(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Which slots more toxic texts hold than their share of U lets expect."""
    in_p, in_u = (np.bincount(np.concatenate([np.unique(s) for s in rows]), minlength=FEATURES) for rows in (positive, unlabelled))
    expected = len(positive) * (in_u + 1) / (len(unlabelled) + 1)
    return (in_p - expected) / np.sqrt(expected + 1) >= SCREEN


def cut_of(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The margin that parts the classes at the least prior-corrected 0-1 risk
    (the middle of the cuts that come within SLACK of it)."""
    at = np.unique(np.concatenate([p, u]))
    at = np.append(at, at[-1] + 1)  # above all: no text is toxic
    missed = np.searchsorted(np.sort(p), at) / len(p)
    above = 1 - np.searchsorted(np.sort(u), at) / len(u)
    risk = prior * missed + np.maximum(0, above - prior * (1 - missed))
    best = int(np.argmin(risk))
    good = risk <= risk[best] + SLACK
    low = best - int(np.argmax(~good[best::-1])) + 1 if not good[: best + 1].all() else 0
    high = best + int(np.argmax(~good[best:])) - 1 if not good[best:].all() else len(at) - 1
    return float((at[low] + at[high]) / 2)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk."""
    keep = screen(positive, unlabelled)
    p_rows, u_rows = Rows(positive, keep), Rows(unlabelled, keep)
    rng = np.random.default_rng(SEED)
    w, bias = np.zeros(FEATURES), float(np.log(prior / (1 - prior)))
    moments = [np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)]
    steps = max(1, -(-max(len(unlabelled), len(positive)) // BATCH))
    t = 0
    for _ in range(EPOCHS):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for s in range(steps):
            u = u_order[s * BATCH : (s + 1) * BATCH]
            p = np.take(p_order, np.arange(s * BATCH, (s + 1) * BATCH) % len(p_order))[: max(1, min(BATCH, len(p_order)))]
            if not len(u):
                continue
            m_p, m_u = p_rows.margin(p, w, bias), u_rows.margin(u, w, bias)
            # logistic loss: d l(m)/dm = -sigmoid(-m), d l(-m)/dm = sigmoid(m)
            rest = np.logaddexp(0, m_u).mean() - prior * np.logaddexp(0, m_p).mean()
            up, un, uu = -sigmoid(-m_p) / len(p), sigmoid(m_p) / len(p), sigmoid(m_u) / len(u)
            if rest >= 0:
                g_p, g_u = prior * (up - un), uu
            else:
                g_p, g_u = prior * un, -uu
            g = np.append(p_rows.spread(p, g_p) + u_rows.spread(u, g_u) + DECAY * w, g_p.sum() + g_u.sum())
            t += 1
            moments[0] += 0.1 * (g - moments[0])
            moments[1] += 0.001 * (g * g - moments[1])
            step = RATE * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
            w -= step[:-1]
            bias -= step[-1]
    cut = cut_of(p_rows.margin(np.arange(len(positive)), w, bias), u_rows.margin(np.arange(len(unlabelled)), w, bias), prior)
    return SHARPNESS * w, SHARPNESS * (bias - cut) + float(np.log(THRESHOLD / (1 - THRESHOLD)))


def sample_rows(docs: DataFrame, labels: DataFrame, can_train: Column, max_positive: int, max_unlabelled: int) -> tuple[DataFrame, float]:
    """(text, positive) of the training sample, and the class prior.  An id that
    many rows share gives one row (that of the smallest text hash)."""
    known = labels.where(F.col("doc_id").isNotNull()).select("doc_id", "toxic").where(can_train)
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    order = F.xxhash64("doc_id")
    toxic = known.where("toxic = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(max_positive)
    ids = docs.where(F.col("doc_id").isNotNull()).where(can_train).select("doc_id")
    others = ids.distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_unlabelled)
    picked = toxic.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False)))
    rows = docs.select("doc_id", "text").join(picked, "doc_id")
    one = rows.groupBy("doc_id", "positive").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return one.select("text", "positive"), prior


def fit(sample: DataFrame, prior: float) -> tuple[np.ndarray, float] | None:
    """Train in one task on the bounded sample; None without toxic texts."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                texts = b.column("text").slice(i, 256).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column("positive").slice(i, 256), pa.array([features(t).tobytes() for t in texts], pa.binary())], names=["positive", "slots"]
                )

    def learn(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("positive").to_pylist(), table.column("slots").to_pylist(), strict=True))
        p, u = ([np.frombuffer(s, np.int32) for flag, s in rows if flag is want] for want in (True, False))
        if not p or not u:
            return pa.table({"weights": pa.array([], pa.binary())})
        w, bias = train(p, u, min(max(prior, 1e-4), 1 - 1e-4))
        return pa.table({"weights": pa.array([np.append(w, bias).astype("<f4").tobytes()], pa.binary())})

    got = sample.mapInArrow(turn, "positive boolean, slots binary").groupBy(F.lit(0).alias("one")).applyInArrow(learn, "weights binary").collect()
    if not got:
        return None
    all_weights = np.frombuffer(got[0][0], "<f4")
    return all_weights[:-1], float(all_weights[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: doc_id, score (0 to 1) and predicted (1 from the
    threshold on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, float] = {}
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = [set(words_of(t, lower=True)) for t in part.column("text").to_pylist()]
                if model is None:
                    values = np.zeros(len(sets))
                else:
                    w, bias = model
                    new = list(set().union(*sets).difference(memory))
                    if len(memory) + len(new) > REMEMBER:
                        memory.clear()
                        new = list(set().union(*sets))
                    slots = np.array(list(map(slots_of, new)), np.int64).reshape(-1, 1 + len(PREFIXES))
                    memory.update(zip(new, w[slots].sum(axis=1, dtype=np.float64).tolist(), strict=True))
                    sums = np.array([sum(map(memory.__getitem__, sorted(s))) for s in sets])
                    values = sigmoid(sums + bias)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(values, pa.float64()), pa.array((values >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
                )
        memory.clear()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """Fit on the rows that are not held out, score all rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(*sample_rows(texts, labels, F.coalesce(~held_out(F.col("doc_id")), F.lit(False)), max_positive, max_unlabelled))
    scored = score(texts, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
