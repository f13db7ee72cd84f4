"""License scans: ordered signature rules over whole texts, all in Spark SQL
expressions (no Python on the executors, no shuffle: one pass over the rows).

A text becomes its words, lower-case A-Z, joined by one space.  One pass finds
which rule keywords occur; only the rules of those keywords are tried on that
text.  A rule's matches become word intervals: the match is marked in the text
with two characters that no word can hold, and the marked words' indexes are
its ends.  A detection is suppressed if another one contains its interval and
has a better level, or the same level with a wider interval or, for the same
interval, an earlier rule.  After sorting by (start, widest, level, rule) one
sweep that remembers the furthest end of each level decides this.

Edge cases: NULL and empty texts have no words, no detections and score 0; a
text has no length limit; equal rows are each scanned; an empty table gives an
empty result; other columns pass through ``scan`` unless they bear the name of
an added column, which then wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapestry.llm.common import lower_ascii
from tapestry.llm.license_rules import PHRASES, RULES

#: What parts words (after lower-casing A-Z).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEVELS = 3
#: A detection's weight by level; the share of covered words adds up to COVERED.
WEIGHT = {1: 0.9, 2: 0.6, 3: 0.3}
COVERED = 0.1
OPEN, CLOSE = "\x01", "\x02"


def parse_rules(text: str) -> list[dict]:
    """Rules in order: index, label, level, keyword and a whole-word regex."""
    rules = []
    for line in text.strip().splitlines():
        head, _, regex = line.partition(": ")
        label, level, keyword = head.split()
        rules.append({"rule": len(rules), "label": label, "level": int(level), "keyword": keyword, "regex": f"(?<![^ ])(?:{regex})(?![^ ])"})
    return rules


def normal(text: Column) -> Column:
    """The words of a text, joined by one space ('' without words)."""
    return F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN, " "))


def word_count(norm: Column) -> Column:
    spaces = F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))
    return F.when(norm == "", 0).otherwise(spaces + 1).cast("long")


def found_keywords(norm: Column, keywords: list[str]) -> Column:
    longest_first = sorted(set(keywords), key=lambda k: (-len(k), k))
    return F.array_distinct(F.regexp_extract_all(norm, F.lit(f"(?:^| )({'|'.join(longest_first)})(?= |$)"), 1))


def phrase_places(words: Column, phrase: str) -> Column:
    """Word indexes at which the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    at = F.transform(words, lambda w, i: F.when(w == parts[0], i))

    def follows(i: Column) -> Column:
        ok = i.isNotNull()
        for k, p in enumerate(parts[1:], 1):
            ok = ok & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return ok

    return F.filter(at, follows)


def rule_table(rules: list[dict]) -> Column:
    """The rules as one constant array of structs (a fixed, small table)."""
    fields = ("rule", "label", "level", "keyword", "regex")
    return F.array(*[F.struct(*[F.lit(r[f]).alias(f) for f in fields]) for r in rules])


def detections(norm: Column, keywords: Column, rules: list[dict]) -> Column:
    """All matches of the rules whose keyword occurs, sorted:
    (start, minus_end, level, rule, label), ends exclusive."""

    def matches(r: Column) -> Column:
        marked = F.split(F.regexp_replace(norm, r["regex"], F.lit(f"{OPEN}$0{CLOSE}")), " ")
        starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith(OPEN), i)), lambda i: i.isNotNull())
        ends = F.filter(F.transform(marked, lambda w, i: F.when(w.endswith(CLOSE), i + 1)), lambda i: i.isNotNull())
        return F.zip_with(
            starts, ends,
            lambda a, b: F.struct(a.alias("start"), (-b).alias("minus_end"), r["level"].alias("level"), r["rule"].alias("rule"), r["label"].alias("label")),
        )

    tried = F.filter(rule_table(rules), lambda r: F.array_contains(keywords, r["keyword"]) & F.rlike(norm, r["regex"]))
    return F.array_sort(F.flatten(F.transform(tried, matches)))


def suppress(found: Column) -> Column:
    """Sweep the sorted detections; the ones that no other contains (see the
    module's text) come out with their labels, best level and covered words."""
    start = F.struct(
        *[F.lit(-1).alias(f"end{k}") for k in range(1, LEVELS + 1)],
        F.array().cast("array<string>").alias("labels"), F.lit(9).alias("best"), F.lit(0).alias("kept"), F.lit(0).alias("covered"), F.lit(0).alias("until"),
    )

    def step(s: Column, d: Column) -> Column:
        end = -d["minus_end"]
        reach = F.lit(-1)
        for k in range(1, LEVELS + 1):
            reach = F.greatest(reach, F.when(d["level"] >= k, s[f"end{k}"]).otherwise(-1))
        kept = reach < end
        fresh = F.greatest(F.lit(0), end - F.greatest(s["until"], d["start"]))
        return F.struct(
            *[F.when(d["level"] == k, F.greatest(s[f"end{k}"], end)).otherwise(s[f"end{k}"]).alias(f"end{k}") for k in range(1, LEVELS + 1)],
            F.when(kept, F.array_union(s["labels"], F.array(d["label"]))).otherwise(s["labels"]).alias("labels"),
            F.when(kept, F.least(s["best"], d["level"])).otherwise(s["best"]).alias("best"),
            (s["kept"] + kept.cast("int")).alias("kept"),
            (s["covered"] + F.when(kept, fresh).otherwise(0)).alias("covered"),
            F.when(kept, F.greatest(s["until"], end)).otherwise(s["until"]).alias("until"),
        )

    return F.aggregate(found, start, step)


def scan(docs: DataFrame, text_col: str = "text", rules_text: str = RULES, phrases=PHRASES) -> DataFrame:
    """Add to every row: n_words; base_places (one array of word indexes for
    each phrase); detections (all, sorted); verdict (labels, best level, number
    kept, words covered)."""
    rules = parse_rules(rules_text)
    keywords = [r["keyword"] for r in rules] + [p.split(" ")[-1] for p, _ in phrases]
    none = "array<struct<start:int,minus_end:int,level:int,rule:int,label:string>>"
    out = docs.withColumn("_norm", normal(F.col(text_col)))
    out = out.withColumn("n_words", word_count(F.col("_norm"))).withColumn("_keys", found_keywords(F.col("_norm"), keywords))
    hit = F.size("_keys") > 0
    out = out.withColumn("_words", F.when(hit, F.split("_norm", " ")).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("base_places", F.array(*[phrase_places(F.col("_words"), p) for p, _ in phrases]))
    out = out.withColumn("detections", F.when(hit, detections(F.col("_norm"), F.col("_keys"), rules)).otherwise(F.array().cast(none)))
    return out.withColumn("verdict", suppress(F.col("detections"))).drop("_norm", "_keys", "_words")


def digest(scanned: DataFrame, id_col: str = "doc_id", phrases=PHRASES) -> DataFrame:
    """One row per row: counts and places of the phrases, labels and a score."""
    places = F.flatten("base_places")
    base = F.array_compact(F.array(*[F.when(F.size(F.col("base_places")[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv])[F.col("verdict.best")], F.lit(0.0))
    share = F.when(F.col("n_words") > 0, F.col("verdict.covered") / F.col("n_words")).otherwise(0.0)
    return scanned.select(
        F.col(id_col),
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("verdict.labels"))), ",").alias("labels"),
        (weight + COVERED * share).alias("score"),
        F.col("verdict.kept").cast("long").alias("n_kept"),
    )


def license_scan(docs: DataFrame) -> DataFrame:
    return digest(scan(docs.select("doc_id", "text")))
