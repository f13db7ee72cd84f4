"""Text similarity and score bands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapestry.functions._util import as_col

# --- fixed values -----------------------------------------------------------
# Confidence bands: high >= 0.8, medium >= 0.5, low below.
BAND_HIGH = 0.8
BAND_MEDIUM = 0.5
# Of a text of at least POPULAR_FROM characters, those that make up more than
# 1 / POPULAR_SHARE of it (and one more) start no common block.
POPULAR_FROM, POPULAR_SHARE = 200, 100
# ---------------------------------------------------------------------------


def similarity_native(a, b) -> Column:
    """I16 (native): ``1 - levenshtein(a, b) / max(len a, len b)``; two empty
    texts are identical (1.0).  NULL is read as ''.  Runs in codegen."""
    a = F.coalesce(as_col(a), F.lit(""))
    b = F.coalesce(as_col(b), F.lit(""))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


#: Stands for a popular character while blocks are looked for (no character).
_HIDDEN = "\uffff"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, the value computed once."""
    return F.transform(F.array(value), body)[0]


def _upto(n: Column) -> Column:
    """0 .. n - 1; nothing for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _part(text: Column, at: Column, n: Column) -> Column:
    return F.substring(text, at + 1, n)


def _agreeing(n: Column, same: Callable[[Column], Column]) -> Column:
    """How many of ``same(0), same(1), ...`` hold before the first that does not."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(acc: Column, t: Column) -> Column:
        return _let(acc["on"] & same(t), lambda on: F.struct((acc["n"] + on.cast("int")).alias("n"), on.alias("on")))

    return F.aggregate(_upto(n), start, step, lambda acc: acc["n"])


def _longest_block(a: Column, b: Column, seeds: Column) -> Column:
    """Struct (i, j, k): the longest common block of a and ``seeds`` (b with its
    popular characters hidden), the first in a, then in b; extended over equal
    neighbours in b.  The length only grows along a, so a text of n characters
    takes at most 2 n looks for a part of a in b."""
    n = F.char_length(a)

    def step(acc: Column, _: Column) -> Column:
        hit = F.instr(seeds, _part(a, acc["i"], acc["k"] + 1)) > 0
        moved = _let(hit, lambda h: F.struct(
            F.when(h, acc["i"]).otherwise(acc["i"] + 1).alias("i"), (acc["k"] + h.cast("int")).alias("k"), F.when(h, acc["i"]).otherwise(acc["at"]).alias("at")))
        return F.when(acc["i"] + acc["k"] < n, moved).otherwise(acc)

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("k"), F.lit(0).alias("at"))
    found = F.aggregate(_upto(2 * n), start, step, lambda acc: F.struct(
        acc["at"].alias("i"), F.when(acc["k"] > 0, F.instr(seeds, _part(a, acc["at"], acc["k"])) - 1).otherwise(0).alias("j"), acc["k"].alias("k")))

    def extend(m: Column) -> Column:
        i, j, end_a, end_b = m["i"], m["j"], m["i"] + m["k"], m["j"] + m["k"]
        one = F.lit(1)
        left = _agreeing(F.least(i, j), lambda t: _part(a, i - t - 1, one) == _part(b, j - t - 1, one))
        right = _agreeing(F.least(n - end_a, F.char_length(b) - end_b), lambda t: _part(a, end_a + t, one) == _part(b, end_b + t, one))
        wider = _let(left, lambda x: F.struct((i - x).alias("i"), (j - x).alias("j"), (m["k"] + x + right).alias("k")))
        return F.when(b == seeds, m).otherwise(wider)

    return _let(found, extend)


def similarity_ratio(a, b) -> Column:
    """I16 (exact): the sequence-matcher ratio ``2 * M / (length a + length b)``.
    M sums the longest common block of the texts, then of what lies left and
    what lies right of it, and so on.  One native expression: a fold takes one
    open interval a step and puts back the two that its block leaves; texts of n
    and m characters take at most 2 * min(n, m) + 1 steps.  NULL is read as '';
    two empty texts have ratio 1."""
    a, b = F.coalesce(as_col(a).cast("string"), F.lit("")), F.coalesce(as_col(b).cast("string"), F.lit(""))

    def hidden(text: Column) -> Column:
        """The text with its popular characters hidden."""
        n = F.char_length(text)
        often = lambda c: n - F.char_length(F.replace(text, c, F.lit(""))) > F.floor(n / POPULAR_SHARE) + 1
        popular = F.array_join(F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), 0)), often), "")
        return F.when(n < POPULAR_FROM, text).otherwise(_let(popular, lambda p: F.call_function("translate", text, p, F.repeat(F.lit(_HIDDEN), F.char_length(p)))))

    def interval(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
        return F.struct(a0.cast("int").alias("a0"), a1.cast("int").alias("a1"), b0.cast("int").alias("b0"), b1.cast("int").alias("b1"))

    def ratio(t: Column) -> Column:
        n, m = F.char_length(t["a"]), F.char_length(t["b"])
        zero = F.lit(0)

        def split(acc: Column, s: Column) -> Column:
            block = _longest_block(*[_part(t[x], s[y + "0"], s[y + "1"] - s[y + "0"]) for x, y in (("a", "a"), ("b", "b"), ("seeds", "b"))])

            def rest(k: Column) -> Column:
                i, j = s["a0"] + k["i"], s["b0"] + k["j"]
                sides = F.array(interval(s["a0"], i, s["b0"], j), interval(i + k["k"], s["a1"], j + k["k"], s["b1"]))
                open_ = F.filter(sides, lambda x: (k["k"] > 0) & (x["a0"] < x["a1"]) & (x["b0"] < x["b1"]))
                return F.struct(F.concat(F.slice(acc["open"], 1, F.size(acc["open"]) - 1), open_).alias("open"), (acc["m"] + k["k"]).alias("m"))

            return _let(block, rest)

        step = lambda acc, _: F.when(F.size(acc["open"]) == 0, acc).otherwise(_let(F.element_at(acc["open"], -1), lambda s: split(acc, s)))
        start = F.struct(F.filter(F.array(interval(zero, n, zero, m)), lambda x: (x["a1"] > 0) & (x["b1"] > 0)).alias("open"), zero.alias("m"))
        return F.aggregate(_upto(2 * F.least(n, m) + 1), start, step, lambda acc: 2.0 * acc["m"] / (n + m))

    texts = F.struct(a.alias("a"), b.alias("b"), hidden(b).alias("seeds"))
    return F.when(a == b, F.lit(1.0)).otherwise(_let(texts, ratio))


def confidence_band(c) -> Column:
    """C9: 'high' (>= 0.8), 'medium' (>= 0.5), 'low' otherwise; NULL stays NULL."""
    c = as_col(c)
    return (
        F.when(c >= BAND_HIGH, F.lit("high"))
        .when(c >= BAND_MEDIUM, F.lit("medium"))
        .when(c.isNotNull(), F.lit("low"))
    )


def contains_ci(c, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(as_col(c)).contains(needle.lower())
