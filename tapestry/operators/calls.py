"""Calls and their arguments in script text, at any nesting.

A script's string literals and comments are masked by text of the same length,
so only code is left.  The parentheses, brackets and commas of the masked text
have a depth, a running sum.  The delimiters of one call -- its opening, its top-level commas
and its closing -- are the consecutive delimiters of one depth, so each argument
ends where the next delimiter of that depth starts.  Nothing limits depth, chain
length or the number of calls.

A script is one row: a fold over its delimiters finds their depth, a sort of the
array brings those of one depth together, and only calls leave the row; one
shuffle deals the scripts to tasks.  Rows that share a key are one script of
interleaved pieces; they take the window form below.

Unbalanced text yields the calls that are closed.  NULL texts yield none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapestry.functions.text import _let, _upto

LITERAL = (r'"""[\s\S]*?"""' + r"|'''[\s\S]*?'''" + r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' + r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'" + r"|#[^\n]*")


def masked(text: Column) -> Column:
    """The text with string contents as ``_`` and comments as blanks, every
    character in its place."""
    chunks = F.regexp_extract_all(text, F.lit(r"(" + LITERAL + r"""|[^"'#]++|[\s\S])"""), 1)

    def hide(c: Column) -> Column:
        n = F.length(c)
        string = (n > 1) & (c.startswith('"') | c.startswith("'"))
        return (F.when(string, F.concat(F.substring(c, 1, 1), F.repeat(F.lit("_"), n - 2), F.substring(c, 1, 1)))
                .when(c.startswith("#"), F.repeat(F.lit(" "), n)).otherwise(c))

    return F.array_join(F.transform(chunks, hide), "")


#: The text before a delimiter, and the delimiter.
_CUT = r"([^()\[\],]*+)([()\[\],])"
_SIGN = "struct<level:int,at:int,sign:string,name:string,receiver:string>"
_CALL = "struct<call:int,name:string,receiver:string,spans:array<struct<arg_no:int,a:int,b:int>>>"


def _signs(code: Column) -> Column:
    """The delimiters of masked text by depth, then place: (level, at, sign, name,
    receiver), the last two of what stands before an opening; the receiver is
    NULL in a chain."""
    pairs = F.arrays_zip(*[F.regexp_extract_all(code, F.lit(_CUT), g).alias(n) for g, n in ((1, "before"), (2, "sign"))])
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.array().cast(f"array<{_SIGN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        opens, closes = x["sign"].isin("(", "["), x["sign"].isin(")", "]")
        at = acc["at"] + F.length(x["before"])
        name = F.when(x["sign"] == "(", F.regexp_extract(x["before"], r"(\w+)\s*$", 1)).otherwise("")
        chained = F.rlike(x["before"], F.lit(r"^\s*\.\s*\w+\s*$"))
        head = F.when(opens & ~chained, F.regexp_extract(x["before"], r"(\w+)\s*\.\s*\w+\s*$", 1))
        sign = F.struct((acc["depth"] + opens.cast("int")).alias("level"), at.alias("at"), x["sign"].alias("sign"), F.when(opens, name).alias("name"), head.alias("receiver"))
        return F.struct((at + 1).alias("at"), (acc["depth"] + opens.cast("int") - closes.cast("int")).alias("depth"), F.concat(acc["out"], F.array(sign.cast(_SIGN))).alias("out"))

    return F.array_sort(F.aggregate(pairs, start, step, lambda acc: acc["out"]))


def calls_in(code: Column, names: Sequence[str] | None = None, unnamed: bool = False) -> Column:
    """The calls in masked text: (call, name, receiver, spans of the arguments).
    ``names``: only these; ``unnamed``: also brackets and parentheses without a
    name, and what commas part outside of them (call NULL)."""

    def found(signs: Column) -> Column:
        n = F.size(signs)
        level = lambda k: F.get(signs, k)["level"]
        heads = F.filter(_upto(n), lambda k: (k == 0) | F.get(signs, k)["sign"].isin("(", "[") | (level(k) != F.coalesce(level(k - 1), F.lit(0))))
        ends = lambda hs: F.transform(hs, lambda h, j: F.struct(h.alias("k"), F.coalesce(F.get(hs, j + 1), n).alias("end")))

        def spans(h: Column) -> Column:
            own = F.filter(F.sequence(h["k"], h["end"] - 1), lambda k: ~F.get(signs, k)["sign"].isin(")", "]") & (level(k + 1) == level(k)))
            return F.transform(own, lambda k: F.struct((k - h["k"]).alias("arg_no"), (F.get(signs, k)["at"] + 1).alias("a"), F.get(signs, k + 1)["at"].alias("b")))

        def step(acc: Column, h: Column) -> Column:
            def put(x: Column) -> Column:
                receiver = F.coalesce(x["receiver"], F.when(acc["level"] == x["level"], acc["receiver"]), F.lit(""))
                wanted = F.lit(True) if unnamed else F.coalesce(x["name"] != "" if names is None else x["name"].isin(*names), F.lit(False))
                call = F.struct(F.when(x["name"].isNotNull(), x["at"]).alias("call"), F.coalesce(x["name"], F.lit("")).alias("name"), receiver.alias("receiver"), spans(h).alias("spans"))
                out = F.when(wanted, F.concat(acc["out"], F.array(call.cast(_CALL)))).otherwise(acc["out"])
                return F.struct(x["level"].alias("level"), receiver.alias("receiver"), out.alias("out"))

            return _let(F.get(signs, h["k"]), put)

        start = F.struct(F.lit(None).cast("int").alias("level"), F.lit("").alias("receiver"), F.array().cast(f"array<{_CALL}>").alias("out"))
        return F.aggregate(_let(heads, ends), start, step, lambda acc: F.filter(acc["out"], lambda c: F.size(c["spans"]) > 0))

    return _let(_signs(code), found)


def by_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key no other row has, dealt to the tasks by their keys (many
    scripts come from few small files), and the others (None if there are none);
    NULL equals NULL."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a set number is not merged to fewer
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if not counts.limit(1).count():
        return df.repartition(tasks, *keys), None
    again = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [df[k].eqNullSafe(again[f"_k{i}"]) for i, k in enumerate(keys)]
    return df.join(again, same, "left_anti").repartition(tasks, *keys), df.join(again, same, "left_semi")


def call_arguments(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",), unnamed: bool = False) -> DataFrame:
    """One row per argument: ``(keys..., call, name, receiver, arg_no, a, b)``:
    the call's place in the text, the name before its parenthesis, the variable
    at the head of its chain ('' if there is none) and the argument's span.
    ``unnamed``: also the items of brackets and of parentheses without a name."""
    keys = list(keys)
    single, several = by_key(df, keys)
    rows = single.select(*keys, F.explode_outer(calls_in(masked(F.col(text_col)), unnamed=unnamed)).alias("_c")).where("_c IS NOT NULL")
    rows = rows.select(*keys, "_c.call", "_c.name", "_c.receiver", F.explode("_c.spans").alias("_s")).select(*keys, "call", "name", "receiver", "_s.*")
    return rows if several is None else rows.unionByName(_arguments_of_several(several, text_col, keys, unnamed))


def _arguments_of_several(df: DataFrame, text_col: str, keys: list[str], unnamed: bool) -> DataFrame:
    """``call_arguments`` of rows that share keys, by windows over their pieces."""
    pieces = df.select(*keys, F.posexplode(F.split(masked(F.col(text_col)), r"(?<=[()\[\],])|(?=[()\[\],])", -1)).alias("i", "piece"))
    along = Window.partitionBy(*keys).orderBy("i")
    opens, closes = F.col("piece").isin("(", "["), F.col("piece").isin(")", "]")
    pieces = pieces.select(
        *keys, "i", "piece", (F.sum(F.length("piece")).over(along) - F.length("piece")).cast("int").alias("start"),
        F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(along).alias("depth"), F.lag("piece").over(along).alias("before"),
    )
    cuts = pieces.where(opens | closes | (F.col("piece") == ",")).withColumn("level", F.col("depth") + closes.cast("int"))
    level = Window.partitionBy(*keys, "level").orderBy("i")
    before = F.coalesce("before", F.lit(""))
    chained = F.rlike(before, F.lit(r"^\s*\.\s*\w+\s*$"))
    cuts = cuts.select(
        *keys, "level", "i", "start", closes.alias("closing"), F.lead("start").over(level).alias("b"),
        F.last(F.when(opens, F.col("start")), ignorenulls=True).over(level).alias("call"),
        F.last(F.when(opens, F.when(F.col("piece") == "(", F.regexp_extract(before, r"(\w+)\s*$", 1)).otherwise("")), ignorenulls=True).over(level).alias("name"),
        F.last(F.when(opens & ~chained, F.regexp_extract(before, r"(\w+)\s*\.\s*\w+\s*$", 1)), ignorenulls=True).over(level).alias("receiver"),
    )
    number = F.row_number().over(Window.partitionBy(*keys, "level", "call").orderBy("i")) - 1
    rows = cuts.select(*keys, "call", "name", F.coalesce("receiver", F.lit("")).alias("receiver"), number.alias("arg_no"), (F.col("start") + 1).alias("a"), "b", "closing")
    rows = rows.where("NOT closing AND b IS NOT NULL").drop("closing")
    return rows if unnamed else rows.where("name <> ''")


def calls_of(df: DataFrame, name: str, text_col: str = "text", keys: Sequence[str] = ("path",)) -> DataFrame:
    """The calls of one name in text order: ``(keys..., call, match_no, receiver,
    n_args, arg0, arg1, arg2, args, rest)`` with the first three arguments'
    texts, all arguments, and everything from the second argument on."""
    return calls_among(df, [name], text_col, keys).drop("name")


def calls_among(df: DataFrame, names: Sequence[str], text_col: str = "text", keys: Sequence[str] = ("path",)) -> DataFrame:
    """``calls_of`` several names in one pass, with ``name``; ``match_no`` counts
    the calls of a name."""
    keys = list(keys)
    single, several = by_key(df, keys)
    for k in keys:
        single = single.where(F.col(k).isNotNull())
    # a call's number is its place among those of its name
    of = lambda cs, n: F.array_sort(F.filter(cs, lambda c: c["name"] == n))
    number = lambda c, j: F.struct(c["name"].alias("name"), c["call"].alias("call"), j.alias("match_no"), c["receiver"].alias("receiver"), c["spans"].alias("spans"))
    calls = _let(calls_in(masked(F.col(text_col)), list(names)), lambda cs: F.concat(*[F.transform(of(cs, n), number) for n in names]))
    # explode would repeat the whole expression in a filter of its own
    found = single.select(*keys, F.col(text_col).alias("_text"), F.explode_outer(calls).alias("_c")).where("_c IS NOT NULL").select(*keys, "_text", "_c.*")
    if several is not None:
        found = found.unionByName(_calls_of_several(several, names, text_col, keys))
    text = F.col("_text")
    args = F.transform("spans", lambda s: text.substr(s["a"] + 1, s["b"] - s["a"]))
    last = F.element_at("spans", -1)["b"]
    rest = F.when(F.size("spans") > 1, text.substr(F.get("spans", F.lit(1))["a"] + 1, last - F.get("spans", F.lit(1))["a"])).otherwise("")
    return found.select(*keys, "name", "call", "match_no", "receiver", F.size("spans").alias("n_args"), args.alias("args"), rest.alias("rest")).select(
        *keys, "name", "call", "match_no", "receiver", "n_args", *[F.get("args", F.lit(k)).alias(f"arg{k}") for k in range(3)], "args", "rest")


def _calls_of_several(df: DataFrame, names: Sequence[str], text_col: str, keys: list[str]) -> DataFrame:
    """The calls of rows that share keys, each with the texts of its key."""
    spans = _arguments_of_several(df, text_col, keys, False).where(F.col("name").isin(*names))
    spans = spans.groupBy(*keys, "name", "call", "receiver").agg(F.array_sort(F.collect_list(F.struct("arg_no", "a", "b"))).alias("spans"))
    match_no = (F.row_number().over(Window.partitionBy(*keys, "name").orderBy("call")) - 1).alias("match_no")
    spans = spans.select(*keys, "name", "call", match_no, "receiver", "spans")
    return spans.join(df.select(*keys, F.col(text_col).alias("_text")), keys)
