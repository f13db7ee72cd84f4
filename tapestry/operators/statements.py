"""Statements of script text, the versions of their variables, and what
expressions refer to (M4, M8, M10-M12, M15, D14).

A script is cut into statements by bracket depth, not by line starts: a fold over
its lines, where its row lies, says whether a line opens a statement or
continues one, so statements over several lines, in indented blocks and behind
``if x:`` count alike.  Every assignment is a version of its variable, and a name means its
latest version above the place where it stands: definitions and uses of a name
are sorted together by place, and a running ``last`` carries the definition to
the uses (linear in both, however often a name is bound again).

Everything else is window, array and join work keyed by the script, so scripts
are spread over tasks.  NULL texts have no
statements.  In a loop, a use does not see a definition below it.  Text after
an unclosed bracket belongs to the statement that opened it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapestry.functions.names import is_column_name, py_strip
from tapestry.functions.text import _let
from tapestry.operators.calls import LITERAL, by_key, call_arguments, calls_among, masked
from tapestry.operators.scripts import RAW_DICT_NAMES
from tapestry.operators.tokens import NAME, TOKEN, WORD
from tapestry.session import written

# Stand-ins of a line break and a semicolon inside a string.
BREAK, SEMICOLON = "\ue000", "\ue001"
#: Calls whose result still is the table they were called on.
CARRIED = ("filter", "select", "where", "groupBy", "agg", "withColumn", "withColumns", "withColumnRenamed", "drop", "distinct",
           "dropDuplicates", "orderBy", "sort", "alias", "cache", "persist", "repartition", "coalesce")

# ------------------------------------------------------------------ statements
def _shown(text: Column) -> Column:
    """The text with comments blank and the breaks inside strings replaced, so
    that it can be cut wherever the masked text can."""
    chunks = F.regexp_extract_all(text, F.lit(r"(" + LITERAL + r"""|[^"'#]++|[\s\S])"""), 1)
    string = lambda c: (F.length(c) > 1) & (c.startswith('"') | c.startswith("'"))
    show = lambda c: (F.when(string(c), F.translate(c, "\n;", BREAK + SEMICOLON))
                      .when(c.startswith("#"), F.repeat(F.lit(" "), F.length(c))).otherwise(c))
    return F.array_join(F.transform(chunks, show), "")


def _starts(code: Column) -> Column:
    """Where the statements of masked text start, and its end."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("held"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, line: Column) -> Column:
        opens = (acc["depth"] <= 0) & ~acc["held"] & F.rlike(line, F.lit(r"[^\s;]"))
        net = F.length(F.translate(line, ")]}", "")) - F.length(F.translate(line, "([{", ""))
        held = F.rtrim(line, F.lit("\r\n \t")).endswith("\\")
        starts = F.when(opens, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"])
        return F.struct((acc["at"] + F.length(line)).alias("at"), (acc["depth"] + net).alias("depth"), held.alias("held"), starts.alias("starts"))

    return F.aggregate(F.split(code, r"(?<=[\n;])", -1), start, step, lambda acc: F.concat(acc["starts"], F.array(acc["at"])))


def statements(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",)) -> DataFrame:
    """``(keys..., stmt, start, code, text)``: each statement's number, place in
    the text, masked text and text (comments blank), both of one length."""
    keys = list(keys)
    single, several = by_key(df, keys)
    rows = single.select(*keys, masked(F.col(text_col)).alias("_code"), _shown(F.col(text_col)).alias("_text"))
    spans = _let(_starts(F.col("_code")), lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda x, i: F.struct(x.alias("start"), (F.get(at, i + 1) - x).alias("size"))))
    rows = rows.select(*keys, "_code", "_text", F.posexplode_outer(spans).alias("stmt", "_s")).where("_s IS NOT NULL").select(*keys, "_code", "_text", "stmt", "_s.*")
    part = lambda c: F.col(c).substr(F.col("start") + 1, F.col("size"))
    rows = rows.select(*keys, "stmt", "start", part("_code").alias("code"), F.translate(part("_text"), BREAK + SEMICOLON, "\n;").alias("text"))
    return rows if several is None else rows.unionByName(_statements_of_several(several, text_col, keys))


def _statements_of_several(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """``statements`` of rows that share keys, by windows over their lines."""
    cut = r"(?<=[\n;])"
    lines = F.arrays_zip(F.split(masked(F.col(text_col)), cut, -1).alias("code"), F.split(_shown(F.col(text_col)), cut, -1).alias("line"))
    rows = df.select(*keys, F.posexplode(lines).alias("i", "z")).select(*keys, "i", "z.code", "z.line")
    above = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    net = F.length(F.translate("code", ")]}", "")) - F.length(F.translate("code", "([{", ""))
    held = F.rtrim(F.lag("code").over(Window.partitionBy(*keys).orderBy("i")), F.lit("\r\n \t")).endswith("\\")
    rows = rows.select(
        *keys, "i", "code", "line", F.coalesce(F.sum(F.length("code")).over(above), F.lit(0)).cast("int").alias("start"),
        ((F.coalesce(F.sum(net).over(above), F.lit(0)) <= 0) & ~F.coalesce(held, F.lit(False)) & F.rlike("code", F.lit(r"[^\s;]"))).alias("opens"))
    upto = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stmt", (F.count_if("opens").over(upto) - 1).cast("int")).where("stmt >= 0")
    parts = F.array_sort(F.collect_list(F.struct("i", "code", "line")))
    whole = rows.groupBy(*keys, "stmt").agg(F.min("start").alias("start"), parts.alias("parts"))
    join = lambda f: F.array_join(F.transform("parts", lambda p: p[f]), "")
    return whole.select(*keys, "stmt", "start", join("code").alias("code"), F.translate(join("line"), BREAK + SEMICOLON, "\n;").alias("text"))


_TARGET = r"^\s*(?:(?:if|elif|else|for|while|with|try|except|finally)\b[^:]*:\s*)?(" + NAME + r")\s*(?::[^=\n]*)?=(?!=)\s*"


def assignments(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",), cut: DataFrame | None = None) -> DataFrame:
    """``(keys..., stmt, var, version, at, until, code, text)``: every ``name =
    ...`` statement with the masked and plain text of its right side; uses at
    places up to ``until`` see the version before.  ``cut`` are the script's
    ``statements``, if they are at hand."""
    keys = list(keys)
    s = (statements(df, text_col, keys) if cut is None else cut).withColumn("var", F.regexp_extract("code", _TARGET, 1)).where("var <> ''")
    right = F.regexp_replace("code", _TARGET, "")
    s = s.withColumn("until", F.col("start") + F.length("code")).withColumn("right", right)
    s = s.withColumn("at", F.col("until") - F.length("right"))
    version = F.row_number().over(Window.partitionBy(*keys, "var").orderBy("stmt"))
    return s.select(*keys, "stmt", "var", version.alias("version"), "at", "until", F.col("right").alias("code"),
                    F.expr("right(text, length(right))").alias("text"))


def in_force(uses: DataFrame, defs: DataFrame, payload: Sequence[str], keys: Sequence[str] = ("path",), var: str = "var", at: str = "at") -> DataFrame:
    """``uses`` (keys, ``var``, ``at``, ...) with the ``payload`` columns of the
    latest of ``defs`` (keys, var, until, ...) above each; NULL if there is none."""
    keys = list(keys)
    use, found = F.struct(*uses.columns), F.struct(*payload)
    names = [*keys, "_var", "_at", "_def", "_use", "_found"]
    kind = lambda df, s: df.select(s.alias("s")).schema["s"].dataType
    d = defs.select(*keys, "var", "until", F.lit(1), F.lit(None).cast(kind(uses, use)), found).toDF(*names)
    u = uses.select(*keys, var, at, F.lit(0), use, F.lit(None).cast(kind(defs, found))).toDF(*names)
    above = Window.partitionBy(*keys, "_var").orderBy("_at", "_def").rowsBetween(Window.unboundedPreceding, 0)
    both = u.unionByName(d).withColumn("_found", F.last("_found", ignorenulls=True).over(above)).where("_def = 0")
    return both.select("_use.*", *[F.col("_found")[p].alias(p) for p in payload])


# ------------------------------------------------------------------ lists (M4, M7)
_COMPREHENSION = r"(?s)^(.*?)\s+for\s+(" + NAME + r")\s+in\s+(" + NAME + r")\s*$"


def _each(rows: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """``(.., at, item)`` rows whose item is ``expr for v in names``, once for
    each item of the list in force, ``v`` replaced by it; ``sub`` is its number."""
    names = rows.select("*", F.regexp_extract("item", _COMPREHENSION, 3).alias("_names")).where("_names <> ''")
    names = in_force(names, lists, ["items"], keys, var="_names")
    names = names.select("*", F.posexplode("items").alias("sub", "_value"))
    words = F.regexp_extract_all(F.regexp_extract("item", _COMPREHENSION, 1), F.lit(WORD), 0)
    name = F.regexp_extract("item", _COMPREHENSION, 2)
    filled = F.array_join(F.transform(words, lambda w: F.when(w == name, F.col("_value")).otherwise(w)), "")
    return names.withColumn("item", filled).drop("_names", "_value", "items")


def list_versions(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",), assigned: DataFrame | None = None) -> DataFrame:
    """``(keys..., var, version, at, until, items)``: every assignment, with the item
    texts if its right side is a list (or a tuple of several items), else NULL.
    ``[f(c) for c in names]`` holds f of each item of the list ``names``.
    ``assigned`` are the script's ``assignments``, if they are at hand."""
    keys = list(keys)
    a = written(assignments(df, text_col, keys), "assignments") if assigned is None else assigned
    a = a.withColumn("text", F.rtrim("text", F.lit("\r\n \t;")))
    one = [*keys, "stmt"]
    heads = a.where(F.rlike("code", F.lit(r"^[\[(]")))
    spans = call_arguments(heads, "text", one, unnamed=True).where("call = 0")
    spans = spans.groupBy(*one).agg(F.array_sort(F.collect_list(F.struct("arg_no", "a", "b"))).alias("spans"))
    last = F.element_at("spans", -1)["b"]
    found = heads.join(spans, one).where((last == F.length("text") - 1) & (F.col("text").startswith("[") | (F.size("spans") > 1)))
    cut = F.transform("spans", lambda s: py_strip(F.col("text").substr(s["a"] + 1, s["b"] - s["a"])))
    found = found.select(*one, "var", "until", F.filter(cut, lambda x: x != "").alias("items"))
    lists = written(a.select(*one, "var", "version", "at", "until").join(found.select(*one, "items"), one, "left"), "lists")
    made = lists.where(F.size("items") == 1).select(*one, "at", F.get("items", F.lit(0)).alias("item"))
    made = _each(made, lists, keys).groupBy(*one).agg(F.array_sort(F.collect_list(F.struct("sub", "item"))).alias("made"))
    out = lists.join(made, one, "left")
    items = F.coalesce(F.transform("made", lambda m: m["item"]), F.col("items"))
    return out.select(*keys, "var", "version", "at", "until", items.alias("items"))


def expand_items(items: DataFrame, lists: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Arguments ``(keys..., at, item_no, item, ...)`` with ``*names``, ``names``
    and ``*[f(c) for c in names]`` replaced by the items of the list in force at
    that place; ``item_no`` counts on, other arguments stay."""
    keys = list(keys)
    rest = [c for c in items.columns if c not in (*keys, "at", "item_no", "item")]
    named = items.withColumn("_name", F.regexp_extract("item", r"^\s*\*?\s*(" + NAME + r")\s*$", 1))
    inner = F.regexp_extract("item", r"(?s)^\s*\*\s*\[(.*)\]\s*$", 1)
    star = named.withColumn("_inner", inner).withColumn("_made", F.rlike("_inner", F.lit(_COMPREHENSION)))
    plain = in_force(star.where("NOT _made"), lists, ["items"], keys, var="_name")
    one = F.when(F.col("items").isNull(), F.array("item")).otherwise(F.col("items"))
    plain = plain.select(*keys, "at", *rest, F.col("item_no").alias("_no"), F.posexplode(one).alias("_sub", "item"))
    made = _each(star.where("_made").select(*keys, "at", *rest, "item_no", F.col("_inner").alias("item")), lists, keys)
    made = made.select(*keys, "at", *rest, F.col("item_no").alias("_no"), F.col("sub").alias("_sub"), "item")
    order = Window.partitionBy(*keys, "at").orderBy("_no", "_sub")
    return plain.unionByName(made).select(*keys, "at", *rest, (F.row_number().over(order) - 1).alias("item_no"), "item")


# ------------------------------------------------------------------ mapped expressions (M3, M4)
_ALIAS = r"(?s)^(.*?)\s*\.\s*alias\(\s*['\"]([^'\"]+)['\"]\s*\)\s*$"
_ENTRY = r"(?s)^\s*\{?\s*['\"]([^'\"]+)['\"]\s*:\s*(.*?)\s*\}?\s*$"


#: The calls that make target columns.
MAKERS = ("withColumn", "withColumns", "select", "agg")


def expressions(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",), lists: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """Every target column that a script's calls make: ``(keys..., at, item_no,
    call, receiver, direct, target_column, transformation)`` from
    ``withColumn``, ``withColumns``, ``select`` and ``agg`` (column lists
    expanded), in text order.  An item without an alias that is a plain column
    is its own target (``direct``).  ``calls`` are the ``calls_among`` of
    ``MAKERS``, if they are written already."""
    keys = list(keys)
    lists = written(list_versions(df, text_col, keys), "lists") if lists is None else lists
    if calls is None:
        calls = written(calls_among(df, MAKERS, text_col, keys).drop("match_no", "arg1", "arg2"), "calls")  # read by three branches
    calls = calls.withColumnRenamed("call", "at").withColumnRenamed("name", "call")
    head = [*keys, "at", "call", "receiver"]
    quoted = r"^\s*['\"]([^'\"]*)['\"]\s*$"
    mapped = F.lit(False).alias("direct")
    one = calls.where("call = 'withColumn' AND n_args > 1").select(
        *head, F.lit(0).alias("item_no"), mapped, F.regexp_extract("arg0", quoted, 1).alias("target_column"), F.col("rest").alias("e"))
    many = calls.where("call = 'withColumns'").select(*head, F.posexplode("args").alias("item_no", "item")).select(
        *head, "item_no", mapped, F.regexp_extract("item", _ENTRY, 1).alias("target_column"), F.regexp_extract("item", _ENTRY, 2).alias("e"))
    items = calls.where("call IN ('select', 'agg')").select(*head, F.posexplode("args").alias("item_no", "item"))
    items = expand_items(items, lists, keys)
    alias = F.regexp_extract("item", _ALIAS, 2)
    bare = F.regexp_extract("item", r"^\s*(?:(?:\w+\s*\.\s*)?col\(\s*)?['\"]([^'\"]+)['\"]\s*\)?\s*$", 1)
    path = F.regexp_extract("item", r"^\s*\w+\s*(?:\.\s*|\[\s*['\"])(\w+)(?:['\"]\s*\])?\s*$", 1)
    target = F.when(alias != "", alias).when(bare != "", bare).otherwise(path)
    items = items.select(*head, "item_no", (alias == "").alias("direct"), target.alias("target_column"), F.when(alias != "", F.regexp_extract("item", _ALIAS, 1)).otherwise(F.col("item")).alias("e"))
    out = one.unionByName(many).unionByName(items).where("target_column <> ''")
    return out.select(*keys, "at", "item_no", "call", "receiver", "direct", "target_column", F.regexp_replace(py_strip(F.col("e")), r"\s*\n\s*", " ").alias("transformation"))


# ------------------------------------------------------------------ references
def references(df: DataFrame, expr_col: str = "transformation", keys: Sequence[str] = ("path",)) -> DataFrame:
    """``(keys..., ref_no, var, column)``: the columns that an expression names:
    ``col("x")`` (var ''), ``df["x"]`` and ``df.x``, nested fields as ``x.y``.
    Methods (``df.x.cast(..)``), attributes of a call's result, strings and
    comments name no column.  ``keys`` must tell the rows apart."""
    tokens = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(expr_col), F.lit(TOKEN), 0)).alias("ref_no", "token"))
    column = F.regexp_extract("token", r"^(?:\w+\s*\.\s*)?col\(\s*['\"]([^'\"]*)['\"]\s*\)$", 1)
    dotted = F.regexp_replace(F.regexp_replace("token", r"\s*\[\s*['\"]([^'\"]*)['\"]\s*\]", ".$1"), r"\s*\.\s*", ".")
    path = F.rlike("token", F.lit(r"(?s)^[A-Za-z_]\w*\s*[.\[].*[\w\]]$"))
    out = tokens.select(
        *keys, "ref_no", F.when(column != "", F.lit("")).otherwise(F.regexp_extract(dotted, r"^(\w+)\.", 1)).alias("var"),
        F.when(column != "", column).when(path, F.regexp_replace(dotted, r"^\w+\.", "")).alias("column"))
    return out.where(F.col("column").isNotNull() & is_column_name(F.replace("column", F.lit("."), F.lit("_"))))


def imported_names(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",), cut: DataFrame | None = None) -> DataFrame:
    """``(keys..., var)``: the names that a script imports (modules, no data).
    ``cut`` are the script's ``statements``, if they are at hand."""
    rows = (statements(df, text_col, keys) if cut is None else cut).select(*keys, F.regexp_extract("code", r"(?s)^\s*(?:from\s+[\w.]+\s+)?import\s+\(?(.*?)\)?\s*$", 1).alias("names"))
    names = rows.select(*keys, F.explode(F.split("names", ",")).alias("name"))
    return names.select(*keys, F.regexp_extract("name", r"(\w+)\s*$", 1).alias("var")).where("var <> ''").distinct()


# ------------------------------------------------------------------ fields
def field_tree(df: DataFrame, expr_col: str = "transformation", keys: Sequence[str] = ("path",)) -> DataFrame:
    """``(keys..., field_no, path, parent, alias, depth, transformation)``: the
    aliased arguments inside an expression at any depth (fields of structs in
    arrays, aggregates and structs), each under the aliased argument that holds
    it; a field's transformation is its text before the alias.  Fields of one
    expression are compared with each other (its size, squared).  ``keys`` must
    tell the rows apart."""
    keys = list(keys)
    spans = call_arguments(df, expr_col, keys, unnamed=True).select(*keys, "a", "b")
    text = F.col("_text")
    args = spans.join(df.select(*keys, F.col(expr_col).alias("_text")), keys)
    args = args.select(*keys, "a", "b", text.substr(F.col("a") + 1, F.col("b") - F.col("a")).alias("arg"))
    loop = r"(?s)\s+for\s+\w+\s+in\s+.*$"
    args = args.withColumn("arg", F.when(F.rlike(F.regexp_replace("arg", loop, ""), F.lit(_ALIAS)), F.regexp_replace("arg", loop, "")).otherwise(F.col("arg")))
    fields = args.withColumn("alias", F.regexp_extract("arg", _ALIAS, 2)).where("alias <> ''")
    fields = fields.withColumn("e", F.regexp_replace(py_strip(F.regexp_extract("arg", _ALIAS, 1)), r"\s*\n\s*", " "))
    held = fields.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", "b", "alias", "e"))).alias("all"))
    holds = lambda x: F.filter("all", lambda y: (y["a"] <= x["a"]) & (y["b"] >= x["b"]) & ((y["a"] < x["a"]) | (y["b"] > x["b"])))
    tree = held.select(*keys, F.posexplode(F.transform("all", lambda x: F.struct(
        x["alias"].alias("alias"), x["e"].alias("e"), F.transform(holds(x), lambda y: y["alias"]).alias("up")))).alias("field_no", "f"))
    return tree.select(
        *keys, "field_no", F.concat_ws(".", "f.up", F.array("f.alias")).alias("path"), F.concat_ws(".", "f.up").alias("parent"),
        F.col("f.alias").alias("alias"), (F.size("f.up") + 1).alias("depth"), F.col("f.e").alias("transformation"))


# ------------------------------------------------------------------ versioned lineage
_TABLE = r"^[(\s]*[\w.]*\btable\(\s*['\"]([^'\"]+)['\"]"
_SUBSCRIPT = r"^[(\s]*(\w+)\s*\[\s*['\"]([^'\"]+)['\"]\s*\]"
_BASE = r"^[(\s]*(" + NAME + r")\s*(?:\.|[)\s;]*$)"
_LOADED = r"^\w+\([^,()]*,[^,()]*,\s*(\w+)\s*\)"
_JOINED = r"\.\s*join\(\s*\(*\s*(" + NAME + r")\s*[.,)\[]"
_NODE = "struct<kind:string,name:string,version:int>"


def version_sources(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",), assigned: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """``(keys..., var, version, until, source_no, source, carried)``: what each
    assignment is made of, as nodes ``(kind, name, version)``:

    * ``.table("t")`` and ``d["t"]``: table t, version 0;
    * ``f(spark, schema, names)``: the tables of the list ``names`` in force;
    * the variable at the head of the chain (or alone) and the right side of
      every join: its latest version above, or (name, version 0) if it has none.

    ``carried`` marks the head of a chain whose first call keeps the table.
    ``assigned`` and ``lists`` are the script's ``assignments`` and
    ``list_versions``, if they are at hand."""
    keys = list(keys)
    a = assigned = written(assignments(df, text_col, keys), "assignments") if assigned is None else assigned
    node = lambda kind, name, version=0: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit(version).alias("version"))
    none = F.array().cast("array<string>")
    table = F.regexp_extract("text", _TABLE, 1)
    sub = F.regexp_extract("text", _SUBSCRIPT, 2)
    direct = F.when(table != "", table).when(sub != "", sub)
    base = F.regexp_extract("code", _BASE, 1)
    keeps = F.rlike("code", F.lit(r"^[(\s]*\w+\s*(?:[)\s;]*$|\.\s*(?:" + "|".join(CARRIED) + r")\()"))
    names = F.concat(F.when(base.isin("", "None", "True", "False") | direct.isNotNull(), none).otherwise(F.array(base)),
                     F.when(table != "", none).otherwise(F.regexp_extract_all("code", F.lit(_JOINED), 1)))
    a = a.select(*keys, "var", "version", "at", "until", direct.alias("direct"), F.regexp_extract("code", _LOADED, 1).alias("listed"),
                 names.alias("names"), (direct.isNull() & (base != "") & keeps).alias("keeps"))
    head = [*keys, "var", "version", "until"]
    direct_rows = a.where("direct IS NOT NULL").select(*head, F.lit(0).alias("source_no"), node("table", F.col("direct")).alias("source"), F.lit(True).alias("carried"))
    lists = list_versions(df, text_col, keys, assigned) if lists is None else lists
    listed = in_force(a.where("listed <> ''").select(*head, "at", "listed"), lists, ["items"], keys, var="listed")
    quoted = F.filter("items", lambda x: F.rlike(x, F.lit(r"^['\"].*['\"]$")))
    listed = listed.select(*head, F.posexplode(quoted).alias("source_no", "item"))
    listed = listed.select(*head, "source_no", node("table", F.expr("substr(item, 2, length(item) - 2)")).alias("source"), (F.col("source_no") == 0).alias("carried"))
    uses = a.select(*head, "at", "keeps", F.posexplode("names").alias("source_no", "name"))
    defs = a.select(*keys, "var", "until", F.col("version").alias("source_version"))
    uses = in_force(uses, defs, ["source_version"], keys, var="name")
    source = F.struct(F.when(F.col("source_version").isNull(), "name").otherwise("var").alias("kind"), F.col("name"), F.coalesce("source_version", F.lit(0)).alias("version"))
    uses = uses.select(*head, "source_no", source.alias("source"), (F.col("keeps") & (F.col("source_no") == 0)).alias("carried"))
    return direct_rows.unionByName(listed).unionByName(uses).withColumn("source", F.col("source").cast(_NODE))


def lineage_versions(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",), raw_dicts: Sequence[str] = RAW_DICT_NAMES) -> DataFrame:
    """M11 by versions: distinct edges ``(keys..., target, source)`` between
    nodes ``(kind, name, version)``; kinds are 'var', 'table', and 'name' for a
    name that the script never binds above.  The closures of ``lineage`` run
    over these nodes, so two histories of one name stay apart."""
    rows = version_sources(df, text_col, keys).where(~(F.col("source.kind") == "name") | ~F.col("source.name").isin(*raw_dicts))
    target = F.struct(F.lit("var").alias("kind"), F.col("var").alias("name"), F.col("version")).cast(_NODE)
    return rows.select(*keys, target.alias("target"), "source").distinct()


def table_versions(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",), assigned: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """M8 by versions: ``(keys..., var, version, until, table_name)``: the table of
    every assignment, NULL where its chain ends at none.  A version has one
    parent at most (the head of its chain), and chains are shortened by pointer
    doubling, so their length does not matter."""
    keys = list(keys)
    src = written(version_sources(df, text_col, keys, assigned, lists), "sources")
    up = src.where("carried").select(*keys, "var", "version", F.col("source").alias("up"))
    all_ = src.select(*keys, "var", "version", "until").distinct()
    rows = all_.join(up, [*keys, "var", "version"], "left")
    table = F.when(F.col("up.kind") == "table", F.col("up.name"))
    step = F.when(F.col("up.kind") == "var", F.struct(F.col("up.name").alias("name"), F.col("up.version").alias("version")))
    rows = written(rows.select(*keys, "var", "version", "until", table.alias("table_name"), step.alias("up")), "versions")
    while rows.where("up IS NOT NULL").limit(1).count():
        far = rows.select(*keys, F.struct(F.col("var").alias("name"), F.col("version")).alias("up"), F.col("table_name").alias("far"), F.col("up").alias("next"))
        rows = written(rows.join(far, [*keys, "up"], "left").select(
            *keys, "var", "version", "until", F.coalesce("table_name", "far").alias("table_name"), F.col("next").alias("up")), "versions")
    return rows.drop("up")


def bind_references(refs: DataFrame, versions: DataFrame, keys: Sequence[str] = ("path",), default_var: str = "receiver", at: str = "at") -> DataFrame:
    """References with the table of their variable in force at their place
    (``col("x")`` belongs to ``default_var``): ``table_name``, or the variable
    itself where it has no table."""
    named = refs.withColumn("_of", F.when(F.col("var") == "", F.col(default_var)).otherwise(F.col("var")))
    bound = in_force(named, versions, ["table_name"], keys, var="_of", at=at)
    return bound.withColumn("table_name", F.coalesce("table_name", F.nullif(F.col("_of"), F.lit("")))).drop("_of")
