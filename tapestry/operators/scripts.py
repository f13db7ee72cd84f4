"""Mapping extraction from a corpus of transformation scripts (M1-M10,
M13-M15).

Input is a DataFrame ``scripts(path, text)`` — one whole file per row (see
``sources.catalog.read_scripts``).  Everything here is per-row string/array
work (``split``, ``regexp_extract_all``, higher-order functions, ``explode``):
a corpus of any size is processed map-side, one file per task slot, with no
shuffle and nothing collected.  Relational resolution (variable -> table,
rules per column, lineage closure) is done with joins and aggregates.

Regular expressions cannot balance parentheses: calls are cut by
``calls.calls_of`` at any nesting.  ``statements`` cuts scripts into statements
and tells the versions of a variable apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapestry.functions.names import PY_WHITESPACE_CHARS, is_column_name, py_strip
from tapestry.operators.calls import calls_among, calls_of
from tapestry.operators.tokens import rename_heads
from tapestry.session import written

# --- fixed values -----------------------------------------------------------
CELL_SEPARATOR = "# COMMAND ----------"
MAGIC_PREFIX = "# MAGIC"
MAGIC_SQL = "# MAGIC %sql"
MAGIC_MD = "# MAGIC %md"
# name -> (pattern, capture groups, flags)
CODE_PATTERNS = {
    "column_mapping": (r"""\.withColumn\(['"](.*?)['"], ?(.*?)\)""", (1, 2), "i"),
    "select_mapping": (r"\.select\((.*?)\)", (1,), "i"),
    "when_mapping": (r"\.when\((.*?), ?(.*?)\)", (1, 2), "i"),
    "coalesce_mapping": (r"coalesce\((.*?)\)", (1,), "i"),
    "lit_mapping": (r"""lit\(['"](.*?)['"]""", (1,), "i"),
    "col_mapping": (r"""col\(['"](.*?)['"]""", (1,), "i"),
    "sql_select": (r"SELECT\s+(.*?)\s+FROM", (1,), "is"),
    "sql_case": (r"CASE\s+WHEN\s+(.*?)\s+THEN\s+(.*?)\s+END", (1, 2), "is"),
}
PYSPARK_PATTERNS = ("column_mapping", "select_mapping")
SQL_PATTERNS = ("sql_select", "sql_case")
RAW_DICT_NAMES = ("dm_df",)
DEFAULT_JOIN_TYPE = "inner"
# ---------------------------------------------------------------------------

_Q = "['\"]"
_NQ = "[^'\"]"


def _with_flags(pattern: str, flags: str) -> str:
    return f"(?{flags}){pattern}" if flags else pattern


_WS = PY_WHITESPACE_CHARS


def _starts(c: Column, prefix: str) -> Column:
    """``c.strip().startswith(prefix)`` for a prefix that starts with a
    non-space: trimming the leading whitespace set is enough (no regex, no
    scan of the rest of the line)."""
    return F.ltrim(c, F.lit(_WS)).startswith(prefix)


# ------------------------------------------------------------------------ M1
def split_lines(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",)) -> DataFrame:
    """Whole text -> one row per line ``(keys..., line_no, line)`` (0-based)."""
    return df.select(*keys, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))


def split_cells(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",)) -> DataFrame:
    """M1: notebook text -> typed cells ``(keys..., cell_no, cell_type, text)``.

    Lines whose stripped form starts with the separator split cells.  A cell
    that holds a ``# MAGIC %sql`` marker is 'sql', one with ``# MAGIC %md`` is
    'markdown', anything else 'pyspark' (the type belongs to the cell).  Marker
    lines are dropped; other ``# MAGIC`` lines lose the prefix and are kept
    when something is left; plain lines are kept as they are.  Cells without
    lines are dropped.  Computed within each row: no shuffle.
    """
    # The line array and the cell bounds are materialised as columns first: a
    # lambda that referenced ``split(text)`` itself would re-split the text
    # for every element it visits.
    staged = df.select(*keys, F.split(F.col(text_col), "\n", -1).alias("__lines"))
    lines = F.col("__lines")
    n = F.size(lines)
    seps = F.filter(F.sequence(F.lit(0), n - 1), lambda i: _starts(F.element_at(lines, i + 1), CELL_SEPARATOR))
    staged = staged.select(*keys, "__lines", F.concat(F.array(F.lit(-1)), seps, F.array(n)).alias("__bounds"))
    bounds = F.col("__bounds")
    cells = F.transform(
        F.sequence(F.lit(0), F.size(bounds) - 2),
        lambda k: F.slice(lines, F.element_at(bounds, k + 1) + 2, F.element_at(bounds, k + 2) - F.element_at(bounds, k + 1) - 1),
    )
    out = staged.select(*keys, F.posexplode(cells).alias("cell_no", "cell_lines")).filter(F.size("cell_lines") > 0)

    def kept(line):
        marker = _starts(line, MAGIC_SQL) | _starts(line, MAGIC_MD)
        magic = py_strip(F.replace(line, F.lit(MAGIC_PREFIX), F.lit("")))
        return F.when(marker, F.lit(None)).when(_starts(line, MAGIC_PREFIX), F.nullif(magic, F.lit(""))).otherwise(line)

    cl = F.col("cell_lines")
    typ = (
        F.when(F.exists(cl, lambda x: _starts(x, MAGIC_SQL)), F.lit("sql"))
        .when(F.exists(cl, lambda x: _starts(x, MAGIC_MD)), F.lit("markdown"))
        .otherwise(F.lit("pyspark"))
    )
    body = F.filter(F.transform(cl, kept), lambda x: x.isNotNull())
    return (
        out.select(*keys, "cell_no", typ.alias("cell_type"), body.alias("body"))
        .filter(F.size("body") > 0)
        .select(*keys, "cell_no", "cell_type", F.array_join("body", "\n").alias("text"))
    )


# ------------------------------------------------------------------------ M2-M6
def _match_row(name: str, two_groups: bool):
    def row(x, i):
        second = x["g2"] if two_groups else F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("pattern"), i.alias("match_no"), x["g1"].alias("g1"), second.alias("g2"))

    return row


def extract_patterns(
    df: DataFrame,
    catalog: Mapping[str, tuple[str, Sequence[int], str]] = CODE_PATTERNS,
    text_col: str = "text",
    keys: Sequence[str] = ("path",),
    where: Mapping[str, Column] | None = None,
) -> DataFrame:
    """M2: every match of every named pattern -> one row ``(keys..., pattern,
    match_no, g1, g2)`` (g2 NULL for one-group patterns).  One
    ``regexp_extract_all`` per (pattern, group), zipped per pattern,
    concatenated and exploded once — no cross join.  ``where``: patterns looked
    for in the rows of a condition only."""
    text, where = F.col(text_col), where or {}
    none = F.array().cast("array<struct<pattern:string,match_no:int,g1:string,g2:string>>")
    per_pattern = []
    for name, (pattern, groups, flags) in catalog.items():
        rx = _with_flags(pattern, flags)
        arrs = [F.regexp_extract_all(text, F.lit(rx), g).alias(f"g{j + 1}") for j, g in enumerate(groups)]
        # zip first so each group's matches are extracted once, not once per element
        matches = F.transform(F.arrays_zip(*arrs), _match_row(name, len(arrs) > 1))
        per_pattern.append(F.when(where[name], matches).otherwise(none) if name in where else matches)
    return df.select(*keys, F.explode(F.concat(*per_pattern)).alias("m")).select(*keys, "m.*")


def code_patterns(cells: DataFrame, keys: Sequence[str] = ("path", "cell_no")) -> DataFrame:
    """M2-M5 as the extraction path uses them: pyspark patterns on pyspark
    cells, SQL patterns on sql cells; raw rows ``(keys..., type,
    target_column, transformation, condition, result, source_line)``."""
    of = dict.fromkeys(PYSPARK_PATTERNS, "pyspark") | dict.fromkeys(SQL_PATTERNS, "sql")
    where = {k: F.col("cell_type") == t for k, t in of.items()}
    m = extract_patterns(cells.where(F.col("cell_type").isin("pyspark", "sql")), {k: CODE_PATTERNS[k] for k in of}, keys=keys, where=where)
    p = F.col("pattern")
    g1, g2 = py_strip(F.col("g1")), py_strip(F.col("g2"))
    typ = (F.when(p == "column_mapping", "column_transformation").when(p == "select_mapping", "select_transformation")
           .otherwise(p))
    return m.select(
        *keys, "match_no", typ.alias("type"),
        F.when(p == "column_mapping", g1).alias("target_column"),
        F.when(p == "column_mapping", g2).when(p != "sql_case", g1).alias("transformation"),
        F.when(p == "sql_case", g1).alias("condition"),
        F.when(p == "sql_case", g2).alias("result"),
    )


def extract_with_column(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",), calls: DataFrame | None = None) -> DataFrame:
    """M3: ``df.withColumn("target", expr)`` and each entry of
    ``df.withColumns({"target": expr, ...})`` -> (match_no, receiver,
    target_column, transformation), at any nesting.  ``receiver`` is the
    variable at the head of the call's chain ('' if there is none).  ``calls`` are
    the ``calls_among`` of these names (and others), if they are at hand."""
    keys = list(keys)
    calls = calls_among(df, ["withColumn", "withColumns"], text_col, keys) if calls is None else calls
    calls = calls.where("name = 'withColumns' OR name = 'withColumn' AND n_args > 1")
    item = r"(?s)^\s*\{?\s*" + _Q + "(" + _NQ + "+)" + _Q + r"\s*:\s*(.*?)\s*\}?\s*$"
    entry = lambda target, e: F.struct(target.alias("target_column"), e.alias("e"))
    one = entry(F.regexp_extract("arg0", r"^\s*" + _Q + "(" + _NQ + "*)" + _Q + r"\s*$", 1), F.col("rest"))
    many = F.transform("args", lambda x: entry(F.regexp_extract(x, item, 1), F.regexp_extract(x, item, 2)))
    entries = F.when(F.col("name") == "withColumn", F.array(one)).otherwise(many)
    out = calls.select(*keys, "call", "receiver", F.posexplode(entries).alias("entry", "m")).select(*keys, "call", "entry", "receiver", "m.*")
    out = out.where("target_column <> ''")
    order = Window.partitionBy(*keys).orderBy("call", "entry")
    return out.select(*keys, (F.row_number().over(order) - 1).alias("match_no"), "receiver", "target_column",
                      F.regexp_replace(py_strip(F.col("e")), r"\s*\n\s*", "").alias("transformation"))


def extract_select(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",)) -> DataFrame:
    """M4: ``.select(a, b, ...)`` -> one row per select call with its items."""
    calls = calls_of(df, "select", text_col, keys)
    return calls.select(*keys, "match_no", F.regexp_replace(py_strip(F.array_join("args", ",")), r"\s*\n\s*", " ").alias("transformation"))


def extract_aliased(df: DataFrame, name: str = "select", text_col: str = "text", keys: Sequence[str] = ("path",)) -> DataFrame:
    """M4: the aliased items of ``.select(expr.alias("t"), ...)`` (or, with
    ``name="agg"``, of ``groupBy(...).agg(expr.alias("t"), ...)``) ->
    (match_no, item_no, receiver, target_column, transformation)."""
    alias = r"(?s)^(.*?)\s*\.\s*alias\(\s*" + _Q + "(" + _NQ + "+)" + _Q + r"\s*\)\s*$"
    items = calls_of(df, name, text_col, keys).select(*keys, "match_no", "receiver", F.posexplode("args").alias("item_no", "item"))
    return items.select(
        *keys, "match_no", "item_no", "receiver", F.regexp_extract("item", alias, 2).alias("target_column"),
        F.regexp_replace(py_strip(F.regexp_extract("item", alias, 1)), r"\s*\n\s*", "").alias("transformation"),
    ).where("target_column <> ''")


def extract_when(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",)) -> DataFrame:
    """M6: ``when(condition, value)`` calls -> (condition, result)."""
    calls = calls_of(df, "when", text_col, keys).where("n_args = 2")
    condition, result = py_strip(F.col("arg0")), py_strip(F.col("arg1"))
    return calls.select(*keys, "match_no", condition.alias("condition"), result.alias("result"),
                        F.concat(F.lit("when("), condition, F.lit(", "), result, F.lit(")")).alias("transformation"))


# ------------------------------------------------------------------------ M7, M8, M13
def extract_table_lists(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",)) -> DataFrame:
    """M7: ``name = ['t1', 't2', ...]`` -> (list_name, position, table_name);
    only quoted string items count."""
    rx = r"(?m)^[ \t]*(\w+)[ \t]*=[ \t]*\[([^\]]*)\]"
    t = F.col(text_col)
    z = F.arrays_zip(F.regexp_extract_all(t, F.lit(rx), 1).alias("list_name"), F.regexp_extract_all(t, F.lit(rx), 2).alias("body"))
    lists = df.select(*keys, F.explode(z).alias("m"))
    items = F.regexp_extract_all(F.col("m.body"), F.lit(_Q + "(" + _NQ + "*)" + _Q), 1)
    return lists.select(*keys, F.col("m.list_name").alias("list_name"), F.posexplode(items).alias("position", "table_name"))


def extract_bindings(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",)) -> DataFrame:
    """M8: direct variable -> table bindings ``(keys..., position, var, kind, ref)``,
    ``position`` being the number of the assignment in the script:

    * ``x = d["t"]``                      -> kind 'table', ref 't'
    * ``x = spark.table("t")``            -> kind 'table', ref 't'
    * ``x = f(spark, schema, tables)``    -> kind 'list',  ref 'tables'
      (first table of a list from ``extract_table_lists``)
    * ``x = y.filter/select/groupBy(...)``-> kind 'var',   ref 'y' (carried)

    ``resolve_bindings`` closes 'var'/'list' references into table names."""
    start = r"^[ \t]*(\w+)[ \t]*=[ \t]*"
    forms = [
        ("table", start + r"\w+\[\s*" + _Q + "(" + _NQ + "+)" + _Q + r"\s*\]"),
        ("table", start + r"[\w.]*\.table\(\s*" + _Q + "(" + _NQ + "+)" + _Q),
        ("list", start + r"\w+\([^,()]*,[^,()]*,\s*(\w+)\s*\)"),
        ("var", start + r"\(?\s*(\w+)\s*\.\s*(?:filter|select|groupBy|where|agg)\("),
    ]
    stmts = df.select(*keys, F.posexplode(F.split(F.col(text_col), r"(?m)(?=^[ \t]*\w+[ \t]*=[^=])")).alias("position", "s"))
    ref = F.lit(None).cast("string")
    kind = F.lit(None).cast("string")
    for k, rx in reversed(forms):
        hit = F.regexp_extract("s", rx, 2)
        ref, kind = F.when(hit != "", hit).otherwise(ref), F.when(hit != "", F.lit(k)).otherwise(kind)
    out = stmts.select(*keys, "position", F.regexp_extract("s", start, 1).alias("var"), kind.alias("kind"), ref.alias("ref"))
    return out.where(F.col("kind").isNotNull())


def resolve_bindings(spark, bindings: DataFrame, table_lists: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """M8 + M12: the table of every variable at the end of its script
    ``(keys..., var, table_name)``: its last binding counts.

    A 'list' ref takes the first table of its list; a 'var' ref means the latest
    binding of that variable above it.  So every binding has one parent at
    most, and the chains are shortened by pointer doubling, whatever their
    length.  Variables whose chain ends at no table have no row."""
    keys = list(keys)
    first = table_lists.filter(F.col("position") == 0).select(*keys, F.col("list_name").alias("ref"),
                                                              F.col("table_name").alias("via_list"))
    base = bindings.join(first, keys + ["ref"], "left")
    table = F.when(F.col("kind") == "table", F.col("ref")).when(F.col("kind") == "list", F.col("via_list"))
    base = written(base.select(*keys, "position", "var", "kind", "ref", table.alias("table_name")), "bindings")  # read three times
    earlier = base.select(*keys, F.col("var").alias("ref"), F.col("position").alias("at"))
    up = base.where("kind = 'var'").join(earlier, keys + ["ref"]).where(F.col("at") < F.col("position"))
    up = up.groupBy(*keys, "position").agg(F.max("at").alias("up"))
    rows = written(base.join(up, keys + ["position"], "left").select(*keys, "position", "var", "table_name", "up"), "bindings")
    while rows.where("table_name IS NULL AND up IS NOT NULL").limit(1).count():
        far = rows.select(*keys, F.col("position").alias("up"), F.col("table_name").alias("far_table"), F.col("up").alias("far_up"))
        open_row = F.col("table_name").isNull()
        rows = written(rows.join(far, keys + ["up"], "left").select(
            *keys, "position", "var", F.coalesce("table_name", "far_table").alias("table_name"),
            F.when(open_row, F.col("far_up")).alias("up")), "bindings")
    last = rows.groupBy(*keys, "var").agg(F.max_by("table_name", "position").alias("table_name"))
    return last.where("table_name IS NOT NULL")


def extract_target(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",)) -> DataFrame:
    """The target table of a script: ``target_table = f"{db}.x.t"`` keeps
    the constant parts with leading dots removed ('x.t'); a plain string is
    kept whole; ``.insertInto("t")`` also names a target."""
    t = F.col(text_col)
    fstr = F.regexp_extract(t, r"(?m)^[ \t]*target_table[ \t]*=[ \t]*f" + _Q + "(" + _NQ + "*)" + _Q, 1)
    plain = F.regexp_extract(t, r"(?m)^[ \t]*target_table[ \t]*=[ \t]*" + _Q + "(" + _NQ + "*)" + _Q, 1)
    insert = F.regexp_extract(t, r"\.insertInto\(\s*" + _Q + "(" + _NQ + "+)" + _Q, 1)
    parts = F.split(fstr, r"\{[^}]*\}", -1)
    joined = F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"^\.+", "")), "")
    target = F.when(fstr != "", joined).when(plain != "", plain).when(insert != "", insert)
    return df.select(*keys, target.alias("target_table"))


def extract_rule_block(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",), var: str = "dq_rule_string") -> DataFrame:
    """The data-quality rule block assigned to ``var`` (triple-quoted)."""
    rx = r"(?s)" + var + r"\s*=\s*(?:\"\"\"|''')(.*?)(?:\"\"\"|''')"
    return df.select(*keys, F.regexp_extract(F.col(text_col), rx, 1).alias("rule_block")).filter(F.col("rule_block") != "")


# ------------------------------------------------------------------------ M9
def extract_joins(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("path",), default_how: str = DEFAULT_JOIN_TYPE) -> DataFrame:
    """M9: ``left.join(right, condition[, how])`` -> (join_no, left_df, right_df,
    join_type, condition), every join of a chain with the variable at the
    chain's head as its left side.  ``right`` may be a projected frame such as
    ``lk.select(...)`` (its base variable is reported); ``how`` may be
    positional or a keyword; a missing ``how`` is ``default_how`` (upper-case).
    """
    calls = calls_of(df, "join", text_col, keys).where("receiver <> ''")
    right = F.regexp_extract("arg0", r"^\s*\(?\s*(\w+)", 1)
    quoted = _Q + r"(\w+)" + _Q + r"\s*$"
    named = F.coalesce(F.regexp_extract("arg1", r"^\s*how\s*=\s*" + quoted, 1), F.lit(""))
    third = F.coalesce(F.regexp_extract("arg2", r"^\s*(?:how\s*=\s*)?" + quoted, 1), F.lit(""))
    how = F.when(third != "", third).otherwise(named)
    cond = F.when(named != "", F.coalesce("arg2", F.lit(""))).otherwise(F.coalesce("arg1", F.lit("")))
    cond = F.regexp_replace(py_strip(F.regexp_replace(cond, r"^\s*on\s*=\s*", "")), r"\s*\n\s*", " ")
    return calls.where(right != "").select(
        *keys, F.col("match_no").alias("join_no"), F.col("receiver").alias("left_df"), right.alias("right_df"),
        F.upper(F.when(how != "", how).otherwise(F.lit(default_how))).alias("join_type"),
        F.when(cond != "", cond).otherwise(F.lit("unknown")).alias("condition"),
    )


def resolve_joins(joins: DataFrame, resolved: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """D14 for join details: variables -> table names (falling back to the
    variable), and the variables of the condition's dotted names likewise, each
    once.  The per-script map of bindings is bounded by the script."""
    keys = list(keys)
    r = resolved.select(*keys, "var", "table_name")
    j = joins.join(r.withColumnRenamed("var", "left_df").withColumnRenamed("table_name", "left_table"), keys + ["left_df"], "left")
    j = j.join(r.withColumnRenamed("var", "right_df").withColumnRenamed("table_name", "right_table"), keys + ["right_df"], "left")
    names = r.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("var", "table_name"))).alias("names"))
    j = j.join(names, keys, "left")
    names = F.coalesce("names", F.create_map().cast("map<string,string>"))
    cond = rename_heads(F.col("condition"), names)
    return j.select(
        *keys, "join_no",
        F.coalesce("left_table", "left_df").alias("primary_table"),
        F.coalesce("right_table", "right_df").alias("secondary_table"),
        "join_type", cond.alias("condition"), F.lit("").alias("remarks"),
    )


# ------------------------------------------------------------------------ M10, M15
COL_REF_RE = r"""col\(\s*['"]([^'"]+)['"]\s*\)"""


def column_refs(rule: Column) -> Column:
    """Distinct sorted column names referenced as ``col("x")`` in a rule,
    keeping only plausible column names (C8)."""
    refs = F.regexp_extract_all(rule, F.lit(COL_REF_RE), 1)
    return F.array_sort(F.array_distinct(F.filter(refs, lambda x: is_column_name(x))))


def extract_fields(expr: Column) -> Column:
    """``(alias, source)`` pairs of a struct expression's aliased fields,
    e.g. ``col("a").alias("x")`` -> ('x', 'col("a")')."""
    rx = r"""((?:\w+\.)*\w+\(\s*[^()]*\)|\w+)\s*\.alias\(\s*['"](\w+)['"]\s*\)"""
    src = F.regexp_extract_all(expr, F.lit(rx), 1)
    alias = F.regexp_extract_all(expr, F.lit(rx), 2)
    return F.transform(F.arrays_zip(alias.alias("alias"), src.alias("transformation")), lambda x: x)
