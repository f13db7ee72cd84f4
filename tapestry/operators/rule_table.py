"""Data-quality rules as rows (L1-L8): rules of many entities evaluated by one
expression.

``rule_rows`` reads rule blocks (one text for each entity) into rows
``(entity, line_no, rule, column, severity, kind, arg, args)``.
``apply_rule_table`` gives every row of data the rules of its entity: a row's
columns become one map of texts, and one expression looks a rule's column up in
it and tests it by the rule's kind.  Nothing is compiled on the driver, so new
rules and new entities are new rows.

The forms are those of ``quality``: ``x must not be null``, ``length(x) must be
n``, ``x should be less than v``, ``x should be greater than v``, ``x should be
in [a, b]`` and ``x must be y``; ``must`` is an error, ``should`` a warning.
Bounds that look like a date or ``now`` compare as timestamps, numbers as
doubles, others as texts.  A NULL operand, a value that cannot be cast, and a
column that the data do not have fail a rule; a line of no known form is a rule
of kind NULL and fails too.  An entity without rules has an empty list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapestry.functions.names import py_strip
from tapestry.operators.quality import RULE_INDENT

_FORMS = {
    "not_null": r"^(\w+) (?:must|should) not be null$",
    "length": r"^length\((\w+)\) (?:must|should) be (\d+)$",
    "lt": r"^(\w+) (?:must|should) be less than (.+)$",
    "gt": r"^(\w+) (?:must|should) be greater than (.+)$",
    "in": r"^(\w+) (?:must|should) be in \[(.*)\]$",
    "eq_col": r"^(\w+) (?:must|should) be ([A-Za-z_]\w*)$",
}
_TIME = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2}.*)?$"


def rule_rows(blocks: DataFrame, text_col: str = "text", entity_col: str = "entity") -> DataFrame:
    """L1: ``(entity, line_no, rule, column, severity, kind, arg, args, compare)``
    of every indented line of the entities' rule blocks."""
    lines = blocks.select(F.col(entity_col).alias("entity"), F.posexplode(F.split(py_strip(F.col(text_col)), "\n", -1)).alias("line_no", "line"))
    lines = lines.where(F.col("line").startswith(RULE_INDENT)).select("entity", "line_no", py_strip(F.col("line")).alias("rule")).where("rule <> ''")
    kind = column = arg = F.lit(None).cast("string")
    for name, form in reversed(_FORMS.items()):
        hit = F.rlike("rule", F.lit(form))
        kind, column = F.when(hit, F.lit(name)).otherwise(kind), F.when(hit, F.regexp_extract("rule", form, 1)).otherwise(column)
        if name != "not_null":
            arg = F.when(hit, F.regexp_extract("rule", form, 2)).otherwise(arg)
    bare = lambda c: F.regexp_replace(py_strip(c), r"^['\"]+|['\"]+$", "")
    rows = lines.select("entity", "line_no", "rule", kind.alias("kind"), column.alias("column"), arg.alias("arg"))
    bound = F.col("kind").isin("lt", "gt")
    args = F.when(F.col("kind") == "in", F.transform(F.filter(F.split("arg", ","), lambda x: py_strip(x) != ""), bare))
    rows = rows.withColumns({"args": args, "arg": F.when(bound, bare(F.col("arg"))).otherwise(F.col("arg"))})
    compare = (F.when(bound & ((F.col("arg") == "now") | F.rlike("arg", F.lit(_TIME))), "timestamp")
               .when(bound & F.col("arg").try_cast("double").isNotNull(), "double").when(bound, "string"))
    severity = F.when(F.regexp_extract("rule", r"\b(must|should)\b", 1) == "must", "error").otherwise("warning")
    return rows.select("entity", "line_no", "rule", "column", severity.alias("severity"), "kind", "arg", "args", compare.alias("compare"))


def _passes(r: Column, cols: Column, now: Column) -> Column:
    """Whether the columns' map keeps the rule ``r``; never NULL."""
    v = F.try_element_at(cols, r["column"])

    def compared(kind: str, test) -> Column:
        bound = r["arg"] if kind == "string" else r["arg"].try_cast(kind)
        bound = F.when(r["arg"] == "now", now).otherwise(bound) if kind == "timestamp" else bound
        return test(v if kind == "string" else v.try_cast(kind), bound)

    def by_bound(test) -> Column:
        return (F.when(r["compare"] == "timestamp", compared("timestamp", test)).when(r["compare"] == "double", compared("double", test))
                .otherwise(compared("string", test)))

    kept = (F.when(r["kind"] == "not_null", v.isNotNull())
            .when(r["kind"] == "length", F.length(v) == r["arg"].try_cast("int"))
            .when(r["kind"] == "lt", by_bound(lambda x, y: x < y))
            .when(r["kind"] == "gt", by_bound(lambda x, y: x > y))
            .when(r["kind"] == "in", F.array_contains(r["args"], v))
            .when(r["kind"] == "eq_col", v == F.try_element_at(cols, r["arg"])))
    return F.coalesce(kept, F.lit(False))


def apply_rule_table(df: DataFrame, rules: DataFrame, entity_col: str = "entity", columns: Sequence[str] | None = None, now: Column | None = None,
                     out: str = "dq_results") -> DataFrame:
    """``df`` with ``out``, an array of (rule, column, severity, passed)
    in line order, by the rules of each row's entity.  ``columns``: those that
    rules may name (default: all but maps).  An entity's rules are one row, so
    the join's small side has a row for each entity."""
    now = F.current_timestamp() if now is None else now
    columns = [c for c, t in df.dtypes if not t.startswith("map")] if columns is None else list(columns)
    fields = ["line_no", "rule", "column", "severity", "kind", "arg", "args", "compare"]
    held = rules.groupBy(F.col("entity").alias("_entity")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_rules"))
    cols = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"`{c}`").cast("string") for c in columns]))
    j = df.withColumn("_cols", cols).join(held, F.col(entity_col) == F.col("_entity"), "left")
    result = F.transform("_rules", lambda r: F.struct(r["rule"].alias("rule"), r["column"].alias("column"), r["severity"].alias("severity"),
                                                      _passes(r, F.col("_cols"), now).alias("passed")))
    empty = F.array().cast("array<struct<rule:string,column:string,severity:string,passed:boolean>>")
    return j.withColumn(out, F.coalesce(result, empty)).select(*df.columns, out)
