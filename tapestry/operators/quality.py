"""Data-quality rules.

A rule block is text: an unindented entity header followed by one rule per
line indented four spaces, e.g. ``    length(npi) must be 10``.

* ``rule_lines`` (L1/M14) is a Spark operator: it turns a column of rule
  blocks (for instance extracted from a corpus of scripts) into rows
  ``(line_no, rule, column, severity)``; ``rules_by_column`` (E14) joins the
  rules of each column with ``'; '``.
* ``compile_rules`` turns one small rule block (configuration, not data) into
  Column predicates, and ``apply_rules`` evaluates all of them in a single
  projection: an ``array<struct<rule, column, severity, passed>>`` per row.
  ``flatten_results`` keeps the failures in ``data_quality_result``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
RULE_INDENT = "    "
# operand of a rule: the argument of the first ``f(x)``, else the first word
OPERAND_CALL_RE = r"\w+\((\w+)\)"
OPERAND_WORD_RE = r"^(?:(\w+)\s|(\w+)\s*\()"
RULE_SEPARATOR = "; "
SEVERITY = {"must": "error", "should": "warning"}
# ---------------------------------------------------------------------------

_RULE_FORMS = [
    ("not_null", re.compile(r"^(?P<col>\w+) (?P<sev>must|should) not be null$")),
    ("length", re.compile(r"^length\((?P<col>\w+)\) (?P<sev>must|should) be (?P<n>\d+)$")),
    ("lt", re.compile(r"^(?P<col>\w+) (?P<sev>must|should) be less than (?P<v>.+)$")),
    ("gt", re.compile(r"^(?P<col>\w+) (?P<sev>must|should) be greater than (?P<v>.+)$")),
    ("in", re.compile(r"^(?P<col>\w+) (?P<sev>must|should) be in \[(?P<list>.*)\]$")),
    ("eq_col", re.compile(r"^(?P<col>\w+) (?P<sev>must|should) be (?P<other>[A-Za-z_]\w*)$")),
]


@dataclass(frozen=True)
class Rule:
    text: str
    column: str
    severity: str
    kind: str
    arg: object = None


def parse_rule(text: str) -> Rule:
    t = text.strip()
    for kind, rx in _RULE_FORMS:
        m = rx.match(t)
        if not m:
            continue
        sev = SEVERITY[m.group("sev")]
        col = m.group("col")
        if kind == "length":
            return Rule(t, col, sev, kind, int(m.group("n")))
        if kind in ("lt", "gt"):
            return Rule(t, col, sev, kind, m.group("v").strip())
        if kind == "in":
            items = [s.strip().strip("'\"") for s in m.group("list").split(",") if s.strip()]
            return Rule(t, col, sev, kind, tuple(items))
        if kind == "eq_col":
            return Rule(t, col, sev, kind, m.group("other"))
        return Rule(t, col, sev, kind)
    raise ValueError(f"unsupported rule: {text!r}")


def compile_rules(block: str) -> list[Rule]:
    """Rules of one block, in order; the header and blank lines are skipped."""
    return [parse_rule(line) for line in block.strip().split("\n") if line.startswith(RULE_INDENT) and line.strip()]


_DATE_RE = re.compile(r"^\d{4}-\d{2}-\d{2}$")
_TS_RE = re.compile(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}")


def _bound(value: str, now: Column) -> tuple[Column, str]:
    """A comparison bound and the type the column is compared as."""
    if value == "now":
        return now, "timestamp"
    lit = value.strip("'\"")
    if _DATE_RE.match(lit) or _TS_RE.match(lit):
        return F.lit(lit).cast("timestamp"), "timestamp"
    try:
        return F.lit(float(lit)), "double"
    except ValueError:
        return F.lit(lit), "string"


def rule_predicate(rule: Rule, now: Column | None = None) -> Column:
    """True when a row passes.  NULL operands fail every rule (a rule that is
    not known to hold is reported), except that the result itself is never NULL."""
    now = F.current_timestamp() if now is None else now
    c = F.col(rule.column)
    if rule.kind == "not_null":
        cond = c.isNotNull()
    elif rule.kind == "length":
        cond = F.length(c.cast("string")) == F.lit(rule.arg)
    elif rule.kind in ("lt", "gt"):
        bound, typ = _bound(rule.arg, now)
        v = c.try_cast(typ) if typ != "string" else c.cast("string")
        cond = (v < bound) if rule.kind == "lt" else (v > bound)
    elif rule.kind == "in":
        cond = c.cast("string").isin(list(rule.arg))
    elif rule.kind == "eq_col":
        cond = c.cast("string") == F.col(rule.arg).cast("string")
    else:  # pragma: no cover
        raise ValueError(rule.kind)
    return F.coalesce(cond, F.lit(False))


def apply_rules(df: DataFrame, rules: str | Sequence[Rule], now: Column | None = None, out: str = "dq_results") -> DataFrame:
    """Evaluate every rule in one projection."""
    rules = compile_rules(rules) if isinstance(rules, str) else list(rules)
    results = F.array(
        *[
            F.struct(
                F.lit(r.text).alias("rule"),
                F.lit(r.column).alias("column"),
                F.lit(r.severity).alias("severity"),
                rule_predicate(r, now).alias("passed"),
            )
            for r in rules
        ]
    )
    return df.withColumn(out, results)


def flatten_results(df: DataFrame, src: str = "dq_results", out: str = "data_quality_result") -> DataFrame:
    """Keep only the failed rules (rule, column, severity) in ``out``."""
    failed = F.transform(
        F.filter(F.col(src), lambda x: ~x["passed"]),
        lambda x: F.struct(x["rule"].alias("rule"), x["column"].alias("column"), x["severity"].alias("severity")),
    )
    return df.withColumn(out, failed).drop(src)


def dq_summary(df: DataFrame, src: str = "data_quality_result") -> DataFrame:
    """Failures per rule (explode + partial aggregation)."""
    return (
        df.select(F.explode(F.col(src)).alias("f"))
        .groupBy(F.col("f.rule").alias("rule"), F.col("f.column").alias("column"), F.col("f.severity").alias("severity"))
        .agg(F.count(F.lit(1)).alias("failures"))
    )


def rule_lines(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ()) -> DataFrame:
    """L1/M14 over a column of rule blocks: one row per indented rule line with
    its operand column and severity.  Lines whose operand cannot be read are
    dropped, as are blank lines.  ``line_no`` is 0-based within the block."""
    block = F.regexp_replace(F.col(text_col), r"^\s+|\s+$", "")
    lines = df.select(*keys, F.posexplode(F.split(block, "\n")).alias("line_no", "line"))
    rule = F.regexp_replace(F.col("line"), r"^\s+|\s+$", "")
    by_call = F.regexp_extract(rule, OPERAND_CALL_RE, 1)
    by_word = F.regexp_extract(rule, OPERAND_WORD_RE, 1)
    column = F.when(by_call != "", by_call).when(by_word != "", by_word)
    sev = F.regexp_extract(rule, r"\b(must|should)\b", 1)
    return (
        lines.filter(F.col("line").startswith(RULE_INDENT))
        .select(
            *keys,
            "line_no",
            rule.alias("rule"),
            column.alias("column"),
            F.when(sev == "must", "error").when(sev == "should", "warning").alias("severity"),
        )
        .filter(F.col("column").isNotNull())
    )


def rules_by_column(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rules of each column joined by '; ' in line order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "rule")))
    return lines.groupBy(*keys, "column").agg(
        F.array_join(F.transform(ordered, lambda x: x["rule"]), RULE_SEPARATOR).alias("rules")
    )
