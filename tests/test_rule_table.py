"""Rules as rows against the compiled rules, and odd rules."""

import datetime

from pyspark.sql import functions as F

from tapestry.operators.quality import apply_rules
from tapestry.operators.rule_table import apply_rule_table, rule_rows

BLOCK = """
Provider
    id must not be null
    length(npi) must be 10
    npi must not be null
    born should be less than now
    born should be greater than '1900-01-01'
    length(year) must be 4
    gender should be in ['M','F']
    source must be id
    score should be greater than 2.5
    gender should be less than 'N'
"""
SCHEMA = "entity string, id string, npi string, born timestamp, year int, gender string, source string, score double"
DAY = datetime.datetime
ROWS = [
    ("p", "1", "1234567890", DAY(1980, 1, 1), 1980, "M", "1", 3.0),
    ("p", None, "123456789", DAY(2090, 1, 1), 198, "X", "2", 2.5),
    ("p", "3", None, DAY(1850, 5, 5), None, "F", None, None),
    ("p", "", "", None, 19800, None, "", float("nan")),
]


def test_rows_agree_with_compiled_rules(spark):
    df, now = spark.createDataFrame(ROWS, SCHEMA), F.lit("2026-01-01").cast("timestamp")
    rules = rule_rows(spark.createDataFrame([("p", BLOCK)], "entity string, text string"))
    key = lambda r: (r.id is None, r.id or "")
    want = [(r.id, [tuple(x) for x in r.dq_results]) for r in sorted(apply_rules(df, BLOCK, now).collect(), key=key)]
    got = [(r.id, [tuple(x) for x in r.dq_results]) for r in sorted(apply_rule_table(df, rules, now=now).collect(), key=key)]
    assert got == want and len(got[0][1]) == 10 and all(p for *_, p in dict(got)["1"])


def test_entities_have_rules_of_their_own(spark):
    blocks = [("p", "P\n    x must be y\n    nowhere must be 3 words long\n    odd must not be null"), ("q", "Q\n    length(x) should be 2\n\n    "), ("n", None), (None, "N\n    x must not be null")]
    rules = rule_rows(spark.createDataFrame(blocks, "entity string, text string"))
    assert {(r.entity, r.kind) for r in rules.collect()} == {("p", "eq_col"), ("p", None), ("p", "not_null"), ("q", "length"), (None, "not_null")}
    df = spark.createDataFrame([(e, "ab", "ab", {"m": 1}) for e in ("p", "q", "n", None, "other")], "entity string, x string, y string, odd map<string,int>")
    got = {r.entity: [(x.rule, x.passed) for x in r.dq_results] for r in apply_rule_table(df, rules).collect()}
    assert got == {"p": [("x must be y", True), ("nowhere must be 3 words long", False), ("odd must not be null", False)],
                   "q": [("length(x) should be 2", True)], "n": [], None: [], "other": []}
    assert apply_rule_table(df, rules.where("false")).where("size(dq_results) > 0").count() == 0
    assert apply_rule_table(df.where("false"), rules).count() == 0
