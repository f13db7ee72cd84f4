"""Data-quality rules: the rule block and test rows of FIXTURES.md §3."""

import pytest
from pyspark.sql import functions as F

from tapestry.operators.quality import apply_rules, compile_rules, dq_summary, flatten_results, rule_lines, rules_by_column

# the entity rule block (fixed text)
BLOCK = """
Service_Provider
    service_provider_id must not be null
    length(npi) must be 10
    npi must not be null
    birth_date_of_birth should be less than now
    birth_date_of_birth should be greater than '1900-01-01'
    length(birth_year_of_birth) must be 4
    base_demographic_gender should be in ['M','F']
    source_id must be service_provider_id
"""
SCHEMA = "k string, service_provider_id string, npi string, birth_date_of_birth string, birth_year_of_birth int, " \
         "base_demographic_gender string, source_id string"
ROWS = [
    ("good", "1", "1234567890", "1980-02-03", 1980, "F", "1"),
    ("null_id", None, "1234567890", "1980-02-03", 1980, "M", "1"),
    ("npi9", "3", "123456789", "1980-02-03", 1980, "M", "3"),
    ("future", "4", "1234567890", "2999-01-01", 2999, "M", "4"),
    ("old", "5", "1234567890", "1850-01-01", 1850, "M", "5"),
    ("malformed", "6", "1234567890", "not a date", None, "M", "6"),
    ("gender", "7", "1234567890", "1980-02-03", 1980, "X", "7"),
    ("other_id", "8", "1234567890", "1980-02-03", 1980, "F", "80"),
]


def test_compile_rules():
    rules = compile_rules(BLOCK)
    assert [(r.kind, r.column, r.severity) for r in rules] == [
        ("not_null", "service_provider_id", "error"), ("length", "npi", "error"), ("not_null", "npi", "error"),
        ("lt", "birth_date_of_birth", "warning"), ("gt", "birth_date_of_birth", "warning"),
        ("length", "birth_year_of_birth", "error"), ("in", "base_demographic_gender", "warning"),
        ("eq_col", "source_id", "error")]
    with pytest.raises(ValueError):
        compile_rules("X\n    npi must rhyme")


def test_rule_lines_group_by_column(spark):
    df = spark.createDataFrame([("e", BLOCK)], "k string, text string")
    got = sorted((r.column, r.rules) for r in rules_by_column(rule_lines(df, keys=["k"]), ["k"]).collect())
    assert got == [
        ("base_demographic_gender", "base_demographic_gender should be in ['M','F']"),
        ("birth_date_of_birth", "birth_date_of_birth should be less than now; "
                                "birth_date_of_birth should be greater than '1900-01-01'"),
        ("birth_year_of_birth", "length(birth_year_of_birth) must be 4"),
        ("npi", "length(npi) must be 10; npi must not be null"),
        ("service_provider_id", "service_provider_id must not be null"),
        ("source_id", "source_id must be service_provider_id"),
    ]


def test_apply_and_flatten(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = flatten_results(apply_rules(df, BLOCK, now=F.lit("2026-01-01 00:00:00").cast("timestamp")))
    got = {r.k: [x.rule for x in r.data_quality_result] for r in out.collect()}
    assert got["good"] == []
    assert got["null_id"] == ["service_provider_id must not be null", "source_id must be service_provider_id"]
    assert got["npi9"] == ["length(npi) must be 10"]
    assert got["future"] == ["birth_date_of_birth should be less than now"]
    assert got["old"] == ["birth_date_of_birth should be greater than '1900-01-01'"]
    assert got["malformed"] == ["birth_date_of_birth should be less than now",
                                "birth_date_of_birth should be greater than '1900-01-01'",
                                "length(birth_year_of_birth) must be 4"]
    assert got["gender"] == ["base_demographic_gender should be in ['M','F']"]
    assert got["other_id"] == ["source_id must be service_provider_id"]
    summary = {r.rule: (r.severity, r.failures) for r in dq_summary(out).collect()}
    assert summary["birth_date_of_birth should be less than now"] == ("warning", 2)
    assert summary["source_id must be service_provider_id"] == ("error", 2)
