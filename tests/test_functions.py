"""Column helpers: edge values from FIXTURES.md §6."""

import os

import pytest

from tapestry.functions.arrays import cross_apply, distinct_groups, keyed_map, merge_arrays, merge_maps, non_empty, pick
from tapestry.functions.codes import classify, role_of, translate, yes_no
from tapestry.functions.keys import first_non_empty, full_name, split_code, surrogate_key
from tapestry.functions.names import clean_column, clean_field, clean_rule, clean_table, is_column_name, output_name
from tapestry.plans.provider import SourceValues

IDENT = "array<struct<identifier_type:string,identifier:string,eff_date:string,exp_date:string>>"

VALUES = SourceValues.load(os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures", "source_values.json"))


def test_keyed_map_zero_one_two(spark):
    df = spark.createDataFrame(
        [(0, []), (1, [("npi", "1", "2020", "2021")]), (2, [("npi", "1", None, None), ("npi", "2", None, None)]),
         (3, [(None, "9", None, None), ("tax", "8", None, None)])],
        f"k int, ids {IDENT}")
    got = {r.k: r.m for r in df.select("k", keyed_map("ids", "identifier_type").alias("m")).collect()}
    assert got[0] == {}
    assert list(got[1]) == ["npi"] and got[1]["npi"].eff_date == "2020" and got[1]["npi"].exp_date == "2021"
    assert sorted(got[2]) == ["npi_1", "npi_2"] and got[2]["npi_2"].identifier == "2"
    assert sorted(got[3]) == ["None_1", "tax_2"]


@pytest.mark.parametrize("codes,expected", [
    (["P"], (True, "PCP")), (["S"], (False, "Specialist")), (["B"], (True, "Both PCP and Specialist")),
    (["X"], (None, None)), (["P", "S"], (True, "Both PCP and Specialist")), ([], (None, None)), (None, (None, None)),
])
def test_role_of(spark, codes, expected):
    r = spark.createDataFrame([(codes,)], "c array<string>").select(role_of("c").alias("r")).first().r
    assert (r.pcp_ind, r.service_provider_role) == expected


def test_first_non_empty_and_yes_no(spark):
    df = spark.createDataFrame([("a", "b", "Y"), ("", "b", "N"), (None, "b", "x"), (None, None, None)], "a string, b string, f string")
    got = [(r.v, r.y) for r in df.select(first_non_empty("a", "b").alias("v"), yes_no("f").alias("y")).collect()]
    assert got == [("a", True), ("b", False), ("b", None), (None, None)]


def test_surrogate_key_modes(spark):
    df = spark.createDataFrame([("1", None)], "a string, b string")
    r = df.select(surrogate_key("a", "b").alias("na"), surrogate_key("a", "b", null="").alias("e"),
                  surrogate_key("a", "b", null=None).alias("s")).first()
    import hashlib
    assert r.na == hashlib.md5(b"1NA").hexdigest()
    assert r.e == hashlib.md5(b"1").hexdigest()
    assert r.s is None


def test_split_code_and_full_name(spark):
    df = spark.createDataFrame([("12345-6789", "A", None, "C"), ("12345", None, None, None)], "z string, f string, m string, l string")
    got = [tuple(r) for r in df.select(*split_code("z"), full_name("f", "m", "l")).collect()]
    assert got == [("12345", "6789", "A C"), ("12345", "", "")]


def test_translate_classify_fixed_lists(spark):
    df = spark.createDataFrame([("Home",), ("Billing",), ("UNSPECIFIED",), ("Previous",), ("zzz",)], "t string")
    got = [r.u for r in df.select(classify("t", VALUES.address_use).alias("u")).collect()]
    assert got == ["home", "billing", "temp", "old", None]
    df2 = spark.createDataFrame([("1",), ("NOC",), ("7",), (None,)], "c string")
    got2 = [r.t for r in df2.select(translate("c", VALUES.epsdt, "").alias("t")).collect()]
    assert got2 == ["MD Medicaid EPSDT Certified", "Not Certified", "", ""]


def test_merge_arrays_maps_pick(spark):
    df = spark.createDataFrame([([3, 1], None)], "a array<int>, b array<int>")
    r = df.select(merge_arrays("a", "b", "a").alias("m"), merge_arrays("a", "b", sort="desc").alias("s"),
                  non_empty("b").alias("ne"), pick("a", lambda x: x > 1).alias("p"),
                  pick("a", lambda x: x > 5).alias("none")).first()
    assert r.m == [3, 1, 3, 1] and r.s == [3, 1] and r.ne is False and r.p == 3 and r.none is None
    m = spark.createDataFrame([({"a": 1}, None)], "x map<string,int>, y map<string,int>").select(merge_maps("x", "y").alias("m")).first().m
    assert m == {"a": 1}


def test_cross_apply_and_distinct_groups(spark):
    q = "array<struct<code:string,taxonomy:string,num:string>>"
    df = spark.createDataFrame([(["t1", "t2"], [("c", None, "n")]), ([], [("c", None, "n")]), (None, [("c", None, "n")])],
                               f"codes array<string>, q {q}")
    out = df.select(cross_apply("codes", "q", {"code": lambda t, x: t, "taxonomy": lambda t, x: t}).alias("r")).collect()
    assert [[(e.code, e.taxonomy) for e in r.r] for r in out] == [[("t1", "t1"), ("t2", "t2")], [("c", None)], [("c", None)]]
    # without keep_when_empty an empty outer list empties the result (legacy behaviour)
    out2 = df.select(cross_apply("codes", "q", {"code": lambda t, x: t}, keep_when_empty=False).alias("r")).collect()
    assert [r.r for r in out2][1] == []
    g = spark.createDataFrame([([[1, 2], [1, 2], [2, 3]],)], "g array<array<int>>").select(distinct_groups("g").alias("d")).first().d
    assert g == [1, 2, 2, 3]


@pytest.mark.parametrize("raw,table,column", [
    (None, "unknown", "unknown"), ("", "unknown", "unknown"), ("unknown", "unknown", "unknown"),
    ("  Members_DF ", "members", "Members_DF"), ("x_df", "x", "x_df"), ('"quoted"', '"quoted"', "quoted"),
    ("'single'", "'single'", "single"), ('"', '"', ""), ("   ", "", ""),
])
def test_clean_names(spark, raw, table, column):
    r = spark.createDataFrame([(raw,)], "v string").select(clean_table("v").alias("t"), clean_column("v").alias("c")).first()
    assert (r.t, r.c) == (table, column)


def test_clean_rule_field(spark):
    r = spark.createDataFrame([(" F.col('a') + pyspark.sql.functions.lit(1) ", None)], "r string, f string").select(
        clean_rule("r").alias("r"), clean_field("f").alias("f")).first()
    assert (r.r, r.f) == ("col('a') + lit(1)", "")


@pytest.mark.parametrize("name,ok", [("member_id", True), ("_x", True), ("9x", False), ("a-b", False), ("when", False),
                                     ("yyyy-MM-dd", False), ("", False), ("prénom", True), ("a.b", False)])
def test_is_column_name(spark, name, ok):
    assert spark.createDataFrame([(name,)], "v string").select(is_column_name("v").alias("ok")).first().ok is ok


def test_output_name(spark):
    df = spark.createDataFrame([("db.silver.<t>",), (None,), ("[]:*?",), ("x" * 40,)], "v string")
    got = [r.o for r in df.select(output_name("v").alias("o")).collect()]
    assert got == ["db_silver_t", "unknown", "Sheet1", "x" * 31]
