"""Statements, versions, references, fields and lists over odd scripts."""

import pytest

from tapestry.operators import scripts as S
from tapestry.operators import statements as V
from tapestry.operators.lineage import lineage_closure

SCHEMA = "path string, text string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def script(spark, text):
    return spark.createDataFrame([("p", text), ("empty", ""), ("null", None)], SCHEMA)


def test_statements_by_depth(spark):
    text = ('a = f(\n1,\n2)\n# a comment = x\nif a: b = """x\n; y = 3"""; c = \\\n  a\nfor i in r:\n    d = [  # list\n'
            "i]\n\n    d.e == 3\nopen = (\nnever = 1")
    df = script(spark, text)
    got = V.statements(df).where("path = 'p'").orderBy("stmt").collect()
    assert [r.text.strip() for r in got] == [
        "a = f(\n1,\n2)", 'if a: b = """x\n; y = 3""";', "c = \\\n  a", "for i in r:", "d = [        \ni]", "d.e == 3", "open = (\nnever = 1"]
    assert all(len(r.text) == len(r.code) and text[r.start : r.start + 3] == r.text[:3] for r in got)
    a = V.assignments(df)
    assert [(v, n, t.strip()) for v, n, t in rows(a, "var", "version", "text")] == [
        ("a", 1, "f(\n1,\n2)"), ("b", 1, '"""x\n; y = 3""";'), ("c", 1, "\\\n  a"), ("d", 1, "[        \ni]"), ("open", 1, "(\nnever = 1")]
    assert V.statements(df).where("path <> 'p'").count() == 0


def test_versions_keep_histories_apart(spark):
    text = 'x = spark.table("a")\ny = x.filter("q")\nx = spark.table("b")\nz = x.join(y, "k")\nx = x.union(w)\n'
    edges = V.lineage_versions(script(spark, text))
    closure = lineage_closure(spark, edges, keys=["path"])
    got = {((r.node.name, r.node.version), (r.ancestor.name, r.ancestor.version)) for r in closure.collect()}
    assert got == {
        (("x", 1), ("a", 0)), (("y", 1), ("x", 1)), (("y", 1), ("a", 0)), (("x", 2), ("b", 0)), (("x", 3), ("x", 2)), (("x", 3), ("b", 0)),
        (("z", 1), ("x", 2)), (("z", 1), ("b", 0)), (("z", 1), ("y", 1)), (("z", 1), ("x", 1)), (("z", 1), ("a", 0))}
    assert rows(V.table_versions(script(spark, text)), "var", "version", "table_name") == [
        ("x", 1, "a"), ("x", 2, "b"), ("x", 3, None), ("y", 1, "a"), ("z", 1, None)]


def test_lists_load_tables_by_version(spark):
    text = 'ts = ["t1", "t2"]\na = load(spark, db, ts)\nts = ("t3",\n "t4")\nb = load(spark, db, ts)\nc = (a\n  .select("k"))\n'
    df = script(spark, text)
    assert rows(V.table_versions(df), "var", "version", "table_name") == [("a", 1, "t1"), ("b", 1, "t3"), ("c", 1, "t1")]
    edges = {(r.target.name, r.source.name) for r in V.lineage_versions(df).collect()}
    assert edges == {("a", "t1"), ("a", "t2"), ("b", "t3"), ("b", "t4"), ("c", "a")}


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ('df.total + col("a") + df["b"]', [("", "a"), ("df", "b"), ("df", "total")]),
        ('F.col("a").cast("int")', [("", "a")]),
        ("df.x.y.cast('int').alias(\"z\")", [("df", "x.y")]),
        ('df["a"]["b"].c + f(df.g).h + "df.no" + 1.5', [("df", "a.b.c"), ("df", "g")]),
        ('df . spaced  # df.comment\n + mycol("x")', [("df", "spaced")]),
        ('lit("col(\'a\')")', []), ("df.filter(df.p > 1).q", [("df", "p")]), ("", []), (None, []),
    ],
)
def test_references(spark, expr, want):
    df = spark.createDataFrame([("p", expr)], "path string, transformation string")
    assert rows(V.references(df), "var", "column") == want


def test_fields_of_any_depth(spark):
    e = 'struct(col("a").alias("x"), array(*[struct(when(c > 1, lit("(")).alias("p")) for c in cs]).alias("y"), col("b")).alias("top")'
    df = spark.createDataFrame([("p", e), ("q", 'col("a").alias("x")'), ("r", None)], "path string, transformation string")
    got = [(r.path, r.parent, r.alias, r.depth, r.transformation) for r in V.field_tree(df.withColumnRenamed("path", "k"), keys=["k"]).orderBy("field_no").collect()]
    assert got == [("x", "", "x", 1, 'col("a")'), ("y", "", "y", 1, 'array(*[struct(when(c > 1, lit("(")).alias("p")) for c in cs])'),
                   ("y.p", "y", "p", 2, 'when(c > 1, lit("("))')]


def test_column_lists(spark):
    text = 'cols = ["a", col("b").alias("c")]\nx = t.select(*cols)\ncols = 3\ny = t.select(*cols)\nz = t.select(*[f(v) for v in cols], "k")\n'
    e = V.expressions(script(spark, text))
    assert rows(e, "target_column", "transformation", "direct") == [("a", '"a"', True), ("c", 'col("b")', False), ("k", '"k"', True)]


def test_names_are_replaced_once(spark):
    df = spark.createDataFrame([("p", 0, "a", "b", "INNER", 'a.k == b.k and "a.b" and f(a).a.b and c.a')],
                               "path string, join_no int, left_df string, right_df string, join_type string, condition string")
    names = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "$1\\")], "path string, var string, table_name string")
    got = S.resolve_joins(df, names).first()
    assert (got.primary_table, got.secondary_table, got.condition) == ("b", "c", 'b.k == c.k and "a.b" and f(a).a.b and $1\\.a')
    assert S.resolve_joins(df, names.where("false")).first().condition == df.first().condition


def test_statements_are_cut_within_their_rows(spark):
    df = spark.createDataFrame([("p", "\n# c\nx = (1,\n 2); y = 3 \\\n + 4\n"), ("q", "")], "path string, text string")
    got = V.statements(df)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.path, r.stmt, r.start, r.text) for r in got.collect()) == [("p", 0, 5, "x = (1,\n 2);"), ("p", 1, 17, " y = 3 \\\n + 4\n")]
    again = V.statements(df.unionByName(df).where("path = 'p'")).collect()
    assert len(again) > 2  # rows of one key keep the window form
