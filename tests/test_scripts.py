"""Fixture checks for the script-corpus operators."""

from pyspark.sql import functions as F

from tapestry.operators import scripts as S
from tapestry.operators.lineage import lineage_closure, lineage_edges, lineage_roots
from tapestry.operators.quality import rule_lines, rules_by_column


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_read_scripts_filters_extension_and_recurses(scripts):
    paths = sorted(r.path for r in scripts.collect())
    # notes.txt is skipped by the extension filter; the empty file yields no row
    assert paths == ["member_load.py", "sub/bad_syntax.py"]
    full = scripts.filter("path = 'member_load.py'").first().text
    assert full.startswith("# Databricks notebook source") and full.rstrip().endswith("insertInto(target_table)")


def test_split_cells_types_and_magic(scripts):
    cells = S.split_cells(scripts).filter("path = 'member_load.py'")
    got = rows(cells, "cell_no", "cell_type")
    assert got == [(0, "pyspark"), (1, "markdown"), (2, "pyspark"), (3, "pyspark"), (4, "sql"), (5, "pyspark")]
    md = cells.filter("cell_no = 1").first().text
    assert md == "\nLoad the member tables\n"
    sql = cells.filter("cell_no = 4").first().text
    assert sql.splitlines()[1:] == ["SELECT member_id,", "CASE WHEN state_cd = 'MD' THEN 'Maryland' END AS state",
                                    "FROM silver.member"]


def test_split_cells_edges(spark):
    df = spark.createDataFrame(
        [("a", "x\n# COMMAND ----------\n  # COMMAND ----------  \ny"), ("b", "# COMMAND ----------"), ("c", "")],
        "path string, text string")
    got = rows(S.split_cells(df), "path", "cell_no", "text")
    # empty cells (no lines) vanish; a text that is only a separator has no cell;
    # an empty text is one empty pyspark cell
    assert got == [("a", 0, "x"), ("a", 2, "y"), ("c", 0, "")]


def test_code_patterns_follow_cell_types(scripts):
    cells = S.split_cells(scripts)
    got = rows(S.code_patterns(cells).filter("path = 'member_load.py'"), "type", "target_column", "transformation", "condition")
    assert ("column_transformation", "full_name", 'concat(col("first_name"', None) in got
    assert ("select_transformation", None, '"member_id", "state_cd", "first_name", "last_name"', None) in got
    assert ("sql_case", None, None, "state_cd = 'MD'") in got
    assert any(t == "sql_select" and tr.startswith("member_id,") for t, _, tr, _ in got)


def test_extract_with_column_balanced(scripts):
    got = rows(S.extract_with_column(scripts), "target_column", "transformation")
    assert got == [
        ("addresses", 'sort_array(collect_list(struct(col("line1").alias("address_line_1"), col("city").alias("city"))))'),
        ("full_name", 'concat(col("first_name"), lit(" "), col("last_name"))'),
        ("state_name", 'when(col("txt").isNotNull(), col("txt")).otherwise(lit("unknown"))'),
    ]


def test_column_refs_and_fields(scripts):
    wc = S.extract_with_column(scripts)
    out = {r.target_column: (r.cols, r.f) for r in wc.select(
        "target_column", S.column_refs(F.col("transformation")).alias("cols"),
        S.extract_fields(F.col("transformation")).alias("f")).collect()}
    assert out["full_name"][0] == ["first_name", "last_name"]
    assert out["addresses"][0] == ["city", "line1"]
    assert [(x.alias, x.transformation) for x in out["addresses"][1]] == [
        ("address_line_1", 'col("line1")'), ("city", 'col("city")')]


def test_extract_when(scripts):
    got = rows(S.extract_when(scripts), "condition", "result")
    assert got == [('col("txt").isNotNull()', 'col("txt")')]


def test_table_lists_and_bindings(spark, scripts):
    tl = S.extract_table_lists(scripts)
    assert rows(tl, "list_name", "position", "table_name") == [
        ("code_tables", 0, "state_codes"), ("member_tables", 0, "member_base"), ("member_tables", 1, "member_addr")]
    b = S.extract_bindings(scripts)
    r = S.resolve_bindings(spark, b, tl)
    assert rows(r, "path", "var", "table_name") == [
        ("member_load.py", "active_df", "member_base"),
        ("member_load.py", "addr_df", "member_addr"),
        ("member_load.py", "base_df", "member_base"),
        ("member_load.py", "recent_df", "member_base"),
        ("member_load.py", "state_df", "ref.state_codes"),
        ("sub/bad_syntax.py", "x", "raw.events"),
        ("sub/bad_syntax.py", "y", "raw.events"),
    ]


def test_bindings_are_extracted_once(spark, tmp_path):
    """Resolving reads its bindings once, and the scripts of a small file are dealt to all tasks."""
    from tapestry.plans.q_scripts import part_scripts

    kinds = [("p", 0, "a", "table", "t"), ("p", 1, "b", "var", "a"), ("p", 2, "a", "list", "l"), ("p", 3, "c", "var", "a"), ("q", 0, "a", "var", "a"), (None, 0, "a", "table", "t")]
    schema = "path string, position int, var string, kind string, ref string"
    seen = spark.sparkContext.accumulator(0)
    counted = spark.createDataFrame(spark.createDataFrame(kinds, schema).rdd.map(lambda r: (seen.add(1), r)[1]), schema)
    lists = spark.createDataFrame([("p", "l", 0, "u"), ("p", "l", 1, "v")], "path string, list_name string, position int, table_name string")
    got = {(r.path, r.var, r.table_name) for r in S.resolve_bindings(spark, counted, lists).collect()}
    assert got == {("p", "a", "u"), ("p", "b", "t"), ("p", "c", "u"), (None, "a", "t")}
    assert seen.value == len(kinds)
    part = spark.createDataFrame([(k, "Brand#1", "TYPE", k % 3) for k in range(20)], "p_partkey long, p_brand string, p_type string, p_size int")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    dealt = part_scripts(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_joins_resolved(spark, scripts):
    tl = S.extract_table_lists(scripts)
    r = S.resolve_bindings(spark, S.extract_bindings(scripts), tl)
    j = S.extract_joins(scripts)
    assert rows(j, "left_df", "right_df", "join_type") == [("joined_df", "addr_df", "INNER"), ("recent_df", "state_df", "LEFT")]
    got = rows(S.resolve_joins(j, r), "primary_table", "secondary_table", "join_type", "condition")
    assert got == [
        ("joined_df", "member_addr", "INNER", "joined_df.member_id == member_addr.member_id"),
        ("member_base", "ref.state_codes", "LEFT", '(col("state_cd") == col("cd"))'),
    ]
    # the documented default join type can be switched to the legacy LEFT
    assert rows(S.extract_joins(scripts, default_how="left").filter("right_df = 'addr_df'"), "join_type") == [("LEFT",)]


def test_target_and_rule_block(scripts):
    assert rows(S.extract_target(scripts), "path", "target_table") == [
        ("member_load.py", "silver.member"), ("sub/bad_syntax.py", None)]
    blk = S.extract_rule_block(scripts)
    lines = rule_lines(blk, "rule_block", keys=["path"])
    assert rows(lines, "line_no", "column", "severity") == [(1, "member_id", "error"), (2, "state_cd", "error"),
                                                           (3, "member_id", "error")]
    by_col = rows(rules_by_column(lines, ["path"]), "column", "rules")
    assert by_col == [("member_id", "member_id must not be null; member_id must be source_id"),
                      ("state_cd", "length(state_cd) must be 2")]


def test_lineage_edges_closure_roots(spark, scripts):
    e = lineage_edges(scripts)
    assert rows(e.filter("path = 'member_load.py'"), "target", "source") == [
        ("active_df", "base_df"), ("both_df", "addr_df"), ("both_df", "joined_df"), ("joined_df", "recent_df"),
        ("joined_df", "state_df"), ("recent_df", "active_df"), ("state_df", "ref.state_codes")]
    roots = rows(lineage_roots(spark, e, keys=["path"]).filter("node = 'both_df'"), "root", "depth")
    assert roots == [("addr_df", 1), ("base_df", 4), ("ref.state_codes", 3)]


def test_closure_stops_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "target string, source string")
    got = rows(lineage_closure(spark, e), "node", "ancestor", "depth")
    assert ("a", "c", 2) in got and len(got) == 6  # each node reaches the other two, never itself


def test_calls_leave_their_rows_only(spark):
    """No piece of a text is shuffled or sorted: one row a call behind the script's row."""
    from tapestry.operators.calls import call_arguments, calls_of

    df = spark.createDataFrame([("p", 'x = a.f(g(1, [2, 3]), "(").f(4)\n'), ("q", "f(1, (2"), (None, "f(1)"), ("r", None)], "path string, text string")
    plan = calls_of(df, "f")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    got = sorted((r.path, r.match_no, r.receiver, r.args) for r in calls_of(df, "f").collect())
    assert got == [("p", 0, "a", ["g(1, [2, 3])", ' "("']), ("p", 1, "a", ["4"]), ("q", 0, "", ["1"])]
    spans = sorted((r.call, r.name, r.arg_no, r.a, r.b) for r in call_arguments(df.where("path = 'p'"), unnamed=True).collect())
    assert spans == [(7, "f", 0, 8, 20), (7, "f", 1, 21, 25), (9, "g", 0, 10, 11), (9, "g", 1, 12, 19), (13, "", 0, 14, 15), (13, "", 1, 16, 18), (28, "f", 0, 29, 30)]


def test_code_patterns_read_the_cells_once(spark):
    df = spark.createDataFrame([("p", 0, "pyspark", 'd.select(a)\nSELECT x FROM t'), ("p", 1, "sql", "SELECT y FROM t .select(b)"), ("p", 2, "markdown", "SELECT z FROM t")],
                               "path string, cell_no int, cell_type string, text string")
    out = S.code_patterns(df)
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out, "cell_no", "type", "transformation") == [(0, "select_transformation", "a"), (1, "sql_select", "y")]
