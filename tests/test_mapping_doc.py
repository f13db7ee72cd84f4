"""End-to-end mapping document on the fixture corpus."""

import os
import tempfile

from tapestry.plans.mapping_doc import extract_mappings, write_document


def test_mapping_document(spark, scripts):
    doc = extract_mappings(spark, scripts)
    rows = {r.target_column: r for r in doc.mappings.collect()}
    assert set(rows) == {"full_name", "state_name", "addresses"}
    # chained calls on both_df: its table is not a bound table, so it falls back to the variable
    assert rows["full_name"].source_table == "both_df"
    assert rows["full_name"].source_columns == "both_df.first_name, both_df.last_name"
    assert rows["full_name"].dq_rules == ""
    assert [(f.alias, f.transformation) for f in rows["addresses"].array_fields] == [
        ("address_line_1", 'col("line1")'), ("city", 'col("city")')]
    joins = sorted((r.left_df, r.right_df, r.join_type) for r in doc.joins.collect())
    assert joins == [("joined_df", "member_addr", "INNER"), ("member_base", "ref.state_codes", "LEFT")]
    assert sorted(r.target_table or "" for r in doc.targets.collect()) == ["", "silver.member"]
    out = tempfile.mkdtemp(prefix="tapestry-doc-")
    write_document(doc, out)
    back = spark.read.option("header", "true").csv(os.path.join(out, "mappings"))
    assert back.count() == 3 + 2  # three mappings + two array-field continuation rows
