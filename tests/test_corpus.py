"""Incremental extraction, and the whole workflow over the fixture corpus."""

import pytest
from pyspark.sql import functions as F

from tapestry.operators import scripts as S
from tapestry.plans.corpus_job import corpus_mappings, run_corpus
from tapestry.sources.corpus import Corpus
from tapestry.sources.run_store import RunStore

SCHEMA = "path string, text string"


def line(target):
    return f'x_df = a_df.withColumn("{target}", col("c"))\n'


def test_only_changed_scripts_are_extracted(spark, tmp_path):
    seen = []

    def extract(scripts):
        seen.append(sorted(r.path for r in scripts.collect()))
        return S.extract_with_column(scripts)

    corpus = Corpus(spark, str(tmp_path / "c"), {"mappings": extract}, buckets=4)
    with pytest.raises(ValueError, match="update"):
        corpus.read("mappings")
    scripts = {f"s{k}": line(f"t{k}") for k in range(6)} | {"empty": "", "null": None}
    frame = lambda: spark.createDataFrame([*scripts.items(), (None, line("lost"))], SCHEMA)
    rows = lambda: sorted((r.path, r.target_column) for r in corpus.read("mappings").collect())
    changes = lambda df: sorted((r.path, r.change) for r in df.collect())

    assert len(changes(corpus.update(frame()))) == 8 and rows() == [(f"s{k}", f"t{k}") for k in range(6)]
    assert changes(corpus.update(frame())) == [] and len(seen) == 1  # nothing changed: nothing is extracted
    scripts["s1"], scripts["s9"] = line("new") + line("two"), line("t9")
    del scripts["s2"]
    scripts["s3"] = "# no mapping any more"
    assert changes(corpus.update(frame())) == [("s1", "changed"), ("s2", "removed"), ("s3", "changed"), ("s9", "new")]
    assert seen[1] == ["s1", "s3", "s9"]
    assert rows() == [("s0", "t0"), ("s1", "new"), ("s1", "two"), ("s4", "t4"), ("s5", "t5"), ("s9", "t9")]
    assert sorted(r.path for r in corpus.read("manifest").collect()) == sorted(scripts)
    assert len(changes(corpus.update(frame().where("false")))) == 8 and rows() == []
    corpus.update(frame())
    assert len(rows()) == 6
    with pytest.raises(ValueError, match="twice"):
        corpus.update(frame().unionByName(frame()))


def test_the_workflow(spark, scripts, tmp_path):
    got = {r.target_field: r for r in corpus_mappings(spark, scripts).collect()}
    # both sides read the same rules off both_df, whose chain ends at no table
    assert {k: (r.match_class, r.source_table, r.needs_review) for k, r in got.items()} == {
        "full_name": ("exact", "both", False), "state_name": ("exact", "both", False), "addresses": ("exact", "both", False)}
    assert got["full_name"].source_column == "both_df.first_name, both_df.last_name"
    store = RunStore(spark, str(tmp_path / "runs"))
    for _ in range(2):
        saved = run_corpus(spark, scripts, store, F.lit("2024-01-01").cast("timestamp"))
    assert sorted((r.session_id, r.target_field) for r in saved.collect()) == [("member_load.py", t) for t in ("addresses", "full_name", "state_name")]


def test_the_workflow_parses_each_script_once(spark, monkeypatch):
    """Statements are cut and calls are found once for both sides, whatever reads them."""
    from tapestry.operators import statements as V
    from tapestry.plans import corpus_job, mapping_doc

    asked = []
    for module, name in ((V, "statements"), (V, "calls_among"), (S, "calls_among"), (mapping_doc, "calls_among")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _real=real, _name=name, **k: (asked.append(_name), _real(*a, **k))[1])
    text = 'a_df = spark.table("db.t")\nx_df = a_df.withColumn("u", col("a")).withColumns({"v": col("b")}).select(a_df.c.alias("w"))\n'
    rows = [("p", text), ("q", text), ("q", text), (None, text), ("r", None), ("s", "")]
    got = corpus_job.corpus_mappings(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(asked) == ["calls_among", "statements"]
    assert sorted((r.target_field, r.match_class) for r in got if r.path == "p") == [("u", "exact"), ("v", "exact"), ("w", "code_only")]


def test_many_touched_paths_are_not_sent_to_every_task(spark, monkeypatch, tmp_path):
    from tapestry.sources import corpus as module

    scripts = spark.createDataFrame([(f"s{k}", line(f"t{k}")) for k in range(8)], SCHEMA)
    plan = lambda: scripts.join(module.paths_of(scripts.limit(5)), "path", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(module, "SENT", 4)
    assert "SortMergeJoin" in plan() and "BroadcastHashJoin" not in plan()
    corpus = Corpus(spark, str(tmp_path / "c"), {"mappings": lambda s: s.select("path", F.length("text").alias("n"))}, buckets=2)
    assert corpus.update(scripts).count() == 8
    assert sorted((r.path, r.change) for r in corpus.update(scripts.where("path <> 's1'").withColumn("text", F.concat("text", F.lit("#")))).collect()) == [
        (f"s{k}", "removed" if k == 1 else "changed") for k in range(8)]
    assert sorted((r.path, r.n) for r in corpus.read("mappings").collect()) == [(f"s{k}", len(line(f"t{k}")) + 1) for k in range(8) if k != 1]
