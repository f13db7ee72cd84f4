"""The corpus pipeline, stage by stage."""

import corpus_pipeline
from tapestry.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_registry(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_files"]
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {*(f"op{k}" for k in range(1, 14)), "pipeline"} and len(names) == 14
    assert set(registry.oracle_sql()) <= names


def test_pipeline_on_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = docs.where("doc_id < 3").selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").limit(1).selectExpr("200000 as doc_id", "concat('x y ', text, ' z') as text", "'en' as lang", "'s' as source", "1L as n_chars")
    rows = docs.union(planted).union(bench.selectExpr("cast(doc_id as long) as doc_id", "text", "lang", "source", "n_chars"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF).cache()
        assert rows.columns == COLUMNS
        kept[name] = {r["doc_id"] for r in rows.select("doc_id").collect()}
    assert not {100000, 100001, 100002} & kept["near_dedup"]
    assert 200000 in kept["near_dedup"] and 200000 not in kept["decontamination"]
    assert kept["mixing"] == kept["decontamination"]  # every clean document stays
    out = corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect()
    assert len(out) == rows.count()


def test_empty_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF)
        assert rows.collect() == []
