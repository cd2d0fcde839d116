"""The stages in a row, each against its operator's own result on the stage's input."""

import corpus_pipeline
from revlens.llm import packing, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "quality rules":
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in quality.within_limits(docs).collect())
        if name == "near dedup":
            gone = {r["doc_id"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"] != r["group_id"]}
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in gone)
        if name == "packing":
            assert out.columns == ["bin", "slot", "doc_id", "start", "n_tokens"]
            have = {r["doc_id"] for r in out.collect()}
            assert have == {r["doc_id"] for r in docs.collect() if (r["text"] or "") != ""}
        else:
            assert out.columns == whole
            docs = spark.createDataFrame(out.collect(), out.schema)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.groupBy("bin").sum("n_tokens").agg({"sum(n_tokens)": "max"}).first()[0] <= packing.WINDOW
