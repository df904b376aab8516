"""The pipeline's rows follow from its stages; what it drops is what the operators name."""

import corpus_pipeline
from orgpulse.llm import decontam, neardup


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = step(spark, docs, d)
        assert docs.columns == columns
        left = {r[0] for r in docs.select("doc_id").collect()}
        gone = ids - left
        if name == "near_dedup":
            found = neardup.near_duplicates(before).where("not kept")
            assert gone == {r[0] for r in found.select("doc_id").collect()}
        elif name == "decontamination":
            found = decontam.contamination(before, spark.read.parquet(f"{d}/benchmark.parquet"))
            assert gone == {r[0] for r in found.where("found.contaminated").select("doc_id").collect()}
        elif name == "pii":
            assert not gone
        ids = left
    packed = corpus_pipeline.run(spark, d)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == ids
