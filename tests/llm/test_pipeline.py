"""The pipeline, stage by stage, on the smallest tables."""

import re

import corpus_pipeline
from eospark.functions.storage import staged
from eospark.llm import simhash_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), name)
        before, after = {r["doc_id"] for r in docs.select("doc_id").collect()}, {r["doc_id"] for r in out.select("doc_id").collect()}
        assert after <= before
        if name != "packing":
            assert out.columns == docs.columns
        if name == "exact_dedup":
            norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in out.collect()]
            assert len(norm) == len(set(norm)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in docs.collect()})
        if name == "simhash_near_dedup":
            runs = [set(simhash_dedup.shingles(r["text"], 5)) for r in out.collect()]
            like = [len(a & b) / len(a | b) for i, a in enumerate(runs) for b in runs[:i] if a | b]
            assert max(like) < 0.8
        if name in ("mixing", "packing"):
            assert after == before
        docs = out
        seen.append(name)
    assert seen == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
