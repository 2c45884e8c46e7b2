"""The pipeline's stages on planted cases."""

import corpus_pipeline

from polyview.llm import decontaminate, jaccard


def test_stages_keep_clean_documents_and_catch_planted_ones(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    plain = docs.first()["text"]
    extra = spark.createDataFrame([(90_001, plain + " tail", "en", "s", 5), (90_002, None, "en", "s", 0), (90_003, "call +1 (743) 555-3824 now", "en", "s", 26)], docs.schema)
    docs = docs.unionByName(extra)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns
        got = {r["doc_id"]: r["text"] for r in after.collect()}
        was = {r["doc_id"]: r["text"] for r in before.collect()}
        if name == "near_duplicates":
            found = {r["doc_id"]: r["component_id"] for r in jaccard.classes(before, 5, 80).collect()}
            assert set(got) == {k for k, c in found.items() if k == c} and 90_001 not in got
        if name == "decontamination":
            bad = {r["doc_id"] for r in decontaminate.overlaps(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert set(got) == set(was) - bad
        if name == "pii":
            assert set(got) == set(was) and "555-3824" not in got[90_003] and all(len(got[k] or "") == len(was[k] or "") for k in got)
        before = spark.createDataFrame([tuple(r) for r in after.collect()], docs.schema)
    packed = corpus_pipeline.STAGES[4][1](spark, before, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in before.collect()}
