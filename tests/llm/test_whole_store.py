"""Reading a store back checks its ranges against the manifest."""

import pytest
from pyspark.sql import functions as F

from polyview.llm import idstore
from polyview.llm.common import new_path
from polyview.llm.queries import tokenizer


def test_missing_and_altered_recipes_are_errors(spark):
    docs = spark.createDataFrame([(k, f"text number {k} " * 20) for k in range(12)], "doc_id long, text string")
    path = new_path(spark, "test-store")
    idstore.write_store(docs, path, tokenizer("byte_bpe_50k.json"), end_id=0)
    assert idstore.read_digests(spark, path).count() == 12
    whole = spark.read.schema(idstore._SCHEMA.format(id="bigint")).parquet(path)
    recipe = F.col("kind") == "recipe"
    for changed in (
        whole.where(~(recipe & (F.col("doc_id") == 5))),
        whole.withColumn("doc_id", F.when(recipe & (F.col("doc_id") == 5), F.lit(500)).otherwise(F.col("doc_id"))),
        whole.withColumn("start", F.when(recipe & (F.col("doc_id") == 11), F.col("start") + 1).otherwise(F.col("start"))),
        whole.where("kind <> 'range'"),
    ):
        other = new_path(spark, "test-store")
        changed.write.partitionBy("kind", "bucket").parquet(other)
        with pytest.raises(Exception, match="match the manifest|out of place"):
            idstore.read_digests(spark, other).collect()
    empty = new_path(spark, "test-store")
    idstore.write_store(docs.limit(0), empty, tokenizer("byte_bpe_50k.json"), end_id=0)
    assert idstore.read_digests(spark, empty).count() == 0
