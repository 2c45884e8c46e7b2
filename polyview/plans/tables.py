"""Tables written in the folder that all executors share, to end a lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH = "/tmp/checkpoints"


def new_path(spark: SparkSession, label: str) -> str:
    """Below ``spark.checkpoint.dir`` (SCRATCH where that is unset, as in tests)."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or SCRATCH).rstrip("/")
    return f"{base}/polyview-model-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet in the shared folder, and read from there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_table(df: DataFrame | None) -> None:
    path = getattr(df, "_written_at", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
