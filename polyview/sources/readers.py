"""Readers of one wide table: CSV (also gzipped), JSON, JSON lines, Parquet, Arrow IPC, in-memory frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ROW = "_row"
INDEX_NAMES = ("id", "index")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def _ipc(spark: SparkSession, path: str) -> DataFrame:
    """Read by Spark as a binary file, so any store will do; for tables that fit the driver."""
    import pyarrow as pa

    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    source = pa.BufferReader(bytes(raw))
    try:
        found = pa.ipc.open_file(source).read_all()
    except pa.ArrowInvalid:
        found = pa.ipc.open_stream(pa.BufferReader(bytes(raw))).read_all()
    return spark.createDataFrame(found)


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".csv": _csv,
    ".csv.gz": _csv,
    ".json": lambda spark, path: spark.read.json(path, multiLine=True),
    ".jsonl": lambda spark, path: spark.read.json(path),
    ".parquet": lambda spark, path: spark.read.parquet(path),
    ".arrow": _ipc,
    ".feather": _ipc,
    ".ipc": _ipc,
}


def read_table(spark: SparkSession, source: object) -> DataFrame:
    """A path by its extension, or a Spark, pandas or Arrow frame as it is. A pandas index becomes the column ``ID``
    where no column has an index name."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        for ending in sorted(READERS, key=len, reverse=True):
            if source.rstrip("/").lower().endswith(ending):
                return READERS[ending](spark, source)
        raise ValueError(f"unsupported extension: {source}")
    if hasattr(source, "to_pandas") and not hasattr(source, "schema"):
        source = source.to_pandas()
    if hasattr(source, "reset_index") and not any(str(c).lower() in INDEX_NAMES for c in source.columns):
        source = source.rename_axis("ID").reset_index()
    return spark.createDataFrame(source)


def empty(spark: SparkSession) -> DataFrame:
    """No rows and no columns but the index."""
    return spark.createDataFrame([], StructType([StructField("ID", StringType())]))


def index_column(columns: list[str]) -> str:
    found = [c for c in columns if c.lower() in INDEX_NAMES]
    if len(found) != 1:
        raise ValueError("no index column" if not found else f"several index columns: {found}")
    return found[0]


def with_row_names(df: DataFrame, check: bool = True) -> DataFrame:
    """The index column as a string ``_row``, checked to be unique and without nulls in one pass."""
    own = index_column(df.columns)
    out = df.select(F.col(f"`{own}`").cast("string").alias(ROW), *[f"`{c}`" for c in df.columns if c != own])
    if check:
        n, some, distinct = out.agg(F.count("*"), F.count(ROW), F.countDistinct(ROW)).first()
        if some != n:
            raise ValueError("the index has nulls")
        if distinct != n:
            raise ValueError("the index has repeated values")
    return out
