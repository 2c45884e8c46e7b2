"""What the corpus operators share: words, folds, shared scratch tables, bounded samples."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes that aren't one of the six ASCII white-space characters;
#: ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: The same class where the regular expression engine is Java's or DuckDB's.
SPACES = r"[\x20\x09-\x0D]+"
SCRATCH = "/tmp/checkpoints"
#: Ids that are broadcast at most, some 16 MB.
MOST_IDS = 1 << 20

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_TO_LOWER = bytes.maketrans(_UPPER, _LOWER)
_ROOTS: dict[str, tuple[object, str]] = {}


def lowered_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case; none for a null."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def hash_unit(*cols: str) -> Column:
    """A number in [0, 1) that depends on the values alone, for reproducible samples."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / F.lit(float(1 << 52))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir`` (or SCRATCH where that is unset),
    which all executors share; it goes when the application ends."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or SCRATCH).rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        root = f"{base}/polyview-{app}"
        _ROOTS[app] = (spark, root)

        def leave() -> None:
            try:
                _delete(spark, root)
            except Exception:  # the JVM may be gone before this runs
                pass

        atexit.register(leave)
    return _ROOTS[app][1]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str, parts: int | None = None, rows: int | None = None) -> DataFrame:
    """df written as a table in the shared folder and read from there: lineage ends, and a lost
    executor costs no recomputation. ``drop_stored`` deletes it. rows: at most so many go to Python at a time while
    this is written, which bounds what rows with long texts need on both sides."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_BATCH, None)
    if rows:
        spark.conf.set(_BATCH, str(rows))
    try:
        (df if parts is None else df.coalesce(parts)).write.parquet(path)
    finally:
        if rows:
            spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    for t in tables:
        if getattr(t, "_stored_at", None):
            _delete(t.sparkSession, t._stored_at)


def forget_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that shuffle files of tables that are stored by now go from the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in the one column of ``ids``; rows without an id stay. The ids are written and
    counted; up to MOST_IDS of them are broadcast, so no text is shuffled, and more are left to a join by shuffle."""
    bad = stored(ids.select(F.col(ids.columns[0]).alias("_bad")).where("_bad is not null").distinct(), "ids")
    return docs.join(F.broadcast(bad) if bad.count() <= MOST_IDS else bad, F.col(doc_id) == F.col("_bad"), "left_anti")


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: What empties memories that outlast a task in a worker process.
KEPT: list[Callable[[], None]] = []


def fresh_worker() -> None:
    """Gives back what other operators' tasks have left in this worker process, which Spark uses again."""
    for forget in KEPT:
        forget()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers that scatters them."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


class Memo(dict):
    """A dictionary that computes what it lacks and starts anew beyond ``limit`` entries."""

    def __init__(self, compute, limit: int = 150_000):
        super().__init__()
        self._compute, self._limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self._limit:
            self.clear()
        value = self[key] = self._compute(key)
        return value


LETTERS = re.compile(r"[^\W\d_]+")
