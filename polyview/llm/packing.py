"""Best-fit packing with exact complements.

Sequences hold ``size`` tokens, so only how many pieces have each length matters: at most ``size`` counts,
however large the corpus. The plan is made from these counts alone. Lengths, sums of two and sums of three
that are exactly ``size`` are looked up in the counts and used as often as all their lengths last, longest
first; the rest is placed best fit, longest first, whole classes of equal pieces into classes of equally
filled sequences at a time. The plan is a list of slots (length, first rank, how many, first sequence,
offset), bounded by the number of lengths, and a piece finds its slot by its rank among those of its length.
Ranks come from per-partition counts, so no key's pieces meet in one task.

Null and empty texts are one piece that is the end token alone. Equal lengths are interchangeable. Rows with
equal ids are packed each for itself; null ids stay null. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyview.llm.common import stored
from polyview.llm.tokens import encoder

#: Rows that a worker gets at a time.
BATCH = 2000


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 4096, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), and for pack(): part and the piece's rank among those of its
    length there."""
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer, False)
        end = np.array([end_id], "<u4").tobytes()
        part, ranks = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in batches:
            rows: dict[str, list] = {k: [] for k in ("of", "piece", "start", "length", "crc", "rank", "ids")}
            for i, raw in enumerate(tool.in_steps(b.column(1).to_pylist())):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    own = raw[at : at + 4 * size]
                    n = len(own) // 4
                    for name, x in (("of", i), ("piece", k), ("start", at // 4), ("length", n), ("crc", zlib.crc32(own)), ("rank", ranks[n])):
                        rows[name].append(x)
                    if with_ids:
                        rows["ids"].append(own)
                    ranks[n] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            data = [b.column(0).take(pa.array(rows["of"], pa.int64())), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc")), pa.array([part] * len(rows["of"]), pa.int32()), pa.array(rows["rank"], pa.int64())]
            if with_ids:
                names, data = [*names, "ids"], [*data, pa.array(rows["ids"], pa.binary())]
            yield pa.RecordBatch.from_arrays(data, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def plan(counts: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """counts[n]: how many pieces have length n. Slots as rows (length, first rank, how many, first sequence, offset)
    and the number of sequences."""
    left, used, slots, total = counts.astype(np.int64).copy(), np.zeros(size + 1, np.int64), [], 0

    def put(length: int, m: int, first: int, offset: int) -> None:
        slots.append((length, int(used[length]), m, first, offset))
        used[length] += m
        left[length] -= m

    def fill(lengths: tuple[int, ...], m: int) -> None:
        nonlocal total
        offset = 0
        for length in lengths:
            put(length, m, total, offset)
            offset += length
        total += m

    if left[size]:
        fill((size,), int(left[size]))
    for a in range(size - 1, (size - 1) // 2, -1):
        b = size - a
        m = int(left[a] // 2 if a == b else min(left[a], left[b]))
        if m:
            fill((a, b), m)
    for a in range(size - 2, (size + 2) // 3 - 1, -1):
        while left[a]:
            b = np.arange((size - a + 1) // 2, min(a, size - a - 1) + 1)
            c = size - a - b
            often = np.minimum(left[b] // np.where(b == c, 2, 1), left[c])
            often = np.minimum(often, left[a] // (1 + (b == a) + (c == a)))
            if not len(b) or not often.max():
                break
            k = int(often.argmax())
            fill((a, int(b[k]), int(c[k])), int(often[k]))
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, how many)
    free = np.zeros(size + 1, bool)

    def leave(space: int, first: int, m: int) -> None:
        if space and m:
            room.setdefault(space, []).append((first, m))
            free[space] = True

    for length in range(size, 0, -1):
        while left[length]:
            k = int(free[length:].argmax()) + length
            if free[k]:
                first, m = room[k].pop()
                free[k] = bool(room[k])
                now = min(m, int(left[length]))
                put(length, now, first, size - k)
                leave(k, first + now, m - now)
                leave(k - length, first, now)
            else:
                fits = size // length
                whole, rest = divmod(int(left[length]), fits)
                for j in range(fits if whole else 0):
                    put(length, whole, total, j * length)
                leave(size - fits * length, total, whole)
                total += whole
                for j in range(rest):
                    put(length, 1, total, j * length)
                leave(size - rest * length, total, bool(rest))
                total += bool(rest)
    return np.array(slots, np.int64).reshape(-1, 5), total


def pack(cut: DataFrame, size: int = 4096) -> DataFrame:
    """A stored table of pieces() with sequence_id and offset in place of part and rank. Also fit for any table that has
    length, part and rank."""
    spark = cut.sparkSession
    counts = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # one row a length
        counts[r["length"]] = r["count"]
    slots, _ = plan(counts, size)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    shared = spark.sparkContext.broadcast((slots[:, 0] << 44 | slots[:, 1], slots))  # as large as the plan, bounded by size
    before = Window.partitionBy("_l").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(F.col("part").alias("_p"), F.col("length").alias("_l")).agg(F.count("*").alias("_n")).select("_p", "_l", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = cut.join(base, (F.col("part") == F.col("_p")) & (F.col("length") == F.col("_l"))).select(*cut.columns, (F.col("_before") + F.col("rank")).alias("_r"))
    kept = [c for c in cut.columns if c not in ("part", "rank")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "_r"))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            own = rows[at]
            data = [*(b.column(n) for n in kept), pa.array(own[:, 3] + rank - own[:, 1], pa.int64()), pa.array(own[:, 4], pa.int64())]
            yield pa.RecordBatch.from_arrays(data, [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in kept) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_texts(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 4096, with_ids: bool = False) -> DataFrame:
    return pack(stored(pieces(docs, tokenizer, end_id, size, with_ids), "pieces", rows=BATCH), size)
