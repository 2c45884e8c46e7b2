"""Content-addressed store of token-id streams.

A text's ids and its end token are cut where a rolling hash over WINDOW ids has its low bits zero, between
LEAST and MOST ids, so equal passages give equal chunks wherever they stand. A chunk is stored once, under the BLAKE2b
digest of its ids. A document's recipe lists its chunks' digests and their Merkle root; recipes are range-partitioned and
sorted by document id, and the manifest has, for each range, its documents, ids and the Merkle root
over its recipes. The layout in the store's folder, all Parquet:

kind=chunk/bucket=-1   key (digest), ids (little-endian integers, 2 bytes each if the vocabulary allows, else 4)
kind=recipe/bucket=r   doc_id, row (its number in the range), start (ids before it in the range), n_tokens, keys (digests
                       one after another), root
kind=range/bucket=r    row (number of documents), n_tokens, root

Reading back checks each chunk against its digest, each recipe against its root and length, and each range against the
manifest; anything missing or altered is an error. Null and empty texts have the end token only. Null ids sort first; rows
with equal ids stand next to each other, in the order of their roots. An empty table gives an empty store and result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.llm.common import mixed, shuffle_parts
from polyview.llm.tokens import encoder

WINDOW, MASK, LEAST, MOST = 4, 511, 128, 2048
DIGEST = 16
_SCHEMA = "kind string, bucket int, doc_id {id}, row long, start long, n_tokens long, keys binary, root binary, key binary, ids binary"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; a last odd node moves up as it is."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


class Tree:
    """merkle() of leaves that come one at a time, with a logarithmic number of nodes in memory."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        node = (0, digest(b"\0" + leaf))
        while self.nodes and self.nodes[-1][0] == node[0]:
            node = (node[0] + 1, digest(b"\1" + self.nodes.pop()[1] + node[1]))
        self.nodes.append(node)

    def root(self) -> bytes:
        if not self.nodes:
            return digest(b"")
        out = self.nodes[-1][1]
        for _, left in reversed(self.nodes[:-1]):
            out = digest(b"\1" + left + out)
        return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    return next(iter(all_cuts(ids, np.array([len(ids)]))), [])


def all_cuts(ids: np.ndarray, lengths: np.ndarray) -> Iterator[list[int]]:
    """Ends of the chunks of each of several id streams that stand one after another, counted from the stream's start. The rolling
    hash runs over all of them at once; windows that reach over a border end within LEAST of it and cut nothing."""
    n = len(ids)
    ends = np.empty(0, np.int64)
    if n >= WINDOW:
        one = mixed(ids.astype(np.uint64) + np.uint64(1))
        h = one[: n - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + one[k : n - WINDOW + 1 + k]
        ends = np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0) + WINDOW
    stop = np.cumsum(lengths)
    start = stop - lengths
    lo, hi = np.searchsorted(ends, start + LEAST), np.searchsorted(ends, stop)
    for first, n, a, b in zip(start.tolist(), lengths.tolist(), lo.tolist(), hi.tolist(), strict=True):
        out, at = [], 0
        for e in [*(ends[a:b] - first).tolist(), n] if a < b else [n]:
            while e - at > MOST:
                at += MOST
                out.append(at)
            if e - at >= LEAST or e == n and e > at:
                at = e
                out.append(at)
        yield out


def leaf(doc_id: object, n_tokens: int, root: bytes) -> bytes:
    return f"{doc_id}|{n_tokens}|".encode() + root


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 2, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> None:
    """One pass over the texts and one shuffle of chunks and recipes. width: bytes of a stored id."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranges = ranges or parts
    bounds = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 1000)).first()[0] if ranges > 1 else []
    bounds = sorted(set(bounds or []))  # fewer than the number of ranges
    number = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]).cast(f"array<{kind}>"), lambda x: x <= F.col("doc_id"))) if bounds else F.lit(0)
    schema = _SCHEMA.format(id=kind)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer, True, f"<u{width}")
        end, seen = np.array([end_id], f"<u{width}").tobytes(), set()
        for b in batches:
            recipes, chunks = [], []
            for raws in tool.by_step(b.column("text").to_pylist()):
                raws = [raw + end for raw in raws]
                ids = np.frombuffer(b"".join(raws), f"<u{width}")
                for raw, ends in zip(raws, all_cuts(ids, np.array([len(raw) // width for raw in raws], np.int64)), strict=True):
                    keys, at = [], 0
                    for e in ends:
                        own = raw[at * width : e * width]
                        at = e
                        keys.append(digest(own))
                        if keys[-1] not in seen:
                            if len(seen) > 300_000:
                                seen.clear()
                            seen.add(keys[-1])
                            chunks.append((keys[-1], own))
                    recipes.append((at, b"".join(keys), merkle(keys)))
            none = lambda n, t: pa.nulls(n, t)
            n = len(recipes)
            yield pa.RecordBatch.from_arrays([pa.array(["recipe"] * n), b.column("bucket"), b.column("doc_id"), none(n, pa.int64()), none(n, pa.int64()), pa.array([r[0] for r in recipes], pa.int64()), pa.array([r[1] for r in recipes], pa.binary()), pa.array([r[2] for r in recipes], pa.binary()), none(n, pa.binary()), none(n, pa.binary())], NAMES)
            for k in range(0, len(chunks), 2000):
                part = chunks[k : k + 2000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * n), pa.array([-1] * n, pa.int32()), none(n, b.column("doc_id").type), *(none(n, pa.int64()) for _ in range(3)), none(n, pa.binary()), none(n, pa.binary()), pa.array([c[0] for c in part], pa.binary()), pa.array([c[1] for c in part], pa.binary())], NAMES)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by kind, range, id and key: drops repeated chunks, numbers recipes, adds the ranges' rows."""
        last, at, tree, row, start = None, None, Tree(), 0, 0

        def closing(b: pa.RecordBatch) -> pa.RecordBatch:
            one = {"kind": ["range"], "bucket": pa.array([at], pa.int32()), "row": [row], "n_tokens": [start], "root": pa.array([tree.root()], pa.binary())}
            return pa.RecordBatch.from_arrays([pa.array(one[f.name], f.type) if f.name in one else pa.nulls(1, f.type) for f in b.schema], schema=b.schema)

        b = None
        for b in batches:
            kinds, keys = b.column("kind").to_pylist(), b.column("key").to_pylist()
            keep = []
            for k in range(len(kinds)):
                if kinds[k] == "chunk":
                    if keys[k] != last:
                        last = keys[k]
                        keep.append(k)
            if keep:
                yield b.take(pa.array(keep, pa.int64()))
            own = [k for k in range(len(kinds)) if kinds[k] == "recipe"]
            if own:
                r = b.take(pa.array(own, pa.int64()))
                rows, starts = [], []
                for bucket, i, n, root in zip(r.column("bucket").to_pylist(), r.column("doc_id").to_pylist(), r.column("n_tokens").to_pylist(), r.column("root").to_pylist(), strict=True):
                    if bucket != at:
                        if at is not None:
                            yield closing(b)
                        at, tree, row, start = bucket, Tree(), 0, 0
                    rows.append(row)
                    starts.append(start)
                    tree.add(leaf(i, n, root))
                    row, start = row + 1, start + n
                r = r.set_column(3, "row", pa.array(rows, pa.int64())).set_column(4, "start", pa.array(starts, pa.int64()))
                yield r
        if at is not None:
            yield closing(b)

    out = docs.withColumn("bucket", number.cast("int")).mapInArrow(encoded, schema)
    out = out.repartition(parts, "kind", "bucket", "key").sortWithinPartitions("kind", "bucket", F.col("doc_id").asc_nulls_first(), "key", "root")
    out.mapInArrow(finished, schema).write.option("compression", "zstd").partitionBy("kind", "bucket").parquet(path)


NAMES = ["kind", "bucket", "doc_id", "row", "start", "n_tokens", "keys", "root", "key", "ids"]


def _part(spark: SparkSession, path: str, kind: str, id_type: str) -> DataFrame:
    return spark.read.schema(_SCHEMA.format(id=id_type)).parquet(path).where(F.col("kind") == kind)


def _shifts(bits: int = 32) -> list[list[int]]:
    """Tables that append 2^k zero bytes to a crc32, four of 256 entries one after another for each k."""
    step = [0xEDB88320, *(1 << k for k in range(31))]

    def times(m: list[int], v: int) -> int:
        out, k = 0, 0
        while v:
            if v & 1:
                out ^= m[k]
            v, k = v >> 1, k + 1
        return out

    square = lambda m: [times(m, x) for x in m]
    m, out = square(square(square(step))), []
    for _ in range(bits):
        out.append([times(m, x << 8 * byte) for byte in range(4) for x in range(256)])
        m = square(m)
    return out


_TABLES: list[list[int]] = []


def joined_crc(a: int, b: int, length: int) -> int:
    """crc32 of two byte strings one after the other, from theirs and the second's length."""
    if not _TABLES:
        _TABLES.extend(_shifts())
    k = 0
    while length:
        if length & 1:
            t = _TABLES[k]
            a = t[a & 255] ^ t[256 + (a >> 8 & 255)] ^ t[512 + (a >> 16 & 255)] ^ t[768 + (a >> 24)]
        length, k = length >> 1, k + 1
    return a ^ b


def _checked(width: int):
    """Chunk rows to (key, n, crc of the ids as 32-bit integers), each checked against its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ns, crcs = [], [], []
            for key, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if digest(ids) != key:
                    raise ValueError(f"chunk {key.hex()} is altered")
                keys.append(key)
                ns.append(len(ids) // width)
                crcs.append(zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())], ["key", "n", "crc"])

    return run


def _starts(spark: SparkSession, path: str, id_type: str) -> dict[int, int]:
    """ids before each range; one row a range is read."""
    out, at = {}, 0
    for r in sorted(_part(spark, path, "range", id_type).select("bucket", "n_tokens").collect(), key=lambda r: r[0]):
        out[r[0]] = at
        at += r[1]
    return out


def _references(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    """A row for each place of a chunk in a recipe."""
    recipes = _part(spark, path, "recipe", id_type).select("bucket", "row", "doc_id", "start", "n_tokens", "keys", "root")
    places = F.transform(F.sequence(F.lit(0), (F.length("keys") / DIGEST).cast("int") - 1), lambda k: F.col("keys").substr(k * DIGEST + 1, F.lit(DIGEST)))
    return recipes.select("bucket", "row", F.posexplode(places).alias("pos", "key"))


def read_digests(spark: SparkSession, path: str, id_type: str = "bigint", width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a store, from its chunks, recipes and ranges, all checked.

    A chunk's crc is computed once; a document's follows from its chunks' by appending, so ids themselves aren't shuffled."""
    verify_manifest(spark, path, id_type)
    chunks = _part(spark, path, "chunk", id_type).select("key", "ids").mapInArrow(_checked(width), "key binary, n long, crc long")
    found = _references(spark, path, id_type).join(chunks, "key", "left")
    per = found.groupBy("bucket", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc", "key"))).alias("p"))
    recipes = _part(spark, path, "recipe", id_type).select("bucket", "row", "doc_id", "start", "n_tokens", "root")

    @F.pandas_udf("long")
    def crc(places: pd.Series, total: pd.Series, root: pd.Series) -> pd.Series:
        out = []
        for p, t, r in zip(places, total, root, strict=True):
            a, n = 0, 0
            for x in p:
                if x["n"] is None:
                    raise ValueError(f"chunk {bytes(x['key']).hex()} is missing")
                a = joined_crc(a, int(x["crc"]), 4 * int(x["n"]))
                n += int(x["n"])
            if n != t or merkle([bytes(x["key"]) for x in p]) != bytes(r):
                raise ValueError("a recipe doesn't match its root")
            out.append(a)
        return pd.Series(out, dtype="int64")

    starts = _starts(spark, path, id_type)
    base = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("bucket")) if starts else F.lit(0)
    return recipes.join(per, ["bucket", "row"]).select("doc_id", (F.col("start") + base).cast("long").alias("start"), "n_tokens", crc("p", "n_tokens", "root").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str, id_type: str = "bigint", width: int = 2) -> DataFrame:
    """doc_id and ids (array of int) of every document, put together from its chunks."""
    chunks = _part(spark, path, "chunk", id_type).select("key", "ids")
    per = _references(spark, path, id_type).join(chunks, "key", "left").groupBy("bucket", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("p"))

    @F.pandas_udf("array<int>")
    def ids(places: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b"".join(bytes(x["ids"]) for x in p), f"<u{width}").astype(np.int32) for p in places])

    recipes = _part(spark, path, "recipe", id_type).select("bucket", "row", "doc_id")
    return recipes.join(per, ["bucket", "row"]).select("doc_id", ids("p").alias("ids"))


def verify_manifest(spark: SparkSession, path: str, id_type: str = "bigint") -> bytes:
    """The store's root over its ranges, after each range's recipes were checked against the manifest."""
    recipes = _part(spark, path, "recipe", id_type).select("bucket", "row", "doc_id", "start", "n_tokens", "root").repartition("bucket").sortWithinPartitions("bucket", "row")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, rows, total = None, Tree(), 0, 0
        one = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([rows], pa.int64()), pa.array([total], pa.int64()), pa.array([tree.root()], pa.binary())], ["bucket", "row", "n_tokens", "root"])
        for b in batches:
            for bucket, row, i, start, n, root in zip(*(b.column(c).to_pylist() for c in ("bucket", "row", "doc_id", "start", "n_tokens", "root")), strict=True):
                if bucket != at:
                    if at is not None:
                        yield one()
                    at, tree, rows, total = bucket, Tree(), 0, 0
                if (row, start) != (rows, total):
                    raise ValueError(f"range {bucket} lacks recipes, or they are out of place")
                tree.add(leaf(i, n, root))
                rows, total = rows + 1, total + n
        if at is not None:
            yield one()

    got = {r[0]: (r[1], r[2], bytes(r[3])) for r in recipes.mapInArrow(roots, "bucket int, row long, n_tokens long, root binary").collect()}
    ranges = {r[0]: (r[1], r[2], bytes(r[3])) for r in _part(spark, path, "range", id_type).select("bucket", "row", "n_tokens", "root").collect()}
    said = {k: root for k, (_, _, root) in ranges.items()}
    if got != ranges:
        raise ValueError("the recipes don't match the manifest")
    return merkle([said[k] for k in sorted(said)])
