"""Jaccard join of word shingles, size-aware heavy-light.

A text's set has its distinct shingles of ``n`` words in lower case (the whole sequence if it has fewer words; nothing
without words). Two texts link if their sets' Jaccard similarity is at least ``percent`` / 100; the result is each
document's class under the links.

Equal sets are one node from the start. Small sets (light) emit a hash for each of their subsets that could be an
intersection of the needed size, so linked small sets share the key of their intersection itself, and a shared key with fitting
sizes is a link. Large sets (heavy) enter inverted lists: tokens are ordered rarest class first, then by
hash, and of a set of s with required overlap of at least c = ceil(s * percent / 100), the first s - c + k(s) tokens are
listed, where k(s) = SHARED + s // PER; of linked sets, the smaller one of s shares k(s) of these at least. A token's class is the product
of its words' frequencies, as most shingles of rare words are in one text alone; shingles that batches of texts repeat come last.
The boundary is the size that minimises the number of
subsets emitted plus the expected number of list entries scanned, from the sizes of all sets and list lengths measured on a
hash sample of the tokens. Any order of tokens is right; the counts behind it only make lists short.

No list is expanded into all its pairs. Each list first proposes links to one centre, linear in its length; the verified
ones are joined into components; only pairs of a list in different components, with sizes, first shared positions and parity sketches that
allow a link, remain, and all of those are verified. So copies in any number cost links to a centre, and no link between
components is lost. Heavy pairs are verified on the shingles themselves. Equal sets (by a digest of 128 bits) and light pairs rest on hashes: there
a shared key of 64 bits is the intersection.

Null and empty texts have an empty set and link with nothing. Null ids keep a null class and link with nothing. Rows of the
same id count as one document. Only id and text are read; the ids are integers. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.llm.common import drop_stored, fresh_worker, lowered_words, mixed, stored
from polyview.llm.components import components

SHARED, PER = 3, 64
#: Bounds of what is broadcast: frequent tokens and words for the order, and bits of the filter of shared tokens. Beyond them lists
#: get longer and the filter passes more; results stay the same.
FREQUENT, WORDS, FILTER_BITS = 1 << 17, 1 << 16, 1 << 27
#: The boundary is chosen up to this size, at which a set has over 10 ** 20 subsets; this share of tokens is counted to measure lists.
MOST_LIGHT, SAMPLE = 200, 1 << 12
SKETCH = 128
#: Rows that a worker gets at a time.
BATCH = 2000
_BLOCK = 1 << 15
_SKETCH = [f"k{k}" for k in range(SKETCH // 64)]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """The set itself."""
    if not words:
        return set()
    return {tuple(words)} if len(words) < n else set(zip(*(words[k:] for k in range(n)), strict=False))


class WordHashes(dict):
    """Places of words in ``hash`` (64 bits) and ``rank`` (classes of frequency, 0 for all that aren't among the frequent); starts
    anew beyond ``limit`` words."""

    def __init__(self, frequent: tuple[np.ndarray, np.ndarray] | None = None, limit: int = 100_000):
        super().__init__()
        self.limit = limit
        self.classes = {} if frequent is None else dict(zip(frequent[0].tolist(), frequent[1].tolist(), strict=True))
        self.hash, self.rank = np.empty(limit, np.uint64), np.zeros(limit, np.uint16)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        h = xxhash.xxh3_64_intdigest(word)
        self.hash[k], self.rank[k] = h, self.classes.get(h, 0)
        return k

    def places(self, words: list[bytes]) -> np.ndarray:
        """They hold until the next call."""
        if len(self) + len(words) > self.limit:
            self.clear()
            if len(words) > self.limit:  # a very long text
                self.limit = len(words)
                self.hash, self.rank = np.empty(self.limit, np.uint64), np.zeros(self.limit, np.uint16)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def hashed(words: list[bytes], n: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the set's members, ascending, their classes of frequency, and the words' hashes."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    at = known.places(words)
    one, rank = known.hash[at], known.rank[at].astype(np.uint64)
    m = min(n, len(words))
    h, r = one[: len(one) - m + 1].copy(), rank[: len(one) - m + 1].copy()
    for k in range(1, m):
        h = h * _STEP + one[k : len(one) - m + 1 + k]
        r += rank[k : len(one) - m + 1 + k]
    h, first = np.unique(mixed(h + np.uint64(m)), return_index=True)
    return h, r[first], one


def least_overlap(s: int, percent: int) -> int:
    return -(-s * percent // 100)


def needed(s: int) -> int:
    """Tokens that a set of s shares with a larger one it links with, at least, among the listed ones."""
    return SHARED + s // PER


def subsets(h: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Keys and sizes of the subsets that can be an intersection with a set that links."""
    m = mixed(h + _STEP)
    total = int(m.sum(dtype=np.uint64))
    keys, sizes, s = [], [], len(h)
    values = [int(x) for x in m]
    for away in range(s - max(1, least_overlap(s, percent)) + 1):
        for gone in combinations(values, away):
            keys.append((total - sum(gone)) % (1 << 64))
            sizes.append(s - away)
    out = mixed(np.array(keys, np.uint64) + np.array(sizes, np.uint64) * _STEP)
    return out.view(np.int64).tolist(), sizes


def light_cost(s: int, percent: int) -> int:
    return sum(comb(s, k) for k in range(s - max(1, least_overlap(s, percent)) + 1))


def boundary(sizes: dict[int, int], length: float, percent: int) -> int:
    """Largest size of a light set; length: expected entries of a list that a token meets."""
    heavy = lambda s: (s - least_overlap(s, percent) + needed(s)) * (1 + length)
    # With too few tokens to share as many, a set is light whatever it costs.
    first = max(s for s in range(1, MOST_LIGHT) if least_overlap(s, percent) < needed(s) + 1)
    best, cost, now = first, 0.0, 0.0
    for b in range(first + 1, MOST_LIGHT + 1):
        now += sizes.get(b, 0) * (light_cost(b, percent) - heavy(b))
        if now < cost:
            best, cost = b, now
    return best


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """One pass: kind 0, tokens frequent within a batch with their counts there; 1, small sizes; 2, the hash sample; 3, words
    frequent within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        known = WordHashes()
        none = np.empty(0, np.uint64)
        for b in batches:
            sets = [hashed(lowered_words(t), n, known) for t in b.column("text").to_pylist()]
            token, count = np.unique(np.concatenate([none, *(s[0] for s in sets)]), return_counts=True)
            word, many = np.unique(np.concatenate([none, *(s[2] for s in sets)]), return_counts=True)
            often, some, usual = count >= max(4, len(sets) // 250), token % np.uint64(SAMPLE) == 0, many >= 8
            size, of = np.unique([len(s[0]) for s in sets if 0 < len(s[0]) <= MOST_LIGHT], return_counts=True)
            kind = np.repeat([0, 1, 2, 3], [often.sum(), len(size), some.sum(), usual.sum()])
            key = np.concatenate([token[often], size.astype(np.uint64), token[some], word[usual]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(np.concatenate([count[often], of, count[some], many[usual]]), pa.int64())], ["kind", "key", "n"])

    return docs.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _frequent(survey: DataFrame, kind: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys of a kind, ascending, and twice the logarithm of their counts."""
    top = survey.where(F.col("kind") == kind).orderBy(F.desc("n"), "key").limit(most).toPandas()
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.round(2 * np.log2(top["n"].to_numpy(np.float64))).astype(np.int64)[order]


def _sets(docs: DataFrame, n: int, percent: int, light: int, frequent: tuple, shared: list) -> DataFrame:
    """doc_id, size, same (digest of the set), keys (listed tokens in order), parts and part_sizes (subset keys), and
    sketch: for each of SKETCH buckets of hashes, whether the set has an odd number of tokens there. frequent: tokens, then words.
    shared: gets the broadcast."""
    shared.append(sent := docs.sparkSession.sparkContext.broadcast(frequent))

    def ordered(h: np.ndarray, r: np.ndarray, most: int) -> np.ndarray:
        tokens, rank = sent.value[0]
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
            r = np.where(tokens[at] == h, np.uint64(1 << 14) + rank[at].astype(np.uint64), r)
        at = np.argsort(r << np.uint64(48) | h >> np.uint64(16), kind="stable")[:most]
        return h[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        known = WordHashes(sent.value[1])
        lists = lambda rows, dtype, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([np.empty(0, dtype), *rows]).astype(dtype), kind))
        for b in batches:
            size, same, keys, parts, part_sizes, sketch = [], [], [], [], [], []
            for t in b.column("text").to_pylist():
                h, r, _ = hashed(lowered_words(t), n, known)
                s = len(h)
                size.append(s)
                same.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                odd = np.bincount((h >> np.uint64(32)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
                sketch.append(np.packbits(odd.astype(bool)).view(np.int64))
                heavy = s and s * 100 // percent > light
                keys.append(ordered(h, r, s - least_overlap(s, percent) + needed(s)).view(np.int64) if heavy else np.empty(0, np.int64))
                p = subsets(h, percent) if 0 < s <= light else ([], [])
                parts.append(np.array(p[0], np.int64))
                part_sizes.append(np.array(p[1], np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(same, pa.binary()), lists(keys, np.int64, pa.int64()), lists(parts, np.int64, pa.int64()), lists(part_sizes, np.int64, pa.int64()), lists(sketch, np.int64, pa.int64())], ["doc_id", "size", "same", "keys", "parts", "part_sizes", "sketch"])

    return docs.mapInArrow(run, "doc_id long, size long, same binary, keys array<long>, parts array<long>, part_sizes array<long>, sketch array<long>")


class Bits:
    """A bit for each of FILTER_BITS slots; compressed while it travels."""

    def __init__(self, blocks: dict[int, bytes]):
        self.blocks = blocks
        self._words: np.ndarray | None = None

    def __getstate__(self) -> dict[int, bytes]:
        return self.blocks

    def __setstate__(self, blocks: dict[int, bytes]) -> None:
        self.__init__(blocks)

    def has(self, slot: np.ndarray) -> np.ndarray:
        if self._words is None:
            self._words = np.zeros(FILTER_BITS // 32, np.uint32)
            for b, raw in self.blocks.items():
                self._words[b * _BLOCK : (b + 1) * _BLOCK] = np.frombuffer(zlib.decompress(raw), np.uint32)
        return (self._words[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1


def _bits(slots: DataFrame) -> Bits:
    """A bit for each of FILTER_BITS slots, set where column ``s`` names it; the size is bounded whatever the input."""
    words = slots.groupBy(F.shiftright("s", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("bits"))

    def filled(t: pa.Table) -> pa.Table:
        w, block = t.column("w").to_numpy(), np.zeros(_BLOCK, np.uint32)
        block[w % _BLOCK] = t.column("bits").to_numpy().astype(np.uint32)
        return pa.table({"b": pa.array([w[0] // _BLOCK], pa.int32()), "block": pa.array([zlib.compress(block.tobytes(), 1)], pa.binary())})

    rows = words.groupBy((F.col("w") / _BLOCK).cast("int")).applyInArrow(filled, "b int, block binary").collect()  # FILTER_BITS in all
    return Bits({r["b"]: bytes(r["block"]) for r in rows})


def _shared_filter(sets: DataFrame) -> Bits:
    """The slots of tokens that two or more rows list."""
    keys = sets.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1")
    return _bits(keys.select(F.col("key").bitwiseAND(FILTER_BITS - 1).alias("s")))


def _slot(c: str):
    return F.xxhash64(c).bitwiseAND(FILTER_BITS - 1)


def _having(docs: DataFrame, nodes: DataFrame, shared: list) -> DataFrame:
    """The texts of the nodes and perhaps of some others: a filter of bounded size drops the rest where they are read, so no
    text is shuffled for this. shared: gets the broadcast."""
    shared.append(sent := docs.sparkSession.sparkContext.broadcast(_bits(nodes.select(_slot("node").alias("s")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.flatnonzero(sent.value.has(b.column("slot").to_numpy(zero_copy_only=False)))
            yield b.take(pa.array(keep)).select(["doc_id", "text"])

    return docs.where("doc_id is not null").select("doc_id", "text", _slot("doc_id").alias("slot")).mapInArrow(run, "doc_id long, text string")


def _passed(sets: DataFrame, bits: Bits, shared: list) -> DataFrame:
    """doc_id, size, same, parts, part_sizes, and of keys those that pass, with their places. shared: gets the broadcast."""
    shared.append(sent := sets.sparkSession.sparkContext.broadcast(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("keys")
            values = own.flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(own.offsets.to_numpy())
            keep = sent.value.has(values & (FILTER_BITS - 1))
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(lengths)))]), pa.int32())
            more = [pa.ListArray.from_arrays(offsets, pa.array(x[keep], pa.int64())) for x in (values, place)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("size"), b.column("same"), b.column("parts"), b.column("part_sizes"), b.column("sketch"), *more], ["doc_id", "size", "same", "parts", "part_sizes", "sketch", "keys", "places"])

    return sets.mapInArrow(run, "doc_id long, size long, same binary, parts array<long>, part_sizes array<long>, sketch array<long>, keys array<long>, places array<long>")


def _released(spark: SparkSession, shared: list) -> None:
    """Frees broadcasts whose readers are done, and lets Spark's cleaner delete the shuffle files of plans that are gone."""
    for x in shared:
        x.destroy()
    shared.clear()
    spark.sparkContext._jvm.System.gc()


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose texts link; b repeats more, and its set is kept while it does."""
    shared: list = []
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    texts = stored(_having(docs, nodes, shared), "texts", rows=BATCH)
    _released(docs.sparkSession, shared)
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("t")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        last, own = None, set()
        for x in batches:
            out = []
            a, b = x.column("a"), x.column("b")
            for k, (s, t) in enumerate(zip(x.column("s").to_pylist(), x.column("t").to_pylist(), strict=True)):
                if t != last:
                    last, own = t, shingles(lowered_words(t), n)
                other = shingles(lowered_words(s), n)
                common = len(own & other)
                if 100 * common >= percent * (len(own) + len(other) - common) and common:
                    out.append(k)
            take = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(take), b.take(take)], ["a", "b"])

    links = stored(both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long"), "links", rows=BATCH // 4)
    drop_stored(nodes, texts)
    return links


def classes(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id in the document's class) for each row of docs."""
    docs = _texts(docs, doc_id, text)
    spark, shared = docs.sparkSession, []
    survey = stored(_survey(docs, n), "survey", rows=BATCH)
    frequent = _frequent(survey, 0, FREQUENT), _frequent(survey, 3, WORDS)
    sizes = {r["key"]: r["n"] for r in survey.where("kind = 1").collect()}  # MOST_LIGHT rows at most
    # Rare tokens head the lists; frequent ones are last and don't count.
    met = survey.where("kind = 2").join(survey.where("kind = 0").select("key"), "key", "left_anti").agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
    light = boundary(sizes, float(met or 1.0), percent)
    drop_stored(survey)

    sets = stored(_sets(docs, n, percent, light, frequent, shared), "sets", rows=BATCH)
    _released(spark, shared)
    heads = stored(sets.where("size > 0 and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("node")), "heads")
    own = _passed(sets.where("size > 0 and doc_id is not null"), _shared_filter(sets), shared).where("size(keys) > 0 or size(parts) > 0")
    own = own.join(heads.select("node", F.col("same").alias("_same")), (F.col("doc_id") == F.col("node")) & (F.col("same") == F.col("_same"))).dropDuplicates(["doc_id", "same"])
    own = stored(own.select("node", "size", "keys", "places", "parts", "part_sizes", "sketch"), "own", rows=BATCH)
    _released(spark, shared)

    # Heavy: list entries, of sets that share enough with others; reach: the most that a set can have in common with another.
    enough_listed = f"size(keys) >= {SHARED} + cast(ceil(size * {percent} / 100.0) as long) div {PER}"
    lists = own.where(enough_listed).select("node", "size", (F.col("size") - F.get("places", F.lit(0))).alias("reach"), F.explode(F.arrays_zip("keys", "places")).alias("e"))
    lists = lists.select("node", "size", F.col("e.keys").alias("key"), F.col("e.places").alias("place"), "reach")
    marks = own.select(F.col("node").alias("_own"), *[F.get("sketch", k).alias(c) for k, c in enumerate(_SKETCH)])
    part = own.select("node", "size", F.explode(F.arrays_zip("parts", "part_sizes")).alias("e")).select("node", "size", "e.parts", "e.part_sizes").toDF("node", "size", "key", "common")
    often = part.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("key").alias("_key"))
    part = stored(part.join(often, F.col("key") == F.col("_key"), "left_semi"), "parts")

    # Sizes s and t with overlap c link if 100 c >= percent (s + t - c).
    enough = f"cast(ceil({percent} * (size + size2) / {100 + percent}.0) as long)"
    # Each token in one set alone flips one bit of the sketches' difference at most.
    apart = " + ".join(f"bit_count({c} ^ {c}2)" for c in _SKETCH)
    near = F.expr(f"size + size2 - ({apart}) >= 2 * {enough}")
    may = F.expr(f"least(reach, reach2) >= {enough} and least(size, size2) >= {enough} and least(place, place2) + least(size - place, size2 - place2) >= {enough}")
    sure = F.expr(f"100 * common >= {percent} * (size + size2 - common)")
    pairs = lambda x: x.groupBy("node", "node2").agg(F.count("*").alias("_n"), F.first("size").alias("size"), F.first("size2").alias("size2")).where(f"_n >= {SHARED} + least(size, size2) div {PER}")

    # First to one centre of each list: the entry with the earliest place, which has most in common with the rest.
    rank = F.expr("shiftleft(place, 40) | (xxhash64(node) & 1099511627775L)")
    centre = lists.withColumn("_o", rank).groupBy("key").agg(F.count("*").alias("_n"), F.min_by("node", "_o").alias("node2"), F.min_by("size", "_o").alias("size2"), F.min_by("reach", "_o").alias("reach2"), F.min("place").alias("place2")).where("_n > 1").drop("_n").withColumnRenamed("key", "key2")
    tried = pairs(lists.join(centre, F.expr("key = key2 and node <> node2") & may))
    other = marks.select(*[F.col(c).alias(f"{c}2") for c in marks.columns])
    tried = tried.join(marks, F.col("node") == F.col("_own")).join(other, F.col("node2") == F.col("_own2")).where(near)
    tried = stored(tried.select(F.col("node").alias("a"), F.col("node2").alias("b")), "tried")
    links = _verified(tried, docs, n, percent)
    middle = part.groupBy("key").agg(F.min_by("node", F.expr("shiftleft(size, 40) | (xxhash64(node) & 1099511627775L)")).alias("node2"), F.min("size").alias("size2")).withColumnRenamed("key", "key2")
    small = stored(part.join(middle, F.expr("key = key2 and node <> node2") & sure).select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct(), "links")
    found = components(links.unionByName(small))
    _released(spark, shared)

    # Then all that is left between components.
    def split(table: DataFrame) -> DataFrame:
        in_ = table.join(found.select(F.col("node").alias("_node"), "component"), F.col("node") == F.col("_node"), "left").withColumn("c", F.coalesce("component", "node")).drop("_node", "component")
        in_ = stored(in_, "split")
        mixed_ = in_.groupBy("key").agg(F.min("c").alias("_a"), F.max("c").alias("_b")).where("_a <> _b").select(F.col("key").alias("_key"))
        out = stored(in_.join(mixed_, F.col("key") == F.col("_key"), "left_semi"), "split")
        drop_stored(in_)
        return out

    def between(table: DataFrame, names: list[str], on) -> DataFrame:
        other = table.select(*[F.col(c).alias(f"{c}2") for c in names])
        return table.join(other, F.expr("key = key2 and c <> c2 and node < node2") & on)

    named_ = [F.col("node").alias("a"), F.col("node2").alias("b")]
    sketched = own.where(enough_listed).select("node", "size", "keys", "places", *[F.get("sketch", k).alias(c) for k, c in enumerate(_SKETCH)])
    left = sketched.select("node", "size", (F.col("size") - F.get("places", F.lit(0))).alias("reach"), *_SKETCH, F.explode(F.arrays_zip("keys", "places")).alias("e")).select("node", "size", "reach", *_SKETCH, F.col("e.keys").alias("key"), F.col("e.places").alias("place"))
    left = split(left)
    rest = pairs(between(left, ["key", "node", "size", "place", "reach", "c", *_SKETCH], may & near)).select(*named_)
    done = tried.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"))
    rest = stored(rest.join(done, F.expr("a = _a and b = _b"), "left_anti"), "rest")
    drop_stored(left, tried, own)
    _released(spark, shared)
    mixed_parts = split(part)
    more = _verified(rest, docs, n, percent)
    small2 = stored(between(mixed_parts, ["key", "node", "size", "c"], sure).select(*named_).distinct(), "links")
    drop_stored(mixed_parts, part, rest, found)
    found = components(links.unionByName(small).unionByName(more).unionByName(small2))

    named = heads.join(found.select(F.col("node").alias("_node"), "component"), F.col("node") == F.col("_node"), "left").select(F.col("same").alias("_same"), F.coalesce("component", "node").alias("_c"))
    named = stored(named, "named")
    drop_stored(links, small, more, small2, found, heads)
    _released(spark, shared)
    keep = sets.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.expr("size > 0 and doc_id is not null"), F.col("same")).alias("same"))
    return keep.join(named, F.col("same") == F.col("_same"), "left").select("doc_id", "n_shingles", F.coalesce("_c", "doc_id").alias("component_id"))
