"""Language-model scoring: a hierarchical Pitman-Yor model (Teh, 2006) of words given the word before.

Each context is a restaurant whose dishes are words. The root restaurant is the parent of all contexts, and a table in a
context is a customer of the root; the root's base is uniform over the training vocabulary and one unknown
word. Every word has a restaurant, and so has the start of a text.

Seating is sampled by Gibbs sweeps in blocks: given the contexts' tables T_u and the root's probabilities P(w) of the sweep
before, the c customers of a dish are seated anew one after another, each at a new table with odds
(theta + d T_u) P(w) to (n - d t); beyond EXACT customers, in blocks of a
sixteenth of those seated, with the chance at a block's middle. Dishes are independent then, so a
sweep is a map over partitions of (word, context) counts, followed by sums for the contexts and the words. The
predictive probability (c - d t + (theta + d T_u) P(w)) / (theta + C_u) is averaged over the samples after burn-in, and a text's
score is the sum of log10 of these averages. Discounts come from the counts of counts.

Words outside the common ones are known by 64-bit hashes. The pairs of a batch of texts are counted before they are
shuffled, as sorted compressed columns; a rare word's pairs in common contexts are all in one partition, a common word's are spread by context.
For scoring, the tokens of a batch go to the partition of their pair, those of the most frequent pairs (each over
1 / HOT of all, so fewer than HOT) are scored where they are read; then a document's parts are summed.
What is broadcast is bounded by ``common`` and HOT. Counts cover all training texts.
Pairs in contexts that aren't common are in their contexts' partitions. After each sweep those send the tables of rare words to
the words' partitions, and get the words' root seating back; when scoring, such tokens of rare words take both ways in turn.
A pair that was seen once has one table in every sweep, so such pairs are told to the words' partitions once for all. The number of partitions
follows the training tokens, and there is a message for two partitions only where they have something to say, so never more messages than pairs.

Null and empty texts have the end token alone. Without training texts (N = 0) the model is the base: one unknown word.
Rows are scored each for itself, so repeated ids give repeated rows; null ids stay null. Only id and text are read.
"""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.llm.common import drop_stored, forget_shuffles, mixed, new_path, shuffle_parts, stored
from polyview.llm.wordhash import Places, word_hashes

RARE = np.uint64(1 << 63)
#: A word can't hold white space, so this is no word.
END = xxhash.xxh3_64_intdigest(b"\n")
CONTEXT_BITS, HOT, EXACT = 20, 1 << 17, 128
PART_TOKENS, LEAST_PARTS, BURN_IN, SAMPLES = 2_000_000, 8, 1, 2
#: Marks the rows of pairs that hold what is the same in every sweep.
FIXED = -1
#: Bits of a text's number in its batch.
DOC_BITS = 32
_NEAR, _RARE, _FAR = ((np.uint64, True),), ((np.uint64, True), (np.uint32, False)), ((np.uint64, True), (np.uint64, False))
#: Entries of the totals that are added up in one task.
BLOCK = 4096
_COLUMNS = ("key", "n", "word", "at", "m")
_NONE = np.empty(0, np.uint32)
_PRESS, _OPEN = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_BLOB = "p int, batch long, key binary, n binary, word binary, at binary, m binary"


def squeezed(a: np.ndarray, delta: bool = False) -> bytes:
    """A column as compressed byte planes, ascending ones as differences."""
    if delta:
        a = np.diff(a, prepend=a.dtype.type(0))
    return _PRESS.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T))


def opened(raw: bytes, dtype: type, delta: bool = False) -> np.ndarray:
    planes = np.frombuffer(_OPEN.decompress(raw), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    a = np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
    return np.cumsum(a, dtype=dtype) if delta else a


@dataclass(frozen=True)
class Words:
    """hashes (ascending) and counts of the common words; totals of the training tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    kinds: int
    discount: float
    parts: int

    @property
    def contexts(self) -> int:
        return len(self.hashes) + 1

    def end_code(self) -> int:
        i = int(np.searchsorted(self.hashes, np.uint64(END)))
        return i if i < len(self.hashes) and self.hashes[i] == END else END | 1 << 63


def steps(texts: pa.Array, words: Words, places: Places) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of texts: number of the first, word codes, contexts, and how many tokens each text has."""
    end, start = words.end_code(), len(words.hashes)
    for at, h, n in word_hashes(texts):
        n = n + 1
        stop = np.cumsum(n)
        place, common = places.of(h)
        own = np.ones(stop[-1], bool)
        own[stop - 1] = False
        code = np.full(stop[-1], end, np.uint64)
        code[own] = np.where(common, place.astype(np.uint64), h | RARE)
        context = np.empty(len(code), np.uint64)
        context[1:] = code[:-1]
        context[stop - n] = start
        yield at, code, context, n


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(keys + np.uint64(0x51)) % np.uint64(parts)).astype(np.int64)


def ascending(a: np.ndarray) -> np.ndarray:
    """np.argsort(a, kind="stable") of unsigned integers: sorts their first bits with the places in the last ones, and again
    where the bits that were cut off decide."""
    n = len(a)
    bits, free = n.bit_length(), 64 - int(a.max()).bit_length() if n else 64
    if not n or bits > 24:
        return np.argsort(a, kind="stable")
    low = np.uint64((1 << bits) - 1)
    order = (a.astype(np.uint64) << np.uint64(min(free, 63))) & ~low | np.arange(n, dtype=np.uint64)
    order.sort()
    order = (order & low).astype(np.int64)
    if free < bits:
        b = a[order]
        if (b[1:] < b[:-1]).any():
            order = order[np.argsort(b, kind="stable")]
    return order


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin, and the number of each value's run."""
    first = np.ones(len(a), bool)
    first[1:] = a[1:] != a[:-1]
    return np.flatnonzero(first), np.cumsum(first) - 1


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(a, return_inverse=True)."""
    order = ascending(a)
    at, which = runs(a[order])
    back = np.empty(len(a), np.int64)
    back[order] = which
    return a[order[at]], back


def summed_up(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with sums of n (or how often they occur)."""
    if n is None:
        key = np.sort(key)
        at, _ = runs(key)
        return key[at], np.diff(np.append(at, len(key)))
    order = ascending(key)
    key = key[order]
    at, _ = runs(key)
    total = n[order].astype(np.int64)
    return key[at], np.add.reduceat(total, at) if len(at) else total


def counted(word: np.ndarray, at: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (word, context), ascending, with sums of n (or how often they occur)."""
    words, one = distinct(word)
    contexts, two = distinct(at)
    key, total = summed_up((one * len(contexts) + two).astype(np.uint64), n)
    one, two = np.divmod(key.astype(np.int64), max(1, len(contexts)))
    return words[one], contexts[two], total


def _vocabulary(docs: DataFrame, common: int) -> Words:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.full(len(b), END, np.uint64), *(h for _, h, _ in word_hashes(b.column("text"), 1_000_000))]
            h, n = summed_up(np.concatenate(got))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    table = stored(docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    r = table.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    top = table.orderBy(F.desc("n"), "h").limit(common).toPandas()
    drop_stored(table)
    order = np.argsort(top["h"].to_numpy(np.int64).view(np.uint64))
    tokens = int(r[0] or 0)
    return Words(top["h"].to_numpy(np.int64).view(np.uint64)[order], top["n"].to_numpy(np.int64)[order], tokens, int(r[1]), discount(r[2], r[3]), max(LEAST_PARTS, -(-tokens // PART_TOKENS)))


def discount(once: float, twice: float) -> float:
    """From the counts of counts, kept within (0, 1)."""
    return float(min(0.95, max(0.1, once / max(1.0, once + 2.0 * twice))))


def _row(p: int, batch: int, key: np.ndarray, n: np.ndarray, word: np.ndarray, at: np.ndarray, m: np.ndarray) -> tuple:
    return p, batch, squeezed(key, True), squeezed(n.astype(np.uint32)), squeezed(word, True), squeezed(at.astype(np.uint32)), squeezed(m.astype(np.uint32))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["p", "batch", *_COLUMNS])


def _dealt(parts: int, *tables: tuple[np.ndarray, tuple[np.ndarray, ...]]) -> Iterator[tuple[int, list[tuple[np.ndarray, ...]]]]:
    """For each partition, the rows of each table that are dealt to it, in their order."""
    cut = []
    for p, columns in tables:
        p = p.astype(np.min_scalar_type(parts))  # short ones are sorted fast
        order = np.argsort(p, kind="stable")
        cut.append((np.searchsorted(p[order], np.arange(parts + 1)), [c[order] for c in columns]))
    for k in range(parts):
        own = [tuple(c[b[k] : b[k + 1]] for c in columns) for b, columns in cut]
        if any(len(o[0]) for o in own):
            yield k, own


def pair_keys(code: np.ndarray, context: np.ndarray) -> np.ndarray:
    return code << np.uint64(CONTEXT_BITS) | context.astype(np.uint64)


def _pair_counts(docs: DataFrame, words: Words) -> DataFrame:
    """p, and its pairs of common words (key, n) and of rare words (word, at, m) in common contexts; one row a partition.
    From ``parts`` on, those of rare contexts: context (in key), word and n."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(shared.value.hashes)
        for b in batches:
            for _, code, context, _ in steps(b.column("text"), shared.value, places):
                far = context >= RARE
                rare, known = (code >= RARE) & ~far, (code < RARE) & ~far
                key, n = summed_up(pair_keys(code[known], context[known]))
                word, at, m = counted(code[rare], context[rare])
                dealt = _dealt(shared.value.parts, (part_of(key, shared.value.parts), (key, n)), (part_of(word, shared.value.parts), (word, at, m)))
                rows = [_row(p, 0, *a, *c) for p, (a, c) in dealt]
                key, word, n = counted(context[far], code[far])
                rows += [_row(shared.value.parts + q, 0, u, k, w, _NONE, _NONE) for q, ((u, w, k),) in _dealt(shared.value.parts, (part_of(key, shared.value.parts), (key, word, n)))]
                for k in range(0, len(rows), 64):
                    yield _batch(rows[k : k + 64])

    def merged(t: pa.Table) -> pa.Table:
        p = t.column("p")[0].as_py()
        key, n, word, at, m = _all(t)
        if p >= shared.value.parts:
            key, word, n = counted(key, word, n)
            return pa.Table.from_batches([_batch([_row(p, 0, key, n, word, _NONE, _NONE)])])
        return pa.Table.from_batches([_batch([_row(p, 0, *summed_up(key, n), *counted(word, at, m))])])

    return docs.mapInArrow(run, _BLOB).groupBy("p").applyInArrow(merged, _BLOB)


def _all(t: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    kinds = ((np.uint64, True), (np.uint32, False), (np.uint64, True), (np.uint32, False), (np.uint32, False))
    return [np.concatenate([np.empty(0, d), *(opened(x, d, delta) for x in t.column(c).to_pylist())]) for c, (d, delta) in zip(_COLUMNS, kinds, strict=True)]


@dataclass(frozen=True)
class State:
    """What a sweep needs of the one before. tables, customers: by context; p_common: root probability of the common
    words; root_*: totals of the root."""

    tables: np.ndarray
    customers: np.ndarray
    p_common: np.ndarray
    root_customers: float
    root_tables: float
    d: float
    d0: float
    theta: float
    theta0: float
    unknown: float  # base probability of one word

    def new_mass(self) -> float:
        return self.theta0 + self.d0 * self.root_tables

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.d0 * tables + self.new_mass() * self.unknown) / (self.theta0 + self.root_customers)

    def pair(self, n: np.ndarray, t: np.ndarray, context: np.ndarray, parent: np.ndarray) -> np.ndarray:
        c = self.customers[context]
        return np.where(c > 0, (n - self.d * t + (self.theta + self.d * self.tables[context]) * parent) / (self.theta + c), parent)


def seated(n: np.ndarray, new: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that n customers of one dish take, where ``new`` is the weight of a new table."""
    n = n.astype(np.int64)
    t = np.minimum(n, 1).astype(np.float64)
    live = np.flatnonzero(n > 1)
    sat = 1
    while len(live):
        step = 1 if sat < EXACT else sat // 16
        block = np.minimum(n[live] - sat, step)
        chance = new[live] / (new[live] + np.maximum(sat + (block - 1) / 2 - d * t[live], 1e-9))
        t[live] += rng.random(len(live)) < chance if sat < EXACT else rng.binomial(block, chance)
        sat += step
        live = live[n[live] > sat]
    return t


def lookup(names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x among ascending names, and whether it is there."""
    place = np.minimum(np.searchsorted(names, x), max(0, len(names) - 1))
    return place, names[place] == x if len(names) else np.zeros(len(x), bool)


def common_tables(columns: list[np.ndarray], state: State, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, word and new seating of a partition's pairs of common words."""
    context = (columns[0] & np.uint64((1 << CONTEXT_BITS) - 1)).astype(np.int64)
    code = (columns[0] >> np.uint64(CONTEXT_BITS)).astype(np.int64)
    return context, code, seated(columns[1], (state.theta + state.d * state.tables)[context] * state.p_common[code], state.d, rng)


Said = list[tuple[int, bytes, bytes, bytes, bytes]]


def _parted(t: pa.Table) -> tuple[list[np.ndarray], dict[int, Said], tuple[np.ndarray, np.ndarray]]:
    """A partition's pairs; by sweep what other partitions say to it: their number, key, n, word and m; and rare words in pairs of rare
    contexts that were seen once, with the number of these."""
    said: dict[int, Said] = {}
    batch = t.column("batch").to_numpy()
    for k in np.flatnonzero(batch > 0):
        tag = int(batch[k]) - 1
        said.setdefault(tag >> 32, []).append((tag & 0xFFFFFFFF, *(t.column(c)[int(k)].as_py() for c in ("key", "n", "word", "m"))))
    return _all(t.filter(pa.array(batch == 0))), said, _fixed(t.filter(pa.array(batch == FIXED)))


def _fixed(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    names = [opened(x, np.uint64, True) for x in t.column("key").to_pylist()]
    names, which = distinct(np.concatenate([np.empty(0, np.uint64), *names]))
    return names, np.bincount(which, np.concatenate([_NONE, *(opened(x, np.uint32) for x in t.column("n").to_pylist())]), len(names)).astype(np.int64)


def _once(pairs: DataFrame, words: Words) -> DataFrame:
    """A row for each partition of rare words: those in pairs of rare contexts that were seen once, and how often they are."""
    parts = words.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                _, n, word, _, _ = _all(b.slice(k, 1))
                names, many = summed_up(word[(word >= RARE) & (n == 1)])
                rows = [(q, FIXED, squeezed(w, True), squeezed(m.astype(np.uint32)), None, None, None) for q, ((w, m),) in _dealt(parts, (part_of(names, parts), (names, many)))]
                for at in range(0, len(rows), 64):
                    yield _batch(rows[at : at + 64])

    def merged(t: pa.Table) -> pa.Table:
        names, many = _fixed(t)
        return pa.Table.from_batches([_batch([(t.column("p")[0].as_py(), FIXED, squeezed(names, True), squeezed(many.astype(np.uint32)), None, None, None)])])

    return pairs.where(F.col("p") >= parts).mapInArrow(run, _BLOB).groupBy("p").applyInArrow(merged, _BLOB)


def _bucketed(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, bucketed by p, so that grouping by p needs no shuffle."""
    spark = df.sparkSession
    path = new_path(spark, "pairs")
    name = f"polyview_pairs_{path[-12:]}"
    df.write.bucketBy(shuffle_parts(spark), "p").option("path", path).saveAsTable(name)

    def leave() -> None:
        with contextlib.suppress(Exception):  # the session may be gone before this runs
            spark.sql(f"DROP TABLE IF EXISTS {name}")

    atexit.register(leave)
    return spark.table(name)


def _far(said: Said, fixed: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rare words that follow rare contexts: their tables and how often they do."""
    names = [opened(key, np.uint64, True) for _, key, *_ in said]
    names, which = distinct(np.concatenate([np.empty(0, np.uint64), *names, fixed[0]]))
    tables, n = (np.concatenate([_NONE, *(opened(x[k], np.uint32) for x in said), fixed[1]]) for k in (4, 2))
    return names, np.bincount(which, tables, len(names)), np.bincount(which, n, len(names)).astype(np.int64)


def sample(columns: list[np.ndarray], state: State | None, rng: np.random.Generator, said: Said, fixed: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """New seating of a partition's pairs in common contexts, and root seating of its rare words, whose tables in rare
    contexts are those of the sweep before. Without a state, one table a pair."""
    key, n, word, at, m = columns
    far_names, far_tables, far_n = _far(said, fixed)
    begin, which = runs(word)
    names, _ = summed_up(np.concatenate([word[begin], far_names]))
    which, at = np.searchsorted(names, word[begin])[which], at.astype(np.int64)
    more, seen = np.zeros(len(names)), np.bincount(which, m, len(names)).astype(np.int64)
    there = np.searchsorted(names, far_names)
    more[there] = far_tables
    seen[there] += far_n
    tables, customers, under = np.ones(len(word)), np.bincount(which, minlength=len(names)) + more, np.ones(len(names))
    if state is None:
        context, code = (key & np.uint64((1 << CONTEXT_BITS) - 1)).astype(np.int64), (key >> np.uint64(CONTEXT_BITS)).astype(np.int64)
        t = np.ones(len(key))
    else:
        context, code, t = common_tables(columns, state, rng)
        weight = state.theta + state.d * state.tables
        for _ in range(2):  # the rare words' root seating and their contexts' in turn
            under = seated(customers, np.full(len(names), state.new_mass() * state.unknown), state.d0, rng)
            parent = state.root(customers, under)
            tables = seated(m, weight[at] * parent[which], state.d, rng)
            customers = np.bincount(which, tables, len(names)) + more
        under = seated(customers, np.full(len(names), state.new_mass() * state.unknown), state.d0, rng)
    return {"code": code, "context": context, "t": t, "names": names, "which": which, "at": at, "tables": tables, "customers": customers, "under": under, "seen": seen}


def far_sample(columns: list[np.ndarray], state: State | None, rng: np.random.Generator, said: Said, p: int) -> dict[str, np.ndarray]:
    """New seating of a partition's pairs in rare contexts, given those contexts' tables and the root's seating of the sweep before."""
    key, n, word, _, _ = columns
    begin, which = runs(key)
    contexts = key[begin]
    t = np.ones(len(word))
    rare = word >= RARE
    more = np.flatnonzero(n > 1)  # the others have one table each
    if state is not None and len(more):
        tables = np.bincount(which, minlength=len(contexts)).astype(float)
        own = which[more]
        tables[own[runs(own)[0]]] = np.concatenate([_NONE, *(opened(x[4], np.uint32) for x in said if x[0] == p)])
        names = np.concatenate([np.empty(0, np.uint64), *(opened(x[1], np.uint64, True) for x in said if x[0] != p)])
        held = np.concatenate([np.empty(0), *(opened(x[3], float) for x in said if x[0] != p)])
        order = ascending(names)
        parent, own = np.empty(len(more)), word[more]
        far = rare[more]
        parent[~far] = state.p_common[own[~far].astype(np.int64)]
        parent[far] = state.root(held[order][np.searchsorted(names[order], own[far])], 0.0)
        t[more] = seated(n[more], (state.theta + state.d * tables[which[more]]) * parent, state.d, rng)
    return {"contexts": contexts, "which": which, "rare": rare, "more": more, "t": t, "tables": np.bincount(which, t, len(contexts)), "customers": np.bincount(which, n, len(contexts))}


def _rng(seed: int, sweep: int, p: int) -> np.random.Generator:
    return np.random.default_rng([seed, max(0, sweep), p])


def _sums(pairs: DataFrame, said: DataFrame | None, words: Words, state: State | None, seed: int, sweep: int) -> tuple[np.ndarray, DataFrame]:
    """Totals over all partitions of a sweep: tables and customers by common context, root customers by common word, and
    rare words' root customers and tables, pairs seen once and twice; few rows reach the driver. And what partitions say
    to each other: rare contexts' partitions their tables by rare word, and rare words' partitions their root seating."""
    shared = pairs.sparkSession.sparkContext.broadcast((words.contexts, len(words.hashes), words.parts, state))
    tag = (max(0, sweep) << 32) + 1

    def run(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
        contexts, common, parts, now = shared.value
        total = np.zeros(2 * contexts + common + 4)
        t = left if right is None else pa.concat_tables([left, right.cast(left.schema)])
        p = t.column("p")[0].as_py()
        columns, heard, fixed = _parted(t)
        heard = next(iter(heard.values()), [])
        key, n, word, at, m = columns
        rows = []
        if p < parts:
            got = sample(columns, now, _rng(seed, sweep, p), heard, fixed)
            total[:contexts] += np.bincount(got["context"], got["t"], contexts) + np.bincount(got["at"], got["tables"], contexts)
            total[contexts : 2 * contexts] += np.bincount(got["context"], n, contexts) + np.bincount(got["at"], m, contexts)
            total[2 * contexts : -4] += np.bincount(got["code"], got["t"], common)
            total[-4:] += [got["customers"].sum(), got["under"].sum(), (n == 1).sum() + (m == 1).sum(), (n == 2).sum() + (m == 2).sum()]
            held = got["customers"] - words_d0 * got["under"]
            for src, asked, *_ in heard:
                rows.append((src, tag + p, asked, None, squeezed(held[np.searchsorted(got["names"], opened(asked, np.uint64, True))]), None, None))
        else:
            got = far_sample(columns, now, _rng(seed, sweep, p), heard, p)
            rare = got["rare"]
            total[2 * contexts : -4] += np.bincount(word[~rare].astype(np.int64), got["t"][~rare], common)
            total[-2:] += [(n == 1).sum(), (n == 2).sum()]
            more = got["more"]
            rows.append((p, tag + p, None, None, None, None, squeezed(got["tables"][summed_up(got["which"][more])[0]].astype(np.uint32))))
            said_ = more[rare[more]]
            names, which = distinct(word[said_])
            tables, seen = (np.bincount(which, x[said_], len(names)).astype(np.uint32) for x in (got["t"], n))
            for q, ((w, x, y),) in _dealt(parts, (part_of(names, parts), (names, tables, seen))):
                rows.append((q, tag + p, squeezed(w, True), squeezed(y), None, None, squeezed(x)))
        for k in range(0, len(total), BLOCK):
            if total[k : k + BLOCK].any():
                rows.append((-1 - k // BLOCK, 0, squeezed(total[k : k + BLOCK]), None, None, None, None))
        return pa.Table.from_batches([_batch(rows)])

    words_d0 = words.discount

    def added(t: pa.Table) -> pa.Table:
        """A block's total over the partitions."""
        total = sum(opened(raw, float) for raw in t.column("key").to_pylist())
        return pa.table({"k": pa.array([-1 - t.column("p")[0].as_py()], pa.int32()), "s": pa.array([total.tobytes()], pa.binary())})

    made = pairs.groupBy("p").applyInArrow(lambda t: run(t), _BLOB) if said is None else pairs.groupBy("p").cogroup(said.groupBy("p")).applyInArrow(lambda left, right: run(left, right), _BLOB)
    out = stored(made, "sweep")
    shared.destroy()
    total = np.zeros(2 * words.contexts + len(words.hashes) + 4)
    for r in out.where("p < 0").groupBy("p").applyInArrow(added, "k int, s binary").collect():  # as long as total
        own = np.frombuffer(bytes(r["s"]))
        total[r["k"] * BLOCK : r["k"] * BLOCK + len(own)] = own
    kept = out.where("p >= 0")
    kept._stored_at = out._stored_at
    return total, kept


def _state(total: np.ndarray, words: Words, before: State | None, rng: np.random.Generator, theta: float, theta0: float) -> State:
    """The state after a sweep: the root's common words are seated here, from their customers."""
    contexts = words.contexts
    customers = total[2 * contexts : -4]
    d = discount(total[-2], total[-1]) if before is None else before.d
    base = State(total[:contexts], total[contexts : 2 * contexts], np.zeros(len(customers)), float(customers.sum() + total[-4]), float(total[-3] + (customers > 0).sum()) if before is None else before.root_tables, d, words.discount, theta, theta0, 1.0 / (words.kinds + 1))
    under = seated(customers, np.full(len(customers), base.new_mass() * base.unknown), base.d0, rng)
    base = replace(base, root_tables=float(under.sum() + total[-3]))
    return replace(base, p_common=base.root(customers, under))


@dataclass(frozen=True)
class Model:
    """sweeps: (number, state before, state after) of each sample kept."""

    words: Words
    sweeps: list[tuple[int, State, State]]
    seed: int

    def common_probabilities(self, columns: list[np.ndarray], p: int) -> np.ndarray:
        """Averages for a partition's pairs of common words."""
        out = 0.0
        for sweep, before, after in self.sweeps:
            context, code, t = common_tables(columns, before, _rng(self.seed, sweep, p))
            out = out + after.pair(columns[1], t, context, after.p_common[code])
        return out / len(self.sweeps)

    def pair_probabilities(self, columns: list[np.ndarray], p: int, said: dict[int, Said], fixed: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Averages for a partition's common pairs and rare pairs; distinct rare words, their root probabilities by
        sample, and how often each was seen."""
        _, n, _, _, m = columns
        one, two, roots = 0.0, 0.0, []
        for sweep, before, after in self.sweeps:
            s = sample(columns, before, _rng(self.seed, sweep, p), said.get(sweep - 1, []), fixed)
            root = after.root(s["customers"], s["under"])
            roots.append(root)
            one = one + after.pair(n, s["t"], s["context"], after.p_common[s["code"]])
            two = two + after.pair(m, s["tables"], s["at"], root[s["which"]])
        return one / len(self.sweeps), two / len(self.sweeps), s["names"], np.array(roots), s["seen"]

    def far_scores(self, columns: list[np.ndarray], p: int, said: dict[int, Said], tokens: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]) -> list[np.ndarray]:
        """Average probabilities of tokens (context, word, root probabilities by sample if rare) after rare contexts."""
        key, n, word, _, _ = columns
        begin, _ = runs(key)
        bounds = key[begin], begin
        ends = np.append(bounds[1][1:], len(key))
        out = [0.0] * len(tokens)
        places = []
        for context, w, _ in tokens:
            place, known = lookup(bounds[0], context)
            spot, seen = np.zeros(len(w), np.int64), np.zeros(len(w), bool)
            if len(key):
                lo, hi = bounds[1][place].copy(), ends[place].copy()
                last = hi.copy()
                while (open_ := lo < hi).any():  # by halves within each context's words
                    mid = (lo + hi) // 2
                    less = open_ & (word[np.minimum(mid, len(word) - 1)] < w)
                    lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
                spot = np.minimum(lo, len(word) - 1)
                seen = known & (lo < last) & (word[spot] == w)
            places.append((place, known, spot, seen))
        for k, (sweep, before, after) in enumerate(self.sweeps):
            s = far_sample(columns, before, _rng(self.seed, sweep, p), said.get(sweep - 1, []), p)
            for i, ((_, w, roots), (place, known, spot, seen)) in enumerate(zip(tokens, places, strict=True)):
                parent = after.p_common[w.astype(np.int64)] if roots is None else roots[k]
                if len(key):
                    held = np.where(seen, n[spot] - after.d * s["t"][spot], 0.0)
                    parent = np.where(known, (held + (after.theta + after.d * s["tables"][place]) * parent) / (after.theta + s["customers"][place]), parent)
                out[i] = out[i] + parent / len(self.sweeps)
        return out

    def unseen(self, context: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """Average probability of words not seen in their contexts; roots: by sample and token."""
        none = np.zeros(len(context))
        return np.mean([after.pair(none, none, context, roots[k]) for k, (_, _, after) in enumerate(self.sweeps)], axis=0)


def _hot(pairs: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Keys and probabilities of the pairs that are over 1 / HOT of all tokens: fewer than HOT."""
    shared = pairs.sparkSession.sparkContext.broadcast(model)
    least = max(2, model.words.tokens // HOT + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                p = b.column("p")[k].as_py()
                columns = _all(b.slice(k, 1))
                hot = columns[1] >= least
                if p < shared.value.words.parts and hot.any():
                    one = shared.value.common_probabilities(columns, p)
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0][hot].view(np.int64)), pa.array(one[hot])], ["key", "x"])

    got = pairs.where("batch = 0").mapInArrow(run, "key long, x double").toPandas().sort_values("key")
    return got["key"].to_numpy(np.int64).view(np.uint64), got["x"].to_numpy(float)


def _log_counts(c: np.ndarray) -> np.ndarray:
    return np.log10(c.astype(float) + 1)


def _numbers(doc: np.ndarray) -> np.ndarray:
    """The numbers of texts in their batches."""
    return (doc & ((1 << DOC_BITS) - 1)).astype(np.uint32)


def _gathered(t: pa.Table, batches: np.ndarray, columns: tuple[str, ...], *kinds: tuple[type, bool]) -> list[np.ndarray]:
    """Columns of all batches one after another; the last one's numbers of texts with the row's number before them."""
    out = [np.concatenate([np.empty(0, d), *(opened(x, d, delta) for x in t.column(c).to_pylist())]) for c, (d, delta) in zip(columns[:-1], kinds, strict=True)]
    return [*out, np.concatenate([np.empty(0, np.int64), *(opened(x, np.uint32).astype(np.int64) | k << DOC_BITS for k, x in enumerate(t.column(columns[-1]).to_pylist()))])]


def _by_batch(batches: np.ndarray, doc: np.ndarray, *values: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """By batch: the numbers of the texts that there are, and sums of the values by text."""
    who, back = distinct(doc.astype(np.uint64))
    sums = [np.bincount(back, v, len(who)) for v in values]
    batch = batches[(who >> np.uint64(DOC_BITS)).astype(np.int64)]
    order = np.argsort(batch, kind="stable")
    begin, _ = runs(batch[order])
    return {int(batch[k[0]]): (_numbers(who[k].astype(np.int64)), *(v[k] for v in sums)) for k in np.split(order, begin[1:]) if len(k)}


_PARTS = "p int, batch long, head boolean, id binary, key binary, n binary, word binary, at binary, m binary, x binary, y binary, z binary"


def _home(batch: int) -> int:
    """A group of its own for each batch of texts, for what waits for its sums."""
    return -1 - ((batch >> 32) * 2654435761 + (batch & 0xFFFFFFFF)) % (1 << 30)


def _scored(docs: DataFrame, pairs: DataFrame, said: DataFrame, model: Model, id_type: str) -> DataFrame:
    words = model.words
    hot_keys, hot_values = _hot(pairs, model)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, hot_keys, hot_values))
    names = ["p", "batch", "head", "id", *_COLUMNS, "x", "y", "z"]
    kinds = [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 9]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keys, values = shared.value
        places, number = Places(own.words.hashes), 0
        for b in batches:
            for first, code, context, lengths in steps(b.column("text"), own.words, places):
                batch = TaskContext.get().partitionId() << 32 | number
                number += 1
                doc = np.repeat(np.arange(len(lengths)), lengths).astype(np.uint32)
                far, rare = context >= RARE, code >= RARE
                logs = np.bincount(doc[~rare], _log_counts(own.words.counts)[code[~rare].astype(np.int64)], len(lengths))
                n_known = np.bincount(doc[~rare], minlength=len(lengths))
                key, of = pair_keys(code[~rare & ~far], context[~rare & ~far]), doc[~rare & ~far]
                order = ascending(key)
                key, of = key[order], of[order]
                place, hot = lookup(keys, key)
                score = np.bincount(of[hot], np.log10(hot_values[place[hot]]), len(lengths))
                sink = pa.BufferOutputStream()
                ids = b.column("doc_id").slice(first, len(lengths))
                with pa.ipc.new_stream(sink, pa.schema([("doc_id", ids.type)])) as w:
                    w.write_batch(pa.RecordBatch.from_arrays([ids], ["doc_id"]))
                yield batch_of([(_home(batch), batch, True, sink.getvalue().to_pybytes(), squeezed(lengths.astype(np.uint64)), None, None, None, squeezed(n_known.astype(np.uint32)), squeezed(score), squeezed(logs), None)])
                key, of = key[~hot], of[~hot]
                rows, parts = [], own.words.parts
                near, both = ((part_of(code[k], parts), (code[k], context[k], doc[k])) for k in (o[ascending(code[o])] for o in (np.flatnonzero(rare & ~far), np.flatnonzero(rare & far))))
                for p, (a, c, e) in _dealt(parts, (part_of(key, parts), (key, of)), near, both):
                    rows.append((p, batch, False, None, squeezed(a[0], True), squeezed(a[1]), squeezed(c[0], True), squeezed(c[1].astype(np.uint32)), squeezed(c[2]), squeezed(e[0], True), squeezed(e[1]), squeezed(e[2])))
                k = np.flatnonzero(far & ~rare)
                k = k[ascending(context[k])]
                for q, ((u, w, d),) in _dealt(parts, (part_of(context[k], parts), (context[k], code[k], doc[k]))):
                    rows.append((parts + q, batch, False, None, squeezed(u, True), squeezed(d), squeezed(w.astype(np.uint32)), None, None, None, None, None))
                for k in range(0, len(rows), 64):
                    yield batch_of(rows[k : k + 64])

    def looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums by document of the tokens of one partition, those of all batches at once; the batches' heads pass as they are."""
        if not len(left):
            return left
        own = shared.value[0]
        p, parts = left.column("p")[0].as_py(), own.words.parts
        if p < 0 or p >= parts:
            return left
        columns, said_, fixed = _parted(right)
        one, two, names_, roots, total = own.pair_probabilities(columns, p, said_, fixed)
        pkey, _, pword, pat, _ = columns
        unknown = np.array([after.new_mass() * after.unknown / (after.theta0 + after.root_customers) for _, _, after in own.sweeps])
        batches = left.column("batch").to_numpy()
        (key, of), (word, at, doc), (word2, at2, doc2) = (_gathered(left, batches, c, *kinds_) for c, kinds_ in ((("key", "n"), _NEAR), (("word", "at", "m"), _RARE), (("x", "y", "z"), _FAR)))
        place, seen = lookup(pkey, key)
        x = np.empty(len(key))
        x[seen] = one[place[seen]]
        rest = key[~seen]
        code, context = (rest >> np.uint64(CONTEXT_BITS)).astype(np.int64), (rest & np.uint64((1 << CONTEXT_BITS) - 1)).astype(np.int64)
        x[~seen] = own.unseen(context, np.array([after.p_common[code] for _, _, after in own.sweeps]))

        def rooted(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Places, whether the word is known, its root probabilities by sample, how often it was seen."""
            place, known = lookup(names_, w)
            if not len(names_):
                return place, known, np.repeat(unknown[:, None], len(w), 1), np.zeros(len(w), np.int64)
            return place, known, np.where(known, roots[:, place], unknown[:, None]), np.where(known, total[place], 0)

        place, known, root, c = rooted(word)
        y = own.unseen(at.astype(np.int64), root)
        begin, which = runs(pword)
        join = np.searchsorted(names_, pword[begin])[which].astype(np.uint64) << np.uint64(CONTEXT_BITS) | pat.astype(np.uint64)
        spot, both = lookup(join, place.astype(np.uint64) << np.uint64(CONTEXT_BITS) | at.astype(np.uint64))
        both &= known
        y[both] = two[spot[both]]
        # after rare contexts, words go on to those with their root probabilities
        _, _, root, c2 = rooted(word2)
        order = ascending(at2)
        out = []
        for q, ((u, w, d, *r),) in _dealt(parts, (part_of(at2[order], parts), (at2[order], word2[order], doc2[order], *root[:, order]))):
            out.append((parts + q, 0, False, None, squeezed(u, True), squeezed(_numbers(d)), squeezed(w), None, squeezed(batches[d >> DOC_BITS]), squeezed(np.concatenate(r)), None, None))
        scores = _by_batch(batches, np.concatenate([of, doc]), np.log10(np.concatenate([x, y])))
        c = np.concatenate([c, c2])
        counts = _by_batch(batches, np.concatenate([doc, doc2]), _log_counts(c), c > 0)
        nothing = _NONE, np.empty(0), np.empty(0)
        for k in sorted({*scores, *counts}):
            (who, score), (rare, logs, n_known) = scores.get(k, nothing[:2]), counts.get(k, nothing)
            out.append((_home(k), k, False, None, None, squeezed(who), None, squeezed(rare), squeezed(n_known.astype(np.uint32)), squeezed(score), squeezed(logs), None))
        return pa.Table.from_batches([batch_of(out)])

    def looked_up_far(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums by document of the tokens after one partition's rare contexts; all else passes as it is."""
        own = shared.value[0]
        if not len(left) or left.column("p")[0].as_py() < 0:
            return left
        batches = np.unique(np.concatenate([left.column("batch").to_numpy(), *(opened(a, np.int64) for a in left.column("m").to_pylist() if a is not None)]))
        tokens, docs_ = [], []
        for far in (False, True):  # common words, then rare ones with their roots
            t = left.filter(pa.array([(x is not None) == far for x in left.column("x").to_pylist()]))
            key, n, word, m, x = (t.column(c).to_pylist() for c in ("key", "n", "word", "m", "x"))
            if not len(t):
                continue
            roots = np.concatenate([opened(a, float).reshape(len(own.sweeps), -1) for a in x], axis=1) if far else None
            tokens.append((np.concatenate([opened(a, np.uint64, True) for a in key]), np.concatenate([opened(a, np.uint64 if far else np.uint32).astype(np.uint64) for a in word]), roots))
            numbers = [opened(a, np.uint32).astype(np.int64) for a in n]
            which = [opened(a, np.int64) for a in m] if far else [np.full(len(a), k) for a, k in zip(numbers, t.column("batch").to_pylist(), strict=True)]
            docs_.append(np.searchsorted(batches, np.concatenate(which)) << DOC_BITS | np.concatenate(numbers))
        columns, said_, _ = _parted(right)
        found = own.far_scores(columns, left.column("p")[0].as_py(), said_, tokens)
        out = []
        for k, (who, score) in sorted(_by_batch(batches, np.concatenate(docs_), np.log10(np.concatenate(found))).items()):
            out.append((_home(k), k, False, None, None, squeezed(who), None, squeezed(_NONE), squeezed(_NONE), squeezed(score), squeezed(np.empty(0)), None))
        return pa.Table.from_batches([batch_of(out)])

    constant = np.log10(words.tokens + words.kinds + 1)

    def summed(t: pa.Table) -> pa.Table:
        """The documents of one batch of texts."""
        h = t.column("head").to_pylist().index(True)
        col = {c: t.column(c).to_pylist() for c in ("id", "key", "n", "at", "m", "x", "y")}
        lengths, n_known = opened(col["key"][h], np.uint64).astype(np.int64), opened(col["m"][h], np.uint32).astype(np.int64)
        score, logs = opened(col["x"][h], float).copy(), opened(col["y"][h], float).copy()
        for k in range(len(t)):
            if k != h:
                score[opened(col["n"][k], np.uint32)] += opened(col["x"][k], float)
                rare = opened(col["at"][k], np.uint32)
                logs[rare] += opened(col["y"][k], float)
                n_known[rare] += opened(col["m"][k], np.uint32)
        ids = pa.ipc.open_stream(col["id"][h]).read_all().column("doc_id").combine_chunks()
        n = len(lengths)
        return pa.table({"doc_id": ids, "n_tokens": lengths, "n_known": n_known, "train_tokens": np.full(n, words.tokens, np.int64), "base_score": logs - lengths * constant, "score": score})

    parts = docs.mapInArrow(read, _PARTS)
    known = pairs.unionByName(said)
    sums = parts.groupBy("p").cogroup(known.where(F.col("p") < words.parts).groupBy("p")).applyInArrow(looked_up, _PARTS)
    sums = sums.groupBy("p").cogroup(known.where(F.col("p") >= words.parts).groupBy("p")).applyInArrow(looked_up_far, _PARTS)
    return sums.groupBy("batch").applyInArrow(summed, f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, train: Column | None = None, common: int = 1 << 16, theta: float = 2.0, theta0: float = 2.0, seed: int = 11, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score of every row of docs, the model
    learned from the rows for which ``train``, a condition on doc_id, holds (all without one). 10 ** (-score / n_tokens) is a
    text's perplexity."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    learned = (docs if train is None else docs.where(train)).select("text")
    words = _vocabulary(learned, min(common, (1 << CONTEXT_BITS) - 2))
    counts = stored(_pair_counts(learned, words), "counts")
    pairs = _bucketed(counts.unionByName(_once(counts, words)))
    drop_stored(counts)
    forget_shuffles(docs.sparkSession)
    rng = np.random.default_rng([seed, 1])
    # rare contexts' partitions speak first, so that all rare words are known where they are seated
    _, first = _sums(pairs.where(F.col("p") >= words.parts), None, words, None, seed, -1)
    total, said = _sums(pairs, first, words, None, seed, 0)
    drop_stored(first)
    now, sweeps, kept = _state(total, words, None, rng, theta, theta0), [], []
    for sweep in range(1, BURN_IN + SAMPLES + 1):
        total, more = _sums(pairs, said, words, now, seed, sweep)
        after = _state(total, words, now, rng, theta, theta0)
        if sweep > BURN_IN:
            sweeps.append((sweep, now, after))
            kept.append(said)
        else:
            drop_stored(said)
        now, said = after, more
    drop_stored(said)
    forget_shuffles(docs.sparkSession)
    return _scored(docs, pairs, reduce(DataFrame.unionByName, kept), Model(words, sweeps, seed), docs.schema["doc_id"].dataType.simpleString())
