"""Near duplicates, components, overlaps, packing and the token store: against brute force and round trips."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from polyview.llm import decontaminate, idstore, jaccard, packing
from polyview.llm.common import lowered_words, new_path
from polyview.llm.components import components

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def roots(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        p[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


def near_copies(seed=0):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5000)}"
    texts = [None, "", " ", "one", "one", "One two", "a b c", "a b c", " ".join(word() for _ in range(9000))]
    for size in (4, 9, 10, 12, 19, 20, 25, 60, 150):
        base = [word() for _ in range(size)]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
        texts.append(" ".join(base[:-1]))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rng.choice([2, 4, 80]))) for _ in range(60)]
    return texts


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_classes_against_brute_force(spark, n, percent):
    texts = near_copies()
    sets = [jaccard.shingles(lowered_words(t), n) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = {k: (len(sets[k]), c) for k, c in enumerate(roots(len(texts), links))}
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, node string").repartition(7)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs, n, percent).collect()} == want


def test_classes_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (7, "A b C d")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard.classes(docs, 3, 90).collect()) == [(-1, -1), (4, 4), (4, 4), (7, 4)]
    assert jaccard.classes(docs.limit(0), 3, 90).count() == 0


def test_boundary_moves_with_the_lists():
    sizes = {s: 1000 for s in range(1, 41)}
    assert jaccard.boundary(sizes, 1.0, 90) <= jaccard.boundary(sizes, 1000.0, 90)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    names = rng.sample(range(1000), 200)
    links = [(k, k + 1) for k in range(60)] + [(70, k) for k in range(71, 120)] + [(rng.randrange(120, 200), rng.randrange(120, 200)) for _ in range(40)]
    edges = spark.createDataFrame([(names[a], names[b]) for a, b in links], "a long, b long")
    least = collections.defaultdict(list)
    for k, c in enumerate(roots(200, links)):
        least[c].append(names[k])
    want = {x: min(g) for g in least.values() if len(g) > 1 for x in g}
    assert {r["node"]: r["component"] for r in components(edges).collect()} == want


def brute_overlaps(docs, items):
    out = {}
    for d, t in docs:
        x = (t or "").lower().split()
        for i, u in items:
            y = (u or "").lower().split()
            w = min(13, len(y))
            if len(y) < 6:
                continue
            fits = [(p, p + w - 1, s) for p in range(len(x) - w + 1) for q in range(len(y) - w + 1) for s in [sum(a == b for a, b in zip(x[p : p + w], y[q : q + w], strict=True))] if s >= w - 2 * w // 13]
            if fits:
                out[d, i] = (min(f[0] for f in fits), max(f[1] for f in fits), max(f[2] for f in fits))
    return out


def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"v{rng.randint(0, 400)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((3, 6, 7, 9, 12, 13, 14, 30, 30))] + [(20, None), (21, "")]
    docs = [(0, None), (1, ""), (2, "short one")]
    for k in range(3, 120):
        _, text = rng.choice(items[:9])
        own = text.split()
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            own[rng.randrange(len(own))] = word()
        a = rng.randrange(0, max(1, len(own) - 12))
        own = own[a:] if rng.random() < 0.5 else own
        docs.append((k, " ".join([*(word() for _ in range(rng.randint(0, 20))), *(w.upper() for w in own), *(word() for _ in range(rng.randint(0, 20)))])))
    table = spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, h string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["last_word"], r["best"]) for r in decontaminate.overlaps(table, bench).collect()}
    assert got == brute_overlaps(docs, items) and len(got) > 30
    kept = {r["doc_id"] for r in decontaminate.clean(table, bench).collect()}
    assert kept == {k for k, _ in docs} - {d for d, _ in got}
    assert decontaminate.overlaps(table, bench.limit(0)).count() == decontaminate.overlaps(table.limit(0), bench).count() == 0


TEXTS = [None, "", " ", "Hello  world\n\n it's", "<|endoftext|> x", "hi <|endoftext|> there<|startoftext|>", "a\n\n\nb  \n c \n", "tab\tand\r\nline", "Déjà vu, naïve.", " odd space", "x" * 9000, "word " * 6000, "same text", "same text", "É́ ﬁ ＡＢ\x1cz"]


def ids_of(path, text, end):
    t = Tokenizer.from_file(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, offset int")
    rows = packing.pack_texts(docs, WORD).collect()
    want = {}
    for k, t in enumerate(TEXTS):
        ids = ids_of(WORD, t, 1)
        for p, at in enumerate(range(0, len(ids), 4096)):
            want[k, p] = (at, len(ids[at : at + 4096]), crc(ids[at : at + 4096]))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack_texts(docs.limit(0), WORD).count() == 0


@pytest.mark.parametrize("size", [7, 16, 64])
def test_plans_place_every_piece_once(size):
    rng = np.random.default_rng(size)
    for n in (0, 1, 50, 3000):
        counts = np.bincount(rng.integers(1, size + 1, n), minlength=size + 1)
        slots, total = packing.plan(counts, size)
        room, used = collections.defaultdict(list), np.zeros(size + 1, int)
        for length, rank, m, first, offset in slots.tolist():
            assert rank == used[length]
            used[length] += m
            for k in range(m):
                room[first + k].append((offset, length))
        assert (used == counts).all() and len(room) == total
        assert all(sum(x for _, x in s) <= size and sorted(o for o, _ in s) == np.cumsum([0, *[x for _, x in sorted(s)]])[:-1].tolist() for s in room.values())
        least = -(-int(counts @ np.arange(size + 1)) // size)
        assert total <= least * 1.25 + 2


def test_store_round_trip(spark):
    rows = [(7 * k % 17, t, "z") for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    path = new_path(spark, "test-store")
    idstore.write_store(docs, path, BYTE, end_id=0)
    want, at = {}, 0
    for k, t, _ in sorted(rows):
        ids = ids_of(BYTE, t, 0)
        want[k] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in idstore.read_digests(spark, path).collect()} == want
    assert {r["doc_id"]: list(r["ids"]) for r in idstore.read_ids(spark, path).collect()} == {k: ids_of(BYTE, t, 0) for k, t, _ in rows}
    assert len(idstore.verify_manifest(spark, path)) == idstore.DIGEST
    keys = [bytes(r["key"]) for r in spark.read.parquet(path).where("kind = 'chunk'").collect()]
    assert len(keys) == len(set(keys))
    empty = new_path(spark, "test-store")
    idstore.write_store(docs.limit(0), empty, BYTE, end_id=0)


def test_joined_crc_and_merkle():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(0, 300)), rng.randbytes(rng.randrange(0, 300))
        assert idstore.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    for n in range(9):
        tree = idstore.Tree()
        for k in range(n):
            tree.add(bytes([k]))
        assert tree.root() == idstore.merkle([bytes([k]) for k in range(n)])


def test_chunks_cover_the_stream_and_move_with_it():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_000, 20_000)
    ends = idstore.cuts(ids)
    assert ends[-1] == len(ids) and all(0 < b - a <= idstore.MOST for a, b in zip([0, *ends], ends, strict=False))
    moved = idstore.cuts(np.concatenate([rng.integers(0, 50_000, 777), ids]))
    assert len({e - 777 for e in moved} & set(ends)) > 0.7 * len(ends)
