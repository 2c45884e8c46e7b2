"""Words are hashed many at a time, as the words of ``lowered_words``; orders and sums by key."""

import cProfile
import pstats

import numpy as np
import pyarrow as pa
import pytest

from polyview.llm import pitman_yor as py
from polyview.llm.common import lowered_words
from polyview.llm.wordhash import Places, word_hashes

TEXTS = [None, "", "  ", " a", "a\x00 a", "a b\x0bc", "AB ab", "x" * 64 + " " + "x" * 65 + "\t" + "y" * 200, "é ÉÉ @[`{ @Z[", "abcdefgh abcdefgh1 abcdefghi", "tail", "\x85a a", None, "end "]


@pytest.mark.parametrize("step", [1, 7, 1_000_000])
@pytest.mark.parametrize("texts", [pa.array(TEXTS), pa.array(TEXTS, pa.large_string()), pa.array(["zz zz", *TEXTS])[1:], pa.array(TEXTS)[:0], pa.array(["".join(f"x{chr(i)}y" for i in range(1, 0x300)), "a"])])
def test_hashes_are_those_of_the_lowered_words(texts, step):
    seen, own = {}, []
    for first, h, n in word_hashes(texts, step):
        assert first == len(own) and n.sum() == len(h)
        own += [x.tolist() for x in np.split(h, np.cumsum(n)[:-1])]
    assert len(own) == len(texts)
    for t, hashes in zip(texts.to_pylist(), own, strict=True):
        words = lowered_words(t)
        assert len(words) == len(hashes)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_texts_are_coded_without_python_work_for_each_word():
    texts = pa.array([" ".join(f"word{k * 40 + i}" for i in range(40)) for k in range(2000)])
    h = np.unique(np.concatenate([h for _, h, _ in word_hashes(texts)]))
    assert len(h) == 80_000
    words = py.Words(h[:1000], np.ones(1000, np.int64), 80_000, 80_000, 0.5, 8)
    with cProfile.Profile() as calls:
        (got,) = py.steps(texts, words, Places(words.hashes))
    assert pstats.Stats(calls).total_calls < 2000
    _, code, context, n = got
    assert n.tolist() == [41] * 2000 and (code < 1000).sum() == 1000
    first = np.cumsum(n) - n
    assert (context[first] == 1000).all() and (np.delete(context, first) == np.delete(code, first + 40)).all()


@pytest.mark.parametrize("names", [[], [5], [2**64 - 1], [0, 2**63], list(range(100))])
def test_places(names):
    x = np.array([0, 5, 99, 2**63, 2**64 - 1], np.uint64)
    place, there = Places(np.array(names, np.uint64)).of(x)
    assert there.tolist() == [v in names for v in x.tolist()]
    assert place[there].tolist() == [names.index(v) for v in x[there].tolist()]


def test_orders_and_sums():
    rng = np.random.default_rng(3)
    near = (rng.integers(0, 9, 3000).astype(np.uint64) << np.uint64(60)) + rng.integers(0, 40, 3000).astype(np.uint64)  # differ in last bits alone
    for a in (near, near[:1], near[:0], rng.integers(0, 2**63, 3000).astype(np.uint64), np.full(3000, 2**64 - 1, np.uint64), rng.integers(0, 9, 3000).astype(np.uint32)):
        n, b = rng.integers(1, 9, len(a)).astype(np.uint32), rng.integers(0, 5, len(a)).astype(np.uint32)
        assert (py.ascending(a) == np.argsort(a, kind="stable")).all()
        for got, want in zip(py.distinct(a), np.unique(a, return_inverse=True), strict=True):
            assert (got == want).all()
        for got, want in zip(py.summed_up(a), np.unique(a, return_counts=True), strict=True):
            assert (got == want).all()
        sums = {}
        for k in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
            sums[k[:2]] = sums.get(k[:2], 0) + k[2]
        assert [((w, u), m) for w, u, m in zip(*(x.tolist() for x in py.counted(a, b, n)), strict=True)] == sorted(sums.items())


def test_scores_do_not_depend_on_batches(spark, monkeypatch):
    """Rare words after rare contexts go on together for all batches of texts, with their batch beside them."""
    monkeypatch.setattr(py, "PART_TOKENS", 500)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 40)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r["doc_id"]: r["score"] for r in py.score(docs, common=10).collect()}
    doc = np.array([3 << py.DOC_BITS | 5, 1 << py.DOC_BITS | 5, 3 << py.DOC_BITS | 5, 7])
    got = py._by_batch(np.array([9, 4, 2, 1 << 32 | 1]), doc, np.array([1.0, 2.0, 4.0, 8.0]))
    assert {k: (w.tolist(), v.tolist()) for k, (w, v) in got.items()} == {9: ([7], [8.0]), 4: ([5], [2.0]), 1 << 32 | 1: ([5], [5.0])}
    many = docs.repartition(12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {r["doc_id"]: r["score"] for r in py.score(many, common=10).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx(want)
