"""Predictive probabilities of the language model sum to one in every context, and seating follows the restaurant one customer after another."""

import numpy as np
import pytest

from polyview.llm import pitman_yor as py

NONE = (np.empty(0, np.uint64), np.empty(0, np.int64))


def totals(columns, got, words):
    contexts, common = words.contexts, len(words.hashes)
    total = np.zeros(2 * contexts + common + 4)
    total[:contexts] = np.bincount(got["context"], got["t"], contexts) + np.bincount(got["at"], got["tables"], contexts)
    total[contexts : 2 * contexts] = np.bincount(got["context"], columns[1], contexts) + np.bincount(got["at"], columns[4], contexts)
    total[2 * contexts : -4] = np.bincount(got["code"], got["t"], common)
    total[-4:] = [got["customers"].sum(), got["under"].sum(), (columns[1] == 1).sum() + (columns[4] == 1).sum(), (columns[1] == 2).sum() + (columns[4] == 2).sum()]
    return total


@pytest.mark.parametrize("seed", range(4))
def test_probabilities_sum_to_one_in_every_context(seed):
    rng = np.random.default_rng(seed)
    rare = np.sort(rng.choice(1 << 40, 6, replace=False).astype(np.uint64) | py.RARE)
    words = py.Words(np.array([1, 2, 3], np.uint64), np.array([30, 20, 10]), 100, 3 + len(rare), 0.6, 1)
    pairs = sorted({(int(rng.integers(3)), int(rng.integers(4))) for _ in range(8)})
    key = np.sort(py.pair_keys(np.array([w for w, _ in pairs], np.uint64), np.array([u for _, u in pairs], np.uint64)))
    both = sorted({(int(rng.integers(len(rare))), int(rng.integers(4))) for _ in range(10)} | {(k, 0) for k in range(len(rare))})
    columns = [key, rng.integers(1, 400, len(key)).astype(np.uint32), rare[[w for w, _ in both]], np.array([u for _, u in both], np.uint32), rng.integers(1, 5, len(both)).astype(np.uint32)]
    start = np.random.default_rng([seed, 1])
    now = py._state(totals(columns, py.sample(columns, None, start, [], NONE), words), words, None, start, 2.0, 2.0)
    sweeps = []
    for sweep in (1, 2, 3):
        after = py._state(totals(columns, py.sample(columns, now, py._rng(seed, sweep, 0), [], NONE), words), words, now, start, 2.0, 2.0)
        sweeps.append((sweep, now, after))
        now = after
    model = py.Model(words, sweeps[1:], seed)
    one, two, names, roots, seen = model.pair_probabilities(columns, 0, {}, NONE)
    assert names.tolist() == rare.tolist() and seen.sum() == columns[4].sum()
    unknown = np.array([[a.new_mass() * a.unknown / (a.theta0 + a.root_customers)] for _, _, a in model.sweeps])
    for u in range(4):
        at = np.array([u])
        total = float(model.unseen(at, unknown)[0])
        for w in range(3):
            k = np.flatnonzero(key == py.pair_keys(np.array([w], np.uint64), at.astype(np.uint64)))
            total += float(one[k[0]] if len(k) else model.unseen(at, np.array([[a.p_common[w]] for _, _, a in model.sweeps]))[0])
        for i, w in enumerate(rare):
            k = np.flatnonzero((columns[2] == w) & (columns[3] == u))
            total += float(two[k[0]] if len(k) else model.unseen(at, roots[:, [i]])[0])
        assert total == pytest.approx(1, rel=1e-9)


def brute(n, new, d, rng):
    """Seats n customers one after another at tables: a new one by weight ``new``, an old one by its size less d."""
    sizes = []
    for _ in range(n):
        w = np.array([*(s - d for s in sizes), new if sizes else 1.0])
        k = rng.choice(len(w), p=w / w.sum())
        if k == len(sizes):
            sizes.append(1)
        else:
            sizes[k] += 1
    return len(sizes)


@pytest.mark.parametrize(("n", "new"), [(3, 0.4), (12, 1.5), (60, 5.0)])
def test_tables_are_distributed_as_in_the_restaurant(n, new):
    rng = np.random.default_rng(n)
    want = np.bincount([brute(n, new, 0.5, rng) for _ in range(3000)], minlength=n + 1) / 3000
    got = np.bincount(py.seated(np.full(20_000, n), np.full(20_000, new), 0.5, rng).astype(int), minlength=n + 1) / 20_000
    assert np.abs(np.cumsum(got) - np.cumsum(want)).max() < 0.035
