"""Every context has its own restaurant, however rare."""

import numpy as np
import pytest

from polyview.llm import pitman_yor as py


def test_rare_contexts_are_kept_apart(spark, monkeypatch):
    monkeypatch.setattr(py, "PART_TOKENS", 100)
    rows = [(k, f"x{k % 20} y{k % 20}") for k in range(400)] + [(k, "the of and to in") for k in range(400, 900)]
    probe = [(1000 + k, f"x{k} y{k}") for k in range(20)] + [(2000 + k, f"x{k} y{(k + 1) % 20}") for k in range(20)] + [(3000 + k, f"x{k} the") for k in range(20)] + [(4000, "new1 new2"), (4001, "x1 new2"), (4002, "new1 the")]
    docs = spark.createDataFrame(rows + probe, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in py.score(docs, docs["doc_id"] < 900, common=3).collect()}
    assert len(got) == len(rows) + len(probe) and all(np.isfinite(x) and x < 0 for x in got.values())
    assert min(got[1000 + k] - got[2000 + k] for k in range(20)) > 1  # y follows its own x alone
    # as many restaurants as with room for all words
    full = {r["doc_id"]: r["score"] for r in py.score(docs, docs["doc_id"] < 900).collect()}
    assert [got[k] for k in sorted(got)] == pytest.approx([full[k] for k in sorted(full)], abs=0.35)


def test_probabilities_after_a_rare_context_sum_to_one():
    rare = np.sort(np.array([5, 9, 70], np.uint64) | py.RARE)
    u = np.uint64(77) | py.RARE
    words = py.Words(np.array([1, 2], np.uint64), np.array([3, 3]), 20, 5, 0.5, 4)
    state = py.State(np.zeros(3), np.zeros(3), np.array([0.3, 0.2]), 10.0, 4.0, 0.4, 0.5, 2.0, 2.0, 1 / 6)
    columns = [np.array([u] * 3, np.uint64), np.array([4, 1, 300], np.uint32), np.array([0, rare[0], rare[2]], np.uint64), py._NONE, py._NONE]
    said = {0: [(6, None, None, None, py.squeezed(np.array([3], np.uint32))), (1, py.squeezed(rare, True), None, py.squeezed(np.array([0.5, 0.5, 0.7])), None)]}
    model = py.Model(words, [(1, state, state)], 3)
    roots = np.array([[0.1, 0.15, 0.2, 0.05]])
    for context in (u, np.uint64(78) | py.RARE):
        one, two = model.far_scores(columns, 6, said, [(np.array([context] * 2), np.array([0, 1], np.uint64), None), (np.array([context] * 4), np.append(rare, np.uint64(123) | py.RARE), roots)])
        assert one.sum() + two.sum() == pytest.approx(1)
    assert two == pytest.approx(roots[0])  # a context that was never met
