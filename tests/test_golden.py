"""Hand-written posterior states with known answers."""

import itertools

import numpy as np
import pytest

from polyview.functions import dist
from polyview.operators import explanation, information, likelihood, prediction, structure
from polyview.plans.model import Model, State, View
from polyview.sources.codebook import Codebook, Column

ALL = [0, 1, 2]


def g(*pairs):
    return {"mu": np.array([p[0] for p in pairs]), "sigma": np.array([p[1] for p in pairs])}


def view(cols, w, params, zr):
    return View(cols, np.array(w), np.bincount(zr).astype(float), dict(zip(cols, params, strict=True)))


def small() -> Model:
    """Three states of four rows and three continuous columns."""
    one = State([
        view([0, 2], [0.5, 0.5], [g((1.6831137962662617, 4.359431212837638), (-0.8244161883997966, 0.7575638719355798)), g((0.5076734992824962, 0.7882387359076757), (1.0440437033779726, 0.5436399535396607))], [0, 0, 1, 1]),
        view([1], [0.25, 0.75], [g((0.44326836512804435, 0.6953682931737042), (-0.8066568923121809, 0.40556559538220105))], [0, 1, 1, 1]),
    ])
    two = State([
        view([0], [0.25, 0.5, 0.25], [g((0.05993223546726123, 0.9958300138016791), (0.1262416504554439, 0.803819985472255), (1.3261764764341246, 2.0806506255473396))], [0, 1, 1, 2]),
        view([1, 2], [0.5, 0.5], [g((1.0587685142481083, 0.795060473607129), (-0.932767468057905, 1.9136339702621532)), g((1.4013986626928305, 2.008206474685051), (0.1421540716511905, 1.3897586257505348))], [0, 0, 1, 1]),
    ])
    three = State([view([0, 1, 2], [0.25, 0.75], [g((0.8395737234054341, 2.677359827494987), (0.13593401813761558, 0.3853593118165761)), g((-0.319829787477083, 0.9371050705347151), (1.741700503791252, 0.7983083135669791)), g((2.052367520597165, 6.506702782624374), (-0.4258927202425684, 0.529124586571219))], [0, 1, 1, 1])])
    return Model(Codebook("small", [Column.continuous(f"c{j}") for j in range(3)]), [one, two, three])


def entropies() -> Model:
    """Two continuous and two categorical columns, the same components in two states."""
    c0, c1 = g((0, 1), (-0.8, 0.75)), g((0.44326836512804435, 0.6953682931737042), (-0.8066568923121809, 0.40556559538220105))
    c2 = {"ln_w": np.array([[-2.56494936, -1.87180218, -0.77318989, -1.178655], [-0.91629073, -1.2039728, -1.60943791, -2.30258509]])}
    c3 = {"ln_w": np.array([[-0.69314718, -0.69314718], [-0.91629073, -0.51082562]])}
    one = State([view([0, 2], [0.5, 0.5], [c0, c2], [0, 0, 1, 1]), view([1, 3], [0.25, 0.75], [c1, c3], [0, 1, 1, 1])])
    two = State([view([0, 1], [0.5, 0.5], [c0, c1], [0, 0, 1, 1]), view([2, 3], [0.25, 0.75], [c2, c3], [0, 1, 1, 1])])
    return Model(Codebook("e", [Column.continuous("c0"), Column.continuous("c1"), Column.categorical("c2", 4), Column.categorical("c3", 2)]), [one, two])


def lp(m, cols, x, given=None, states=None, scaled=False):
    v = [np.array([i]) for i in x]
    return float(likelihood.logp_values(m, cols, v, [np.zeros(1, bool)] * len(v), given or {}, states or list(range(len(m.states))), scaled)[0])


def test_depprob():
    m = small()
    assert [structure.depprob(m, *p) for p in ((0, 1), (1, 2), (0, 2), (1, 1))] == pytest.approx([1 / 3, 2 / 3, 2 / 3, 1])


@pytest.mark.parametrize(("cols", "x", "want"), [([0], [1.2], -2.9396185776733437), ([0, 2], [1.2, -0.3], -4.277889544469348), ([0, 1], [1.2, 0.2], -4.718619899900069)])
def test_logp_of_one_state(cols, x, want):
    assert lp(small(), cols, x, states=[0]) == pytest.approx(want, abs=1e-10)


def test_logp_first_state():
    assert lp(small(), [0], [-1.0], states=[0]) == pytest.approx(-1.223532985437053, abs=1e-9)


def test_chain_rule_holds_in_each_state():
    m = small()
    for s in ALL:
        assert lp(m, [0, 2], [0.3, 0.1], states=[s]) == pytest.approx(lp(m, [0], [0.3], {2: 0.1}, [s]) + lp(m, [2], [0.1], states=[s]), abs=1e-10)


def test_given_weights():
    views = small().states[0].views
    raw = [np.log(v.weights) + likelihood.ln_cell(small(), v, j, np.array([x]), np.array([False]))[0] for v, j, x in ((views[0], 0, 0.0), (views[1], 1, -1.0))]
    assert np.concatenate(raw) == pytest.approx([-3.158958, -1.926578, -4.095863, -0.417781], abs=1e-5)


@pytest.mark.parametrize(("states", "want"), [([0], 1.36854170815232), ([0, 1], 1.3687155004671951)])
def test_entropy_of_a_category(states, want):
    m = entropies()
    assert information.entropy(Model(m.codebook, [m.states[s] for s in states]), [2]) == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize(("states", "want"), [([0], 2.0503963193592734), ([1], 2.035433971709626), ([0, 1], 2.0504022456286415)])
def test_entropy_of_two_categories(states, want):
    m = entropies()
    assert information.entropy(Model(m.codebook, [m.states[s] for s in states]), [2, 3]) == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize(("states", "want"), [([0], 2.726163712601034), ([1], 2.7354575323710746), ([0, 1], 2.744356173055859)])
def test_entropy_of_a_category_and_a_number(states, want):
    m = entropies()
    assert information.entropy(Model(m.codebook, [m.states[s] for s in states]), [2, 0]) == pytest.approx(want, abs=1e-6)


def test_mutual_information_kinds():
    assert information.mi_of(1.0, 2.0, 2.5, "UnNormed") == pytest.approx(0.5)
    assert information.mi_of(1.0, 2.0, 2.5, "iqr") == pytest.approx(0.2)
    assert information.mi_of(1.0, 1.0, 3.0, "unnormed") == 0
    with pytest.raises(ValueError):
        information.mi_of(1, 1, 1, "other")
    m = entropies()
    assert information.conditional_entropy(m, 2, [2]) == 0 and information.info_prop(m, [2], [2]) == 1
    with pytest.raises(ValueError):
        information.conditional_entropy(m, 2, [3, 3])


def test_predict_spread_out_modes():
    m = Model(Codebook("s", [Column.continuous("c")]), [State([view([0], [0.5, 0.2, 0.3], [g((-0.12, 0.1), (10, 0.5), (20, 0.2))], [0, 0, 1, 2])])])
    assert prediction.predict(m, 0) == (pytest.approx(-0.12, abs=1e-4), 0.0)


def test_predict_and_conflicts():
    m = entropies()
    value, unc = prediction.predict(m, "c3", {"c2": 0})
    assert value in (0, 1) and 0 <= unc <= 1
    with pytest.raises(ValueError):
        prediction.predict(m, "c3", {"c3": 1})
    with pytest.raises(ValueError):
        prediction.predict(m, "c3", {"c2": 9})
    with pytest.raises(IndexError):
        prediction.predict(m, "nothing")
    with pytest.raises(ValueError):
        m.chosen([])


def test_variability():
    m = entropies()
    assert prediction.variability(m, "c2") == pytest.approx(1.3687155004671951, abs=1e-6)
    assert prediction.variability(m, "c0") > 0


def test_held_out_curves():
    m = small()
    for greedy in (True, False):
        curve = explanation.held_out_neglogp(m, {"c0": 0.5}, {"c1": 0.2, "c2": 1.0}, greedy)
        assert len(curve) == 3 and curve[0][0] == []
    names, imp = explanation.explain_prediction(m, "c0", {"c1": 0.2, "c2": 1.0})
    assert names == ["c1", "c2"] and len(imp) == 2


def partitions(n):
    def go(prefix):
        if len(prefix) == n:
            yield prefix
            return
        for k in range(max(prefix, default=-1) + 2):
            yield from go([*prefix, k])

    return list(go([]))


def test_partition_masses_sum_to_one():
    every = partitions(4)
    assert len(every) == 15
    assert sum(np.exp(dist.ln_crp(np.bincount(z), 1.3)) for z in every) == pytest.approx(1)
    assert sum(np.exp(dist.ln_pyp(np.bincount(z), 1.3, 0.4)) for z in every) == pytest.approx(1)
    assert dist.ln_pyp(np.array([2, 1]), 0.7, 1e-12) == pytest.approx(dist.ln_crp(np.array([2, 1]), 0.7))


def test_marginals():
    counts = np.array([[1.0, 2.0, 0.0]])
    total = sum(np.exp(dist.ln_marginal("categorical", {"alpha": 0.7}, {"counts": np.array([np.bincount(x, minlength=3)], float)})[0]) for x in itertools.product(range(3), repeat=2))
    assert total == pytest.approx(1) and dist.ln_marginal("categorical", {"alpha": 1.0}, {"counts": counts})[0] < 0
    s = lambda x: {"n": np.array([len(x)], float), "mean": np.array([np.mean(x)]), "ss": np.array([np.var(x) * len(x)]), "sum": np.array([np.sum(x)], float), "ln_fact": dist.gammaln(np.array(x, float) + 1).sum()[None]}
    p = {"shape": 2.0, "rate": 0.5}
    assert sum(np.exp(dist.ln_marginal("count", p, s([x]))[0]) for x in range(400)) == pytest.approx(1, abs=1e-6)
    x, w = np.polynomial.legendre.leggauss(400)
    x = x * 60
    dens = [np.exp(dist.ln_marginal("continuous", {"m": 0.3, "k": 1.2, "v": 3.0, "s2": 1.1}, s([v]))[0]) for v in x]
    assert float(np.dot(dens, w) * 60) == pytest.approx(1, abs=1e-3)


def test_ward_orders_neighbours_together():
    d = np.abs(np.subtract.outer(np.array([0.0, 10.0, 0.5, 10.4]), np.array([0.0, 10.0, 0.5, 10.4])))
    order = dist.leaf_order(dist.ward(d), 4, d)
    assert abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1
