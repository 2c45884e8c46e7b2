"""Row kernels against the exact posterior of small tables, by enumeration of all partitions."""

import numpy as np
import pytest

from polyview.functions import dist
from polyview.plans import kernels
from polyview.sources.codebook import Column

# The tables, priors and tolerance of the enumeration checks.
COLUMNS = {
    "continuous": (Column.continuous("x"), {"m": 0.0, "k": 1.0, "v": 1.0, "s2": 1.0}, np.array([-1.1, -0.9, 0.4, 1.7])),
    "categorical": (Column.categorical("x", 4), {"alpha": 1.0}, np.array([0.0, 0.0, 2.0, 3.0])),
    "count": (Column.count("x"), {"shape": 3.0, "rate": 3.0}, np.array([0.0, 1.0, 1.0, 4.0])),
}
PROCESSES = {"dirichlet": {"alpha": 1.2}, "pitman_yor": {"alpha": 0.8, "d": 0.3}}


def partitions(n):
    """All restricted growth strings."""
    out = [[0]]
    for _ in range(n - 1):
        out = [[*z, k] for z in out for k in range(max(z) + 2)]
    return [tuple(z) for z in out]


def canonical(z):
    seen = {}
    return tuple(seen.setdefault(k, len(seen)) for k in z)


def start(kind, process, gone=None, z=(0, 0, 0, 0)):
    column, prior, x = COLUMNS[kind]
    gone = np.zeros(len(x), bool) if gone is None else gone
    return kernels.Partition({0: column}, {0: (x, gone)}, {0: prior}, process, np.array(z))


def exact(kind, process):
    names = partitions(4)
    ln = np.array([(p := start(kind, process, z=z)).ln_fit().sum() + p.ln_mass() for z in names])
    return names, np.exp(ln - dist.logsumexp(ln))


def slice_step(p, rng):
    """The slice kernel as the sweep composes it: weights and components given the partition, slice variables, the broken stick, labels."""
    column, prior = p.columns[0], p.priors[0]
    u0, w = rng.random(len(p.z)), None
    d, k = p.process.get("d", 0.0), len(p.counts)
    own = rng.dirichlet(np.append(p.counts - d, p.process["alpha"] + d * k))
    w, rest = own[:-1].tolist(), own[-1]
    u = u0 * np.array(w)[p.z]
    while rest >= u.min():
        b = rng.beta(1 - d, p.process["alpha"] + d * (len(w) + 1))
        w.append(rest * b)
        rest *= 1 - b
    s = p.sums[0]
    if column.ftype == "categorical":
        stats = {"counts": np.concatenate([s[:, :-2], np.zeros((len(w) - k, s.shape[1] - 2))])}
    else:
        n, mean = s[:, 0], s[:, 1] / s[:, 0]
        pad = np.zeros(len(w) - k)
        stats = {"n": np.append(n, pad), "mean": np.append(mean + p.shift[0], pad), "ss": np.append(np.maximum(s[:, 2] - n * mean**2, 0), pad), "sum": np.append(s[:, 1], pad), "ln_fact": np.append(s[:, 3], pad)}
    params = dist.posterior_draw(column.ftype, prior, stats, rng)
    x = p.cells[0][0] + p.shift[0]
    z = kernels.sliced(dist.ln_density(column.ftype, params, x), np.array(w), u, rng)
    return np.unique(z, return_inverse=True)[1]


@pytest.mark.parametrize("kind", COLUMNS)
@pytest.mark.parametrize("process", PROCESSES)
@pytest.mark.parametrize("kernel", ["gibbs", "sams", "slice"])
def test_chains_reach_the_exact_posterior(kind, process, kernel):
    names, want = exact(kind, PROCESSES[process])
    rng, p, seen = np.random.default_rng([3, len(kind), len(process), len(kernel)]), start(kind, PROCESSES[process]), dict.fromkeys(names, 0)
    n = 0
    for _ in range(5):  # the chain goes on until it is close, as samples in a row are alike
        for _ in range(1200):
            for _ in range(2):
                if kernel == "slice":
                    p = start(kind, PROCESSES[process], z=slice_step(p, rng))
                else:
                    kernels.KERNELS[kernel](p, rng)
            seen[canonical(p.z.tolist())] += 1
        n += 1200
        got = np.array([seen[z] for z in names]) / n
        error = np.abs(np.cumsum(got) - np.cumsum(want)).mean()
        if error < 0.02:
            break
    assert error < 0.02


@pytest.mark.parametrize("kind", COLUMNS)
def test_statistics_follow_the_moves(kind):
    rng = np.random.default_rng(1)
    p = start(kind, PROCESSES["dirichlet"], np.array([False, True, False, False]))
    for _ in range(30):
        kernels.gibbs(p, rng)
        kernels.sams(p, rng)
        again = start(kind, PROCESSES["dirichlet"], np.array([False, True, False, False]), p.z)
        assert p.counts == pytest.approx(again.counts) and p.sums[0] == pytest.approx(again.sums[0], abs=1e-9)


def test_sticks_are_broken_below_the_smallest_slice_variable():
    rng = np.random.default_rng(2)
    for least in (0.3, 1e-4, 1e-9):
        w = kernels.broken(np.array([5.0, 2.0]), {"alpha": 2.0}, least, rng)
        assert len(w) >= 2 and 1 - w.sum() < least
