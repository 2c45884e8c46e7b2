"""Densities, conjugate marginals and draws, quadrature and minimisers in NumPy.

A component set is a dict of arrays with one entry for each category: {"mu", "sigma"} (continuous), {"ln_w"} of shape
(K, codes) (categorical), {"rate"} (count), {"p"} (presence of a value that is missing not at random).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

LN_2PI = math.log(2 * math.pi)
# Lanczos coefficients for g = 7, n = 9.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def gammaln(x: np.ndarray | float) -> np.ndarray:
    """ln Gamma(x) for x > 0."""
    z = np.asarray(x, float) - 1
    s = _LANCZOS[0] + sum(c / (z + k) for k, c in enumerate(_LANCZOS[1:], 1))
    t = z + 7.5
    return 0.5 * LN_2PI + (z + 0.5) * np.log(t) - t + np.log(s)


def logsumexp(a: np.ndarray, axis: int = -1) -> np.ndarray:
    """Stays -inf where all terms are."""
    m = np.max(a, axis=axis, keepdims=True)
    safe = np.where(np.isfinite(m), m, 0)
    with np.errstate(divide="ignore"):
        out = np.log(np.sum(np.exp(a - safe), axis=axis)) + np.squeeze(safe, axis)
    return out


def ln_density(kind: str, c: dict, x: np.ndarray) -> np.ndarray:
    """(len(x), K) log densities; x: values or codes, none missing."""
    x = np.asarray(x)
    if kind == "continuous":
        z = (x[:, None].astype(float) - c["mu"]) / c["sigma"]
        return -0.5 * z * z - np.log(c["sigma"]) - 0.5 * LN_2PI
    if kind == "categorical":
        return c["ln_w"][:, x.astype(int)].T
    if kind == "count":
        v = x[:, None].astype(float)
        return v * np.log(c["rate"]) - c["rate"] - gammaln(v + 1)
    if kind == "presence":
        return np.where(x[:, None].astype(bool), np.log(c["p"]), np.log1p(-c["p"]))
    raise ValueError(f"unknown column type {kind}")


def ln_density_max(kind: str, c: dict) -> np.ndarray:
    """Log density at each component's mode."""
    if kind == "continuous":
        return -np.log(c["sigma"]) - 0.5 * LN_2PI
    if kind == "categorical":
        return c["ln_w"].max(1)
    m = np.floor(c["rate"])
    return m * np.log(c["rate"]) - c["rate"] - gammaln(m + 1)


def draw(kind: str, c: dict, k: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One value from component k[i] for each i."""
    if kind == "continuous":
        return rng.normal(c["mu"][k], c["sigma"][k])
    if kind == "count":
        return rng.poisson(c["rate"][k])
    cdf = np.cumsum(np.exp(c["ln_w"]), 1)
    cdf /= cdf[:, -1:]
    return (rng.random(len(k))[:, None] > cdf[k]).sum(1)


def count_bounds(rates: np.ndarray, tail: float = 1e-12) -> tuple[int, int]:
    """Smallest range of counts outside of which every rate has less than tail on either side."""
    lo, hi = float(np.min(rates)), float(np.max(rates))
    ln_tail = math.log(tail)
    a = int(lo)
    while a > 0 and a * math.log(lo) - lo - math.lgamma(a + 1) > ln_tail:
        a -= 1
    b = int(hi) + 1
    while b * math.log(hi) - hi - math.lgamma(b + 1) > ln_tail:
        b += 1
    return a, b


def panels(mu: np.ndarray, sigma: np.ndarray, order: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights over stretches that follow each component's scale."""
    edges = np.unique(np.concatenate([mu + s * sigma for s in (-9, -6, -4, -2.5, -1.25, 0, 1.25, 2.5, 4, 6, 9)]))
    x, w = np.polynomial.legendre.leggauss(order)
    a, b = edges[:-1, None], edges[1:, None]
    return ((b - a) / 2 * x + (a + b) / 2).ravel(), ((b - a) / 2 * w).ravel()


def bounded_minimum(f: Callable[[np.ndarray], np.ndarray], lo: float, hi: float, grid: int = 200, rounds: int = 60) -> float:
    """Best point of a grid, refined by golden section; f takes an array."""
    if hi <= lo:
        return lo
    x = np.linspace(lo, hi, grid + 1)
    k = int(np.argmin(f(x)))
    a, b = x[max(0, k - 1)], x[min(grid, k + 1)]
    g = (math.sqrt(5) - 1) / 2
    for _ in range(rounds):
        c, d = b - g * (b - a), a + g * (b - a)
        fc, fd = f(np.array([c, d]))
        a, b = (a, d) if fc < fd else (c, b)
    return float((a + b) / 2)


# Conjugate marginals ln m and posterior draws, for arrays of sufficient statistics (one entry a category).


def ln_marginal(kind: str, prior: dict, s: dict) -> np.ndarray:
    """s: n, mean, ss (sum of squares about the mean), sum, ln_fact, counts as the type needs."""
    if kind == "continuous":
        m, k, v, s2 = (prior[x] for x in ("m", "k", "v", "s2"))
        n = s["n"]
        kn, vn = k + n, v + n
        vs = v * s2 + s["ss"] + k * n / kn * (s["mean"] - m) ** 2
        return gammaln(vn / 2) - gammaln(v / 2) + 0.5 * np.log(k / kn) + v / 2 * np.log(v * s2) - vn / 2 * np.log(vs) - n / 2 * math.log(math.pi)
    if kind == "categorical":
        a, c = prior["alpha"], s["counts"]
        size = c.shape[1]
        return gammaln(size * a) - gammaln(size * a + c.sum(1)) + (gammaln(a + c) - gammaln(a)).sum(1)
    if kind == "count":
        a, b = prior["shape"], prior["rate"]
        return a * np.log(b) - gammaln(a) + gammaln(a + s["sum"]) - (a + s["sum"]) * np.log(b + s["n"]) - s["ln_fact"]
    c = s["counts"]  # presence: Beta(1/2, 1/2)
    return gammaln(c + 0.5).sum(1) - gammaln(c.sum(1) + 1) - 2 * gammaln(0.5)


def posterior_draw(kind: str, prior: dict, s: dict, rng: np.random.Generator) -> dict:
    if kind == "continuous":
        m, k, v, s2 = (prior[x] for x in ("m", "k", "v", "s2"))
        n = s["n"]
        kn, vn = k + n, v + n
        mn = (k * m + n * s["mean"]) / kn
        vs = v * s2 + s["ss"] + k * n / kn * (s["mean"] - m) ** 2
        var = vs / rng.chisquare(vn)
        return {"mu": rng.normal(mn, np.sqrt(var / kn)), "sigma": np.sqrt(var)}
    if kind == "categorical":
        g = rng.gamma(prior["alpha"] + s["counts"]) + 1e-300
        return {"ln_w": np.log(g / g.sum(1, keepdims=True))}
    if kind == "count":
        return {"rate": np.maximum(rng.gamma(prior["shape"] + s["sum"]) / (prior["rate"] + s["n"]), 1e-12)}
    return {"p": np.clip(rng.beta(s["counts"][:, 1] + 0.5, s["counts"][:, 0] + 0.5), 1e-9, 1 - 1e-9)}


def point_estimate(kind: str, s: dict) -> dict:
    """Components straight from sufficient statistics: moments, and counts with half a case added."""
    if kind == "continuous":
        return {"mu": s["mean"], "sigma": np.sqrt(np.maximum(s["ss"] / np.maximum(s["n"], 1), 1e-12))}
    if kind == "count":
        return {"rate": np.maximum(s["mean"], 1e-12)}
    c = s["counts"] + 0.5
    return {"ln_w": np.log(c / c.sum(1, keepdims=True))} if kind == "categorical" else {"p": c[:, 1] / c.sum(1)}


def ln_crp(counts: np.ndarray, alpha: float) -> float:
    """Log mass of a partition under the Chinese restaurant process."""
    c = np.asarray(counts, float)
    return float(gammaln(c).sum() + len(c) * math.log(alpha) + gammaln(alpha) - gammaln(c.sum() + alpha))


def ln_pyp(counts: np.ndarray, alpha: float, d: float) -> float:
    """The same for the Pitman-Yor process; equal at d = 0."""
    c = np.asarray(counts, float)
    k = np.arange(1, len(c))
    return float(np.log(alpha + d * k).sum() - (gammaln(alpha + c.sum()) - gammaln(alpha + 1)) + (gammaln(c - d) - gammaln(1 - d)).sum())


def ward(distance: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Linkage rows (a, b, height, size) by Lance-Williams updates for Ward's criterion."""
    n = len(distance)
    d = {(i, j): float(distance[i, j]) for i in range(n) for j in range(i)}
    size, live, out = dict.fromkeys(range(n), 1), list(range(n)), []
    get = lambda i, j: d[max(i, j), min(i, j)]
    for new in range(n, 2 * n - 1):
        a, b = min(((i, j) for x, i in enumerate(live) for j in live[:x]), key=lambda p: (get(*p), p))
        h = get(a, b)
        live = [i for i in live if i not in (a, b)]
        for i in live:
            t = size[a] + size[b] + size[i]
            d[new, i] = math.sqrt(max(0.0, ((size[a] + size[i]) * get(a, i) ** 2 + (size[b] + size[i]) * get(b, i) ** 2 - size[i] * h * h) / t))
        size[new] = size[a] + size[b]
        live.append(new)
        out.append((min(a, b), max(a, b), h, size[new]))
    return out


def leaf_order(links: list[tuple[int, int, float, int]], n: int, distance: np.ndarray) -> list[int]:
    """Leaves of the tree, each pair of branches turned so that their nearest ends meet."""
    part = {i: [i] for i in range(n)}
    for k, (a, b, _, _) in enumerate(links):
        best = min(((distance[x[-1], y[0]], x, y) for x in (part[a], part[a][::-1]) for y in (part[b], part[b][::-1])), key=lambda t: t[0])
        part[n + k] = best[1] + best[2]
    return part[n + len(links) - 1] if links else list(range(n))
