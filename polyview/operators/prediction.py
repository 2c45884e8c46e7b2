"""Prediction of hypothetical cells, imputation of table cells, their uncertainty, and how well a column is fitted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.functions import dist
from polyview.operators.likelihood import Given, given_weights, resolved
from polyview.plans.model import Model, decode_column

Mixture = tuple[np.ndarray, dict]  # weights and components


def mixtures(model: Model, j: int, given: dict[int, object], states: list[int]) -> list[Mixture]:
    """The column's distribution in each state under the conditions."""
    out = []
    for s in states:
        view = model.states[s].views[model.states[s].view_of(j)]
        w = given_weights(model, view, given)
        w = np.exp(w - dist.logsumexp(w))
        out.append((w, view.params[j]))
    return out


def density(kind: str, mix: Mixture, x: np.ndarray) -> np.ndarray:
    return np.exp(dist.ln_density(kind, mix[1], x)) @ mix[0]


def support(kind: str, mixes: list[Mixture]) -> np.ndarray | None:
    if kind == "categorical":
        return np.arange(mixes[0][1]["ln_w"].shape[1])
    if kind == "count":
        lo, hi = dist.count_bounds(np.concatenate([p["rate"] for _, p in mixes]))
        return np.arange(lo, hi + 1)
    return None


def mode(kind: str, mixes: list[Mixture]) -> float:
    """Most likely value of the mean mixture; the first of equals."""
    f = lambda x: -np.mean([density(kind, m, x) for m in mixes], 0)
    own = support(kind, mixes)
    if own is not None:
        return float(own[int(np.argmin(f(own)))])
    mu, sigma = np.concatenate([p["mu"] for _, p in mixes]), np.concatenate([p["sigma"] for _, p in mixes])
    best = mu[int(np.argmin(f(mu)))]
    near = float(sigma[np.argmin(np.abs(mu - best))])
    return dist.bounded_minimum(f, max(float(mu.min()), best - 2 * near), min(float(mu.max()), best + 2 * near))


def uncertainty(kind: str, mixes: list[Mixture]) -> float:
    """Mean total-variation distance of the states' mixtures from their mean, scaled to reach 1; 0 for one state."""
    if len(mixes) < 2:
        return 0.0
    own = support(kind, mixes)
    if own is None:
        x, w = dist.panels(np.concatenate([p["mu"] for _, p in mixes]), np.concatenate([p["sigma"] for _, p in mixes]), 16)
    else:
        x, w = own, np.ones(len(own))
    p = np.array([density(kind, m, x) for m in mixes])
    return float(np.mean([0.5 * np.sum(np.abs(q - p.mean(0)) * w) for q in p]) * len(mixes) / (len(mixes) - 1))


def absence(model: Model, j: int, given: dict[int, object], states: list[int]) -> np.ndarray | None:
    """Each state's probability that the column is missing, if that is modelled."""
    if not model.codebook.columns[j].mnar:
        return None
    out = []
    for s in states:
        view = model.states[s].views[model.states[s].view_of(j)]
        w = np.exp(given_weights(model, view, given))
        out.append(1 - float(view.present[j]["p"] @ (w / w.sum())))
    return np.array(out)


def jensen_shannon(p: np.ndarray) -> float:
    h = lambda q: -sum(x * np.log(x) for x in (q, 1 - q) if x > 0)
    return float(h(p.mean()) - np.mean([h(x) for x in p]))


def _value(model: Model, j: int, x: float) -> object:
    c = model.codebook.columns[j]
    return float(x) if c.ftype == "continuous" else int(x) if c.ftype == "count" else c.values[int(x)]


def predict(model: Model, target: str | int, given: Given | None = None, states: list[int] | None = None, with_uncertainty: bool = True):
    """The most likely value, None if missing is likelier than not; and how much the states differ about it."""
    j = model.codebook.index(target)
    cond, chosen = resolved(model, given, [j]), model.chosen(states)
    gone = absence(model, j, cond, chosen)
    if gone is not None and gone.mean() > 0.5:
        return (None, jensen_shannon(gone)) if with_uncertainty else None
    kind, mixes = model.codebook.columns[j].ftype, mixtures(model, j, cond, chosen)
    out = _value(model, j, mode(kind, mixes))
    return (out, uncertainty(kind, mixes)) if with_uncertainty else out


def variability(model: Model, target: str | int, given: Given | None = None, states: list[int] | None = None) -> float:
    """Variance of the predictive distribution of a number, entropy of that of a category."""
    j = model.codebook.index(target)
    kind, mixes = model.codebook.columns[j].ftype, mixtures(model, j, resolved(model, given, [j]), model.chosen(states))
    if kind == "categorical":
        p = np.mean([density(kind, m, support(kind, mixes)) for m in mixes], 0)
        return float(-np.sum(np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0)))
    w = np.concatenate([w for w, _ in mixes]) / len(mixes)
    mean = np.concatenate([p["mu" if kind == "continuous" else "rate"] for _, p in mixes])
    var = np.concatenate([p["sigma"] ** 2 if kind == "continuous" else p["rate"] for _, p in mixes])
    return float(w @ (var + mean**2) - (w @ mean) ** 2)


def impute(model: Model, col: str | int, rows: DataFrame | None = None, with_uncertainty: bool = True, states: list[int] | None = None) -> DataFrame:
    """row, the column's most likely value in the row's own categories, uncertainty. rows: a table with ``row``; all rows where the
    cell is missing without it. A map over the rows; equal sets of categories are solved once for each batch."""
    j = model.codebook.index(col)
    c, chosen = model.codebook.columns[j], model.chosen(states)
    views = [(model.slot(s, model.states[s].view_of(j)), model.states[s].views[model.states[s].view_of(j)].params[j]) for s in chosen]
    own = model.rows().where(F.col(f"`{c.name}`").isNull()) if rows is None else model.rows().join(rows.select("row"), "row", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, tuple] = {}
        for b in batches:
            if not len(b):
                continue
            sets, of = np.unique(np.stack(b["z"].to_list())[:, [slot for slot, _ in views]], axis=0, return_inverse=True)
            for key in map(tuple, sets.tolist()):
                if key not in known:
                    mixes = [(np.ones(1), {n: x[k : k + 1] for n, x in p.items()}) for k, (_, p) in zip(key, views, strict=True)]
                    known[key] = float(mode(c.ftype, mixes)), uncertainty(c.ftype, mixes)
            got = np.array([known[key] for key in map(tuple, sets.tolist())])[of.ravel()]
            yield pd.DataFrame({"row": b["row"], "x": got[:, 0], "uncertainty": got[:, 1]})

    out = own.select("row", "z").mapInPandas(run, "row string, x double, uncertainty double")
    kind = {"continuous": "double", "count": "long"}.get(c.ftype, "int")
    out = out.select("row", decode_column(c, F.col("x").cast(kind)).alias(c.name), "uncertainty")
    return out if with_uncertainty else out.drop("uncertainty")


def feature_error(model: Model, col: str | int) -> tuple[float, float]:
    """(error, centroid) of the fit: twice the area between the probability transforms' distribution and the uniform for
    numbers; summed differences of observed and predicted cumulative shares for categories."""
    j = model.codebook.index(col)
    c = model.codebook.columns[j]
    mixes = mixtures(model, j, {}, list(range(len(model.states))))
    x = F.col(f"`{c.name}`")
    if c.ftype == "categorical":
        seen = np.zeros(len(c.values))
        for r in model.rows().where(x.isNotNull()).groupBy(x.alias("x")).count().collect():
            seen[r["x"]] = r["count"]
        gap = np.cumsum(seen / seen.sum()) - np.cumsum(np.mean([density(c.ftype, m, np.arange(len(seen))) for m in mixes], 0))
        total = float(np.abs(gap).sum())
        return total, float((np.arange(len(seen)) * np.abs(gap)).sum() / total) if total else 0.0
    if c.ftype != "continuous":
        raise ValueError("the error is defined for continuous and categorical columns")

    @F.pandas_udf("double")
    def transform(v: pd.Series) -> pd.Series:
        from math import erf

        e = np.vectorize(erf)
        a = v.to_numpy(float)[:, None]
        return pd.Series(np.mean([0.5 * (1 + e((a - p["mu"]) / (p["sigma"] * np.sqrt(2)))) @ w for w, p in mixes], 0))

    bins = 1000  # the transforms' distribution at 1000 points: a bounded summary of all rows
    counts = np.zeros(bins)
    for r in model.rows().where(x.isNotNull()).select(F.least(F.floor(transform(x) * bins), F.lit(bins - 1)).alias("b")).groupBy("b").count().collect():
        counts[int(r["b"])] = r["count"]
    gap = np.cumsum(counts) / counts.sum() - np.arange(1, bins + 1) / bins
    area = np.abs(gap).mean()
    return float(2 * area), float((np.abs(gap) * np.linspace(0, 1, bins)).mean() / area) if area else 0.0


#: Up to so many values, their exact median is left to one task.
FEW = 1_000_000


def median(own: DataFrame, x: Column, n: int) -> float | None:
    """The exact median of n present values. Of many, an approximate stretch around it is counted and sorted alone, and widened
    until it holds the middle."""
    if n <= FEW:
        return own.agg(F.percentile(x, 0.5)).first()[0]
    for margin in (0.001, 0.01, 0.1, 0.5):
        lo, hi = own.agg(F.percentile_approx(x, [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)], 10_000)).first()[0]
        below, within = own.agg(F.count_if(x < lo), F.count_if(x.between(lo, hi))).first()
        at, take = (n - 1) // 2 - below, 2 - n % 2
        if 0 <= at and at + take <= within:
            return float(np.mean([r[0] for r in own.where(x.between(lo, hi)).select(x.alias("x")).orderBy("x").offset(at).limit(take).collect()]))
    return own.agg(F.percentile(x, 0.5)).first()[0]


def summarize(model: Model, col: str | int) -> dict:
    """Count of present cells and, by type, extremes, mean, median, variance, all most frequent values."""
    c = model.codebook[col]
    x = F.col(f"`{c.name}`")
    own = model.rows().where(x.isNotNull())
    if c.ftype == "continuous":
        out = own.agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance")).first().asDict()
        return out | {"median": median(own, x, out["n"])}
    counts = own.groupBy(x.alias("x")).count()
    top = counts.join(F.broadcast(counts.agg(F.max("count").alias("_m"))), F.col("count") == F.col("_m"))  # one row
    modes = sorted(r["x"] for r in top.collect())
    out = own.agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), *([F.avg(x).alias("mean")] if c.ftype == "count" else [])).first().asDict()
    if c.ftype == "count":
        out["median"] = median(own, x, out["n"])
    if c.ftype == "categorical":
        out["min"], out["max"], modes = c.values[out["min"]], c.values[out["max"]], [c.values[m] for m in modes]
    return out | {"mode": modes}
