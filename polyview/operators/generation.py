"""Simulation from the joint distribution and draws from a row's own categories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from polyview.functions import dist
from polyview.operators.likelihood import Given, given_weights, resolved
from polyview.plans.model import Model


def simulate_values(model: Model, cols: list[int], given: dict[int, object], n: int, rng: np.random.Generator, states: list[int]) -> list[np.ndarray]:
    """Coded values: a state for each draw, then a category in each view that is needed, shared by the view's columns.
    Missing ones (only where absence is modelled) are NaN."""
    state = rng.choice(states, n)
    out = [np.zeros(n) for _ in cols]
    for s in sorted(set(state.tolist())):
        mine = np.flatnonzero(state == s)
        for view in model.states[s].views:
            own = [i for i, j in enumerate(cols) if j in view.cols]
            if own:
                w = np.exp(given_weights(model, view, given))
                k = rng.choice(len(w), len(mine), p=w / w.sum())
                for i in own:
                    x = dist.draw(model.codebook.columns[cols[i]].ftype, view.params[cols[i]], k, rng).astype(float)
                    if cols[i] in view.present:
                        x[rng.random(len(k)) >= view.present[cols[i]]["p"][k]] = np.nan
                    out[i][mine] = x
    return out


def _types(model: Model, cols: list[int]) -> str:
    kinds = {"continuous": "double", "count": "long"}
    return ", ".join(f"`{c.name}` {kinds.get(c.ftype) or {'string': 'string', 'bool': 'boolean', 'uint': 'int'}[c.value_kind]}" for c in (model.codebook.columns[j] for j in cols))


def decoded(model: Model, col: int, x: np.ndarray) -> list:
    c = model.codebook.columns[col]
    return [None if v != v else float(v) if c.ftype == "continuous" else int(v) if c.ftype == "count" else c.values[int(v)] for v in x]


def simulate(model: Model, spark: SparkSession, cols: list, given: Given | None = None, n: int = 1, states: list[int] | None = None, seed: int = 0, include_given: bool = False) -> DataFrame:
    """n rows, made where they are needed; the same seed and n give the same rows for the same number of cores."""
    js = [model.codebook.index(c) for c in cols]
    cond, chosen = resolved(model, given, js), model.chosen(states)
    shared = spark.sparkContext.broadcast(model.dataless())
    more = list(cond) if include_given else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            if len(b):
                rng = np.random.default_rng([seed, int(b["id"].iloc[0])])
                x = simulate_values(own, js, cond, len(b), rng, chosen)
                data = {own.codebook.columns[j].name: decoded(own, j, v) for j, v in zip(js, x, strict=True)}
                data |= {own.codebook.columns[j].name: decoded(own, j, np.full(len(b), np.nan if cond[j] is None else cond[j], float)) for j in more}
                yield pd.DataFrame(data, dtype=object)

    return spark.range(n).mapInPandas(run, _types(model, [*js, *more]))


def draw(model: Model, row: str | int, col: str | int, n: int = 1, seed: int = 0) -> list:
    """n values of a cell from the categories that its row has."""
    j = model.codebook.index(col)
    r = model.rows().where(model.where(row)).select("z").first()
    if r is None:
        raise IndexError(f"no row {row!r}")
    rng = np.random.default_rng([seed, 77])
    out = np.zeros(n)
    state = rng.integers(0, len(model.states), n)
    for s, st in enumerate(model.states):
        mine = np.flatnonzero(state == s)
        v = st.view_of(j)
        k = np.full(len(mine), r["z"][model.slot(s, v)])
        x = dist.draw(model.codebook.columns[j].ftype, st.views[v].params[j], k, rng).astype(float)
        if j in st.views[v].present:
            x[rng.random(len(k)) >= st.views[v].present[j]["p"][k]] = np.nan
        out[mine] = x
    return decoded(model, j, out)
