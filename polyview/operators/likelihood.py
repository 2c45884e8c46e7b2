"""Likelihoods of hypothetical values (marginal over categories) and surprisal of table cells (in their categories)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.functions import dist
from polyview.functions.expressions import ln_density, logsumexp
from polyview.plans.model import Model, View, decode_column

Given = dict


def coded(model: Model, col: int, value: object) -> object:
    """A value as the engine holds it; None for a missing one."""
    c = model.codebook.columns[col]
    if value is None or isinstance(value, float) and value != value:
        return None
    return c.code(value) if c.ftype == "categorical" else float(value) if c.ftype == "continuous" else int(value)


def resolved(model: Model, given: Given | None, targets: list[int] = ()) -> dict[int, object]:
    """Conditions by column number; a target among them, or a missing value where that says nothing, is an error."""
    out = {}
    for name, value in (given or {}).items():
        j = model.codebook.index(name)
        if j in targets:
            raise ValueError(f"column {name!r} is both a target and given")
        x = coded(model, j, value)
        if x is None and not model.codebook.columns[j].mnar:
            raise ValueError(f"column {name!r} is given as missing, but is missing at random")
        out[j] = x
    return out


def ln_cell(model: Model, view: View, j: int, x: np.ndarray, gone: np.ndarray, scaled: bool = False, presence: bool = True) -> np.ndarray:
    """(len(x), K) log likelihood of a column's values; missing ones score their absence where that is modelled."""
    c = model.codebook.columns[j]
    safe = np.where(gone, 0, x) if c.ftype == "categorical" else np.where(gone, 1, x)
    out = dist.ln_density(c.ftype, view.params[j], safe)
    if scaled:
        out = out - dist.ln_density_max(c.ftype, view.params[j])
    if j in view.present:
        p = view.present[j]["p"]
        return np.where(gone[:, None], np.log1p(-p)[None], out + np.log(p) if presence else out)
    return np.where(gone[:, None], 0.0, out)


def given_weights(model: Model, view: View, given: dict[int, object]) -> np.ndarray:
    """Log weights of a view's categories under the conditions on its columns; normalised if there are any."""
    with np.errstate(divide="ignore"):
        w = np.log(view.weights)
    own = [(j, x) for j, x in given.items() if j in view.cols]
    for j, x in own:
        w = w + ln_cell(model, view, j, np.array([0 if x is None else x]), np.array([x is None]))[0]
    return w - dist.logsumexp(w) if own else w


def logp_values(model: Model, cols: list[int], values: list[np.ndarray], gone: list[np.ndarray], given: dict[int, object], states: list[int], scaled: bool = False) -> np.ndarray:
    """ln p of each row of values, averaged over states; only views that hold a target are looked at."""
    per = []
    for s in states:
        total = 0.0
        for view in model.states[s].views:
            own = [i for i, j in enumerate(cols) if j in view.cols]
            if own:
                w = given_weights(model, view, given)[None]
                total = total + dist.logsumexp(w + sum(ln_cell(model, view, cols[i], values[i], gone[i], scaled, False) for i in own), 1)
        per.append(total)
    out = dist.logsumexp(np.array(per), 0) - np.log(len(states))
    return out / len(cols) if scaled else out


def logp(model: Model, values: DataFrame, cols: list, given: Given | None = None, states: list[int] | None = None, scaled: bool = False, out: str = "logp") -> DataFrame:
    """values with a column of log likelihoods of its columns ``cols`` (decoded values). The model's parameters, which don't
    grow with the rows, are broadcast. Unknown categories raise."""
    js = [model.codebook.index(c) for c in cols]
    if not js:
        raise ValueError("no columns to score")
    cond, chosen = resolved(model, given, js), model.chosen(states)
    names = [model.codebook.columns[j].name for j in js]
    shared = values.sparkSession.sparkContext.broadcast(model.dataless())

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            x, gone = [], []
            for j, series in zip(js, batch if isinstance(batch, tuple) else (batch,), strict=True):
                c = own.codebook.columns[j]
                g = series.isna().to_numpy()
                if g.any() and not c.mnar:
                    raise ValueError(f"column {c.name} has missing values to score")
                if c.ftype == "categorical":
                    codes = {v: k for k, v in enumerate(c.values)}
                    got = series[~g].map(codes)
                    if got.isna().any():
                        raise ValueError(f"column {c.name} has an unknown category")
                    v = np.zeros(len(series), int)
                    v[~g] = got.astype(int)
                else:
                    v = series.fillna(0).to_numpy(float)
                x.append(v)
                gone.append(g)
            yield pd.Series(logp_values(own, js, x, gone, cond, chosen, scaled))

    return values.withColumn(out, scored(*[F.col(f"`{n}`") for n in names]))


def surprisal(model: Model, col: str | int, states: list[int] | None = None, keep_missing: bool = False, value: str | None = None) -> DataFrame:
    """row, the column, surprisal: minus the log likelihood of each cell in the categories that its row has, averaged over
    states. A JVM expression over the rows, without joins. value: a column of data that holds other, coded values to score."""
    j = model.codebook.index(col)
    c = model.codebook.columns[j]
    x = F.col(f"`{value or c.name}`")
    terms = [ln_density(c.ftype, model.states[s].views[v].params[j], F.get("z", model.slot(s, v)), x) for s in model.chosen(states) for v in [model.states[s].view_of(j)]]
    out = model.rows() if keep_missing else model.rows().where(x.isNotNull())
    return out.select("row", x.alias(c.name), (F.lit(float(np.log(len(terms)))) - logsumexp(terms)).alias("surprisal"))


def surprisal_of(model: Model, col: str | int, rows: DataFrame, states: list[int] | None = None) -> DataFrame:
    """rows has ``_pos``, ``row`` and ``value`` (coded): in their order row, the column and the surprisal of the value, as if it stood in the row."""
    own = model.rows().join(rows.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"))
    j = model.codebook.index(col)
    c, x = model.codebook.columns[j], F.col("value")
    terms = [ln_density(c.ftype, model.states[s].views[v].params[j], F.get("z", model.slot(s, v)), x) for s in model.chosen(states) for v in [model.states[s].view_of(j)]]
    return own.select("_pos", "row", decode_column(c, x).alias(c.name), (F.lit(float(np.log(len(terms)))) - logsumexp(terms)).alias("surprisal")).orderBy("_pos").drop("_pos")


def inconsistency(model: Model, values: DataFrame, cols: list, given: Given | None = None) -> DataFrame:
    """Log likelihood of the values together over that of each alone; with conditions, over that without them."""
    if len(cols) == 1 and not given:
        raise ValueError("one value alone needs conditions")
    both = logp(model, values, cols, given, out="_joint")
    if given:
        return logp(model, both, cols, out="_alone").withColumn("inconsistency", F.col("_joint") / F.col("_alone")).drop("_joint", "_alone")
    for k, c in enumerate(cols):
        both = logp(model, both, [c], out=f"_one{k}")
    total = sum((F.col(f"_one{k}") for k in range(1, len(cols))), F.col("_one0"))
    return both.withColumn("inconsistency", F.col("_joint") / total).drop("_joint", *[f"_one{k}" for k in range(len(cols))])
