"""Tidy tables behind the usual plots: rows are what grows, so those stay in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.operators.explanation import explain_prediction, predict_xs
from polyview.operators.likelihood import logp_values, resolved
from polyview.operators.prediction import predict
from polyview.plans.model import Model, decode_column


def prediction(model: Model, spark: SparkSession, target: str | int, given: dict | None = None, n_points: int = 1000) -> DataFrame:
    """x, state (null for the mean of all), p: the target's distribution under the conditions in each state; and value and uncertainty of the
    prediction, the same in each row. x has the support of categories (their values as text), the range of counts, or an even grid."""
    j = model.codebook.index(target)
    c = model.codebook.columns[j]
    x = predict_xs(model, c.name, given, n_points)
    cond, none = resolved(model, given, [j]), np.zeros(len(x), bool)
    value, unsure = predict(model, target, given)
    label = [str(c.values[int(v)]) for v in x] if c.ftype == "categorical" else [float(v) for v in x]
    rows = []
    for s in [None, *range(len(model.states))]:
        p = np.exp(logp_values(model, [j], [x], [none], cond, list(range(len(model.states))) if s is None else [s]))
        rows += [(v, s, float(q), None if value is None else str(value), float(unsure)) for v, q in zip(label, p, strict=True)]
    return spark.createDataFrame(rows, f"x {'string' if c.ftype == 'categorical' else 'double'}, state int, p double, value string, uncertainty double")


def state(model: Model, k: int) -> DataFrame:
    """rix, row, view, category, col, value (as text) of each present cell of a state."""
    s = model.states[model.chosen([k])[0]]
    cells = [F.struct(F.lit(v).alias("view"), F.get("z", model.slot(k, v)).alias("category"), F.lit(model.codebook.columns[j].name).alias("col"), decode_column(model.codebook.columns[j], F.col(f"`{model.codebook.columns[j].name}`")).cast("string").alias("value")) for v, view in enumerate(s.views) for j in view.cols]
    return model.rows().select("rix", "row", F.explode(F.array(*cells)).alias("c")).select("rix", "row", "c.*").where("value is not null")


def explanation(model: Model, spark: SparkSession, target: str, given: dict, method: str = "ablative-err") -> DataFrame:
    """col, value (as text), importance, most important first."""
    names, weights = explain_prediction(model, target, given, method)
    rows = sorted(zip(names, weights, strict=True), key=lambda r: -abs(r[1]))
    return spark.createDataFrame([(n, str(given[n]), float(w)) for n, w in rows], "col string, value string, importance double")
