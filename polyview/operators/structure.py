"""Which columns depend on each other, which rows are alike: queries on the views and categories alone."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.functions import dist
from polyview.functions.expressions import pick
from polyview.plans.model import Model

#: Pairs of rows up to this many are broadcast to find their rows.
SMALL_PAIRS = 20_000


def depprob(model: Model, a: str | int, b: str | int) -> float:
    i, j = model.codebook.index(a), model.codebook.index(b)
    return 1.0 if i == j else float(np.mean([s.view_of(i) == s.view_of(j) for s in model.states]))


def depprob_pairs(model: Model, spark: SparkSession, pairs: list[tuple]) -> DataFrame:
    name = lambda c: model.codebook[c].name
    return spark.createDataFrame([(name(a), name(b), depprob(model, a, b)) for a, b in pairs], "A string, B string, depprob double")


def view_weights(model: Model, wrt: list | None, by_columns: bool) -> list[tuple[int, int, float]]:
    """(state, slot of z, weight) of the views that count: all, or those of the columns in wrt."""
    if wrt is not None and not wrt:
        raise ValueError("wrt names no column")
    own = None if wrt is None else {model.codebook.index(c) for c in wrt}
    return [(s, model.slot(s, v), float(len(view.cols)) if by_columns else 1.0) for s, state in enumerate(model.states) for v, view in enumerate(state.views) if own is None or own & set(view.cols)]


def _alike(model: Model, used: list[tuple[int, int, float]], a: Column, b: Column) -> Column:
    """Mean over states of the weighted share of views in which two rows have the same category."""
    per = []
    for s in range(len(model.states)):
        own = [(slot, w) for t, slot, w in used if t == s]
        total = sum(w for _, w in own)
        per.append(sum((F.when(F.get(a, slot) == F.get(b, slot), F.lit(w / total)).otherwise(F.lit(0.0)) for slot, w in own), F.lit(0.0)))
    return sum(per[1:], per[0]) / float(len(per))


def rowsim(model: Model, pairs: DataFrame, wrt: list | None = None, by_columns: bool = False) -> DataFrame:
    """pairs has columns A and B of row names: adds rowsim. Few pairs are broadcast to the rows, many are joined by name; pairs
    of pairs are never formed. Unknown rows are left out."""
    used = view_weights(model, wrt, by_columns)
    names = model.rows().select(F.col("row").alias("_r"), F.col("z").alias("_z"))
    few = pairs.limit(SMALL_PAIRS + 1).count() <= SMALL_PAIRS
    if few:
        named = pairs.select("A", "B").distinct()
        wanted = F.broadcast(named.select(F.explode(F.array("A", "B")).alias("_w")).distinct())
        names = names.join(wanted, F.col("_r") == F.col("_w"), "left_semi")
    one = pairs.join(names.select(F.col("_r").alias("A"), F.col("_z").alias("_a")), "A").join(names.select(F.col("_r").alias("B"), F.col("_z").alias("_b")), "B")
    return one.select("A", "B", F.when(F.col("A") == F.col("B"), F.lit(1.0)).otherwise(_alike(model, used, F.col("_a"), F.col("_b"))).alias("rowsim"))


def novelty(model: Model, wrt: list | None = None) -> DataFrame:
    """row, novelty: one minus the mean share of rows in the row's categories; a map over the rows."""
    used = view_weights(model, wrt, False)
    views = [view for s in model.states for view in s.views]
    per = []
    for s in range(len(model.states)):
        own = [slot for t, slot, _ in used if t == s]
        shares = [pick(views[slot].sizes / max(1.0, views[slot].sizes.sum()), F.get("z", slot)) for slot in own]
        per.append(sum(shares[1:], shares[0]) / float(len(shares)))
    return model.rows().select("row", (1.0 - sum(per[1:], per[0]) / float(len(per))).alias("novelty"))


def all_pairs(names: list[str]) -> list[tuple[str, str]]:
    return list(itertools.product(names, names))


def clustermap(frame: list[tuple[str, str, float]]) -> tuple[list[str], list[list[float]], list[tuple[int, int, float, int]]]:
    """Names in dendrogram order, the reordered matrix and the linkage (Ward on the rows' distances) of a small pairwise
    result, which the caller has collected."""
    names = sorted({a for a, _, _ in frame})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, x in frame:
        m[at[a], at[b]] = x
    d = np.sqrt(np.maximum(0, ((m[:, None] - m[None]) ** 2).sum(2)))
    links = dist.ward(d)
    order = dist.leaf_order(links, len(names), d)
    return [names[i] for i in order], m[np.ix_(order, order)].tolist(), links
