"""Connected components of a graph given as a table of edges, by alternating large-star and small-star steps
(Kiveris et al., 2014): each step is one minimum for each node and one join, partial minima are taken before
the shuffle, and no node's neighbours are gathered. Edges are written to the shared folder after each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.llm.common import drop_stored, stored


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct (u, v), u > v. Large: a node's greater neighbours are linked to the least of it and its neighbours;
    small: it and its smaller neighbours are linked to the least of them."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    near = around.join(least, F.col("u") == F.col("w"))
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (the smallest node of its component) for each node that has an edge to another one, as a stored table."""
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stored(now.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            break
        last = mark
        wide = stored(_step(now, True), "edges")
        drop_stored(now)
        now = stored(_step(wide, False), "edges")
        drop_stored(wide)
    else:
        raise RuntimeError("the components did not settle")
    out = stored(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    drop_stored(now)
    return out
