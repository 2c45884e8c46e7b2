"""The fitted model: S posterior samples ("states") of columns in views and of rows in categories within each view.

What doesn't grow with the rows (views, weights, component parameters) is held by the driver and goes into plans as literals
or small broadcasts. What does grow is one DataFrame, ``data``: ``rix`` (ordinal), ``row`` (name), one encoded column for
each codebook column (categories as codes), and ``z``, an array with the row's category in every view of every state. Row
operators are therefore map-only over ``data``: no join of assignments, no shuffle.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.functions import dist
from polyview.plans.tables import written
from polyview.sources.codebook import Codebook, Column
from polyview.sources.readers import ROW

VERSION = 2


@dataclass
class View:
    """cols: numbers of its columns; params: column -> components; present: column -> {"p"} where missing not at random."""

    cols: list[int]
    weights: np.ndarray
    sizes: np.ndarray
    params: dict[int, dict] = field(default_factory=dict)
    present: dict[int, dict] = field(default_factory=dict)
    process: dict = field(default_factory=lambda: {"alpha": 1.0})


@dataclass
class State:
    views: list[View]
    process: dict = field(default_factory=lambda: {"alpha": 1.0})
    priors: dict[int, dict] = field(default_factory=dict)
    diagnostics: list[tuple[float, float]] = field(default_factory=list)

    def view_of(self, col: int) -> int:
        return next(v for v, view in enumerate(self.views) if col in view.cols)

    def assignment(self, n: int) -> list[int]:
        return [self.view_of(c) for c in range(n)]


@dataclass
class Model:
    codebook: Codebook
    states: list[State]
    data: DataFrame | None = None

    def slot(self, s: int, v: int) -> int:
        """Place of a view's category in z."""
        return sum(len(st.views) for st in self.states[:s]) + v

    @property
    def n_slots(self) -> int:
        return sum(len(st.views) for st in self.states)

    def chosen(self, states: list[int] | None) -> list[int]:
        if states is None:
            return list(range(len(self.states)))
        if not states:
            raise ValueError("no states were named")
        if min(states) < 0 or max(states) >= len(self.states):
            raise IndexError("a state is out of bounds")
        return list(states)

    def dataless(self) -> Model:
        return replace(self, data=None)

    def rows(self) -> DataFrame:
        if self.data is None:
            raise ValueError("this model has no data")
        return self.data

    def where(self, row: str | int) -> SparkColumn:
        return F.col("row") == row if isinstance(row, str) else F.col("rix") == int(row)


def encode_column(c: Column, x: SparkColumn) -> SparkColumn:
    """A column as doubles, longs or codes. NaN counts as missing; a value outside the support raises."""
    if c.ftype == "continuous":
        v = x.cast("double")
        return F.when(F.isnan(v), None).otherwise(v)
    if c.ftype == "count":
        return x.cast("long")
    if c.value_kind == "uint":
        code = x.cast("int")
        return F.when(code.isNull() | code.between(0, len(c.values) - 1), code).otherwise(F.raise_error(F.lit(f"column {c.name} has an unknown category")).cast("int"))
    texts = [str(v).lower() if c.value_kind == "bool" else v for v in c.values]
    code = F.array_position(F.array(*[F.lit(t) for t in texts]), x.cast("string")) - 1
    return F.when(code >= 0, code.cast("int")).otherwise(F.when(x.isNotNull(), F.raise_error(F.lit(f"column {c.name} has an unknown category")).cast("int")))


def decode_column(c: Column, x: SparkColumn) -> SparkColumn:
    if c.ftype != "categorical" or c.value_kind == "uint":
        return x
    return F.element_at(F.array(*[F.lit(v) for v in c.values]), x + 1)


def encode(df: DataFrame, book: Codebook, order: list[str] | None = None) -> DataFrame:
    """df has ``_row`` and the codebook's columns: rix, row and the encoded columns. With ``order`` (column names), the
    ordinal follows these columns; else it follows the partitions' order (no global sort)."""
    missing = [c for c in book.column_names if c not in df.columns]
    if missing:
        raise ValueError(f"the data lack columns of the codebook: {missing}")
    out = df.select(F.col(ROW).alias("row"), *[encode_column(c, F.col(f"`{c.name}`")).alias(c.name) for c in book.columns], *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order or [])])
    return numbered(out, [f"_o{k}" for k in range(len(order or []))]).select("rix", "row", *[f"`{c}`" for c in book.column_names])


def _fixed_parts(df: DataFrame) -> bool:
    """Whether each run of df has the same rows in the same partitions, whatever columns are read: nothing is shuffled, and
    the rows come from files or from the driver."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    leaves = re.findall(r"(\w*Scan\w*|InMemory\w*|Range|Union|Coalesce)\b", plan)
    return "Exchange" not in plan and bool(leaves) and all(x in ("FileScan", "LocalTableScan", "Range") for x in leaves)


def numbered(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """rix = 0, 1, ... without a single-task window: rows are numbered within partitions, whose sizes are added up.

    Partitions that a shuffle made may differ between two runs (adaptive execution merges them by their size, which depends on
    the columns that are read), so such rows are written once with their places, and both the sizes and the rows are read
    from there. Rows of a partition without a size are an error, not dropped."""
    spark = df.sparkSession
    own = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    own = own.withColumn("_m", F.monotonically_increasing_id())
    if order or not _fixed_parts(df):
        own = written(own, "numbered")
    own = own.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in own.groupBy("_p").agg(F.count("*")).collect()}  # one row a partition
    at, base = 0, []
    for p in sorted(sizes):
        base.append((p, at))
        at += sizes[p]
    starts = F.broadcast(spark.createDataFrame(base, "_q long, _b long"))
    start = F.when(F.col("_b").isNull(), F.raise_error(F.lit("a partition has no number")).cast("long")).otherwise(F.col("_b"))
    return own.join(starts, F.col("_p") == F.col("_q"), "left").withColumn("rix", start + F.col("_i")).drop("_m", "_p", "_i", "_q", "_b")


def ln_factorial(x: SparkColumn) -> SparkColumn:
    v = F.greatest(x.cast("double"), F.lit(8.0))
    stirling = v * F.log(v) - v + 0.5 * F.log(2 * np.pi * v) + 1 / (12 * v) - 1 / (360 * v * v * v) + 1 / (1260 * v * v * v * v * v)
    return F.when(x < 9, F.log(F.factorial(F.least(x, F.lit(9)).cast("int")).cast("double"))).otherwise(stirling)


def suffstats(data: DataFrame, book: Codebook, sizes: list[int], wanted: dict[int, list[int]] | None = None) -> list[dict[int, dict]]:
    """For each slot of z, with sizes[slot] categories: column -> statistics by category. One pass for numbers, one for
    codes; partial sums are made before the shuffle, which moves a row for each task, slot, category (and code).
    wanted: the columns of each slot (all without)."""
    out: list[dict[int, dict]] = [{} for _ in sizes]
    cells = data.select("*", F.posexplode("z").alias("_slot", "_k")).where(F.col("_k").isNotNull())
    numbers = [j for j, c in enumerate(book.columns) if c.ftype != "categorical"]
    if numbers:
        aggs = []
        for j in numbers:
            x = F.col(f"`{book.columns[j].name}`")
            aggs += [F.count(x).alias(f"n{j}"), F.avg(x.cast("double")).alias(f"m{j}"), F.var_pop(x.cast("double")).alias(f"v{j}")]
            if book.columns[j].ftype == "count":
                aggs.append(F.sum(ln_factorial(x)).alias(f"f{j}"))
        for r in cells.groupBy("_slot", "_k").agg(*aggs).collect():  # a row for each category
            for j in numbers:
                if wanted is None or j in wanted[r["_slot"]]:
                    s = out[r["_slot"]].setdefault(j, {k: np.zeros(sizes[r["_slot"]]) for k in ("n", "mean", "ss", "sum", "ln_fact")})
                    n = r[f"n{j}"]
                    if n:
                        s["n"][r["_k"]], s["mean"][r["_k"]], s["ss"][r["_k"]], s["sum"][r["_k"]] = n, r[f"m{j}"], n * r[f"v{j}"], n * r[f"m{j}"]
                        s["ln_fact"][r["_k"]] = r[f"f{j}"] if book.columns[j].ftype == "count" else 0.0
    codes = [F.struct(F.lit(j).alias("j"), F.col(f"`{c.name}`").cast("int").alias("x")) for j, c in enumerate(book.columns) if c.ftype == "categorical"]
    codes += [F.struct(F.lit(-1 - j).alias("j"), F.col(f"`{c.name}`").isNotNull().cast("int").alias("x")) for j, c in enumerate(book.columns) if c.mnar]
    for slot, own in enumerate(out):
        for j, c in enumerate(book.columns):
            if wanted is None or j in wanted[slot]:
                if c.ftype == "categorical":
                    own[j] = {"counts": np.zeros((sizes[slot], len(c.values)))}
                elif j not in own:
                    own[j] = {k: np.zeros(sizes[slot]) for k in ("n", "mean", "ss", "sum", "ln_fact")}
                if c.mnar:
                    own[-1 - j] = {"counts": np.zeros((sizes[slot], 2))}
    if codes:
        seen = cells.select("_slot", "_k", F.explode(F.array(*codes)).alias("c")).where(F.col("c.x").isNotNull()).groupBy("_slot", "_k", "c.j", "c.x").count()
        for r in seen.collect():  # a row for each category and code
            own = out[r["_slot"]].get(r["j"])
            if own is not None:
                own["counts"][r["_k"], r["x"]] = r["count"]
    return out


def category_sizes(data: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    out = [np.zeros(n) for n in sizes]
    for r in data.select(F.posexplode("z").alias("s", "k")).where("k is not null").groupBy("s", "k").count().collect():
        out[r["s"]][r["k"]] = r["count"]
    return out


def from_assignments(book: Codebook, data: DataFrame, layouts: list[tuple[list[int], list[int]]]) -> Model:
    """A model with given assignments and point estimates. layouts: for each state the column -> view map and the
    number of categories of each view; data has z."""
    sizes = [k for _, cats in layouts for k in cats]
    wanted = [[j for j, x in enumerate(zc) if x == v] for zc, cats in layouts for v in range(len(cats))]
    stats = suffstats(data, book, sizes, dict(enumerate(wanted)))
    counts = category_sizes(data, sizes)
    states, slot = [], 0
    for _, cats in layouts:
        views = []
        for _ in cats:
            n = counts[slot]
            view = View(wanted[slot], n / max(1.0, n.sum()), n)
            for j in wanted[slot]:
                view.params[j] = dist.point_estimate(book.columns[j].ftype, stats[slot][j])
                if book.columns[j].mnar:
                    view.present[j] = dist.point_estimate("presence", stats[slot][-1 - j])
            views.append(view)
            slot += 1
        states.append(State(views))
    return Model(book, states, data)


def _plain(x: object) -> object:
    return x.tolist() if isinstance(x, np.ndarray) else x


def save(model: Model, spark: SparkSession, path: str, diagnostics: bool = True) -> None:
    """A folder with the table as Parquet and everything else as one JSON text table, written by Spark so that any
    store will do."""
    states = [
        {
            "process": s.process, "priors": {str(k): v for k, v in s.priors.items()}, "diagnostics": s.diagnostics if diagnostics else [],
            "views": [{"cols": v.cols, "weights": v.weights.tolist(), "sizes": v.sizes.tolist(), "process": v.process, "params": {str(j): {k: _plain(x) for k, x in p.items()} for j, p in v.params.items()}, "present": {str(j): {k: _plain(x) for k, x in p.items()} for j, p in v.present.items()}} for v in s.views],
        } for s in model.states
    ]
    parts = [("config", json.dumps({"version": VERSION, "has_data": model.data is not None})), ("codebook", model.codebook.json()), *[(f"state {k}", json.dumps(s)) for k, s in enumerate(states)]]
    spark.createDataFrame(parts, "part string, content string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    if model.data is not None:
        model.data.write.mode("overwrite").parquet(f"{path}/data")


def load(spark: SparkSession, path: str) -> Model:
    parts = {r[0]: r[1] for r in spark.read.parquet(f"{path}/model").collect()}
    config = json.loads(parts["config"])
    if config["version"] in (0, 1):
        raise ValueError(f"version {config['version']} is deprecated")
    if config["version"] != VERSION:
        raise ValueError(f"version {config['version']} is unsupported")
    states = []
    for k in range(len(parts) - 2):
        s = json.loads(parts[f"state {k}"])
        arrays = lambda ps: {int(j): {n: np.array(x) for n, x in p.items()} for j, p in ps.items()}
        views = [View(v["cols"], np.array(v["weights"]), np.array(v["sizes"]), arrays(v["params"]), arrays(v["present"]), v["process"]) for v in s["views"]]
        states.append(State(views, s["process"], {int(j): p for j, p in s["priors"].items()}, [tuple(d) for d in s["diagnostics"]]))
    data = spark.read.parquet(f"{path}/data") if config["has_data"] else None
    return Model(Codebook.parse(parts["codebook"]), states, data)


_DIAGNOSTICS = "state long, iter long, loglike double, logprior double, score double"


def write_diagnostics(model: Model, spark: SparkSession, path: str) -> None:
    """As CSV with a header."""
    rows = [(k, i, float(a), float(b), float(a + b)) for k, s in enumerate(model.states) for i, (a, b) in enumerate(s.diagnostics)]
    spark.createDataFrame(rows, _DIAGNOSTICS).coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_diagnostics(spark: SparkSession, path: str) -> list[list[tuple[float, float]]]:
    """(loglike, logprior) by state and iteration."""
    out: list[list[tuple[float, float]]] = []
    for r in spark.read.csv(path, header=True, schema=_DIAGNOSTICS).orderBy("state", "iter").collect():  # one row an iteration
        out += [[] for _ in range(r["state"] + 1 - len(out))]
        out[r["state"]].append((r["loglike"], r["logprior"]))
    return out


def save_state(model: Model, spark: SparkSession, path: str, state: int) -> None:
    """One state as a model of its own, with its rows."""
    k = model.chosen([state])[0]
    s = model.states[k]
    data = None if model.data is None else model.data.withColumn("z", F.array(*[F.get("z", model.slot(k, v)) for v in range(len(s.views))]))
    save(Model(model.codebook, [s], data), spark, path)
