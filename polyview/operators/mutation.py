"""Edits of the table: upserts, appends, removals, bounded windows. Each returns a new model; nothing changes in place.

New rows get a category in every view by one draw from the view's weights and components (a map over the new rows); removed
rows leave the views' sizes and weights, which are counted anew."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.functions import dist
from polyview.operators.likelihood import ln_cell
from polyview.plans import fit
from polyview.plans.model import Model, State, View, category_sizes, decode_column, encode_column, numbered
from polyview.sources.codebook import Column, infer
from polyview.sources.readers import ROW, with_row_names


#: Distinct values of a categorical column, which the driver holds.
MOST_VALUES = 100_000


@dataclass(frozen=True)
class WriteMode:
    """insert: unrestricted, deny_rows, deny_columns, deny_both; overwrite: allow, missing_only (cells of present rows and columns
    may be filled, not changed) or deny (they may not be touched, so values go to new rows and new columns alone); extend: whether unknown
    categories join a column's support; append: None, ("window",) or ("trench", most rows, at row)."""

    insert: str = "unrestricted"
    overwrite: str = "deny"
    extend: bool = False
    append: tuple | None = None

    @classmethod
    def unrestricted(cls) -> WriteMode:
        return cls("unrestricted", "allow", True)


def extended(model: Model, patch: DataFrame) -> Model:
    """The model with the patch's unknown categories in its supports, at no weight until the next fit."""
    out = copy.copy(model)
    out.codebook, out.states = copy.deepcopy(model.codebook), copy.deepcopy(model.states)
    for c in out.codebook.columns:
        if c.ftype == "categorical" and c.name in patch.columns:
            before = len(c.values)
            new = [r[0] for r in patch.select(F.col(f"`{c.name}`")).distinct().limit(MOST_VALUES + 1).collect() if r[0] is not None]
            if len(new) > MOST_VALUES:
                raise ValueError(f"column {c.name} has more than {MOST_VALUES} distinct values; that is no categorical column")
            for value in sorted(new):
                c.extend(value)
            if len(c.values) > before:
                j = out.codebook.index(c.name)
                for s in out.states:
                    p = s.views[s.view_of(j)].params[j]
                    p["ln_w"] = np.concatenate([p["ln_w"], np.full((len(p["ln_w"]), len(c.values) - before), -np.inf)], 1)
    return out


def assigned(model: Model, rows: DataFrame, seed: int = 0) -> DataFrame:
    """Encoded rows with z, drawn for each view given the row's cells."""
    shared = rows.sparkSession.sparkContext.broadcast(model.dataless())
    names = model.codebook.column_names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            if not len(b):
                continue
            rng = np.random.default_rng([seed, int(b["rix"].iloc[0])])
            z = np.zeros((len(b), own.n_slots), np.int32)
            slot = 0
            for s in own.states:
                for view in s.views:
                    with np.errstate(divide="ignore"):
                        w = np.repeat(np.log(view.weights)[None], len(b), 0)
                    for j in view.cols:
                        x = b[names[j]]
                        gone = x.isna().to_numpy()
                        w = w + ln_cell(own, view, j, x.fillna(0).to_numpy(), gone)
                    w = np.where(np.isfinite(w.max(1))[:, None], w, 0)
                    z[:, slot] = (w + rng.gumbel(size=w.shape)).argmax(1)
                    slot += 1
            yield b.assign(z=list(z))

    schema = rows.select("rix", "row", *[f"`{n}`" for n in names])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema)
    return schema.mapInPandas(run, f"{kinds}, z array<int>")


def recounted(model: Model, data: DataFrame) -> Model:
    """The model over other rows, with sizes and weights of the categories counted anew."""
    sizes = category_sizes(data, [len(v.weights) for s in model.states for v in s.views])
    states, slot = [], 0
    for s in model.states:
        views = []
        for v in s.views:
            n = sizes[slot]
            views.append(View(v.cols, n / n.sum() if n.sum() else v.weights, n, v.params, v.present, v.process))
            slot += 1
        states.append(State(views, s.process, s.priors, s.diagnostics))
    return Model(model.codebook, states, data)


def insert(model: Model, patch: DataFrame, mode: WriteMode | None = None, new_columns: list[Column] | None = None, seed: int = 0) -> tuple[Model, dict]:
    """Upserts cells of ``patch`` (an index column and some of the columns; nulls are left alone) and returns the model and what
    was done. One full join by row name; new rows are appended at the end."""
    mode = mode or WriteMode()
    patch = with_row_names(patch)
    cols = [c for c in patch.columns if c != ROW]
    unknown = [c for c in cols if c not in model.codebook.column_names]
    if unknown:
        if mode.insert in ("deny_columns", "deny_both"):
            raise ValueError(f"new columns are denied: {unknown}")
        if sorted(c.name for c in new_columns or []) != sorted(unknown):
            raise ValueError("new columns need metadata for just the new columns")
        model = with_columns(model, new_columns, seed)
    own = model.rows()
    if mode.extend:
        model = extended(model, patch)
    coded = patch.select(F.col(ROW).alias("_row"), *[encode_column(model.codebook[c], F.col(f"`{c}`")).alias(f"_n_{c}") for c in cols])
    seen = coded.join(own, F.col("_row") == F.col("row"), "left")
    known = [c for c in cols if c not in unknown]
    set_ = lambda empty: F.when(F.col("row").isNotNull(), sum((F.when(F.col(f"_n_{c}").isNotNull() & (F.col(f"`{c}`").isNull() == F.lit(empty)), 1).otherwise(0) for c in known), F.lit(0))).otherwise(0)
    n_new, n_over, n_fill, n_blank = seen.agg(F.sum(F.col("row").isNull().cast("int")), F.sum(set_(False)), F.sum(set_(True)), F.sum(F.when(F.coalesce(*[F.col(f"_n_{c}").cast("string") for c in cols]).isNull(), 1).otherwise(0)) if cols else F.lit(0)).first()
    if n_blank:
        raise ValueError("a row of the patch has no values")
    if n_new and mode.insert in ("deny_rows", "deny_both"):
        raise ValueError(f"{n_new} new rows are denied")
    if n_over and mode.overwrite != "allow":
        raise ValueError(f"{n_over} present cells would be overwritten")
    if n_fill and mode.overwrite == "deny":
        raise ValueError(f"{n_fill} empty cells of present rows would be filled")
    merged = own.join(coded, F.col("row") == F.col("_row"), "left").select("rix", "row", *[F.coalesce(F.col(f"_n_{c}"), F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`") for c in model.codebook.column_names], "z")
    if n_new:
        top = own.agg(F.coalesce(F.max("rix"), F.lit(-1))).first()[0] + 1
        fresh = numbered(coded.join(own.select("row"), F.col("_row") == F.col("row"), "left_anti"))
        kinds = {f.name: f.dataType for f in own.schema}
        fresh = fresh.select((F.col("rix") + top).alias("rix"), F.col("_row").alias("row"), *[(F.col(f"_n_{c}") if c in cols else F.lit(None)).cast(kinds[c]).alias(c) for c in model.codebook.column_names])
        merged = merged.unionByName(assigned(model, fresh, seed))
    out = recounted(model, merged)
    if unknown:
        out = fit.place_columns(out, unknown, seed)
    if mode.append and n_new:
        out = trimmed(out, mode.append, int(n_new))
    return out, {"new_rows": int(n_new or 0), "overwritten": int(n_over or 0), "new_columns": unknown}


def trimmed(model: Model, how: tuple, added: int) -> Model:
    """window: as many front rows go as were added; trench: rows from a place on go until no more than a number are left."""
    if how[0] == "window":
        return remove_range(model, 0, added)
    n = model.rows().count()
    return remove_range(model, how[2], max(0, n - how[1]))


def remove_range(model: Model, at: int, n: int) -> Model:
    """Without n rows from ordinal position ``at`` on; the rest is numbered anew."""
    data = model.rows()
    spots = ranked(data)
    kept = spots.where(~F.col("_at").between(at, at + n - 1))
    return recounted(model, kept.withColumn("rix", F.col("_at") - F.when(F.col("_at") >= at + n, n).otherwise(0)).drop("_at"))


def ranked(data: DataFrame) -> DataFrame:
    """data with each row's position by rix, by numbering sorted ranges."""
    return numbered(data.withColumnRenamed("rix", "_x"), ["_x"]).withColumnRenamed("rix", "_at").withColumnRenamed("_x", "rix").select("_at", *data.columns)


def remove_rows(model: Model, names: DataFrame) -> tuple[Model, DataFrame]:
    """names has ``row``: the model without these rows, and the rows that went."""
    data = model.rows()
    gone = data.join(names.select("row"), "row", "left_semi")
    left = ranked(data.join(names.select("row"), "row", "left_anti")).withColumn("rix", F.col("_at")).drop("_at")
    return recounted(model, left), gone


def remove_cells(model: Model, cells: DataFrame) -> Model:
    """cells has ``row`` and ``col``: blanks them; rows and columns without any value left go."""
    names = model.codebook.column_names
    wide = cells.groupBy(F.col("row").alias("_row")).agg(F.collect_set("col").alias("_cols"))  # at most one entry a column
    data = model.rows().join(wide, F.col("row") == F.col("_row"), "left")
    data = data.select("rix", "row", *[F.when(F.array_contains("_cols", n), None).otherwise(F.col(f"`{n}`")).alias(n) for n in names], "z")
    data = data.where(F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names]).isNotNull())
    out = recounted(model, ranked(data).withColumn("rix", F.col("_at")).drop("_at"))
    present = out.data.agg(*[F.count(F.col(f"`{n}`")).alias(n) for n in names]).first()
    for n in names:
        if not present[n]:
            out = remove_column(out, n)
    return out


def edit_cell(model: Model, row: str, col: str, value: object) -> Model:
    """One cell set without restriction; None blanks it."""
    spark = model.rows().sparkSession
    if value is None:
        return remove_cells(model, spark.createDataFrame([(row, col)], "row string, col string"))
    return insert(model, spark.createDataFrame([(row, value)], ["ID", col]), WriteMode.unrestricted())[0]


def remove_column(model: Model, col: str | int) -> Model:
    """Columns behind it move up; a view without columns goes, with its place in z."""
    j = model.codebook.index(col)
    book = copy.deepcopy(model.codebook)
    name = book.remove(j).name
    shift = lambda i: i - (i > j)
    states, kept, slot = [], [], 0
    for s in model.states:
        views = []
        for v in s.views:
            cols = [shift(i) for i in v.cols if i != j]
            if cols:
                views.append(View(cols, v.weights, v.sizes, {shift(i): p for i, p in v.params.items() if i != j}, {shift(i): p for i, p in v.present.items() if i != j}, v.process))
                kept.append(slot)
            slot += 1
        states.append(State(views, s.process, {shift(i): p for i, p in s.priors.items() if i != j}, s.diagnostics))
    data = None if model.data is None else model.data.drop(name).withColumn("z", F.array(*[F.get("z", k) for k in kept]))
    return Model(book, states, data)


def with_columns(model: Model, columns: list[Column], seed: int = 0) -> Model:
    """New, empty columns, each in a random view of every state, with components that know nothing yet; a state without views gets one,
    with one category. insert() assigns them by their values."""
    rng = np.random.default_rng([seed, 3])
    book, states = copy.deepcopy(model.codebook), copy.deepcopy(model.states)
    data, grown = model.data, False
    kinds = {"continuous": "double", "count": "long", "categorical": "int"}
    for c in columns:
        book.append(c)
        j = len(book.columns) - 1
        for s in states:
            if not s.views:
                s.views.append(View([], np.ones(1), np.zeros(1)))
                grown = True
            view = s.views[rng.integers(len(s.views))]
            k = len(view.weights)
            view.cols.append(j)
            view.params[j] = {"continuous": lambda: {"mu": np.full(k, c.hyper.get("mean", 0.0)), "sigma": np.full(k, c.hyper.get("var", 1.0) ** 0.5)}, "count": lambda: {"rate": np.full(k, max(1e-6, c.hyper.get("shape", 1.0) / c.hyper.get("rate", 1.0)))}, "categorical": lambda: {"ln_w": np.full((k, len(c.values)), -np.log(len(c.values)))}}[c.ftype]()  # noqa: B023
            if c.mnar:
                view.present[j] = {"p": np.full(k, 0.5)}
        if data is not None:
            data = data.withColumn(c.name, F.lit(None).cast(kinds[c.ftype]))
    if data is not None:
        data = data.select("rix", "row", *[f"`{n}`" for n in book.column_names], "z")
        if grown:
            data = data.withColumn("z", F.array(*[F.lit(0)] * len(states)))
    return Model(book, states, data)


def append_rows(model: Model, rows: DataFrame, append: tuple | None = None, seed: int = 0) -> Model:
    return insert(model, rows, WriteMode("deny_columns", "deny", True, append), seed=seed)[0]


def append_columns(model: Model, cols: DataFrame, metadata: list[Column] | None = None, cutoff: int = 20, no_hypers: bool = False, seed: int = 0) -> Model:
    """Columns by row name; their metadata is inferred where none is given."""
    if metadata is None:
        metadata = infer(with_row_names(cols), cutoff=cutoff, no_hypers=no_hypers).columns
    return insert(model, cols, WriteMode("deny_rows"), metadata, seed)[0]


def _picked(data: DataFrame, by: str, kind: str, wanted: list[tuple]) -> DataFrame:
    """Rows by name or by number, with ``_pos``, their place in the caller's list: an equi-join, in which the planner
    broadcasts a list that is small enough."""
    keys = data.sparkSession.createDataFrame(wanted, f"_pos long, _key {kind}")
    return data.join(keys, F.col(by) == F.col("_key")).drop("_key")


def select(model: Model, rows: object = None, cols: object = None) -> DataFrame:
    """Decoded cells with the row name as ``index``, in table order. rows and cols: a number, a name, a slice, or a list of
    numbers and names; all without."""
    book = model.codebook
    if cols is None:
        js = list(range(len(book.columns)))
    elif isinstance(cols, slice):
        js = list(range(len(book.columns)))[cols]
    else:
        js = [book.index(c) for c in (cols if isinstance(cols, list | tuple) else [cols])]
    data = model.rows()
    if isinstance(rows, slice):
        n = data.count()
        start, stop, step = rows.indices(n)
        at = F.col("rix")
        lo, hi = (start, stop - 1) if step > 0 else (stop + 1, start)
        data = data.where(at.between(lo, hi) & ((at - start) % abs(step) == 0))
        order = [F.col("rix").asc() if step > 0 else F.col("rix").desc()]
    elif rows is not None:
        wanted = list(rows) if isinstance(rows, list | tuple) else [rows]
        n = data.count() if any(isinstance(r, int) and r < 0 for r in wanted) else 0
        data = _picked(data, "row", "string", [(k, r) for k, r in enumerate(wanted) if isinstance(r, str)]).unionByName(_picked(data, "rix", "long", [(k, r % n if r < 0 else r) for k, r in enumerate(wanted) if not isinstance(r, str)]))
        order = [F.col("_pos")]
    else:
        order = [F.col("rix")]
    return data.orderBy(*order).select(F.col("row").alias("index"), *[decode_column(book.columns[j], F.col(f"`{book.columns[j].name}`")).alias(book.columns[j].name) for j in js])
