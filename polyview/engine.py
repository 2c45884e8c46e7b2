"""The user's engine: a table, its codebook and a fitted model behind one object."""

from __future__ import annotations

import copy
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.operators import explanation, frames, generation, information, likelihood, mutation, prediction, structure
from polyview.plans import fit
from polyview.plans import model as models
from polyview.plans.model import Model
from polyview.sources import codebook as codebooks
from polyview.sources.codebook import Codebook
from polyview.sources.readers import ROW, read_table, with_row_names


class Oracle:
    """Queries only; without data (``dataless``) those that need rows fail."""

    def __init__(self, spark: SparkSession, model: Model, seed: int = 0):
        self.spark, self.model, self._seed, self._calls = spark, model, seed, 0

    # metadata
    codebook = property(lambda self: self.model.codebook)
    n_cols = property(lambda self: len(self.model.codebook.columns))
    n_states = property(lambda self: len(self.model.states))
    columns = property(lambda self: self.model.codebook.column_names)
    ftypes = property(lambda self: {c.name: c.ftype for c in self.model.codebook.columns})
    n_rows = property(lambda self: 0 if self.model.data is None else self.model.data.count())
    shape = property(lambda self: (self.n_rows, self.n_cols))
    is_empty = property(lambda self: self.n_cols == 0 or self.n_rows == 0)
    index = property(lambda self: self.model.rows().orderBy("rix").select("row"))

    def write_diagnostics(self, path: str) -> None:
        """CSV with one row an iteration and state: state, iter, loglike, logprior, score."""
        models.write_diagnostics(self.model, self.spark, path)

    # tidy tables of what one would plot
    def prediction_frame(self, target, given: dict | None = None, n_points: int = 1000) -> DataFrame:
        return frames.prediction(self.model, self.spark, target, given, n_points)

    def state_frame(self, state: int) -> DataFrame:
        return frames.state(self.model, state)

    def explanation_frame(self, target, given: dict, method: str = "ablative-err") -> DataFrame:
        return frames.explanation(self.model, self.spark, target, given, method)

    def seed(self, seed: int) -> None:
        self._seed, self._calls = seed, 0

    def _next(self) -> int:
        self._calls += 1
        return self._seed * 1_000_003 + self._calls

    def ftype(self, col: str | int) -> str:
        return self.model.codebook[col].ftype

    def categorical_support(self, col: str | int) -> list:
        return self.model.codebook.value_map(col)

    def column_assignment(self, state: int) -> list[int]:
        return self.model.states[self.model.chosen([state])[0]].assignment(self.n_cols)

    def row_assignments(self, state: int) -> DataFrame:
        """rix, row and the category of each view of a state."""
        own = self.model.states[self.model.chosen([state])[0]]
        return self.model.rows().select("rix", "row", *[F.get("z", self.model.slot(state, v)).alias(f"view_{v}") for v in range(len(own.views))])

    def feature_params(self, col: str | int, states: list[int] | None = None) -> dict[int, dict]:
        j = self.model.codebook.index(col)
        return {s: self.model.states[s].views[self.model.states[s].view_of(j)].params[j] for s in self.model.chosen(states)}

    def diagnostics(self, name: str = "score") -> DataFrame:
        """One row an iteration, one column a state; shorter states end in nulls. score is loglike + logprior."""
        pick = {"loglike": lambda d: d[0], "logprior": lambda d: d[1], "score": lambda d: d[0] + d[1]}[name]
        n = max([0, *(len(s.diagnostics) for s in self.model.states)])
        rows = [(i, *[float(pick(s.diagnostics[i])) if i < len(s.diagnostics) else None for s in self.model.states]) for i in range(n)]
        return self.spark.createDataFrame(rows, "iter long, " + ", ".join(f"state_{k} double" for k in range(self.n_states)))

    def __getitem__(self, key):
        rows, cols = key if isinstance(key, tuple) else (None, key)
        out = mutation.select(self.model, rows, cols)
        one = isinstance(rows, int | str) and isinstance(cols, int | str)
        return out.first()[1] if one else out

    def datum(self, row: str | int, col: str | int):
        r = self.model.rows().where(self.model.where(row)).select(models.decode_column(self.codebook[col], F.col(f"`{self.codebook[col].name}`"))).first()
        if r is None:
            raise IndexError(f"no row {row!r}")
        return r[0]

    def summarize_col(self, col: str | int) -> dict:
        return prediction.summarize(self.model, col)

    # structure
    def depprob(self, pairs: list[tuple]) -> DataFrame:
        return structure.depprob_pairs(self.model, self.spark, pairs)

    def rowsim(self, pairs: list[tuple] | DataFrame, wrt: list | None = None, col_weighted: bool = False) -> DataFrame:
        pairs = pairs if isinstance(pairs, DataFrame) else self.spark.createDataFrame([tuple(p) for p in pairs], "A string, B string")
        return structure.rowsim(self.model, pairs, wrt, col_weighted)

    def novelty(self, row: str | int | None = None, wrt: list | None = None):
        out = structure.novelty(self.model, wrt)
        if row is None:
            return out
        name = row if isinstance(row, str) else self.model.rows().where(F.col("rix") == row).first()["row"]
        return out.where(F.col("row") == name).first()["novelty"]

    def pairwise_fn(self, fn: str, indices: list | None = None, **kwargs) -> DataFrame:
        """A, B and the function's value of all ordered pairs of columns, or of the named rows."""
        if fn == "rowsim":
            rows = self.index if indices is None else self.spark.createDataFrame([(n,) for n in self._names(list(indices))], "row string")
            pairs = rows.select(F.col("row").alias("A")).crossJoin(rows.select(F.col("row").alias("B")))  # all pairs are what is asked for
            return self.rowsim(pairs, **kwargs)
        names = [self.codebook[c].name for c in (indices or self.columns)]
        pairs = structure.all_pairs(names)
        return {"depprob": self.depprob, "mi": self.mi}[fn](pairs, **kwargs)

    def clustermap(self, fn: str, indices: list | None = None, **kwargs):
        return structure.clustermap([tuple(r) for r in self.pairwise_fn(fn, indices, **kwargs).collect()])

    # information
    def entropy(self, cols: list, n: int = 1000) -> float:
        return information.entropy(self.model, cols, n)

    def mi(self, pairs: list[tuple], n: int = 1000, mi_type: str = "iqr") -> DataFrame:
        name = lambda c: self.codebook[c].name
        return self.spark.createDataFrame([(name(a), name(b), x) for (a, b), x in zip(pairs, information.mi_pairs(self.model, pairs, mi_type, n), strict=True)], "A string, B string, mi double")

    def conditional_entropy(self, target, given: list, n: int = 1000) -> float:
        return information.conditional_entropy(self.model, target, given, n)

    def info_prop(self, targets: list, predictors: list, n: int = 1000) -> float:
        return information.info_prop(self.model, targets, predictors, n)

    def predictor_search(self, targets: list, most: int, n: int = 1000) -> list[tuple[str, float]]:
        return information.predictor_search(self.model, targets, most, n)

    # likelihood
    def logp(self, values, given: dict | None = None, states: list[int] | None = None, scaled: bool = False):
        """values: a dict (one row, gives a number) or a DataFrame (gives it with a column)."""
        if isinstance(values, dict):
            js = [self.codebook.index(c) for c in values]
            import numpy as np

            x = [likelihood.coded(self.model, j, v) for j, v in zip(js, values.values(), strict=True)]
            for j, v in zip(js, x, strict=True):
                if v is None and not self.codebook.columns[j].mnar:
                    raise ValueError(f"column {self.codebook.columns[j].name} is missing")
            return float(likelihood.logp_values(self.model, js, [np.array([0 if v is None else v]) for v in x], [np.array([v is None]) for v in x], likelihood.resolved(self.model, given, js), self.model.chosen(states), scaled)[0])
        return likelihood.logp(self.model, values, [c for c in values.columns if c in self.columns], given, states, scaled)

    def surprisal(self, col: str | int, rows: list | str | int | None = None, values: list | None = None, states: list[int] | None = None, keep_missing: bool = False) -> DataFrame:
        """Of the table's cells (all rows, or those named); with values, of one hypothetical value for each of the rows, or of several
        values for one row (then without the row's name)."""
        if rows is None and values is None:
            return likelihood.surprisal(self.model, col, states, keep_missing)
        if rows is None:
            names = [r["row"] for r in self.model.rows().orderBy("rix").select("row").limit(len(values) + 1).collect()]  # one more tells that they differ
        else:
            names = self._names(rows if isinstance(rows, list | tuple) else [rows])
        if not names:
            raise ValueError("no rows were named")
        if values is None:
            keys = self.spark.createDataFrame([(k, n) for k, n in enumerate(names)], "_pos long, _row string")
            out = likelihood.surprisal(self.model, col, states, keep_missing)
            return out.join(keys, F.col("row") == F.col("_row")).orderBy("_pos").drop("_pos", "_row")
        if len(names) > 1 and len(names) != len(values):
            raise ValueError(f"{len(names)} rows and {len(values)} values")
        c = self.codebook[col]
        x = [likelihood.coded(self.model, self.codebook.index(col), v) for v in values]
        kind = {"continuous": "double", "count": "long", "categorical": "int"}[c.ftype]
        keys = self.spark.createDataFrame([(k, names[k if len(names) > 1 else 0], v) for k, v in enumerate(x)], f"_pos long, row string, value {kind}")
        out = likelihood.surprisal_of(self.model, col, keys, states)
        return out if len(names) > 1 else out.select("surprisal")

    def _names(self, rows: list) -> list[str]:
        """Row names of names and numbers."""
        numbers = sorted({r for r in rows if isinstance(r, int)})
        known = {}
        if numbers:
            n = self.n_rows if numbers[0] < 0 else 0
            found = mutation._picked(self.model.rows(), "rix", "long", [(r, r % n if r < 0 else r) for r in numbers]).select("_pos", "row").collect()  # as long as the caller's list
            known = {r["_pos"]: r["row"] for r in found}
            if len(known) < len(numbers):
                raise IndexError("a row is out of bounds")
        return [known[r] if isinstance(r, int) else r for r in rows]

    def conditional_entropy_pw(self, cols: list, given: list, n: int = 1000) -> DataFrame:
        pairs = [(self.codebook[a].name, self.codebook[b].name) for a in cols for b in given]
        return self.spark.createDataFrame([(a, b, information.conditional_entropy(self.model, a, [b], n)) for a, b in pairs], "A string, B string, conditional_entropy double")

    def inconsistency(self, values: DataFrame, given: dict | None = None) -> DataFrame:
        return likelihood.inconsistency(self.model, values, [c for c in values.columns if c in self.columns], given)

    # generation, prediction
    def simulate(self, cols: list, given: dict | None = None, n: int = 1, states: list[int] | None = None, include_given: bool = False) -> DataFrame:
        return generation.simulate(self.model, self.spark, cols, given, n, states, self._next(), include_given)

    def draw(self, row: str | int, col: str | int, n: int = 1) -> list:
        return generation.draw(self.model, row, col, n, self._next())

    def predict(self, target, given: dict | None = None, states: list[int] | None = None, with_uncertainty: bool = True):
        return prediction.predict(self.model, target, given, states, with_uncertainty)

    def variability(self, target, given: dict | None = None, states: list[int] | None = None) -> float:
        return prediction.variability(self.model, target, given, states)

    def impute(self, col, rows: list[str] | None = None, with_uncertainty: bool = True) -> DataFrame:
        table = None if rows is None else self.spark.createDataFrame([(r,) for r in rows], "row string")
        return prediction.impute(self.model, col, table, with_uncertainty)

    def feature_error(self, col) -> tuple[float, float]:
        return prediction.feature_error(self.model, col)

    # explanation
    def held_out(self, what: str, target, given: dict, greedy: bool = True):
        """what: neglogp and inconsistency take values by column as target, uncertainty a column."""
        return getattr(explanation, f"held_out_{what}")(self.model, target, given, greedy)

    def attributable(self, what: str, target, given: dict, greedy: bool = True):
        return getattr(explanation, f"attributable_{what}")(self.model, target, given, greedy)

    def explain_prediction(self, target, given: dict, method: str = "ablative-err"):
        return explanation.explain_prediction(self.model, target, given, method)

    # forms
    def dataless(self) -> Oracle:
        return Oracle(self.spark, self.model.dataless(), self._seed)

    def save(self, path: str) -> None:
        models.save(self.model, self.spark, path)

    def __getstate__(self) -> dict:
        """The parts that fit in a pickle: everything but the session and the rows."""
        return {"model": self.model.dataless(), "_seed": self._seed, "_calls": self._calls}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.spark = SparkSession.getActiveSession()


class Engine(Oracle):
    """An oracle that can be fitted and whose table can be edited."""

    @classmethod
    def from_df(cls, spark: SparkSession, source, codebook: Codebook | None = None, n_states: int = 8, seed: int = 0, flat_columns: bool = False, order: list[str] | None = None) -> Engine:
        """From a table (see read_table) with an index column ``id`` or ``index``; without a codebook it is inferred."""
        df = with_row_names(read_table(spark, source))
        book = codebook or codebooks.infer(df)
        return cls(spark, fit.start(book, models.encode(df, book, order), n_states, seed, flat_columns), seed)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        return cls(spark, models.load(spark, path))

    @classmethod
    def empty(cls, spark: SparkSession, name: str = "my_table", n_states: int = 8, seed: int = 0) -> Engine:
        """Without rows and columns; insert() brings both, with the columns' metadata."""
        data = spark.createDataFrame([], "rix long, row string, z array<int>")
        return cls(spark, Model(Codebook.empty(name), [models.State([]) for _ in range(n_states)], data), seed)

    def cell_gibbs(self, row: str | int, col: str | int) -> None:
        """One column's view and one row's category in it anew, in every state; nothing happens to an empty engine."""
        if not self.is_empty:
            self.model = fit.cell_gibbs(self.model, row, col, self._next())

    def update(self, n_iters: int, transitions="default", kernel: str = "slice", timeout: float | None = None, checkpoint: int | None = None, save_path: str | None = None, handler: fit.Handler | list | None = None, column_kernel: str = "gibbs") -> None:
        save: Callable | None = None if save_path is None else lambda sweep, m: models.save(m, self.spark, f"{save_path}/checkpoint-{sweep}")
        handlers = handler if isinstance(handler, list) else [handler or fit.Handler()]
        handlers = [*handlers, fit.Handler(timeout)] if timeout is not None else handlers
        self.model = fit.update(self.model, n_iters, transitions, kernel, self._next(), handlers, save, checkpoint, column_kernel)

    def flatten_columns(self) -> None:
        self.model = fit.flatten(self.model, self._next())

    def insert(self, patch, mode: mutation.WriteMode | None = None, new_columns: list | None = None) -> dict:
        self.model, done = mutation.insert(self.model, read_table(self.spark, patch), mode, new_columns, self._next())
        return done

    def append_rows(self, rows, append: tuple | None = None) -> None:
        self.model = mutation.append_rows(self.model, read_table(self.spark, rows), append, self._next())

    def append_columns(self, cols, metadata: list | None = None, cutoff: int = 20, no_hypers: bool = False) -> None:
        self.model = mutation.append_columns(self.model, read_table(self.spark, cols), metadata, cutoff, no_hypers, self._next())

    def edit_cell(self, row: str, col: str, value) -> None:
        self.model = mutation.edit_cell(self.model, row, col, value)

    def del_column(self, col) -> None:
        self.model = mutation.remove_column(self.model, col)

    def remove_rows(self, names: list[str]) -> DataFrame:
        self.model, gone = mutation.remove_rows(self.model, self.spark.createDataFrame([(n,) for n in names], "row string"))
        return gone

    def remove_cells(self, cells: list[tuple[str, str]]) -> None:
        self.model = mutation.remove_cells(self.model, self.spark.createDataFrame(cells, "row string, col string"))

    def del_rows_at(self, at: int, n: int) -> None:
        self.model = mutation.remove_range(self.model, at, n)

    def copy(self) -> Engine:
        return Engine(self.spark, copy.copy(self.model), self._seed)


__all__ = ["ROW", "Engine", "Oracle"]
