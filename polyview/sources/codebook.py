"""Column metadata of a table: types, supports, priors; inferred from data or declared."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, NullType, ShortType, StringType

from polyview.sources.readers import ROW

CUTOFF = 20
#: Distinct values of a text column, which the driver holds.
MOST_VALUES = 100_000


@dataclass
class PriorProcess:
    """kind dirichlet: alpha ~ Gamma(shape, rate); pitman_yor adds d ~ Beta(a, b)."""

    kind: str = "dirichlet"
    shape: float = 1.0
    rate: float = 1.0
    a: float = 0.5
    b: float = 0.5


@dataclass
class Column:
    """ftype: continuous, count or categorical. values: the support in code order; kind of value: string, uint or bool.
    prior: fixed parameters (then they aren't resampled), else None; hyper: what priors are drawn from."""

    name: str
    ftype: str
    values: list = field(default_factory=list)
    value_kind: str = ""
    hyper: dict = field(default_factory=dict)
    prior: dict | None = None
    notes: str | None = None
    mnar: bool = False

    def code(self, value: object) -> int:
        try:
            return self.values.index(bool(value) if self.value_kind == "bool" else int(value) if self.value_kind == "uint" else str(value))
        except ValueError:
            raise ValueError(f"column {self.name} has no category {value!r}") from None

    def extend(self, value: object) -> int:
        """The code of a value, which joins the support if it is new: strings at the end, integers up to it."""
        if self.value_kind == "bool":
            return self.code(value)
        if self.value_kind == "uint":
            self.values += range(len(self.values), int(value) + 1)
            return int(value)
        if str(value) not in self.values:
            self.values.append(str(value))
        return self.values.index(str(value))

    def missing_not_at_random(self) -> Column:
        return dataclasses.replace(self, mnar=True)

    def renamed(self, name: str) -> Column:
        return dataclasses.replace(self, name=name)

    def noted(self, notes: str) -> Column:
        return dataclasses.replace(self, notes=notes)

    @classmethod
    def continuous(cls, name: str, **more: object) -> Column:
        return cls(name, "continuous", **more)

    @classmethod
    def count(cls, name: str, **more: object) -> Column:
        return cls(name, "count", **more)

    @classmethod
    def categorical(cls, name: str, values: list | int, **more: object) -> Column:
        values = list(range(values)) if isinstance(values, int) else list(values)
        kind = "bool" if all(isinstance(v, bool) for v in values) else "uint" if all(isinstance(v, int) for v in values) else "string"
        return cls(name, "categorical", values, kind, **more)


@dataclass
class Codebook:
    name: str = "my_table"
    columns: list[Column] = field(default_factory=list)
    state_process: PriorProcess = field(default_factory=PriorProcess)
    view_process: PriorProcess = field(default_factory=PriorProcess)
    comments: str | None = None

    @classmethod
    def empty(cls, name: str) -> Codebook:
        return cls(name)

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def index(self, col: str | int) -> int:
        """Position of a column by name, or by number (negative from the end)."""
        n = len(self.columns)
        if isinstance(col, str):
            if col not in self.column_names:
                raise IndexError(f"no column {col!r}")
            return self.column_names.index(col)
        if not -n <= col < n:
            raise IndexError(f"column {col} is out of bounds ({n} columns)")
        return col % n

    def __getitem__(self, col: str | int) -> Column:
        return self.columns[self.index(col)]

    def append(self, column: Column) -> None:
        if column.name in self.column_names:
            raise ValueError(f"column {column.name!r} is there already")
        self.columns.append(column)

    def remove(self, col: str | int) -> Column:
        return self.columns.pop(self.index(col))

    def replaced(self, column: Column) -> None:
        self.columns[self.index(column.name)] = column

    def rename(self, name: str) -> None:
        self.name = name

    def rename_column(self, col: str | int, name: str) -> None:
        if name != self[col].name and name in self.column_names:
            raise ValueError(f"column {name!r} is there already")
        self.columns[self.index(col)] = self[col].renamed(name)

    def merged(self, other: Codebook) -> Codebook:
        """With another's columns behind its own; a name in both is an error."""
        out = dataclasses.replace(self, columns=list(self.columns))
        for c in other.columns:
            out.append(c)
        return out

    def yaml(self) -> str:
        """The JSON form, which is YAML too, where no YAML library is installed."""
        try:
            import yaml
        except ImportError:
            return self.json()
        return yaml.safe_dump(dataclasses.asdict(self), sort_keys=False)

    def value_map(self, col: str | int) -> list:
        return list(self[col].values)

    def json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2)

    @classmethod
    def from_dict(cls, d: dict) -> Codebook:
        d = dict(d)
        return cls(d.get("name", "my_table"), [Column(**c) for c in d.get("columns", [])], PriorProcess(**(d.get("state_process") or {})), PriorProcess(**(d.get("view_process") or {})), d.get("comments"))

    @classmethod
    def parse(cls, text: str) -> Codebook:
        """From JSON, else from YAML where that is installed."""
        try:
            return cls.from_dict(json.loads(text))
        except json.JSONDecodeError:
            import yaml

            return cls.from_dict(yaml.safe_load(text))


_WHOLE = (ByteType, ShortType, IntegerType, LongType)


def infer(df: DataFrame, name: str = "my_table", cutoff: int = CUTOFF, no_hypers: bool = False, only: list[str] | None = None) -> Codebook:
    """One aggregate over all columns, and the distinct values of string columns (a column with very many isn't
    categorical data; the support is held by the driver)."""
    names = [c for c in (only or df.columns) if c != ROW]
    kinds = {f.name: f.dataType for f in df.schema}
    for c in names:
        if isinstance(kinds[c], NullType):
            raise ValueError(f"column {c} is blank")
        if not isinstance(kinds[c], (*_WHOLE, FloatType, DoubleType, StringType, BooleanType)):
            raise ValueError(f"unsupported dtype of column {c}: {kinds[c].simpleString()}")
    aggs = []
    for k, c in enumerate(names):
        x = F.col(f"`{c}`")
        x = F.when(~F.isnan(x), x) if isinstance(kinds[c], (FloatType, DoubleType)) else x  # frames from pandas have NaN for missing
        aggs += [F.min(x).alias(f"lo{k}"), F.max(x).alias(f"hi{k}"), F.count(x).alias(f"n{k}"), F.count("*").alias(f"all{k}")]
        if not isinstance(kinds[c], (StringType, BooleanType)):
            v = x.cast("double")
            aggs += [F.avg(v).alias(f"mean{k}"), F.var_pop(v).alias(f"var{k}"), F.avg(F.log(v + 0.1)).alias(f"ln{k}")]
        elif isinstance(kinds[c], StringType):
            aggs.append(F.approx_count_distinct(x).alias(f"many{k}"))
    got = df.agg(*aggs).first() if aggs else None
    texts = [(k, c) for k, c in enumerate(names) if isinstance(kinds[c], StringType)]
    for k, c in texts:
        if got[f"many{k}"] > MOST_VALUES:
            raise ValueError(f"column {c} has some {got[f'many{k}']} distinct values; that is no categorical column")
    sets: dict[int, list] = {k: [] for k, _ in texts}
    if texts:  # distinct before they meet; their number was bounded above
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").alias("v")) for k, c in texts]))
        for r in df.select(pairs.alias("p")).select("p.*").where("v is not null").distinct().orderBy("k", "v").collect():
            sets[r["k"]].append(r["v"])
    book = Codebook(name)
    for k, c in enumerate(names):
        lo, hi, n, every = (got[f"{x}{k}"] for x in ("lo", "hi", "n", "all"))
        if not n:
            raise ValueError(f"column {c} is blank")
        if lo == hi and n == every:
            raise ValueError(f"column {c} has a single value")
        kind = kinds[c]
        if isinstance(kind, (StringType, BooleanType)) or isinstance(kind, _WHOLE) and 0 <= lo and hi < cutoff:
            values = sets[k] if isinstance(kind, StringType) else [False, True] if isinstance(kind, BooleanType) else list(range(int(hi) + 1))
            own = Column.categorical(c, values)
            own.value_kind = "string" if isinstance(kind, StringType) else own.value_kind
            own.hyper, own.prior = {"shape": 1.0, "scale": 1.0}, {"alpha": 0.5} if no_hypers else None
        elif isinstance(kind, _WHOLE) and lo >= 0:
            mean, ln = got[f"mean{k}"] + 0.1, got[f"ln{k}"]
            s = max(1e-6, math.log(mean) - ln)
            shape = (3 - s + ((s - 3) ** 2 + 24 * s) ** 0.5) / (12 * s)
            own = Column.count(c)
            own.hyper, own.prior = {"shape": shape, "rate": shape / mean}, {"shape": mean, "rate": 1.0} if no_hypers else None
        else:
            own = Column.continuous(c)
            own.hyper = {"mean": got[f"mean{k}"], "var": max(got[f"var{k}"], 1e-12), "n": n}
            own.prior = {"m": got[f"mean{k}"], "k": 1.0, "v": 1.0, "s2": max(got[f"var{k}"], 1e-12)} if no_hypers else None
        book.append(own)
    return book


def infer_column(df: DataFrame, col: str, cutoff: int = CUTOFF, no_hypers: bool = False) -> Column:
    return infer(df, cutoff=cutoff, no_hypers=no_hypers, only=[col]).columns[0]
