"""Engine, readers, edits and fitting on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from polyview.engine import Engine
from polyview.operators.mutation import WriteMode
from polyview.plans.fit import Handler
from polyview.sources.codebook import Codebook, Column, infer
from polyview.sources.readers import read_table, with_row_names


def frame(n=120, seed=0):
    rng = np.random.default_rng(seed)
    k = rng.integers(0, 2, n)
    return pd.DataFrame({"ID": [f"r{i}" for i in range(n)], "x": rng.normal(6 * k, 1), "c": np.where(rng.random(n) < 0.95, k, 1 - k).astype(int), "y": rng.normal(0, 1, n), "s": np.where(k == 1, "b", "a")})


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine.from_df(spark, frame(), n_states=3, seed=2)
    e.update(8)
    return e


def test_infer_types(spark):
    df = spark.createDataFrame([("a", 1, 30, -1, 0.5, True, "u"), ("b", 0, 2, 3, 1.5, False, "v")], "id string, small int, big int, signed int, real double, flag boolean, text string")
    book = infer(with_row_names(df))
    assert {c.name: (c.ftype, len(c.values)) for c in book.columns} == {"small": ("categorical", 2), "big": ("count", 0), "signed": ("continuous", 0), "real": ("continuous", 0), "flag": ("categorical", 2), "text": ("categorical", 2)}
    again = Codebook.parse(book.json())
    assert again.json() == book.json()
    for bad in ([("a", 1), ("b", 1)],):
        with pytest.raises(ValueError):
            infer(with_row_names(spark.createDataFrame(bad, "id string, x int")))
    with pytest.raises(ValueError):
        with_row_names(spark.createDataFrame([("a", 1), ("a", 2)], "id string, x int"))


def test_cutoff_is_twenty(spark):
    for top, kind in ((19, "categorical"), (20, "count")):
        df = spark.range(100).select(F.col("id").cast("string").alias("ID"), (F.col("id") % (top + 1)).cast("int").alias("x"))
        assert infer(with_row_names(df)).columns[0].ftype == kind


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_readers(spark, tmp_path, kind):
    df = spark.createDataFrame(frame(6))
    path = f"{tmp_path}/t.{'jsonl' if kind == 'json' else kind}"
    (df.write.option("header", True) if kind == "csv" else df.write).format(kind).save(path)
    got = read_table(spark, path)
    assert got.count() == 6 and set(got.columns) == set(df.columns)
    with pytest.raises(ValueError):
        read_table(spark, "t.xyz")


def test_fit_finds_dependence(engine):
    got = {(r["A"], r["B"]): r["depprob"] for r in engine.pairwise_fn("depprob").collect()}
    assert got["x", "x"] == 1 and got["x", "s"] >= got["x", "y"]
    assert engine.predict("s", {"x": 6.0})[0] == "b"
    assert engine.diagnostics().count() == 8


def test_queries(engine):
    assert engine.surprisal("x").count() == 120
    assert engine.simulate(["x", "s"], n=50).count() == 50
    assert len(engine.draw("r1", "s", 7)) == 7
    assert 0 <= engine.novelty("r3") <= 1
    assert engine.rowsim([("r0", "r0"), ("r0", "r1")]).count() == 2
    order, _, links = engine.clustermap("depprob")
    assert sorted(order) == sorted(engine.columns) and len(links) == 3
    with pytest.raises(ValueError):
        engine.logp({"x": None})
    with pytest.raises(IndexError):
        engine.logp({"zzz": 1.0})


def test_indexing(engine):
    assert engine["r3", "s"] in ("a", "b")
    assert [r["index"] for r in engine[["r5", "r2"], ["x"]].collect()] == ["r5", "r2"]
    assert [r["index"] for r in engine[2:8:3, "x"].collect()] == ["r2", "r5"]
    assert engine[-1, "x"] == engine["r119", "x"]
    with pytest.raises(IndexError):
        engine["nope"]


def test_edits(engine):
    e = engine.copy()
    with pytest.raises(ValueError):
        e.insert(pd.DataFrame({"ID": ["r0"], "x": [1.0]}))
    e.insert(pd.DataFrame({"ID": ["r0"], "x": [1.25]}), WriteMode.unrestricted())
    assert e["r0", "x"] == 1.25
    e.append_rows(pd.DataFrame({"ID": ["n0"], "x": [0.1], "s": ["new"]}))
    assert e.shape[0] == 121 and e.categorical_support("s")[-1] == "new" and e["n0", "s"] == "new"
    e.edit_cell("n0", "x", None)
    assert e["n0", "x"] is None and e.impute("x").count() == 1
    assert e.remove_rows(["r1", "r2"]).count() == 2 and e.shape[0] == 119
    e.append_columns(pd.DataFrame({"ID": ["r3", "r4"], "extra": [1.5, 2.5]}))
    assert "extra" in e.columns
    e.del_column("y")
    assert "y" not in e.columns
    e.update(1)
    assert engine.shape == (120, 4)


def test_window_keeps_the_size(spark):
    e = Engine.from_df(spark, frame(10), n_states=2, seed=1)
    for k in range(3):
        e.append_rows(pd.DataFrame({"ID": [f"n{k}"], "x": [0.5]}), ("window",))
    assert e.shape[0] == 10 and e.model.rows().where("row = 'r2'").count() == 0


def test_save_and_load(engine, spark, tmp_path):
    engine.save(f"{tmp_path}/m")
    again = Engine.load(spark, f"{tmp_path}/m")
    assert again.shape == engine.shape and again.logp({"x": 1.0}) == pytest.approx(engine.logp({"x": 1.0}))
    with pytest.raises(ValueError):
        engine.dataless().surprisal("x")


def test_stops(spark):
    e = Engine.from_df(spark, frame(20), n_states=1, seed=1)
    e.update(50, handler=Handler(stop=lambda sweep, m: sweep >= 2))
    assert len(e.model.states[0].diagnostics) == 2
    with pytest.raises(ValueError):
        e.update(1, transitions=())
    e.flatten_columns()
    assert set(e.column_assignment(0)) == {0}


def test_missing_not_at_random(spark):
    df = frame(60)
    df.loc[df.index % 3 > 0, "y"] = None
    book = infer(with_row_names(spark.createDataFrame(df)))
    book.replaced(book["y"].missing_not_at_random())
    e = Engine.from_df(spark, df, book, n_states=2, seed=4)
    e.update(3)
    assert e.predict("y")[0] is None
    assert isinstance(Column.count("k").renamed("j"), Column)


def test_entry_points_import():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
