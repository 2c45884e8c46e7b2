"""Numbering of many rows, write modes, streams, the empty engine, and the smaller parts of the front end."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from polyview.engine import Engine
from polyview.operators import explanation, mutation
from polyview.operators.mutation import WriteMode
from polyview.plans import fit, model as models
from polyview.plans.fit import Handler, Interrupt, StateTimeout
from polyview.sources.codebook import Codebook, Column
from polyview.streaming.append import append_stream, score_stream

N = 1_000_000


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A million rows whose numbers are not in the order of the file, over many shuffle partitions that adaptive execution merges."""
    path = f"{tmp_path_factory.mktemp('many')}/rows"
    x = F.col("id")
    own = spark.range(N).select(((x * 7919) % N).alias("rix"), F.concat(F.lit("r"), (x * 7919) % N).alias("row"), (x % 13).cast("double").alias("a"), (x % 5).cast("int").alias("b"), F.array((x % 3).cast("int")).alias("z"))
    own.repartition(9).write.parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    view = models.View([0, 1], np.full(3, 1 / 3), np.full(3, N / 3), {0: {"mu": np.zeros(3), "sigma": np.ones(3)}, 1: {"ln_w": np.log(np.full((3, 5), 0.2))}})
    yield models.Model(Codebook("t", [Column.continuous("a"), Column.categorical("b", 5)]), [models.State([view])], spark.read.parquet(path))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def gapless(df, n):
    r = df.agg(F.count("*"), F.countDistinct("rix"), F.min("rix"), F.max("rix")).first()
    assert tuple(r) == (n, n, 0, n - 1)


def test_no_row_is_lost_or_numbered_twice(many, spark):
    left = mutation.remove_range(many, 10, 3).rows()
    gapless(left, N - 3)
    assert left.where(F.col("rix") != F.when(F.substring("row", 2, 9).cast("long") > 12, F.substring("row", 2, 9).cast("long") - 3).otherwise(F.substring("row", 2, 9).cast("long"))).count() == 0
    some, gone = mutation.remove_rows(many, many.rows().where("rix % 1000 = 7").select("row"))
    gapless(some.rows(), N - N // 1000)
    assert gone.count() == N // 1000
    gapless(models.numbered(many.rows().drop("rix"), ["a", "b"]), N)  # many equal keys
    gapless(models.numbered(many.rows().drop("rix").join(spark.range(1).select(F.lit(0).alias("b0")), F.col("b") >= F.col("b0"))), N)


def test_windows_and_trenches_of_many_rows(many, spark):
    new = spark.createDataFrame([(f"n{k}", float(k)) for k in range(4)], "ID string, a double")
    window = mutation.append_rows(many, new, ("window",)).rows()
    gapless(window, N)
    assert window.where("row in ('r0', 'r1', 'r2', 'r3')").count() == 0 and window.where("rix >= 999996 and row like 'n%'").count() == 4
    trench = mutation.append_rows(many, new, ("trench", N, 10)).rows()
    gapless(trench, N)
    assert trench.where("row in ('r10', 'r11', 'r12', 'r13')").count() == 0 and trench.where("row = 'r9' and rix = 9").count() == 1


def test_medians_of_many_rows(many, monkeypatch):
    from polyview.operators import prediction

    for df, want in ((many.rows(), 6.0), (many.rows().where("a <> 6 or rix % 2 = 0").where("a < 12"), None)):
        n = df.count()
        exact = df.agg(F.percentile("a", 0.5)).first()[0]
        monkeypatch.setattr(prediction, "FEW", 10)
        assert prediction.median(df, F.col("a"), n) == exact == (want if want is not None else exact)
    some = df.limit(1000).withColumn("a", F.col("rix").cast("double") / 7)
    assert prediction.median(some, F.col("a"), 1000) == pytest.approx(some.agg(F.percentile("a", 0.5)).first()[0])


def frame(n=40, seed=0):
    rng = np.random.default_rng(seed)
    k = rng.integers(0, 2, n)
    return pd.DataFrame({"ID": [f"r{i}" for i in range(n)], "x": rng.normal(6 * k, 1), "y": rng.poisson(3 + 9 * k) + 20 * (np.arange(n) == 0), "s": np.where(k == 1, "b", "a")})


@pytest.fixture(scope="module")
def engine(spark):
    df = frame()
    df.loc[3, "x"] = None
    e = Engine.from_df(spark, df, n_states=2, seed=2)
    e.update(3)
    return e


def test_write_modes(engine):
    full, hole, row = ({"ID": ["r0"], "x": [1.0]}, {"ID": ["r3"], "x": [1.0]}, {"ID": ["new"], "x": [1.0]})
    column = pd.DataFrame({"ID": ["r0"], "extra": [1.5]})
    for overwrite, bad in (("deny", [full, hole]), ("missing_only", [full]), ("allow", [])):
        for patch in (full, hole, row):
            if patch in bad:
                with pytest.raises(ValueError):
                    engine.copy().insert(pd.DataFrame(patch), WriteMode(overwrite=overwrite))
            else:
                engine.copy().insert(pd.DataFrame(patch), WriteMode(overwrite=overwrite))
    for insert, patch in (("deny_rows", row), ("deny_both", row), ("deny_columns", column), ("deny_both", column)):
        with pytest.raises(ValueError):
            engine.copy().insert(pd.DataFrame(patch), WriteMode(insert), [Column.continuous("extra")] if "extra" in patch else None)
    e = engine.copy()
    e.insert(column, WriteMode("deny_rows"), [Column.continuous("extra", hyper={"mean": 0.0, "var": 1.0})])
    assert e["r0", "extra"] == 1.5
    with pytest.raises(Exception, match="unknown category"):
        e.insert(pd.DataFrame({"ID": ["r0"], "s": ["zzz"]}), WriteMode(overwrite="allow"))


def test_new_columns_join_the_view_that_explains_them(spark):
    df = frame(150, 5)
    e = Engine.from_df(spark, df, n_states=6, seed=1)
    e.update(6)
    e.append_columns(pd.DataFrame({"ID": df["ID"], "copy": np.where(df["s"] == "b", 9.0, 0.0) + np.random.default_rng(0).normal(0, 0.2, 150)}))
    got = {r["A"]: r["depprob"] for r in e.depprob([("copy", "copy"), ("copy", "s"), ("copy", "x")]).collect() if r["B"] != "copy"}
    assert max(got.values()) > 0.5


def test_surprisal_of_values(engine):
    one = engine.surprisal("x", rows="r1", values=[0.0, 6.0, 50.0]).collect()
    assert [r.asDict().keys() for r in one] == [{"surprisal"}] * 3 and one[2]["surprisal"] > max(one[0]["surprisal"], one[1]["surprisal"])
    two = engine.surprisal("x", rows=["r2", 1], values=[0.0, 6.0]).collect()
    assert [r["row"] for r in two] == ["r2", "r1"] and two[1]["surprisal"] == pytest.approx(one[1]["surprisal"])
    own = {r["row"]: r["surprisal"] for r in engine.surprisal("x").collect()}
    some = engine.surprisal("x", rows=["r5", "r4"]).collect()
    assert [(r["row"], r["surprisal"]) for r in some] == [(n, own[n]) for n in ("r5", "r4")]
    assert engine.surprisal("x", rows="r5", values=[some[0]["x"]]).first()[0] == pytest.approx(own["r5"])
    assert engine.surprisal("s", rows="r1", values=["a", "b"]).count() == 2
    for rows, values in ((["r1", "r2"], [1.0]), ([], [1.0])):
        with pytest.raises(ValueError):
            engine.surprisal("x", rows=rows, values=values)


def test_kernels_sets_and_cells(engine):
    for more in ({"kernel": "gibbs"}, {"kernel": "sams"}, {"kernel": "finite", "column_kernel": "finite"}, {"column_kernel": "slice"}, {"transitions": ("columns", "components")}, {"transitions": "sams"}, {"transitions": "flat"}, {"transitions": "fast"}):
        e = engine.copy()
        e.model = models.Model(e.model.codebook, [models.State(list(s.views), s.process, dict(s.priors), list(s.diagnostics)) for s in e.model.states], e.model.data)
        e.update(1, **more)
        sizes = [{r["k"]: r["count"] for r in e.model.rows().groupBy(F.get("z", slot).alias("k")).count().collect()} for slot in range(e.model.n_slots)]
        assert [[got[k] for k in range(len(v.weights))] for got, v in zip(sizes, [v for s in e.model.states for v in s.views], strict=True)] == [v.sizes.tolist() for s in e.model.states for v in s.views]
        assert all(len(s.diagnostics) == 4 for s in e.model.states)
    with pytest.raises(ValueError):
        engine.update(1, transitions="no such set")
    with pytest.raises(ValueError):
        engine.update(1, kernel="no such kernel")
    e = engine.copy()
    for row, col in (("r0", "x"), ("r0", "s"), (7, "y"), ("r3", "x")):
        e.cell_gibbs(row, col)
    assert e.shape == engine.shape and all(sum(len(v.cols) for v in s.views) == 3 for s in e.model.states)
    assert all(sum(v.sizes) == 40 for s in e.model.states for v in s.views) and e.surprisal("x").count() == 39


def test_handlers(engine):
    class Log(Handler):
        def __init__(self):
            super().__init__()
            self.seen = []

        def state_started(self, state, model):
            self.seen.append(("start", state))

        def state_updated(self, state, sweep, model):
            self.seen.append(("update", state, sweep))

        def state_completed(self, state, model):
            self.seen.append(("done", state))

        def finished(self, model):
            self.seen.append("end")

    class First(Handler):
        def state_over(self, state):
            return state == 0

    log = Log()
    e = engine.copy()
    before = [len(s.diagnostics) for s in e.model.states]
    e.model = models.Model(e.model.codebook, [models.State(list(s.views), s.process, dict(s.priors), list(s.diagnostics)) for s in e.model.states], e.model.data)
    e.update(2, handler=[log, First()])
    assert log.seen == [("start", 0), ("start", 1), ("update", 0, 1), ("update", 1, 1), ("update", 1, 2), ("done", 0), ("done", 1), "end"]
    assert [len(s.diagnostics) for s in e.model.states] == [before[0] + 1, before[1] + 2]
    e.update(50, handler=StateTimeout(seconds=0.0))
    e.update(50, handler=Interrupt(stop=lambda sweep, m: sweep == 1), timeout=600)
    assert len(e.model.states[1].diagnostics) == before[1] + 4


def test_frames_and_diagnostics(engine, spark, tmp_path):
    engine.write_diagnostics(f"{tmp_path}/d")
    got = models.read_diagnostics(spark, f"{tmp_path}/d")
    assert [len(d) for d in got] == [len(s.diagnostics) for s in engine.model.states] and got[0][0] == pytest.approx(engine.model.states[0].diagnostics[0])
    models.save_state(engine.model, spark, f"{tmp_path}/s", 1)
    one = models.load(spark, f"{tmp_path}/s")
    assert len(one.states) == 1 and one.n_slots == len(engine.model.states[1].views)
    cats = engine.prediction_frame("s", {"x": 6.0}).toPandas()
    assert cats[cats.state.isna()]["p"].sum() == pytest.approx(1) and len(cats) == 2 * 3
    grid = engine.prediction_frame("x", n_points=50).toPandas()
    assert len(grid) == 150 and set(grid["uncertainty"]) == {grid["uncertainty"].iloc[0]}
    assert engine.state_frame(0).count() == 119
    assert engine.explanation_frame("x", {"s": "a", "y": 3}, "ablative-dist").count() == 2


def test_explanations_follow_their_definitions(engine):
    given = {"s": "b", "y": 12}
    names, got = explanation.explain_prediction(engine.model, "x", given, "ablative-dist")
    whole = engine.predict("x", given, with_uncertainty=False)
    assert got == pytest.approx([engine.predict("x", {k: v for k, v in given.items() if k != n}, with_uncertainty=False) - whole for n in names])
    names, got = explanation.explain_prediction(engine.model, "x", given)
    xs = explanation.predict_xs(engine.model, "x", mass=0.995)
    p = lambda g: np.array([np.exp(engine.logp({"x": float(x)}, g)) for x in xs[::100]])
    assert np.sign(got[0]) == np.sign((p({"y": 12}) - p(given)).sum()) or abs(got[0]) < 1e-3
    with pytest.raises(ValueError):
        explanation.explain_prediction(engine.model, "s", {"x": 1.0})
    for curve, want in (([4.0, 2.0], 0.0), ([4.0, 2.0, 1.0], (2 / 4 / 2 + 3 / 4 / 2) / 3), ([4.0, 2.0, 5.0, 1.0], 0.0), ([4.0, 2.0, 1.0, 5.0], (2 / 4 / 2 + 3 / 4 / 2) / 3), ([4.0], 0.0)):
        assert explanation.attributable([([], v, []) for v in curve]) == pytest.approx(want)


def test_empty_engine(spark):
    e = Engine.empty(spark, n_states=2)
    assert e.is_empty and e.shape == (0, 0)
    e.update(3)
    e.cell_gibbs(0, 0)
    meta = [Column.continuous("x", hyper={"mean": 0.0, "var": 1.0}), Column.categorical("s", ["a", "b"], hyper={"shape": 1.0, "scale": 1.0})]
    e.insert(pd.DataFrame({"ID": ["r0", "r1"], "x": [0.1, 0.2], "s": ["a", "b"]}), WriteMode(), meta)
    assert e.shape == (2, 2) and e["r1", "s"] == "b"
    e.insert(pd.DataFrame({"ID": [f"r{k}" for k in range(2, 12)], "x": np.linspace(0, 1, 10), "s": ["a", "b"] * 5}))
    e.update(2)
    assert e.shape == (12, 2) and e.logp({"x": 0.3}) < 5 and sorted(r["rix"] for r in e.model.rows().collect()) == list(range(12))


def test_streams(spark, tmp_path):
    for how, top in ((("window",), 10), (("trench", 12, 5), 12)):
        e = Engine.from_df(spark, frame(10, 1), n_states=1, seed=1)
        source = f"{tmp_path}/{how[0]}"
        for k in range(3):
            pd.DataFrame({"ID": [f"n{k}"], "x": [0.5 * k], "s": ["a"]}).to_json(f"{tmp_path}/{how[0]}-{k}.json", orient="records", lines=True)
        import os

        os.makedirs(source)
        query = append_stream(e, spark.readStream.schema("ID string, x double, s string").option("maxFilesPerTrigger", 1).json(source), how, sweeps=0, checkpoint=f"{tmp_path}/c-{how[0]}")
        try:
            for k in range(3):
                os.rename(f"{tmp_path}/{how[0]}-{k}.json", f"{source}/{k}.json")
                query.processAllAvailable()
        finally:
            query.stop()
        assert e.shape[0] == top and e["n2", "x"] == 1.0
        gapless(e.model.rows(), top)
        # after a restart without its checkpoint all batches come again: what is there stays once
        again = append_stream(e, spark.readStream.schema("ID string, x double, s string").json(source), None, sweeps=0, checkpoint=f"{tmp_path}/again-{how[0]}")
        try:
            again.processAllAvailable()
        finally:
            again.stop()
        assert e.model.rows().groupBy("row").count().where("count > 1").count() == 0
    scored = score_stream(e, spark.readStream.schema("ID string, x double").json(source), ["x"]).writeStream.format("memory").queryName("scored").start()
    try:
        scored.processAllAvailable()
        time.sleep(0)
        assert spark.table("scored").count() == 3 and spark.table("scored").where("logp is null").count() == 0
    finally:
        scored.stop()


def test_stages_cut_where_rows_move_again():
    got = fit.stages(fit.SETS["sams"], "slice", "gibbs")
    assert [(("rows" in x), r) for x, r, _ in got] == [(True, "sams"), (True, "sams"), (True, "slice")]
    with pytest.raises(ValueError):
        fit.stages(("rows:none",), "slice", "gibbs")
