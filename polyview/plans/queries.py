"""Registered queries of the table engine, and the same results as SQL.

Fitting is random, so these queries run on fixture models: three states whose assignments are arithmetic on the key, with point
estimates as components. Every operator is a function of the model's tables, so SQL can compute the same from the
driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.operators import explanation, generation, information, likelihood, mutation, prediction, structure
from polyview.plans import fit
from polyview.plans.model import Model, encode, from_assignments, load, save
from polyview.plans.tables import new_path
from polyview.sources.codebook import Codebook, Column, infer
from polyview.sources.readers import ROW, read_table, with_row_names

#: Number of categories and offset of each fixture state.
STATES = ((3, 1), (4, 2), (5, 0))
#: Column -> view of each state, for the columns in FIXTURES' order.
VIEWS = {"orders": ((0, 0, 1), (0, 1, 1), (0, 0, 0)), "part": ((0, 1, 0, 1), (0, 0, 1, 1), (0, 0, 0, 0)), "docs": ((0, 0, 1), (0, 1, 1), (0, 0, 0))}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """key, ``_row`` and the fixture's columns."""
    if name == "orders":
        return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").cast("string").alias(ROW), "o_orderstatus", "o_orderpriority", "o_totalprice")
    if name == "part":
        return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_partkey").cast("string").alias(ROW), "p_brand", "p_type", "p_size", "p_retailprice")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left").select(F.col("doc_id").alias("key"), F.col("doc_id").cast("string").alias(ROW), "lang", "n_chars", "toxic")


def book(spark: SparkSession, df: DataFrame, name: str) -> Codebook:
    own = infer(df.drop("key"), name)
    if name == "docs":
        own.replaced(Column.categorical("toxic", 2, mnar=True))
    return own


def fixture(spark: SparkSession, sf_dir: str, name: str = "orders") -> Model:
    df = source(spark, sf_dir, name)
    own = book(spark, df, name)
    data = encode(df, own)
    layouts, z = [], []
    for (k, b), zc in zip(STATES, VIEWS[name], strict=True):
        n = max(zc) + 1
        layouts.append((list(zc), [k] * n))
        z += [((F.col("row").cast("long") + b + v) % k).cast("int") for v in range(n)]
    return from_assignments(own, data.withColumn("z", F.array(*z)), layouts)


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def one(spark: SparkSession, rows: list[tuple], schema: str, n: int = 6) -> DataFrame:
    return rounded(spark.createDataFrame(rows, schema), n)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most surprising order prices."""
    out = rounded(likelihood.surprisal(fixture(spark, sf_dir), "o_totalprice"))
    return out.orderBy(F.desc("surprisal"), "row").limit(10)


# Queries, by the families of the operator inventory.


def codebook_infer_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "part")
    return spark.createDataFrame([(c.name, c.ftype, len(c.values)) for c in infer(df.drop("key")).columns], "name string, ftype string, k long")


def scan_encode_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    return m.rows().select("row", "o_orderstatus", "o_orderpriority", "o_totalprice")


def _through(spark: SparkSession, df: DataFrame, ending: str) -> DataFrame:
    """df written in a file format and read by the engine's reader."""
    path = f"{new_path(spark, 'file')}.{ending}"
    (df.write.option("header", True).csv if ending == "csv" else df.write.json)(path)
    return read_table(spark, path)


def scan_csv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_row_names(_through(spark, source(spark, sf_dir, "orders").drop("key").withColumnRenamed(ROW, "ID"), "csv"))
    return encode(df, infer(df)).select("row", "o_orderstatus", "o_orderpriority", "o_totalprice")


def scan_jsonl_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_row_names(_through(spark, source(spark, sf_dir, "part").drop("key").withColumnRenamed(ROW, "ID"), "jsonl"))
    return encode(df, infer(df)).select("row", "p_brand", "p_type", "p_size", "p_retailprice")


def save_and_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "model")
    save(fixture(spark, sf_dir), spark, path)
    return rounded(likelihood.surprisal(load(spark, path), "o_totalprice").select("row", "surprisal"))


def index_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.select(fixture(spark, sf_dir), ["1", "7", "32"], ["o_orderpriority", "o_totalprice"])


def summarize_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prediction.summarize(fixture(spark, sf_dir), "o_totalprice")
    return one(spark, [tuple(s[k] for k in ("n", "min", "max", "mean", "median", "variance"))], "n long, min double, max double, mean double, median double, variance double", 3)


def summarize_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prediction.summarize(fixture(spark, sf_dir), "o_orderpriority")
    return spark.createDataFrame([(s["n"], s["min"], s["max"], m) for m in s["mode"]], "n long, min string, max string, mode string")


def summarize_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prediction.summarize(fixture(spark, sf_dir, "part"), "p_size")
    return one(spark, [(s["n"], s["min"], s["max"], s["median"], s["mean"], m) for m in s["mode"]], "n long, min long, max long, median double, mean double, mode long")


def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "docs").rows().where("toxic is null").select("row")


def row_assign_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    slots = [(s, v, m.slot(s, v)) for s, st in enumerate(m.states) for v in range(len(st.views))]
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(v).alias("view"), F.get("z", k).alias("k")) for s, v, k in slots]))
    return m.rows().select("row", cells.alias("c")).select("row", "c.*")


def col_assign_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    return spark.createDataFrame([(s, c.name, st.view_of(j)) for s, st in enumerate(m.states) for j, c in enumerate(m.codebook.columns)], "state int, col string, view int")


def feature_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    rows = [(s, k, float(p["mu"][k]), float(p["sigma"][k])) for s, st in enumerate(m.states) for p in [st.views[st.view_of(2)].params[2]] for k in range(len(p["mu"]))]
    return one(spark, rows, "state int, k int, mu double, sigma double", 3)


def suffstats_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    rows = [(s, k, x, round((float(n) - 0), 6)) for s, st in enumerate(m.states) for p in [st.views[st.view_of(0)].params[0]] for k, w in enumerate(p["ln_w"]) for x, n in enumerate(w)]
    return one(spark, rows, "state int, k int, code int, ln_w double")


def depprob_pw(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    return rounded(structure.depprob_pairs(m, spark, structure.all_pairs(m.codebook.column_names)))


def _pairs(m: Model) -> DataFrame:
    return m.rows().select(F.col("row").alias("A"), ((F.col("row").cast("long") * 7) % 100).cast("string").alias("B"))


def rowsim_view_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    return rounded(structure.rowsim(m, _pairs(m)))


def rowsim_col_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    return rounded(structure.rowsim(m, _pairs(m), by_columns=True))


def rowsim_wrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    return rounded(structure.rowsim(m, _pairs(m), wrt=["o_totalprice"]))


def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.novelty(fixture(spark, sf_dir)))


def novelty_wrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.novelty(fixture(spark, sf_dir), ["o_orderpriority"]))


def entropy_single_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    return one(spark, [(c, information.entropy(m, [c])) for c in ("o_orderstatus", "o_orderpriority")], "col string, h double")


def entropy_cat_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, [(information.entropy(fixture(spark, sf_dir), ["o_orderstatus", "o_orderpriority"]),)], "h double")


def mi_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    h = [information.entropy(m, c) for c in (["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"])]
    return one(spark, [(k, information.mi_of(*h, k)) for k in information.KINDS], "kind string, mi double")


def conditional_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, [(information.conditional_entropy(fixture(spark, sf_dir), "o_orderstatus", ["o_orderpriority"]),)], "h double")


def info_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, [(information.info_prop(fixture(spark, sf_dir), ["o_orderstatus"], ["o_orderpriority"]),)], "p double")


def predictor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir, "part")
    return one(spark, [(k, *x) for k, x in enumerate(information.predictor_search(m, ["p_size"], 2))], "step int, col string, info double", 5)


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "orders").select(F.col(ROW).alias("row"), "o_orderstatus", "o_orderpriority", "o_totalprice")


def logp_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(likelihood.logp(fixture(spark, sf_dir), _values(spark, sf_dir), ["o_totalprice"]).select("row", "logp"))


def logp_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(likelihood.logp(fixture(spark, sf_dir), _values(spark, sf_dir), ["o_orderstatus", "o_orderpriority", "o_totalprice"]).select("row", "logp"))


def logp_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(likelihood.logp(fixture(spark, sf_dir), _values(spark, sf_dir), ["o_totalprice"], {"o_orderpriority": "1-URGENT"}).select("row", "logp"))


def logp_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(likelihood.logp(fixture(spark, sf_dir), _values(spark, sf_dir), ["o_totalprice"], states=[1]).select("row", "logp"))


def logp_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(likelihood.logp(fixture(spark, sf_dir), _values(spark, sf_dir), ["o_totalprice"], scaled=True).select("row", "logp"))


def surprisal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(likelihood.surprisal(fixture(spark, sf_dir), "o_totalprice").select("row", "surprisal"))


def surprisal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one hypothetical price in every row."""
    m = fixture(spark, sf_dir)
    rows = m.rows().select(F.col("rix").alias("_pos"), "row", F.lit(150000.0).alias("value"))
    return rounded(likelihood.surprisal_of(m, "o_totalprice", rows).select("row", "surprisal"))


def surprisal_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(likelihood.surprisal(fixture(spark, sf_dir), "o_orderpriority").select("row", "surprisal"))


def surprisal_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(likelihood.surprisal(fixture(spark, sf_dir, "part"), "p_size").select("row", "surprisal"))


def surprisal_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(likelihood.surprisal(fixture(spark, sf_dir, "docs"), "toxic", keep_missing=True).select("row", "surprisal"))


def inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    return rounded(likelihood.inconsistency(m, _values(spark, sf_dir), ["o_totalprice"], {"o_orderpriority": "1-URGENT"}).select("row", "inconsistency"))


def predict_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    rows = [(s, *prediction.predict(m, "o_orderpriority", {"o_orderstatus": s})) for s in m.codebook["o_orderstatus"].values]
    return one(spark, rows, "given string, value string, uncertainty double")


def predict_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir, "part")
    return one(spark, [prediction.predict(m, "p_size")], "value long, uncertainty double", 5)


def predict_mnar(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir, "docs")
    value, unc = prediction.predict(m, "toxic")
    return one(spark, [(value is None, unc)], "missing boolean, uncertainty double", 9)


def predict_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    return one(spark, [prediction.predict(m, "o_totalprice", {"o_orderpriority": "2-HIGH"})], "value double, uncertainty double", 2)


def variability_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, p = fixture(spark, sf_dir), fixture(spark, sf_dir, "part")
    rows = [("o_orderpriority", prediction.variability(m, "o_orderpriority")), ("o_totalprice", prediction.variability(m, "o_totalprice") / 1e9), ("p_size", prediction.variability(p, "p_size"))]
    return one(spark, rows, "col string, x double", 5)


def feature_error_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    error, centroid = prediction.feature_error(fixture(spark, sf_dir), "o_orderpriority")
    return one(spark, [(error,)], "error double", 8)


def feature_error_pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, [prediction.feature_error(fixture(spark, sf_dir), "o_totalprice")], "error double, centroid double")


def impute_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir, "docs")
    return prediction.impute(m, "toxic", with_uncertainty=False)


def impute_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir, "part")
    return prediction.impute(m, "p_size", m.rows().select("row"), with_uncertainty=False)


def impute_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    return rounded(prediction.impute(m, "o_totalprice", m.rows().select("row")), 2)


def simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.simulate(fixture(spark, sf_dir), spark, ["o_orderstatus", "o_totalprice"], {"o_orderpriority": "5-LOW"}, 1000, include_given=True)


def draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in generation.draw(fixture(spark, sf_dir), "1", "o_totalprice", 100)], "x double")


def held_out_neglogp(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    curve = explanation.held_out_neglogp(m, {"o_totalprice": 150000.0}, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    return one(spark, [(k, ",".join(gone), value) for k, (gone, value, _) in enumerate(curve)], "step int, removed string, neglogp double")


def attributable_neglogp(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    return one(spark, [(explanation.attributable_neglogp(m, {"o_totalprice": 150000.0}, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})[0],)], "share double")


def held_out_inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    curve = explanation.held_out_inconsistency(m, {"o_totalprice": 150000.0}, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    return one(spark, [(k, ",".join(gone), value) for k, (gone, value, _) in enumerate(curve)], "step int, removed string, inconsistency double", 8)


def attributable_inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    return one(spark, [(explanation.attributable_inconsistency(m, {"o_totalprice": 150000.0}, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})[0],)], "share double")


def held_out_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    curve = explanation.held_out_uncertainty(m, "o_orderpriority", {"o_orderstatus": "F"})
    return one(spark, [(k, ",".join(gone), value) for k, (gone, value, _) in enumerate(curve)], "step int, removed string, uncertainty double")


def explain_ablative_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    return one(spark, list(zip(*explanation.explain_prediction(m, "o_totalprice", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, "ablative-dist"), strict=True)), "col string, importance double")


def explain_ablative(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    return one(spark, list(zip(*explanation.explain_prediction(m, "o_totalprice", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}), strict=True)), "col string, importance double")


def upsert_edit_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mutation.edit_cell(fixture(spark, sf_dir), "7", "o_totalprice", 1.5)
    return m.rows().select("row", "o_totalprice")


def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    new = spark.createDataFrame([("new-1", "F", "1-URGENT", 10.0), ("new-2", "O", "NEW-PRIORITY", None)], "ID string, o_orderstatus string, o_orderpriority string, o_totalprice double")
    m = mutation.append_rows(m, new)
    return mutation.select(m).select(F.col("index").alias("row"), "o_orderstatus", "o_orderpriority", "o_totalprice")


def append_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    more = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("ID"), (F.col("o_orderkey") % 3).cast("int").alias("third"))
    return mutation.append_columns(m, more).rows().select("row", "third")


def remove_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    left, _ = mutation.remove_rows(m, m.rows().where("cast(row as long) % 5 = 0").select("row"))
    return left.rows().select("row", "o_totalprice")


def remove_cells_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    cells = m.rows().where("cast(row as long) % 4 = 0").select("row", F.explode(F.array(*[F.lit(c) for c in m.codebook.column_names])).alias("col"))
    cells = cells.unionByName(m.rows().where("cast(row as long) % 4 = 1").select("row", F.lit("o_totalprice").alias("col")))
    return mutation.remove_cells(m, cells).rows().select("row", "o_totalprice")


def window_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    m.data = m.data.withColumn("rix", F.col("row").cast("long"))
    new = spark.createDataFrame([(f"n{k}", float(k)) for k in range(3)], "ID string, o_totalprice double")
    return mutation.append_rows(m, new, ("window",)).rows().select("row", "o_totalprice")


def trench_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir)
    m.data = m.data.withColumn("rix", F.col("row").cast("long"))
    new = spark.createDataFrame([(f"n{k}", float(k)) for k in range(3)], "ID string, o_totalprice double")
    return mutation.append_rows(m, new, ("trench", m.rows().count(), 10)).rows().select("row", "o_totalprice")


def diagnostics_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(r[0], *r[1:]) for r in _fitted(spark, sf_dir)], "iter long, state_0 double, state_1 double")


def _fitted(spark: SparkSession, sf_dir: str) -> list[tuple]:
    df = source(spark, sf_dir, "part").drop("key")
    own = infer(df)
    m = fit.update(fit.start(own, encode(df, own), 2, seed=3), 2, seed=4)
    return [(i, *[float(sum(s.diagnostics[i])) for s in m.states]) for i in range(2)]


QUERIES = {
    f.__name__: f
    for f in (
        scan_csv_orders, scan_jsonl_part, save_and_load, surprisal_values, impute_count, held_out_inconsistency, attributable_inconsistency, held_out_uncertainty, explain_ablative_dist,
        flagship, codebook_infer_part, scan_encode_orders, index_select, summarize_continuous, summarize_categorical, summarize_count, missing_cells, row_assign_list, col_assign_list, feature_params,
        suffstats_by_category, depprob_pw, rowsim_view_weighted, rowsim_col_weighted, rowsim_wrt, novelty, novelty_wrt, entropy_single_cat, entropy_cat_cat, mi_kinds, conditional_entropy, info_prop,
        predictor_search, logp_single, logp_joint, logp_given, logp_states, logp_scaled, surprisal, surprisal_cat, surprisal_count, surprisal_missing, inconsistency, predict_categorical, predict_count,
        predict_mnar, predict_continuous, variability_all, feature_error_cat, feature_error_pit, impute_categorical, impute_continuous, simulate, draw, held_out_neglogp, attributable_neglogp, explain_ablative,
        upsert_edit_cell, append_rows, append_columns, remove_rows, remove_cells_cascade, window_evict, trench_evict, diagnostics_pivot,
    )
}

from polyview.plans.oracles import ORACLES  # noqa: E402
