"""Registered queries of the table engine give a row for every row of the table."""

import numpy as np

from polyview.plans import queries


def test_impute_continuous_covers_all_rows(spark, tmp_path):
    rows = [(k, "FOP"[k % 3], f"{1 + k % 5}-P", float(1000 + 37 * k % 911)) for k in range(1, 241)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["row"]: r["o_totalprice"] for r in queries.impute_continuous(spark, str(tmp_path)).collect()}
    assert set(got) == {str(k) for k, *_ in rows}
    m = queries.fixture(spark, str(tmp_path))
    views = [(m.slot(s, st.view_of(2)), st.views[st.view_of(2)].params[2]) for s, st in enumerate(m.states)]
    for r in m.rows().select("row", "z").collect():
        mu, sigma = (np.array([p[n][r["z"][slot]] for slot, p in views]) for n in ("mu", "sigma"))
        density = lambda x: np.exp(-0.5 * ((np.asarray(x)[..., None] - mu) / sigma) ** 2) @ (1 / sigma)  # noqa: E731, B023
        assert density(got[r["row"]]) >= density(np.linspace(mu.min(), mu.max(), 501)).max() * (1 - 1e-6)
