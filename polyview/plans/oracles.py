"""The registered queries as SQL over the driver's tables."""

from __future__ import annotations

#: Number of categories and offset of each fixture state, columns' views, as in the queries.
_STATES = "(0, 3, 1), (1, 4, 2), (2, 5, 0)"
_TABLES = {
    "orders": ("SELECT o_orderkey AS key, o_orderstatus AS c0, o_orderpriority AS c1, o_totalprice::DOUBLE AS c2 FROM orders", ("cat", "cat", "num"), ((0, 0, 1), (0, 1, 1), (0, 0, 0))),
    "part": ("SELECT p_partkey AS key, p_brand AS c0, p_type AS c1, p_size AS c2, p_retailprice::DOUBLE AS c3 FROM part", ("cat", "cat", "count", "num"), ((0, 1, 0, 1), (0, 0, 1, 1), (0, 0, 0, 0))),
    "docs": ("SELECT d.doc_id AS key, lang AS c0, n_chars AS c1, toxic AS c2 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", ("cat", "count", "cat"), ((0, 0, 1), (0, 1, 1), (0, 0, 0))),
}


def _with(name: str, *more: str) -> str:
    """t (rows), zr (rows with state, view and category), w (weights), and for each column f<j>: parameters by
    category (f: probabilities by value x; mu, sigma; rate), of the view that holds the column."""
    rows, kinds, views = _TABLES[name]
    vm = ", ".join(f"({s}, {v}, {j})" for s, zc in enumerate(views) for j, v in enumerate(zc))
    parts = [
        f"st(s, kk, b) AS (VALUES {_STATES})", f"vm(s, v, col) AS (VALUES {vm})", f"t AS (SELECT *, key::VARCHAR AS row FROM ({rows}) q)",
        "zr AS (SELECT x.s, x.v, t.*, (key + b + x.v) % kk AS k FROM t CROSS JOIN (SELECT DISTINCT s, v FROM vm) x JOIN st ON st.s = x.s)",
        "w AS (SELECT s, v, k, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY s, v) AS w FROM zr GROUP BY s, v, k)",
    ]
    for j, kind in enumerate(kinds):
        own = f"zr JOIN vm USING (s, v) WHERE col = {j}"
        if kind == "num":
            parts.append(f"f{j} AS (SELECT s, v, k, avg(c{j}) AS mu, sqrt(var_pop(c{j})) AS sigma FROM {own} GROUP BY s, v, k)")
        elif kind == "count":
            parts.append(f"f{j} AS (SELECT s, v, k, avg(c{j})::DOUBLE AS rate FROM {own} GROUP BY s, v, k)")
        else:
            parts.append(f"x{j} AS (SELECT c{j} AS x, row_number() OVER (ORDER BY c{j}) - 1 AS code, count(*) OVER () AS kx FROM (SELECT DISTINCT c{j} FROM t WHERE c{j} IS NOT NULL) q)")
            parts.append(
                f"f{j} AS (SELECT g.s, g.v, g.k, x, code, ln((count(z.c{j}) FILTER (WHERE z.c{j} = x) + 0.5::DOUBLE) / (count(z.c{j}) + 0.5::DOUBLE * any_value(kx))) AS lnp FROM (SELECT DISTINCT s, v, k FROM {own}) g "
                f"JOIN zr z ON z.s = g.s AND z.v = g.v AND z.k = g.k CROSS JOIN x{j} GROUP BY g.s, g.v, g.k, x, code)"
            )
    return "WITH " + ",\n".join([*parts, *more])


_GAUSS = "(-0.5::DOUBLE * ((c2 - mu) / sigma) * ((c2 - mu) / sigma) - ln(sigma) - 0.5::DOUBLE * ln(2 * pi()))"
_LNF_COUNT = "(c2 * ln(rate) - rate - lgamma(c2 + 1))"


def _logp(cols: tuple[int, ...], given: str | None = None, states: str = "0, 1, 2", scaled: bool = False) -> str:
    """CTEs ending in lp(row, logp): rows' columns scored jointly; given: a value of column 1."""
    terms = {0: "a0.lnp", 1: "a1.lnp", 2: "(-0.5::DOUBLE * ((c2 - mu) / sigma) * ((c2 - mu) / sigma)" + ("" if scaled else " - ln(sigma) - 0.5::DOUBLE * ln(2 * pi())") + ")"}
    joins = {0: "LEFT JOIN f0 a0 ON a0.s = u.s AND a0.v = u.v AND a0.k = u.k AND a0.x = t.c0", 1: "LEFT JOIN f1 a1 ON a1.s = u.s AND a1.v = u.v AND a1.k = u.k AND a1.x = t.c1", 2: "LEFT JOIN f2 a2 ON a2.s = u.s AND a2.v = u.v AND a2.k = u.k"}
    weight = "SELECT s, v, k, ln(w) AS lw FROM w"
    if given:
        weight = f"SELECT s, v, k, u - (max(u) OVER p + ln(sum(exp(u - mx)) OVER p)) AS lw FROM (SELECT w.s, w.v, w.k, ln(w) + coalesce(lnp, 0) AS u, max(ln(w) + coalesce(lnp, 0)) OVER (PARTITION BY w.s, w.v) AS mx FROM w LEFT JOIN f1 ON f1.s = w.s AND f1.v = w.v AND f1.k = w.k AND f1.x = '{given}') q WINDOW p AS (PARTITION BY s, v)"
    term = " + ".join(f"coalesce({terms[c]}, 0)" for c in cols)
    div = f" / {len(cols)}" if scaled else ""
    return (
        f"wt AS ({weight}),\nused AS (SELECT DISTINCT s, v FROM vm WHERE col IN ({', '.join(map(str, cols))}) AND s IN ({states})),\n"
        f"cell AS (SELECT row, u.s, u.v, lw + {term} AS l FROM t CROSS JOIN (SELECT wt.* FROM wt JOIN used USING (s, v)) u {' '.join(joins[c] for c in cols)}),\n"
        "byv AS (SELECT row, s, v, max(m) + ln(sum(exp(l - m))) AS l FROM (SELECT *, max(l) OVER (PARTITION BY row, s, v) AS m FROM cell) q GROUP BY row, s, v),\n"
        "bys AS (SELECT row, s, sum(l) AS l FROM byv GROUP BY row, s),\n"
        f"lp AS (SELECT row, (max(m) + ln(sum(exp(l - m))) - ln(count(*))){div} AS logp FROM (SELECT *, max(l) OVER (PARTITION BY row) AS m FROM bys) q GROUP BY row)"
    )


def _surprisal(name: str, j: int) -> str:
    term = {"num": _GAUSS, "count": _LNF_COUNT}.get(_TABLES[name][1][j], "lnp").replace("c2", f"z.c{j}")
    on = f" AND f.x = z.c{j}" if _TABLES[name][1][j] == "cat" else ""
    return _with(
        name, f"l AS (SELECT row, {term} AS l FROM zr z JOIN vm ON vm.s = z.s AND vm.v = z.v AND col = {j} JOIN f{j} f ON f.s = z.s AND f.v = z.v AND f.k = z.k{on} WHERE z.c{j} IS NOT NULL)",
        "su AS (SELECT row, ln(count(*)) - (max(m) + ln(sum(exp(l - m)))) AS surprisal FROM (SELECT *, max(l) OVER (PARTITION BY row) AS m FROM l) q GROUP BY row)",
    )


_JOINT = _with(
    "orders", "j AS (SELECT a.x AS a, b.x AS b, s, exp(a.lnp) AS pa, exp(b.lnp) AS pb, a.v AS va, b.v AS vb, a.k AS ka, b.k AS kb FROM f0 a JOIN f1 b USING (s))",
    "ja AS (SELECT f0.x AS a, s, sum(w * exp(lnp)) AS p FROM f0 JOIN w USING (s, v, k) GROUP BY f0.x, s)", "jb AS (SELECT f1.x AS b, s, sum(w * exp(lnp)) AS p FROM f1 JOIN w USING (s, v, k) GROUP BY f1.x, s)",
    "js AS (SELECT a, b, j.s, sum(w.w * pa * pb) AS p FROM j JOIN w ON w.s = j.s AND w.v = va AND w.k = ka WHERE va = vb AND ka = kb GROUP BY a, b, j.s UNION ALL SELECT a, b, ja.s, ja.p * jb.p FROM ja JOIN jb ON ja.s = jb.s WHERE ja.s IN (SELECT s FROM vm WHERE col IN (0, 1) GROUP BY s HAVING count(DISTINCT v) = 2))",
    "hh AS (SELECT (SELECT -sum(p * ln(p)) FROM (SELECT a, avg(p) AS p FROM ja GROUP BY a) q) AS ha, (SELECT -sum(p * ln(p)) FROM (SELECT b, avg(p) AS p FROM jb GROUP BY b) q) AS hb, (SELECT -sum(p * ln(p)) FROM (SELECT a, b, avg(p) AS p FROM js GROUP BY a, b) q) AS hab)",
    "i AS (SELECT *, greatest(0, ha + hb - hab) AS i FROM hh)",
)

_PAIR = "pr AS (SELECT row AS A, ((key * 7) % 100)::VARCHAR AS B FROM t), sz AS (SELECT s, v, count(*) AS nc FROM vm GROUP BY s, v)"


def _rowsim(weight: str, where: str = "true") -> str:
    return _with("orders", _PAIR) + (
        f" SELECT A, B, round(CASE WHEN A = B THEN 1.0::DOUBLE ELSE avg(x) END, 6) AS rowsim FROM (SELECT A, B, a.s, sum(CASE WHEN a.k = b.k THEN {weight} ELSE 0 END)::DOUBLE / sum({weight}) AS x "
        f"FROM pr JOIN zr a ON a.row = A JOIN zr b ON b.row = B AND b.s = a.s AND b.v = a.v JOIN sz ON sz.s = a.s AND sz.v = a.v WHERE {where} GROUP BY A, B, a.s) q GROUP BY A, B"
    )


def _novelty(where: str) -> str:
    return _with("orders") + f" SELECT row, round(1 - avg(x), 6) AS novelty FROM (SELECT row, zr.s, avg(w) AS x FROM zr JOIN w USING (s, v, k) WHERE {where} GROUP BY row, zr.s) q GROUP BY row"


def _lp(select: str, *args, **more) -> str:
    return _with("orders", _logp(*args, **more)) + " " + select


_SCORED = "SELECT row, round(logp, 6) AS logp FROM lp"
_EDIT = "SELECT o_orderkey::VARCHAR AS row, {x} AS o_totalprice FROM orders"

#: Predictive distribution of priority in each state, given each status.
_PREDICT = _with(
    "orders", "gw AS (SELECT g.x AS given, w.s, w.v, w.k, w.w * CASE WHEN f0.lnp IS NULL THEN 1 ELSE exp(f0.lnp) END AS u FROM w CROSS JOIN x0 g LEFT JOIN f0 ON f0.s = w.s AND f0.v = w.v AND f0.k = w.k AND f0.x = g.x)",
    "ps AS (SELECT given, gw.s, f1.x, f1.code, sum(u * exp(lnp)) / sum(u) AS p FROM gw JOIN f1 USING (s, v, k) GROUP BY given, gw.s, f1.x, f1.code)", "pm AS (SELECT given, x, code, avg(p) AS p FROM ps GROUP BY given, x, code)",
    "tv AS (SELECT ps.given, ps.s, 0.5::DOUBLE * sum(abs(ps.p - pm.p)) AS d FROM ps JOIN pm ON pm.given = ps.given AND pm.x = ps.x GROUP BY ps.given, ps.s)",
)

#: ln p(totalprice = 150000 | subset of conditions) by subset.
_HELD = _with(
    "orders", "sub(id, a, b) AS (VALUES (0, true, true), (1, false, true), (2, true, false), (3, false, false))",
    "u AS (SELECT id, w.s, w.v, w.k, ln(w) + CASE WHEN a THEN coalesce(f0.lnp, 0) ELSE 0 END + CASE WHEN b THEN coalesce(f1.lnp, 0) ELSE 0 END AS u FROM w CROSS JOIN sub LEFT JOIN f0 ON f0.s = w.s AND f0.v = w.v AND f0.k = w.k AND f0.x = 'F' LEFT JOIN f1 ON f1.s = w.s AND f1.v = w.v AND f1.k = w.k AND f1.x = '1-URGENT')",
    "ln_ AS (SELECT id, u.s, sum(exp(u) * exp(" + _GAUSS.replace("c2", "150000") + ")) / sum(exp(u)) AS p FROM u JOIN f2 USING (s, v, k) GROUP BY id, u.s)", "nl AS (SELECT id, -ln(avg(p)) AS f FROM ln_ GROUP BY id)",
    "n AS (SELECT max(f) FILTER (id = 0) AS f0, max(f) FILTER (id = 1) AS f1, max(f) FILTER (id = 2) AS f2, max(f) FILTER (id = 3) AS f3 FROM nl)",
)

_APPENDED = "UNION ALL SELECT * FROM (VALUES ('n0', 0.0::DOUBLE), ('n1', 1.0::DOUBLE), ('n2', 2.0::DOUBLE)) q"

ORACLES: dict[str, str] = {
    "flagship": _surprisal("orders", 2) + " SELECT row, c2 AS o_totalprice, round(surprisal, 6) AS surprisal FROM su JOIN t USING (row) ORDER BY 3 DESC, 1 LIMIT 10",
    "codebook_infer_part": "SELECT * FROM (SELECT 'p_brand' AS name, 'categorical' AS ftype, count(DISTINCT p_brand) AS k FROM part UNION ALL SELECT 'p_type', 'categorical', count(DISTINCT p_type) FROM part UNION ALL SELECT 'p_size', CASE WHEN max(p_size) >= 20 THEN 'count' ELSE 'categorical' END, CASE WHEN max(p_size) >= 20 THEN 0 ELSE max(p_size) + 1 END FROM part UNION ALL SELECT 'p_retailprice', 'continuous', 0) q",
    "scan_encode_orders": _with("orders") + " SELECT row, x0.code::INTEGER AS o_orderstatus, x1.code::INTEGER AS o_orderpriority, c2 AS o_totalprice FROM t JOIN x0 ON c0 = x0.x JOIN x1 ON c1 = x1.x",
    "index_select": "SELECT o_orderkey::VARCHAR AS index, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 32)",
    "summarize_continuous": "SELECT count(*) AS n, round(min(o_totalprice), 3) AS min, round(max(o_totalprice), 3) AS max, round(avg(o_totalprice), 3) AS mean, round(quantile_cont(o_totalprice, 0.5), 3) AS median, round(var_pop(o_totalprice), 3) AS variance FROM orders",
    "summarize_categorical": "SELECT (SELECT count(*) FROM orders) AS n, (SELECT min(o_orderpriority) FROM orders) AS min, (SELECT max(o_orderpriority) FROM orders) AS max, o_orderpriority AS mode FROM orders GROUP BY o_orderpriority QUALIFY rank() OVER (ORDER BY count(*) DESC) = 1",
    "summarize_count": "SELECT (SELECT count(*) FROM part) AS n, (SELECT min(p_size)::BIGINT FROM part) AS min, (SELECT max(p_size)::BIGINT FROM part) AS max, (SELECT quantile_cont(p_size, 0.5)::DOUBLE FROM part) AS median, (SELECT round(avg(p_size), 6) FROM part) AS mean, p_size::BIGINT AS mode FROM part GROUP BY p_size QUALIFY rank() OVER (ORDER BY count(*) DESC) = 1",
    "missing_cells": "SELECT doc_id::VARCHAR AS row FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "row_assign_list": _with("orders") + " SELECT row, s AS state, v AS view, k::INTEGER AS k FROM zr",
    "col_assign_list": _with("orders") + " SELECT s AS state, CASE col WHEN 0 THEN 'o_orderstatus' WHEN 1 THEN 'o_orderpriority' ELSE 'o_totalprice' END AS col, v AS view FROM vm",
    "feature_params": _with("orders") + " SELECT s AS state, k::INTEGER AS k, round(mu, 3) AS mu, round(sigma, 3) AS sigma FROM f2",
    "suffstats_by_category": _with("orders") + " SELECT s AS state, k::INTEGER AS k, code::INTEGER AS code, round(lnp, 6) AS ln_w FROM f0",
    "depprob_pw": _with("orders", "nm(col, name) AS (VALUES (0, 'o_orderstatus'), (1, 'o_orderpriority'), (2, 'o_totalprice'))") + " SELECT x.name AS A, y.name AS B, round(avg(CASE WHEN a.v = b.v THEN 1.0::DOUBLE ELSE 0 END), 6) AS depprob FROM vm a JOIN vm b ON a.s = b.s JOIN nm x ON x.col = a.col JOIN nm y ON y.col = b.col GROUP BY x.name, y.name",
    "rowsim_view_weighted": _rowsim("1"),
    "rowsim_col_weighted": _rowsim("nc"),
    "rowsim_wrt": _rowsim("1", "(a.s, a.v) IN (SELECT (s, v) FROM vm WHERE col = 2)"),
    "novelty": _novelty("true"),
    "novelty_wrt": _novelty("(zr.s, zr.v) IN (SELECT (s, v) FROM vm WHERE col = 1)"),
    "entropy_single_cat": _JOINT + " SELECT 'o_orderstatus' AS col, round(ha, 6) AS h FROM hh UNION ALL SELECT 'o_orderpriority', round(hb, 6) FROM hh",
    "entropy_cat_cat": _JOINT + " SELECT round(hab, 6) AS h FROM hh",
    "mi_kinds": _JOINT + " SELECT kind, round(mi, 6) AS mi FROM (SELECT unnest(['unnormed', 'normed', 'linfoot', 'voi', 'jaccard', 'iqr', 'pearson']) AS kind, unnest([i, i / least(ha, hb), sqrt(1 - exp(-2 * i)), ha + hb - 2 * i, 1 - i / hab, i / hab, i / sqrt(ha * hb)]) AS mi FROM i) q",
    "conditional_entropy": _JOINT + " SELECT round(hab - hb, 6) AS h FROM hh",
    "info_prop": _JOINT + " SELECT round((ha + hb - hab) / ha, 6) AS p FROM hh",
    "logp_single": _lp(_SCORED, (2,)),
    "logp_joint": _lp(_SCORED, (0, 1, 2)),
    "logp_given": _lp(_SCORED, (2,), given="1-URGENT"),
    "logp_states": _lp(_SCORED, (2,), states="1"),
    "logp_scaled": _lp(_SCORED, (2,), scaled=True),
    "surprisal": _surprisal("orders", 2) + " SELECT row, round(surprisal, 6) AS surprisal FROM su",
    "surprisal_cat": _surprisal("orders", 1) + " SELECT row, round(surprisal, 6) AS surprisal FROM su",
    "surprisal_count": _surprisal("part", 2) + " SELECT row, round(surprisal, 6) AS surprisal FROM su",
    "surprisal_missing": _surprisal("docs", 2) + " SELECT t.row, round(surprisal, 6) AS surprisal FROM t LEFT JOIN su ON su.row = t.row",
    "predict_categorical": _PREDICT + " SELECT given, arg_max(x, p - 1e-12 * code) AS value, any_value(u) AS uncertainty FROM pm JOIN (SELECT given, round(avg(d) * 3 / 2, 6) AS u FROM tv GROUP BY given) q USING (given) GROUP BY given",
    "predict_mnar": _with("docs", "pr AS (SELECT zr.s, zr.v, zr.k, (count(c2) + 0.5::DOUBLE) / (count(*) + 1) AS p FROM zr JOIN vm ON vm.s = zr.s AND vm.v = zr.v AND col = 2 GROUP BY zr.s, zr.v, zr.k)", "q AS (SELECT s, 1 - sum(w * p) AS q FROM pr JOIN w USING (s, v, k) GROUP BY s)") + " SELECT avg(q) > 0.5 AS missing, round(-avg(q) * ln(avg(q)) - (1 - avg(q)) * ln(1 - avg(q)) - avg(-q * ln(q) - (1 - q) * ln(1 - q)), 9) AS uncertainty FROM q",
    "feature_error_cat": _with("orders", "o AS (SELECT code, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM t JOIN x1 ON c1 = x GROUP BY code)", "e AS (SELECT code, sum(w * exp(lnp)) / 3 AS p FROM f1 JOIN w USING (s, v, k) GROUP BY code)") + " SELECT round(sum(abs(g)), 8) AS error FROM (SELECT sum(o.p - e.p) OVER (ORDER BY code) AS g FROM o JOIN e USING (code)) q",
    "impute_categorical": _with("docs", "l AS (SELECT row, f.code, f.lnp AS l FROM zr z JOIN vm ON vm.s = z.s AND vm.v = z.v AND col = 2 JOIN f2 f ON f.s = z.s AND f.v = z.v AND f.k = z.k WHERE z.c2 IS NULL)") + " SELECT row, arg_max(code, p - 1e-12 * code)::INTEGER AS toxic FROM (SELECT row, code, sum(exp(l)) AS p FROM l GROUP BY row, code) q GROUP BY row",
    "inconsistency": _with("orders", _logp((2,)), _logp((2,), given="1-URGENT").replace("wt AS", "wt2 AS").replace("FROM wt ", "FROM wt2 ").replace("wt.*", "wt2.*").replace("used", "used2").replace("cell", "cell2").replace("byv", "byv2").replace("bys", "bys2").replace("lp AS", "lp2 AS")) + " SELECT lp.row, round(lp2.logp / lp.logp, 6) AS inconsistency FROM lp JOIN lp2 ON lp2.row = lp.row",
    "held_out_neglogp": _HELD + " SELECT 0 AS step, '' AS removed, round(f0, 6) AS neglogp FROM n UNION ALL SELECT 1, CASE WHEN f1 <= f2 THEN 'o_orderstatus' ELSE 'o_orderpriority' END, round(least(f1, f2), 6) FROM n UNION ALL SELECT 2, CASE WHEN f1 <= f2 THEN 'o_orderpriority' ELSE 'o_orderstatus' END, round(f3, 6) FROM n",
    "attributable_neglogp": _HELD + " SELECT round(CASE WHEN f3 > f0 THEN 0 ELSE (least(f1, f2) / f0 / 2 + (f0 - f3) / f0 / 2) / 3 END, 6) AS share FROM n",
    "upsert_edit_cell": _EDIT.format(x="CASE WHEN o_orderkey = 7 THEN 1.5::DOUBLE ELSE o_totalprice END"),
    "append_rows": "SELECT o_orderkey::VARCHAR AS row, o_orderstatus, o_orderpriority, o_totalprice FROM orders UNION ALL SELECT * FROM (VALUES ('new-1', 'F', '1-URGENT', 10.0::DOUBLE), ('new-2', 'O', 'NEW-PRIORITY', NULL)) q",
    "append_columns": "SELECT o_orderkey::VARCHAR AS row, (o_orderkey % 3)::INTEGER AS third FROM orders",
    "remove_rows": _EDIT.format(x="o_totalprice") + " WHERE o_orderkey % 5 <> 0",
    "remove_cells_cascade": _EDIT.format(x="CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_totalprice END") + " WHERE o_orderkey % 4 <> 0",
    "window_evict": f"SELECT * FROM ({_EDIT.format(x='o_totalprice')} ORDER BY o_orderkey OFFSET 3) q {_APPENDED}",
    "trench_evict": f"SELECT * FROM ({_EDIT.format(x='o_totalprice')} QUALIFY row_number() OVER (ORDER BY o_orderkey) NOT BETWEEN 11 AND 13) q {_APPENDED}",
}
#: Two fixtures at once: the parts are joined below.
ORACLES["variability_all"] = (
    "SELECT * FROM (" + _JOINT + " SELECT 'o_orderpriority' AS col, round(hb, 5) AS x FROM hh) q UNION ALL SELECT * FROM (" + _with("orders")
    + " SELECT 'o_totalprice', round((sum(w * (sigma * sigma + mu * mu)) / 3 - (sum(w * mu) / 3) * (sum(w * mu) / 3)) / 1e9, 5) FROM f2 JOIN w USING (s, v, k)) q UNION ALL SELECT * FROM (" + _with("part")
    + " SELECT 'p_size', round(sum(w * (rate + rate * rate)) / 3 - (sum(w * rate) / 3) * (sum(w * rate) / 3), 5) FROM f2 JOIN w USING (s, v, k)) q"
)

_SIZES = "xs AS (SELECT unnest(range(0, 200)) AS x)"
_POISSON = "exp(x * ln(rate) - rate - lgamma(x + 1))"
ORACLES |= {
    "scan_csv_orders": ORACLES["scan_encode_orders"],
    "scan_jsonl_part": _with("part") + " SELECT row, x0.code::INTEGER AS p_brand, x1.code::INTEGER AS p_type, c2::BIGINT AS p_size, c3 AS p_retailprice FROM t JOIN x0 ON c0 = x0.x JOIN x1 ON c1 = x1.x",
    "save_and_load": ORACLES["surprisal"],
    "surprisal_values": _with(
        "orders", "l AS (SELECT row, " + _GAUSS.replace("c2", "150000") + " AS l FROM zr z JOIN vm ON vm.s = z.s AND vm.v = z.v AND col = 2 JOIN f2 f ON f.s = z.s AND f.v = z.v AND f.k = z.k)",
    ) + " SELECT row, round(ln(count(*)) - (max(m) + ln(sum(exp(l - m)))), 6) AS surprisal FROM (SELECT *, max(l) OVER (PARTITION BY row) AS m FROM l) q GROUP BY row",
    "impute_count": _with(
        "part", _SIZES, "kz AS (SELECT row, max(k) FILTER (s = 0) AS a, max(k) FILTER (s = 1) AS b, max(k) FILTER (s = 2) AS c FROM zr JOIN vm USING (s, v) WHERE col = 2 GROUP BY row)",
        f"best AS (SELECT a, b, c, arg_max(x, p - 1e-14 * x) AS p_size FROM (SELECT q.a, q.b, q.c, x, sum({_POISSON}) AS p FROM (SELECT DISTINCT a, b, c FROM kz) q CROSS JOIN xs JOIN f2 ON (f2.s = 0 AND f2.k = q.a) OR (f2.s = 1 AND f2.k = q.b) OR (f2.s = 2 AND f2.k = q.c) GROUP BY q.a, q.b, q.c, x) r GROUP BY a, b, c)",
    ) + " SELECT row, p_size::BIGINT AS p_size FROM kz JOIN best USING (a, b, c)",
    "predict_count": _with("part", _SIZES, f"ps AS (SELECT s, x, sum(w * {_POISSON}) AS p FROM f2 JOIN w USING (s, v, k) CROSS JOIN xs GROUP BY s, x)", "pm AS (SELECT x, avg(p) AS p FROM ps GROUP BY x)")
    + " SELECT (SELECT arg_max(x, p) FROM pm)::BIGINT AS value, round(sum(0.5::DOUBLE * abs(ps.p - pm.p)) / 3 * 3 / 2, 5) AS uncertainty FROM ps JOIN pm USING (x)",
    "held_out_inconsistency": _HELD + " SELECT 0 AS step, '' AS removed, round(f0 / f3, 8) AS inconsistency FROM n UNION ALL SELECT 1, CASE WHEN f1 / f3 <= f2 / f3 THEN 'o_orderstatus' ELSE 'o_orderpriority' END, round(least(f1 / f3, f2 / f3), 8) FROM n UNION ALL SELECT 2, CASE WHEN f1 / f3 <= f2 / f3 THEN 'o_orderpriority' ELSE 'o_orderstatus' END, round(f3 / f3, 8) FROM n",
    "attributable_inconsistency": _HELD + " SELECT round(CASE WHEN 1 > f0 / f3 THEN 0 ELSE (least(f1, f2) / f0 / 2 + (f0 - f3) / f0 / 2) / 3 END, 6) AS share FROM n",
    "held_out_uncertainty": _PREDICT.replace("CROSS JOIN x0 g LEFT JOIN", "CROSS JOIN (SELECT x FROM x0 WHERE x = 'F' UNION ALL SELECT NULL) g LEFT JOIN").replace("JOIN pm ON pm.given = ps.given AND", "JOIN pm ON pm.given IS NOT DISTINCT FROM ps.given AND")
    + " SELECT CASE WHEN given IS NULL THEN 1 ELSE 0 END AS step, CASE WHEN given IS NULL THEN 'o_orderstatus' ELSE '' END AS removed, round(avg(d) * 3 / 2, 6) AS uncertainty FROM tv GROUP BY given",
}
