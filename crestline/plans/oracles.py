"""SQL that gives the same rows as the queries of the catalogue, and the parameters both share."""

from __future__ import annotations

import numpy as np

K = 6
CLUSTERS = 10
DELTA_E = 1.29
SKETCH = (8, 4)  # estimators, hashes


def planes() -> np.ndarray:
    """Hyperplanes of the sketch query, rounded so that both sides read the same numbers."""
    return np.round(np.random.default_rng(42).standard_normal((SKETCH[0] * SKETCH[1], 64)), 6)


POINTS = {
    "E": "SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS f FROM embeddings",
    "P": "SELECT p_partkey::BIGINT AS id, [p_size::DOUBLE, p_retailprice::DOUBLE] AS f FROM part",
    "S": "SELECT s_suppkey::BIGINT AS id, [s_nationkey::DOUBLE, s_acctbal::DOUBLE] AS f FROM supplier",
    "U": """SELECT user_id::BIGINT AS id, [count(*) FILTER (event_type = 'click')::DOUBLE, count(*) FILTER (event_type = 'view')::DOUBLE,
      count(*) FILTER (event_type = 'error')::DOUBLE, count(*)::DOUBLE] AS f FROM events WHERE user_id IS NOT NULL GROUP BY user_id""",
}


def _pairs(points: str) -> str:
    return f"""pts AS ({POINTS[points]}),
pairs AS (SELECT a.id, b.id AS nbr, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(a.f, b.f), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), lambda s, t: s + t) AS d2 FROM pts a, pts b)"""


def _knn(points: str) -> str:
    return f"""{_pairs(points)},
knn AS (SELECT id, nbr, d2, row_number() OVER (PARTITION BY id ORDER BY d2, nbr) AS rk FROM pairs QUALIFY rk <= {K + 1})"""


def _fold(term: str, order: str = "rk") -> str:
    """Terms added in rank order."""
    return f"list_reduce(list_prepend(0.0::DOUBLE, list({term} ORDER BY {order})), lambda s, t: s + t)"


KTH = "rho AS (SELECT id, CASE WHEN max(d2) = 0 THEN 'inf'::DOUBLE ELSE 1 / sqrt(max(d2)) END AS rho FROM knn GROUP BY id)"
DENSER = "(rj.rho > ri.rho OR (rj.rho = ri.rho AND rj.id > ri.id))"
DEP = f"""near AS (
  SELECT k.id, k.nbr AS dep, k.d2 FROM knn k JOIN rho ri ON ri.id = k.id JOIN rho rj ON rj.id = k.nbr
  WHERE k.rk >= 2 AND {DENSER} QUALIFY row_number() OVER (PARTITION BY k.id ORDER BY k.rk) = 1
), far AS (
  SELECT p.id, p.nbr AS dep, p.d2 FROM pairs p JOIN rho ri ON ri.id = p.id JOIN rho rj ON rj.id = p.nbr
  WHERE {DENSER} AND p.id NOT IN (SELECT id FROM near) QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY p.d2, p.nbr DESC) = 1
), graph AS (
  SELECT r.*, d.dep, sqrt(d.d2) AS delta FROM rho r LEFT JOIN (SELECT * FROM near UNION ALL SELECT * FROM far) d ON d.id = r.id
)"""
FULL_DEP = f"""
  SELECT p.id, p.nbr AS dep, sqrt(p.d2) AS delta FROM pairs p JOIN rho ri ON ri.id = p.id JOIN rho rj ON rj.id = p.nbr
  WHERE {DENSER} QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY p.d2, p.nbr DESC) = 1"""


def _graph(points: str, rho: str = KTH) -> str:
    return f"{_knn(points)},\n{rho},\n{DEP}"


def _product(n: int, rho: str = "rho") -> str:
    return f"centers AS (SELECT id FROM graph ORDER BY CASE WHEN dep IS NULL THEN 'inf'::DOUBLE ELSE {rho} * delta END DESC, id LIMIT {n})"


THRESHOLD = f"centers AS (SELECT id FROM graph WHERE dep IS NULL OR (delta >= {DELTA_E} AND rho >= 0.5))"
WALK = """walk AS (
  SELECT id, CASE WHEN id IN (SELECT id FROM centers) THEN id ELSE dep END AS spot, id IN (SELECT id FROM centers) AS done FROM graph
  UNION ALL SELECT w.id, CASE WHEN w.spot IN (SELECT id FROM centers) THEN w.spot ELSE g.dep END, w.spot IN (SELECT id FROM centers) FROM walk w JOIN graph g ON g.id = w.spot WHERE NOT w.done
), rooted AS (SELECT id, spot AS root FROM walk WHERE done),
clusters AS (SELECT id, max(id) OVER (PARTITION BY root) AS cluster FROM rooted)"""


def _clusters(points: str, centers: str) -> str:
    return f"WITH RECURSIVE {_graph(points)},\n{centers},\n{WALK}\n"


BY_PRODUCT = _clusters("E", _product(CLUSTERS))
TOTALS = """, m AS (
  SELECT *, sum(n) OVER (PARTITION BY label) AS a, sum(n) OVER (PARTITION BY cluster) AS b, sum(n) OVER () AS total FROM t
), la AS (SELECT DISTINCT label, a, total FROM m), lb AS (SELECT DISTINCT cluster, b, total FROM m)"""
TABLE = f"""{BY_PRODUCT}, t AS (
  SELECT e.label::BIGINT AS label, c.cluster, count(*) AS n FROM embeddings e JOIN clusters c ON c.id = e.vec_id GROUP BY ALL
){TOTALS}"""
ARI = """, s AS (
  SELECT (SELECT sum(n)::DOUBLE FROM m) AS n, (SELECT sum(n * n)::DOUBLE FROM m) AS s, (SELECT sum(a * a)::DOUBLE FROM la) AS a, (SELECT sum(b * b)::DOUBLE FROM lb) AS b
), q AS (SELECT s - n AS tp, b - s AS fp, a - s AS fn, n * n - (b - s) - (a - s) - s AS tn FROM s)
SELECT round(CASE WHEN fp = 0 AND fn = 0 THEN 1 ELSE 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END, 8) AS ari FROM q"""


def _second(text: str) -> str:
    """The same tables for another choice of centers."""
    for name in ("centers", "walk", "rooted", "clusters"):
        text = text.replace(name, f"{name}_2")
    return text


INFO = """, i AS (
  SELECT (SELECT sum(n / total * ln(n * total / (a * b))) FROM m) AS mi, (SELECT -sum(a / total * ln(a / total)) FROM la) AS hc,
    (SELECT -sum(b / total * ln(b / total)) FROM lb) AS hk
)"""
PRICED = "x AS (SELECT p_retailprice AS x, p_size::BIGINT AS y FROM part)"
MONTHS = "m AS (SELECT year(l_shipdate)::BIGINT AS year, month(l_shipdate)::BIGINT AS month, count(*) AS n FROM lineitem GROUP BY ALL)"


def _front(order: str) -> str:
    return f"f AS (SELECT x, y FROM x QUALIFY coalesce(y > max(y) OVER (ORDER BY {order}, y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true))"


def _race() -> str:
    rows = ", ".join(f"({i // SKETCH[1]}, {i % SKETCH[1]}, [{', '.join(repr(float(x)) for x in plane)}])" for i, plane in enumerate(planes()))
    return f"""WITH planes(e, h, w) AS (VALUES {rows}), pts AS ({POINTS['E']}), bits AS (
  SELECT id, e, h, (list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(f, w), lambda x: x[1] * x[2])), lambda s, t: s + t) > 0)::BIGINT AS bit FROM pts, planes
), b AS (SELECT id, e, sum(bit * (1 << ({SKETCH[1] - 1} - h))) AS bucket FROM bits GROUP BY ALL
), c AS (SELECT e, bucket, count(*) AS cnt FROM b GROUP BY ALL)
SELECT id, sum(cnt)::DOUBLE / {SKETCH[0]} AS rho FROM b JOIN c USING (e, bucket) GROUP BY id"""


def _sweep(ks: list[int]) -> str:
    values = ", ".join(f"({k})" for k in ks)
    return f"""WITH RECURSIVE {_graph('E')}, ranked AS (
  SELECT id, dep, row_number() OVER (ORDER BY CASE WHEN dep IS NULL THEN 'inf'::DOUBLE ELSE ln(rho) + ln(delta) END DESC, id) AS place FROM graph
), ks(k) AS (VALUES {values}), walk AS (
  SELECT k, id, CASE WHEN place <= k THEN id ELSE dep END AS spot, place <= k AS done FROM ranked, ks
  UNION ALL SELECT w.k, w.id, CASE WHEN r.place <= w.k THEN w.spot ELSE r.dep END, r.place <= w.k FROM walk w JOIN ranked r ON r.id = w.spot WHERE NOT w.done
)
SELECT k::INTEGER AS k, id, spot AS cluster FROM walk WHERE done"""


ORACLES = {
    "clusters_product": f"{BY_PRODUCT} SELECT id, cluster FROM clusters",
    "knn_exact": f"WITH {_knn('E')} SELECT * FROM knn",
    "knn_ties": f"WITH {_knn('P')} SELECT * FROM knn",
    "knn_users": f"WITH {_knn('U')} SELECT * FROM knn",
    "density_kth": f"WITH {_knn('E')}, {KTH} SELECT * FROM rho",
    "density_kth_capped": f"WITH {_knn('E')} SELECT id, CASE WHEN max(d2) <= 0 THEN 3.4028234663852886e38 ELSE 1 / sqrt(max(d2)) END AS rho FROM knn GROUP BY id",
    "density_normalized": f"""WITH {_knn('E')}, {KTH}
SELECT k.id, any_value(own.rho) AS rho, any_value(own.rho) / ({_fold('r.rho')} / count(*)) AS rho_rw FROM knn k JOIN rho r ON r.id = k.nbr JOIN rho own ON own.id = k.id GROUP BY k.id""",
    "density_mutual": f"""WITH {_knn('E')}
SELECT a.id, {_fold('1 / (a.rk + b.rk)::DOUBLE', 'a.rk')} * count(*) / {_fold('sqrt(a.d2)', 'a.rk')} AS rho FROM knn a JOIN knn b ON a.id = b.nbr AND a.nbr = b.id GROUP BY a.id""",
    "density_mutual_ties": f"""WITH {_knn('U')}, x AS (
  SELECT a.id, sum(1 / (a.rk + b.rk)::DOUBLE) AS s, count(*) AS n, sum(sqrt(a.d2)) AS l FROM knn a JOIN knn b ON a.id = b.nbr AND a.nbr = b.id GROUP BY a.id
) SELECT p.id, CASE WHEN l > 0 THEN round(s * n / l, 8) END AS rho FROM pts p LEFT JOIN x ON x.id = p.id""",
    "density_topksum": f"WITH {_knn('E')} SELECT id, -{_fold('sqrt(d2)')} AS rho FROM knn GROUP BY id",
    "density_expsq": f"WITH {_knn('U')} SELECT id, round(exp(-({_fold('d2')} / count(*))), 8) AS rho FROM knn GROUP BY id",
    "density_sumexp": f"WITH {_knn('S')} SELECT id, round({_fold('exp(-d2)')} / count(*), 8) AS rho FROM knn GROUP BY id",
    "density_wrapped_dependents": f"WITH {_graph('P', 'rho AS (SELECT id, 60.0::DOUBLE - f[1] AS rho FROM pts)')} SELECT id, dep, delta FROM graph",
    "density_race": _race(),
    "dep_pointers": f"WITH {_graph('E')} SELECT id, dep, delta FROM graph",
    "dep_pointers_ties": f"WITH {_graph('U')} SELECT id, dep, delta FROM graph",
    "dep_restricted": f"WITH {_knn('E')}, {KTH} SELECT * FROM ({FULL_DEP}) WHERE id IN (SELECT vec_id FROM embeddings WHERE label = 3)",
    "dep_legacy": f"WITH {_knn('E')}, {KTH}, d AS ({FULL_DEP}) SELECT rho.id, d.dep, d.delta FROM rho LEFT JOIN d ON d.id = rho.id AND rho.rho > 0.75",
    "decision_graph": f"WITH {_graph('E')} SELECT id, rho, delta, dep FROM graph",
    "max_density_point": f"WITH {_knn('E')}, {KTH} SELECT id, rho FROM rho ORDER BY rho DESC, id DESC LIMIT 1",
    "centers_threshold": f"WITH {_graph('E')}, {THRESHOLD} SELECT id FROM centers",
    "centers_product": f"WITH {_graph('E')}, {_product(CLUSTERS)} SELECT id FROM centers",
    "centers_product_reweighted": f"""WITH {_knn('E')}, r0 AS (SELECT id, 1 / sqrt(max(d2)) AS rho FROM knn GROUP BY id),
rho AS (SELECT k.id, any_value(own.rho) AS rho, any_value(own.rho) / ({_fold('r.rho')} / count(*)) AS rho_rw FROM knn k JOIN r0 r ON r.id = k.nbr JOIN r0 own ON own.id = k.id GROUP BY k.id),
{DEP}, {_product(CLUSTERS, 'rho_rw')} SELECT id FROM centers""",
    "clusters_threshold": f"{_clusters('E', THRESHOLD)} SELECT id, cluster FROM clusters",
    "clusters_users": f"{_clusters('U', _product(8))} SELECT id, cluster FROM clusters",
    "clusters_by_center": f"{BY_PRODUCT} SELECT id, root AS cluster FROM rooted",
    "legacy_clusters": f"""WITH RECURSIVE {_knn('E')}, {KTH}, d AS ({FULL_DEP}),
graph AS (SELECT rho.id, rho.rho, d.dep, d.delta FROM rho LEFT JOIN d ON d.id = rho.id AND rho.rho > 0.75),
centers AS (SELECT id FROM graph WHERE NOT coalesce(dep IS NOT NULL AND rho > 0.75 AND (delta <= {DELTA_E} OR rho < 0.78), false)),
{WALK} SELECT id, cluster FROM clusters""",
    "cluster_count": f"{BY_PRODUCT} SELECT count(DISTINCT cluster) AS num_clusters FROM clusters",
    "dpc_approx_gate": f"{BY_PRODUCT} SELECT count(*) AS points, count(DISTINCT cluster) AS clusters, true AS agrees FROM clusters",
    "cluster_sizes": f"{BY_PRODUCT} SELECT cluster, count(*) AS n FROM clusters GROUP BY cluster",
    "largest_clusters": f"{_clusters('E', _product(60))} SELECT cluster, count(*) AS n FROM clusters GROUP BY cluster ORDER BY n DESC, cluster LIMIT 20",
    "singleton_clusters": f"{_clusters('E', _product(60))} SELECT id, cluster FROM clusters QUALIFY count(*) OVER (PARTITION BY cluster) <= 1",
    "sweep_k": _sweep([2, 5, 10, 40]),
    "metric_recall50_precision50": f"""{TABLE}, h AS (SELECT count(*) FILTER (n / (a + b - n) > 0.5) AS hits FROM m)
SELECT round(hits / (SELECT count(*) FROM la), 8) AS recall50, round(hits / (SELECT count(*) FROM lb), 8) AS precision50 FROM h""",
    "metric_ari": f"{TABLE}{ARI}",
    "metric_ari_of_two": f"""{BY_PRODUCT}, {_second(_product(40))}, {_second(WALK)}, t AS (
  SELECT c.cluster AS label, d.cluster, count(*) AS n FROM clusters c JOIN clusters_2 d ON c.id = d.id GROUP BY ALL
){TOTALS}{ARI}""",
    "metric_homogeneity_completeness": f"""{TABLE}{INFO}
SELECT round(CASE WHEN hc = 0 THEN 1 ELSE mi / hc END, 8) AS homogeneity, round(CASE WHEN hk = 0 THEN 1 ELSE mi / hk END, 8) AS completeness FROM i""",
    "metric_ami": f"""{TABLE}{INFO}, e AS (
  SELECT sum(k / total * ln(total * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(total - a + 1) + lgamma(total - b + 1) - lgamma(total + 1) - lgamma(k + 1)
    - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(total - a - b + k + 1))) AS e
  FROM (SELECT la.a::DOUBLE AS a, lb.b::DOUBLE AS b, la.total::DOUBLE AS total, unnest(range(greatest(1, la.a + lb.b - la.total)::BIGINT, least(la.a, lb.b)::BIGINT + 1)) AS k FROM la, lb)
) SELECT round(CASE WHEN hc = 0 AND hk = 0 THEN 1 ELSE (mi - e) / ((hc + hk) / 2 - e) END, 7) AS ami FROM i, e""",
    "nearest_centroid": f"""WITH pts AS ({POINTS['E']}), x AS (
  SELECT label::BIGINT AS label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings
), mean AS (SELECT label, pos, round(avg(x), 6) AS m FROM x GROUP BY ALL), c AS (SELECT label, list(m ORDER BY pos) AS w FROM mean GROUP BY label)
SELECT id, label AS cluster FROM pts, c
QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(f, w), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), lambda s, t: s + t), label) = 1""",
    "pareto_min_max": f"WITH {PRICED}, {_front('x')} SELECT x, y FROM f",
    "pareto_max_max": f"WITH {PRICED}, {_front('x DESC')} SELECT x, y FROM f",
    "best_within_tol": f"WITH {PRICED}, {_front('x')} SELECT x, y FROM f WHERE abs(y - (SELECT max(y) FROM f)) < 3 ORDER BY x LIMIT 1",
    "speedup_first": f"WITH {MONTHS} SELECT *, first_value(n) OVER (PARTITION BY year ORDER BY month) / n AS speedup FROM m",
    "loglog_slope": f"WITH {MONTHS} SELECT year, round(regr_slope(ln(n), ln(month)), 7) AS slope FROM m GROUP BY year",
    "time_share": f"WITH pts AS ({POINTS['U']}) SELECT id, f[1] / f[4] * 100 AS click_share, f[2] / f[4] * 100 AS view_share, f[3] / f[4] * 100 AS error_share FROM pts",
    "threshold_for_c": f"""WITH {_graph('E')}, d AS (SELECT coalesce(delta, (SELECT max(delta) FROM graph)) AS delta FROM graph)
SELECT avg(delta) AS threshold FROM (SELECT delta, row_number() OVER (ORDER BY delta DESC) AS r FROM d) WHERE r IN (10, 11)""",
    "top_by_product": f"WITH {_graph('E')} SELECT id, rho * coalesce(delta, (SELECT max(delta) FROM graph)) AS product FROM graph ORDER BY product DESC, id LIMIT 10",
    "top_by_delta": f"WITH {_graph('E')} SELECT id, coalesce(delta, (SELECT max(delta) FROM graph)) AS delta FROM graph ORDER BY delta DESC, id LIMIT 5",
    "label_encode": "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer",
    "factorize": """WITH f AS (SELECT c_mktsegment, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS code FROM customer GROUP BY c_mktsegment)
SELECT c_custkey, code FROM customer JOIN f USING (c_mktsegment)""",
    "histogram": """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 50)) + 1, 50)::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY ALL""",
    "most_frequent": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "kv_parse": """WITH v AS (
  SELECT unnest([{'k': 'id', 't': s_suppkey::VARCHAR}, {'k': 'name', 't': s_name}, {'k': 'half', 't': s_suppkey || '.5'}, {'k': 'even', 't': CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'False' END}]) AS p FROM supplier
) SELECT p.k AS key, p.t AS text, CASE p.k WHEN 'id' THEN 'int' WHEN 'half' THEN 'float' WHEN 'even' THEN 'bool' ELSE 'str' END AS kind,
  CASE WHEN p.k = 'id' THEN try_cast(p.t AS BIGINT) END AS as_long, CASE WHEN p.k IN ('id', 'half') THEN try_cast(p.t AS DOUBLE) END AS as_double, CASE WHEN p.k = 'even' THEN lower(p.t) = 'true' END AS as_boolean FROM v""",
    "csv_label_split": "SELECT p_brand AS label, p_size::DOUBLE AS f0, (p_partkey % 100)::DOUBLE AS f1, 2::BIGINT AS width FROM part",
    "method_decode": """SELECT s_suppkey, 'Vamana' AS graph, 32::BIGINT AS max_degree, 1.1::DOUBLE AS alpha, s_suppkey::BIGINT AS "Lbuild", 64::BIGINT AS "L", 16::BIGINT AS "Lnn", 'exp-sum' AS density,
  (s_suppkey % 16)::BIGINT AS "K" FROM supplier""",
    "cluster_ratio": """SELECT c_mktsegment AS dataset, count(DISTINCT c_nationkey) AS num_clusters, count(*) AS gt_num_clusters, count(DISTINCT c_nationkey) / count(*) AS ratio FROM customer GROUP BY c_mktsegment""",
    "union_results": "SELECT n_name AS dataset, n_nationkey::BIGINT AS num_clusters, NULL::VARCHAR AS method FROM nation UNION ALL SELECT r_name, NULL, 'DBSCAN' FROM region",
    "complete_rows": "SELECT s_suppkey, s_acctbal AS x, 1.0::DOUBLE AS y FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0",
    "graph_degrees": "SELECT avg(n) AS avg_degree, max(n) AS max_degree FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)",
    "nonzero_metrics": "SELECT s_suppkey, (s_suppkey % 3)::DOUBLE AS homogeneity, (s_suppkey % 4)::DOUBLE AS completeness FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0",
    "labels_scan": "SELECT vec_id::BIGINT AS id, label::BIGINT AS label FROM embeddings",
    "decision_graph_scan": """SELECT vec_id::BIGINT AS id, 1 / (vec_id + 1)::DOUBLE AS rho, CASE WHEN vec_id > 0 THEN sqrt(vec_id::DOUBLE) END AS delta, CASE WHEN vec_id > 0 THEN vec_id::BIGINT // 2 END AS dep FROM embeddings""",
    "results_scan": """SELECT n_name AS dataset, n_nationkey::BIGINT AS num_clusters, NULL::VARCHAR AS method FROM nation, range(2) UNION ALL SELECT r_name, NULL, 'DBSCAN' FROM region""",
    "vectors_scan": """SELECT vec_id::BIGINT AS id, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last, len(embedding)::BIGINT AS width FROM embeddings""",
    "values_scan": "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS id, s_acctbal AS x FROM supplier",
    "clusters_of_file": f"{BY_PRODUCT} SELECT id, cluster FROM clusters",
    "knn_completed": f"WITH {_knn('E')} SELECT * FROM knn",
    "clusters_noise": f"""{_clusters('E', _product(CLUSTERS).replace("centers AS", "tops AS") + ", centers AS (SELECT id FROM tops UNION SELECT id FROM graph WHERE rho < 0.75)")} SELECT id, cluster FROM clusters""",
    "clusters_merged": f"{BY_PRODUCT} SELECT id, cluster % 3 AS cluster FROM clusters",
    "regression": "SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 5) AS intercept, round(regr_r2(p_retailprice, p_size), 6) AS r2 FROM part",
    "configurations": """SELECT g || '_' || a || '_1.1_' || b || '_' || greatest(2 * k, l) || '_' || n || '_' || w || '_' || k AS method, greatest(2 * k, l)::BIGINT AS width, k::BIGINT AS k
FROM (VALUES ('HCNNG'), ('Vamana')) t1(g), (VALUES (8), (16)) t2(a), (VALUES (8), (16)) t3(b), (VALUES (8), (16)) t4(l), (VALUES (8), (16)) t5(n), (VALUES (4), (8)) t6(k), (VALUES ('kth'), ('sum')) t7(w)""",
    "kmeans_grid": "SELECT nredo::BIGINT AS nredo, niter::BIGINT AS niter FROM range(1, 5) r(nredo), range(1, 46) i(niter) WHERE (niter < 10 OR niter % 5 = 0) AND nredo * niter <= 100",
    "generated_sizes": "SELECT c::BIGINT AS label, (SELECT count(*) FROM part) + c AS n, c::BIGINT AS center FROM range(5) t(c)",
    "distinct_count": "SELECT count(DISTINCT c_mktsegment) AS n FROM customer",
}
ORACLES["metrics_chosen"] = f"SELECT ari, homogeneity FROM ({ORACLES['metric_ari']}), ({ORACLES['metric_homogeneity_completeness']})"
