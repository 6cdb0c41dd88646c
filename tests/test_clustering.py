"""Neighbours, densities, dependent points, centers, labels: hand-computed values on small fixtures."""

import math

import numpy as np
import pytest

from crestline import session
from crestline.operators import assign, centers, density, dependent, graphs, metrics, sketch, sweep
from crestline.operators.components import connected_components
from crestline.operators.knn import complete, exact_knn, nearest_centroid, recall, rerank
from crestline.operators.vectors import dimension, from_matrix, points
from crestline.plans import dpc
from crestline.session import keep

INF = float("inf")


@pytest.fixture(scope="module")
def line(spark):
    """Ten points on y = 2x."""
    return keep(from_matrix(spark, np.array([[x, 2 * x] for x in range(1, 11)])))


@pytest.fixture(scope="module")
def knn(line):
    return keep(exact_knn(line, 3))


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def graph_of(spark, rows, noise=()):
    graph = spark.createDataFrame(rows, "id long, rho double, rho_rw double, dep long, delta double")
    return graph, spark.createDataFrame([(i,) for i in noise], "id long")


def lists(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.id, r.rk)):
        out.setdefault(r.id, []).append((r.nbr, r.d2))
    return out


def line_lists():
    return {0: [(0, 0), (1, 5), (2, 20)], 9: [(9, 0), (8, 5), (7, 20)]} | {i: [(i, 0), (i - 1, 5), (i + 1, 5)] for i in range(1, 9)}


def test_neighbours(knn):
    assert lists(knn) == line_lists()


def test_neighbours_by_block_join_are_the_same(line, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    assert lists(exact_knn(line, 3)) == line_lists()


def test_block_join_over_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pts = keep(from_matrix(spark, np.round(rng.random((2_500, 2)) * 40)))
    small = lists(exact_knn(pts, 5))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    assert lists(exact_knn(pts, 5)) == small


def test_fewer_points_than_neighbours(spark):
    pts = from_matrix(spark, np.array([[0.0], [1.0]]))
    assert lists(exact_knn(pts, 7)) == {0: [(0, 0), (1, 1)], 1: [(1, 0), (0, 1)]}
    assert exact_knn(pts.limit(0), 3).count() == 0


def test_points_reject_what_is_no_vector(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (None, [1.0, 1.0]), (3, [None, 1.0])], "k long, v array<double>")
    assert [r.id for r in points(frame, "k", "v").collect()] == [1]
    with pytest.raises(ValueError):
        dimension(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, features array<double>"))


def test_kth_density(knn):
    got = by_id(density.kth(knn), "rho")
    assert all(math.isclose(got[i], 1 / math.sqrt(20 if i in (0, 9) else 5)) for i in range(10))


def test_other_densities(knn):
    got = by_id(density.exp_squared(knn), "rho")
    assert all(math.isclose(got[i], math.exp(-(25 if i in (0, 9) else 10) / 3)) for i in range(10))
    got = by_id(density.mutual(knn), "rho")
    want = {0: 3 / 2 / math.sqrt(5), 1: 19 * 3 / 40 / math.sqrt(5), 9: 1.4 / math.sqrt(5)} | {i: 27 / 20 / math.sqrt(5) for i in range(2, 9)}
    assert all(math.isclose(got[i], want[i]) for i in range(10))
    got = by_id(density.sum_exp(knn), "rho")
    assert math.isclose(got[3], (1 + 2 * math.exp(-5)) / 3)
    got = by_id(density.top_k_sum(knn), "rho")
    assert math.isclose(got[3], -2 * math.sqrt(5)) and math.isclose(got[0], -math.sqrt(5) - math.sqrt(20))


def test_reweighting(spark, knn):
    rho = spark.createDataFrame(list(enumerate(map(float, [5, 1, 2, 3, 2, 3, 2, 3, 2, 13]))), "id long, rho double")
    got = by_id(density.reweighted(knn, rho), "rho_rw")
    want = [5 / (8 / 3), 1 / (8 / 3), 2 / 2, 3 / (7 / 3), 2 / (8 / 3), 3 / (7 / 3), 2 / (8 / 3), 3 / (7 / 3), 2 / 6, 13 / 6]
    assert all(math.isclose(got[i], want[i]) for i in range(10))


def test_identical_points_are_infinitely_dense(spark):
    same = keep(exact_knn(from_matrix(spark, np.ones((5, 2))), 3))
    for how in (density.kth, density.mutual):
        assert set(by_id(how(same), "rho").values()) == {INF}
    assert set(by_id(density.kth_capped(same), "rho").values()) == {3.4028234663852886e38}
    graph = density.kth(same).join(dependent.dependent_points(from_matrix(spark, np.ones((5, 2))), same, density.kth(same)), "id")
    assert sum(r.dep is None for r in graph.collect()) == 1
    assert centers.by_product(graph, 2).count() == 2


def test_dependent_points(spark, line, knn):
    rho = spark.createDataFrame(list(enumerate(map(float, [5, 1, 2, 3, 2, 3, 2, 3, 2, 3]))), "id long, rho double")
    noise = spark.createDataFrame([(1,)], "id long")
    got = {r.id: (r.dep, r.delta) for r in dependent.dependent_points(line, knn, rho, noise).collect()}
    assert got[0] == got[1] == (None, None)
    assert got[2] == (3, math.sqrt(5)) and got[3] == (5, math.sqrt(20)) and got[9] == (0, math.sqrt(405))
    assert dependent.densest(rho).first().id == 0


def test_dependent_points_break_ties_by_highest_id_beyond_the_lists(spark):
    pts = from_matrix(spark, np.array([[0.0], [-3.0], [3.0], [0.5], [-0.5]]))
    rho = spark.createDataFrame([(0, 3.0), (1, 9.0), (2, 9.0), (3, 1.0), (4, 1.0)], "id long, rho double")
    got = by_id(dependent.dependent_points(pts, exact_knn(pts, 3), rho), "dep")
    assert got[0] == 2 and got[1] == 2 and got[2] is None


THRESHOLD = [(0, 5.0, None, None, None), *[(i, r, None, i - 1, 9.0 + i if i < 6 else 8.0) for i, r in enumerate(map(float, [1, 2, 3, 2, 3, 2, 3, 2, 3]), 1)]]


def test_threshold_centers_and_labels(spark):
    graph, noise = graph_of(spark, THRESHOLD, [2])
    found = centers.by_threshold(graph, 10, 2, noise)
    assert sorted(r.id for r in found.collect()) == [0, 3, 4, 5]
    got = by_id(assign.labels(graph, found, noise), "cluster")
    assert [got[i] for i in range(10)] == [1, 1, 2, 3, 4, 9, 9, 9, 9, 9]
    assert assign.count_clusters(assign.labels(graph, found, noise)).first().num_clusters == 5
    assert sorted(r.id for r in centers.by_threshold(graph).collect()) == [0]


def test_product_centers(spark):
    graph, _ = graph_of(spark, [(i, float(100 - i), float(i), None if i == 0 else i - 1, None if i == 0 else 1.5) for i in range(100)])
    assert sorted(r.id for r in centers.by_product(graph, 50).collect()) == list(range(50))
    assert sorted(r.id for r in centers.by_product(graph, 51, True).collect()) == [0, *range(50, 100)]
    graph, _ = graph_of(spark, [(0, 1.0, 6.0, 0, 100.0), (1, 2.0, 4.0, 2, 200.0), (2, 300.0, 2.0, 0, 0.9)])
    assert sorted(r.id for r in centers.by_product(graph, 2, True).collect()) == [0, 1]
    with pytest.raises(ValueError):
        centers.by_product(graph, 0)


def test_legacy_labels(spark):
    graph, _ = graph_of(spark, [(0, 9.0, None, None, None), (1, 8.0, None, 0, 5.0), (2, 7.0, None, 0, 6.0), (3, 1.0, None, 2, 7.0), (4, 0.5, None, 0, 1.0)])
    got = by_id(assign.legacy_labels(graph, 0.5, 5.0, 2.0), "cluster")
    assert got == {0: 1, 1: 1, 2: 3, 3: 3, 4: 4}


def test_sweep_equals_product_centers(spark, line, knn):
    rho = keep(density.kth(knn))
    graph = keep(rho.join(dependent.dependent_points(line, knn, rho), "id"))
    swept = sweep.sweep(graph, [1, 3, 10])
    for k in (1, 3, 10):
        want = by_id(assign.densest_labels(graph, centers.by_product(graph, k)), "cluster")
        assert by_id(swept.filter(f"k = {k}"), "cluster") == want
    with pytest.raises(ValueError):
        sweep.sweep(graph, [11])


def test_sketch(spark):
    pts = from_matrix(spark, np.array([[1, 0], [1, 0], [0, 1], [-1, 0]]))
    got = by_id(sketch.race_density(pts, 10_000, 3), "rho")
    want = [2 + 1 / 8, 2 + 1 / 8, 1 + 3 / 8, 1 + 1 / 8]
    assert all(abs(got[i] - want[i]) < 0.1 for i in range(4))
    family = sketch.CosineFamily()
    hashed = keep(sketch.buckets(pts, 4, 2, family))
    assert sorted(map(tuple, sketch.merge(sketch.add(hashed), sketch.add(hashed)).collect())) == sorted((e, b, 2 * c) for e, b, c in map(tuple, sketch.add(hashed).collect()))
    assert sketch.defaults(1_000) == (64, 6)


def test_sketch_of_a_stream(spark, tmp_path):
    from crestline.streaming.race import start

    pts = from_matrix(spark, np.random.default_rng(1).standard_normal((50, 3)))
    pts.repartition(3).write.parquet(str(tmp_path / "in"))
    family = sketch.CosineFamily()
    stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = start(stream, 4, 3, family, 3, "running_sketch", str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    batch = sketch.add(sketch.buckets(pts, 4, 3, sketch.CosineFamily()))
    assert sorted(map(tuple, spark.table("running_sketch").select("estimator", "bucket", "cnt").collect())) == sorted(map(tuple, batch.select("estimator", "bucket", "cnt").collect()))


def test_metrics(spark):
    truth = spark.createDataFrame([(i, v) for i, v in enumerate([0, 0, 1, 1])], "id long, label long")

    def scored(found):
        return metrics.evaluate(truth, spark.createDataFrame(list(enumerate(found)), "id long, cluster long"))

    assert scored([5, 5, 2, 2]) == pytest.approx(dict.fromkeys(metrics.METRICS, 1.0))
    got = scored([0, 0, 1, 2])  # published example values for these labels
    assert got["ARI"] == pytest.approx(0.5714285714, abs=1e-9) and got["homogeneity"] == pytest.approx(1.0) and got["completeness"] == pytest.approx(2 / 3)
    assert got["recall50"] == 0.5 and got["precision50"] == pytest.approx(1 / 3)
    got = scored([0, 1, 0, 1])
    assert got["ARI"] == pytest.approx(-0.5) and got["AMI"] == pytest.approx(-0.5) and got["homogeneity"] == pytest.approx(0)
    one = scored([7, 7, 7, 7])
    assert one["homogeneity"] == pytest.approx(0) and one["completeness"] == 1.0 and one["ARI"] == 0.0
    with pytest.raises(ValueError):
        metrics.evaluate(truth, truth.withColumnRenamed("label", "cluster"), ("nope",))


def test_expected_information_of_large_tables():
    """By ratios of neighbouring terms: the same as by factorials where these are exact, and finite far beyond."""
    import pandas as pd

    def plain(a, b, n):
        ways = lambda m: math.comb(a, m) * math.comb(n - a, b - m) / math.comb(n, b)
        return sum(ways(m) * m / n * math.log(n * m / (a * b)) for m in range(max(1, a + b - n), min(a, b) + 1))

    for n, pairs in ((30, [(3, 4), (30, 7), (1, 1), (16, 20)]), (400, [(200, 150), (399, 1), (5, 390)])):
        got = pd.concat(metrics._expected([pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "times": 1})], n)).e
        assert np.allclose(got, [plain(a, b, n) for a, b in pairs], rtol=1e-9, atol=1e-12)
    (far,) = (f.e[0] for f in metrics._expected([pd.DataFrame({"a": [4 * 10**9], "b": [10**9], "times": [1]})], 10**10))
    assert 0 < far < 1e-9  # about 1 / (2 n)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (300, 300)] + [(400, 400 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), keep).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100} | {i: 400 for i in range(400, 450)}


@pytest.fixture(scope="module")
def blobs(spark):
    from crestline.sources.generators import mixture

    made = keep(mixture(spark, [[0, 0], [40, 0], [0, 40], [40, 40]], [90, 110, 100, 80], 2.0))
    return made.select("id", "features"), made.select("id", "label")


@pytest.mark.parametrize("kind", graphs.KINDS)
def test_clustering_of_blobs(blobs, kind):
    pts, truth = blobs
    found = dpc.cluster(pts, K=6, L=32, Lnn=8, center_finder=dpc.Threshold(8.36), Lbuild=32, max_degree=16, graph_type=kind)
    got = metrics.evaluate(truth, found.clusters, ("ARI", "AMI", "homogeneity", "completeness"))
    assert min(got.values()) > 0.95
    assert {"Built index time", "Find knn time", "Compute density time", "Compute dependent points time", "Find clusters time", "Output time", "Total time"} == set(found.metadata)
    graph = found.graph.collect()
    assert sum(r.dep is None for r in graph) == 1
    rho = {r.id: r.rho for r in graph}
    assert all(r.dep is None or (rho[r.dep], r.dep) > (r.rho, r.id) for r in graph)


@pytest.mark.parametrize("kind", ["Vamana", "pyNNDescent", "HCNNG"])
def test_recall_of_graphs(blobs, kind):
    pts, _ = blobs
    edges = keep(graphs.build(pts, kind, 16, 32, 1.1, 6, 60))
    assert graphs.degrees(edges).first().max_degree <= 16
    exact = keep(exact_knn(pts, 7))
    assert recall(graphs.graph_knn(edges, pts, 7, 48), exact).first().recall > 0.9
    assert recall(graphs.join_knn(edges, pts, 7, 48), exact).first().recall > 0.9


def test_graph_dependents_with_few_left_are_exact(blobs):
    pts, _ = blobs
    knn = keep(exact_knn(pts, 7))
    rho = keep(density.kth(knn))
    edges = keep(graphs.build(pts, "HCNNG", 16, 32, 1.1, 6, 60))
    assert by_id(graphs.graph_dependent_points(edges, pts, knn, rho), "dep") == by_id(dependent.dependent_points(pts, knn, rho), "dep")
    searched = by_id(graphs.graph_dependent_points(edges, pts, knn, rho, few=0), "dep")
    assert sum(v is None for v in searched.values()) == 1
    joined = by_id(graphs.join_dependent_points(edges, pts, knn, rho, few=0), "dep")
    assert sum(v is None for v in joined.values()) == 1 and sum(joined[i] == v for i, v in by_id(dependent.dependent_points(pts, knn, rho), "dep").items()) > 0.97 * len(joined)


@pytest.mark.parametrize("kind", ["pyNNDescent", "HCNNG", "Vamana"])
def test_graphs_beyond_the_broadcast_bound(blobs, monkeypatch, kind):
    pts, truth = blobs
    exact = dpc.cluster(pts, K=6, center_finder=dpc.Threshold(8.36), graph_type="BruteForce").clusters
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(graphs, "SHARD", 120)
    monkeypatch.setattr(graphs.join_dependent_points, "__defaults__", (4, 3, 0, None))  # no exact search instead of joins
    options = {} if kind == "Vamana" else {"Lbuild": 32, "max_degree": 16, "graph_type": kind}
    found = dpc.cluster(pts, center_finder=dpc.Threshold(8.36), **options)
    assert metrics.evaluate(truth, found.clusters, ("ARI",))["ARI"] > 0.95
    assert metrics.evaluate(exact.withColumnRenamed("cluster", "label"), found.clusters, ("ARI",))["ARI"] > 0.95
    with pytest.raises(ValueError):
        graphs.graph_knn(graphs.build(pts, "HCNNG"), pts, 3, 8)


def test_complete_and_rerank(line, knn):
    part = knn.filter("id <> 4 AND rk < 3").unionByName(knn.filter("id IN (0, 1) AND rk = 3"))
    assert lists(complete(keep(part), line, 3)) == line_lists()
    assert lists(rerank(knn.select("id", "nbr"), line, 3)) == line_lists()


def test_all_density_names_and_refusals(blobs):
    pts, _ = blobs
    for name in ("kth", "normalized", "race", "exp-sum", "sum-exp", "sum", "mutual"):
        assert dpc.cluster(pts, center_finder=dpc.Product(4), density_computer=name, graph_type="BruteForce").clusters.count() == pts.count()
    for wrong in ({"method": "BruteForce"}, {"graph_type": "vamana"}, {"density_computer": "none"}):
        with pytest.raises(ValueError):
            dpc.cluster(pts, **wrong)
    with pytest.raises(NotImplementedError):
        dpc.cluster(pts, method="BlindProbe")


def test_hooks_and_legacy(blobs):
    pts, _ = blobs
    found = dpc.cluster(pts, center_finder=dpc.Product(4), graph_type="BruteForce", noise_finder=lambda g: g.filter("id = 3").select("id"), merger=lambda labels, g: labels)
    got, dep = by_id(found.clusters, "cluster"), by_id(found.graph, "dep")
    assert got[3] == max(i for i in got if got[i] == got[3]) and got[3] != got[dep[3]]  # noise keeps what hangs on it and follows nobody
    assert dpc.legacy_cluster(pts, 6, 0.0, 8.36, 0.0).clusters.select("cluster").distinct().count() == 4


def test_configurations(spark, blobs):
    made = dpc.configurations([8, 16], ["HCNNG"], [4], ["kth", "sum"])
    assert len(made) == 32 and made[0]["method"] == "HCNNG_8_1.1_8_8_8_kth_4"
    pts, truth = blobs
    ran = list(dpc.run_configurations(pts, made[:1], dpc.Product(4), truth, timeout=300))
    assert ran[0][2]["ARI"] > 0.9


def test_baselines(blobs, spark):
    from crestline.operators import baselines

    pts, truth = blobs
    assert metrics.evaluate(truth, baselines.kmeans(pts, 4, 10, 2), ("ARI",))["ARI"] > 0.9
    near = baselines.assign_to_centroids(pts, baselines.centroids(spark, [(0, [0.0, 0.0]), (1, [40.0, 0.0]), (2, [0.0, 40.0]), (3, [40.0, 40.0])]))
    assert metrics.evaluate(truth, near, ("ARI",))["ARI"] == 1.0
    assert nearest_centroid(pts, pts).filter("id <> nbr").count() == 0
    assert len(baselines.grid()) == 65 or all(r * i <= 100 for r, i in baselines.grid())


def test_legacy_search_beyond_the_broadcast_bound(blobs, monkeypatch):
    pts, truth = blobs
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    for kind in ("HCNNG", "Vamana"):
        found = dpc.legacy_cluster(pts, 6, 0.0, 8.36, 0.0, graph_type=kind, Lbuild=32, max_degree=16, L=32).clusters
        assert metrics.evaluate(truth, found, ("ARI",))["ARI"] > 0.95


def test_intermediate_tables_go(spark, monkeypatch, tmp_path):
    def names():
        return sorted(p.name for p in tmp_path.iterdir())

    with monkeypatch.context() as patch:
        patch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}")
        with session.Scratch() as run:
            kept, _ = run.put(spark.range(3)), keep(spark.range(4))
            with session.Scratch() as inner:
                deeper = inner.put(spark.range(5))
                inner.leave(deeper, deeper)
            assert deeper.count() == 5
            run.leave(kept, kept)
        assert kept.count() == 3 and len(names()) == 1
        with pytest.raises(ZeroDivisionError), session.Scratch() as run:
            run.leave(keep(spark.range(3)), inherited=True)
            1 / 0
        with pytest.raises(Exception, match="for this test"), session.Scratch() as run:
            run.put(spark.sql("SELECT raise_error('for this test') AS x"))
        assert len(names()) == 1


def test_shared_folder():
    from types import SimpleNamespace as Some

    made = lambda master, where: Some(conf=Some(get=lambda key, default: where), sparkContext=Some(master=master, applicationId="some"))
    assert session.shared_dir(made("spark://a:1", "hdfs://x/y/")) == "hdfs://x/y"
    assert session.shared_dir(made("local[2]", None)) == session.shared_dir(made("local", None)) != session.shared_dir(made("local", "/z"))
    for master in ("spark://a:1", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            session.shared_dir(made(master, None))
