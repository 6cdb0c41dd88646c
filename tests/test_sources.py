"""Sources, sinks and reports."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.plans import report
from crestline.sources import binary, generators, sinks, text


def test_text_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("1 2\r\n\n3;4\n 5,\t6 \n7 8")
    got = sorted(map(tuple, ((r.id, r.features) for r in text.vectors(spark, str(tmp_path / "v.txt")).collect())))
    assert got == [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0]), (3, [7.0, 8.0])]
    (tmp_path / "bad.txt").write_text("1 2\n3\n")
    with pytest.raises(ValueError):
        text.vectors(spark, str(tmp_path / "bad.txt"))


def test_row_numbers_follow_the_file_over_many_splits(spark, tmp_path):
    (tmp_path / "n.txt").write_text("".join(f"{i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = text.labels(spark, str(tmp_path / "n.txt"))
        assert rows.filter("id <> label").count() == 0 and rows.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_labels_and_decision_graph(spark, tmp_path):
    (tmp_path / "gt").write_bytes(b"3\r\n 4 \r\n5\r\n")
    assert [r.label for r in text.labels(spark, str(tmp_path / "gt")).orderBy("id").collect()] == [3, 4, 5]
    graph = spark.createDataFrame([(0, 0.1, 1 / 3, 1), (1, 2.5, None, None)], "id long, rho double, delta double, dep long")
    sinks.decision_graph(graph, str(tmp_path / "dg"), text=True)
    assert text.decision_graph(spark, str(tmp_path / "dg")).orderBy("id").collect() == graph.orderBy("id").collect()
    (tmp_path / "old").write_text("1.5 1.34078e+154 2\n2 0.5 0\n")
    assert [(r.dep, r.delta) for r in text.decision_graph(spark, str(tmp_path / "old")).orderBy("id").collect()] == [(None, None), (0, 0.5)]
    sinks.decision_graph(graph, str(tmp_path / "dgp"))
    assert spark.read.parquet(str(tmp_path / "dgp")).count() == 2


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([(i, i % 3) for i in range(100)], "id long, cluster long")
    sinks.clusters(found, str(tmp_path / "c"))
    sinks.clusters(found, "")
    assert [r.cluster for r in text.labels(spark, str(tmp_path / "c"), "cluster").orderBy("id").collect()] == [i % 3 for i in range(100)]
    sinks.values(found, "cluster", str(tmp_path / "v"))
    rows = spark.createDataFrame([("mnist", "Vamana_8_1.1_8_16_8_kth_4", 0.5)], "dataset string, method string, ARI double")
    sinks.append_results(rows, str(tmp_path / "r"))
    sinks.append_results(rows, str(tmp_path / "r"))
    assert text.results(spark, str(tmp_path / "r")).count() == 2
    both = text.results(spark, str(tmp_path / "r"), str(tmp_path / "r"))
    assert both.count() == 4 and both.columns == ["dataset", "method", "ARI"]
    sinks.vectors(spark.createDataFrame([(0, [1.0])], "id long, features array<double>"), str(tmp_path / "p"))


def test_binary(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float64).reshape(3, 2))
    assert [r.features for r in binary.npy(spark, str(tmp_path / "m.npy")).orderBy("id").collect()] == [[0, 1], [2, 3], [4, 5]]
    (tmp_path / "v.fvecs").write_bytes(struct.pack("<ii4f", 2, 2, 1, 2, 3, 4.5))
    assert [r.features for r in binary.header_matrix(spark, str(tmp_path / "v.fvecs")).orderBy("id").collect()] == [[1, 2], [3, 4.5]]
    (tmp_path / "v.ivecs").write_bytes(struct.pack("<ii2i", 1, 2, 7, 8))
    assert binary.header_matrix(spark, str(tmp_path / "v.ivecs"), "int32").first().features == [7, 8]


def test_label_first_and_key_values(spark):
    rows = spark.createDataFrame([("a,1,2.5",), ("b,x,3",)], "value string")
    assert [(r.label, r.features) for r in text.label_first(rows).collect()] == [("a", [1.0, 2.5]), ("b", [None, 3.0])]
    lines = spark.createDataFrame([("n=12",), ("t=1.5e3",), ("ok=True",), ("name=a=b",), ("no pair",), ("big=99999999999999999999",)], "value string")
    got = {r.key: (r.kind, r.as_long, r.as_double, r.as_boolean, r.text) for r in text.key_values(lines).collect()}
    assert got["n"][:3] == ("int", 12, 12.0) and got["t"][:3] == ("float", None, 1500.0) and got["ok"][3] is True and got["name"][::4] == ("str", "a=b")
    assert len(got) == 5


def test_generators(spark):
    made = generators.gaussian(spark, 3, 100)
    again = generators.gaussian(spark, 3, 100).repartition(5)
    assert sorted(map(str, made.collect())) == sorted(map(str, again.collect()))
    scaled = generators.scaling(spark, 2_000, 100, 4)
    assert scaled.count() == 2_000 and {r["count"] for r in scaled.groupBy("label").count().collect()} == {20}
    spread = generators.mixture(spark, [[5.0]], [4_000], 2.0).agg(F.avg(F.col("features")[0]), F.stddev(F.col("features")[0])).first()
    assert abs(spread[0] - 5) < 0.2 and abs(spread[1] - 2) < 0.1


@pytest.fixture(scope="module")
def runs(spark):
    rows = [("a", 1, 1.0, 0.2), ("a", 2, 2.0, 0.5), ("a", 4, 2.5, 0.4), ("a", 8, 4.0, 0.502), ("b", 1, 9.0, 0.1)]
    return spark.createDataFrame(rows, "dataset string, threads long, t double, acc double")


def test_fronts(runs):
    a = runs.filter("dataset = 'a'")
    front = report.pareto(a, "t", "acc")
    assert [r.t for r in front.orderBy("t").collect()] == [1.0, 2.0, 4.0]
    assert report.best_within(front, "t", "acc").first().t == 2.0
    assert [r.t for r in report.pareto(a, "t", "acc", smallest_x=False).collect()] == [4.0]
    assert report.pareto(runs, "t", "acc", by=["dataset"]).count() == 4


def test_fronts_over_many_ranges(spark):
    import random

    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.randint(0, 900) / 10, rng.randint(0, 10_000) + 100 * i % 977, i) for i in range(6_000)] + [("a", None, 5, 1), ("b", 1.0, None, 2)]
    df = spark.createDataFrame(rows, "g string, x double, y long, i long")
    for smallest in (True, False):
        want = set()
        for g in "ab":
            top = None
            for x in sorted({r[1] for r in rows if r[0] == g and r[1] is not None}, reverse=not smallest):
                y = max(r[2] for r in rows if r[0] == g and r[1] == x and r[2] is not None)
                if top is None or y > top:
                    want.add((g, x, y))
                    top = y
        got = report.pareto(df, "x", "y", smallest, ["g"])
        assert got.columns == df.columns and sorted((r.g, r.x, r.y) for r in got.collect()) == sorted(want)
        assert all((r.g, r.x, r.y, r.i) in rows for r in got.collect())
        best = {r.g: r.x for r in report.best_within(got, "x", "y", 500, ["g"]).collect()}
        assert best == {g: min(x for h, x, y in want if h == g and y > max(y for h, _, y in want if h == g) - 500) for g in "ab"}
    assert report.pareto(df.limit(0), "x", "y").count() == 0 and report.best_within(df.limit(0), "x", "y").count() == 0


def test_reports(spark, runs):
    got = {(r.dataset, r.threads): r.speedup for r in report.speedup(runs, "dataset", "threads", "t").collect()}
    assert got[("a", 8)] == 0.25 and got[("b", 1)] == 1.0
    line = spark.createDataFrame([(10.0 ** i, 3 * 100.0 ** i) for i in range(4)], "n double, s double")
    assert math.isclose(report.loglog_slope(line, "n", "s").first().slope, 2.0)
    fit = report.linear_regression(spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(10)] + [(None, 1.0)], "x double, y double"), ["x"], "y")
    assert math.isclose(fit["coefficients"][0], 2.0, rel_tol=1e-6) and math.isclose(fit["r2"], 1.0, rel_tol=1e-9)
    assert report.linear_regression(spark.createDataFrame([(float(i), float(i * i)) for i in range(10)], "x double, y double"), ["x"], "y", 2)["mae"] < 1e-6
    method = spark.createDataFrame([("Vamana_32_1.1_32_64_16_exp-sum_6",), ("kmeans_1_3",)], "method string")
    got = report.decode_method(method).collect()
    assert (got[0].graph, got[0].alpha, got[0].L, got[0].density, got[0].K) == ("Vamana", 1.1, 64, "exp-sum", 6)
    assert (got[1].L, got[1].K) == (None, 3)
    assert report.matching(method, "method", "^Vam").count() == 1
    shares = report.time_shares(runs, {"share": F.col("acc")}, F.col("t")).first()
    assert math.isclose(shares.share, 20.0)
    zero = spark.createDataFrame([(0.0, 1.0), (0.5, 0.0), (0.5, 0.5)], "homogeneity double, completeness double")
    assert report.without_zero_metrics(zero).count() == 1


def test_cluster_reports(spark):
    found = spark.createDataFrame([(0, 5), (1, 5), (2, 2), (3, 3)], "id long, cluster long")
    assert sorted((r.id, r.cluster) for r in report.singletons(found).collect()) == [(2, 2), (3, 3)]
    assert report.largest_clusters(found, 1).first().cluster == 5
    graph = spark.createDataFrame([(0, 1.0, None, None), (1, 2.0, 5.0, 0), (2, 3.0, 3.0, 0), (3, 4.0, 1.0, 0)], "id long, rho double, delta double, dep long")
    assert report.threshold_for(graph, 2).first().threshold == 4.0
    assert [r.id for r in report.top_by_product(graph, 2).collect()] == [1, 2]
    assert [r.id for r in report.top_by_delta(graph, 2).collect()] == [0, 1]
    assert sorted(map(tuple, report.value_histogram(spark.createDataFrame([(x,) for x in [0.0, 1.0, 5.0, 10.0, None]], "v double"), "v", 2).collect())) == [(1, 2), (2, 2)]
    names = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4)], "name string, at long")
    assert {r.at: r.code for r in report.encode(names, "name").collect()} == {4: 0, 2: 1, 1: 2, 3: 2}
    assert {r.at: r.code for r in report.encode(names, "name", "at").collect()} == {1: 0, 3: 0, 2: 1, 4: 2}
    assert report.most_frequent(names, "name", 1).first().name == "b"


def test_vectors_of_a_file_are_parsed_once(spark, tmp_path):
    (tmp_path / "points.txt").write_text("1 2\n\n ;,\t\n3,4\n")
    made = text.vectors(spark, str(tmp_path / "points.txt"))
    assert "FileScan text" not in made._jdf.queryExecution().toString()
    assert sorted(map(tuple, made.collect())) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
