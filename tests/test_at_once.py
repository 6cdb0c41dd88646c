"""Points that fit the broadcast bound: dependent points and labels without joins equal those by joins."""

import numpy as np
import pytest

from crestline import session
from crestline.operators import assign, blocks, dependent
from crestline.operators.vectors import from_matrix
from crestline.plans import catalogue

rng = np.random.default_rng(11)

CASES = {
    "wide": rng.standard_normal((300, 20)),
    "twins": rng.integers(0, 3, (300, 2)).astype(float),
    "one place": np.ones((40, 17)),
    "infinite": np.where(rng.random((200, 3)) < 0.01, np.inf, rng.standard_normal((200, 3))),
    "alone": np.zeros((1, 3)),
}


def _refused(*_):
    raise AssertionError("joined")


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", CASES)
def test_points_that_fit_are_read_once_and_not_joined(spark, monkeypatch, name):
    with monkeypatch.context() as patch:
        patch.setattr(session, "BROADCAST_BYTES", 0)
        pts = from_matrix(spark, CASES[name])
        expected = [_rows(catalogue._graph(pts)), _rows(catalogue._labelled(pts, 5))]
    asked, whole = [], blocks.fits
    monkeypatch.setattr(blocks, "fits", lambda df: (asked.append(1), whole(df))[1])
    monkeypatch.setattr(dependent, "fits", _refused)
    monkeypatch.setattr(dependent, "in_lists", _refused)
    monkeypatch.setattr(assign, "roots", _refused)
    assert [_rows(catalogue._graph(pts)), _rows(catalogue._labelled(pts, 5))] == expected
    assert len(asked) == 1


def test_what_the_driver_cannot_follow_is_joined(spark):
    made = lambda rows: spark.createDataFrame(rows, "id long, rho double, dep long, delta double")
    center = spark.createDataFrame([(3,)], "id long")
    chain = [(1, 1.0, 2, 1.0), (2, 2.0, 3, 1.0), (3, 3.0, None, None), (7, 1.0, 3, 1.0)]
    assert _rows(assign.labels(made(chain), center)) == _rows(spark.createDataFrame([(i, 7) for i in (1, 2, 3, 7)], "id long, cluster long"))
    assert {tuple(r) for r in assign.densest_labels(made(chain), center).collect()} == {(i, 3) for i in (1, 2, 3, 7)}
    assert assign._at_once(made(chain + chain[:1]), center, None) is None  # an id twice
    assert assign._at_once(made([*chain, (8, 1.0, 9, 1.0)]), center, None) is None  # a link out of the graph
    with pytest.raises(ValueError, match="circle"):
        assign.labels(made([*chain, (8, 1.0, 9, 1.0), (9, 1.0, 8, 1.0)]), center)


def test_densities_of_other_points_are_joined(spark):
    pts = from_matrix(spark, rng.standard_normal((30, 3)))
    knn = catalogue._knn(pts)
    rho = pts.select("id", pts.id.cast("double").alias("rho"))
    assert dependent._at_once(pts, knn, rho) is not None
    for other in (rho.filter("id > 3"), rho.selectExpr("id + 1 AS id", "rho"), rho.selectExpr("id", "if(id = 2, NULL, rho) AS rho")):
        assert dependent._at_once(pts, knn, other) is None
    found = dependent.dependent_points(pts, knn, rho.filter("id < 20")).collect()
    assert {r.id for r in found} == set(range(20)) and all(r.dep is None or r.id < r.dep < 20 for r in found)
