"""Searches whose work shall not grow with the product of their tables."""

import math
import os

import numpy as np
import pandas as pd
import pytest

from climekin import queries, search
from climekin.operators import candidates
from climekin.operators import search as engine

DATA = "/root/testdata/sf0.001"
O = {"focal_id": "id", "ref_id": "id"}


def joined(df):
    """Rows that the joins of a query gave."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        if "Join" in kind and node.metrics().contains("numOutputRows"):
            total += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def copies(spark, n, times, seed):
    """Places and climates of n points, again and again under other ids."""
    r = np.random.default_rng(seed)
    one = np.column_stack((r.uniform(-180, 180, n), r.uniform(-90, 90, n), r.uniform(0, 10, n), r.integers(0, 8, n) / 2.5))
    rows = pd.DataFrame(np.tile(one, (times, 1)), columns=["x", "y", "c0", "c1"])
    rows.insert(0, "id", range(1, len(rows) + 1))
    return spark.createDataFrame(rows)


def rows_of(df, digits=7):
    return sorted(tuple(None if v != v else round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_many_pairs_are_dealt_over_tasks(spark):
    """A small table of one file was one task, whatever the pairs that it makes."""
    f, r = copies(spark, 2500, 1, 1).coalesce(1), copies(spark, 25_000, 1, 2).coalesce(1)
    for options in ({"max_clim": 3.0}, {"max_geog": 9000.0}, {}):
        assert search(f, r, "all", coord_type="lonlat", **options, **O).rdd.getNumPartitions() >= 16, options


def test_both_thresholds_prune():
    stats = {s: {"n": n, "x": (-180.0, 180.0), "y": (-90.0, 90.0), "c0": (0.0, 10.0), "c1": (0.0, 10.0)} for s, n in (("focal", 60_000), ("ref", 900_000))}
    plan = candidates.choose(engine.SearchSpec.make("all", 1.0, 2000.0), True, stats, 2)
    assert set(plan.keys) == {"s0", "s1", "s2", "c0", "c1"}


@pytest.mark.parametrize("mode", ["count", "sum", "mean"])
def test_points_that_are_alike_are_merged(spark, mode):
    o = O | {"coord_type": "lonlat", "max_clim": (1.5, 0.4), "max_geog": 6000.0} | ({} if mode == "count" else {"weight": "inverse_geog"})
    seen = []
    for times in (10, 20):
        f, r = copies(spark, 150, times, 3), copies(spark, 200, times, 4)
        seen.append((joined(search(f, r, mode, **o)), f.count()))
    (a, m), (b, n) = seen
    assert n == 2 * m and b < 2.5 * a
    f, r = copies(spark, 30, 3, 3), copies(spark, 400, 3, 4)
    missing = spark.createDataFrame([(9001, 0.0, 0.0, None, 0.4), (9002, 0.0, float("nan"), 1.0, 0.4)], f.schema)
    for options in (o, o | {"max_geog": None, "weight": None, "max_clim": (1.5, math.inf)}):
        want = search(f.union(missing), r, mode, plan="cross", **options)
        with pytest.MonkeyPatch.context() as p:
            p.setattr(engine, "MERGE_PRODUCT", 0)
            got = search(f.union(missing), r, mode, **options)
            assert rows_of(got, 5) == rows_of(want, 5)


@pytest.mark.parametrize(("mode", "options"), [
    ("knn_geog", {"k": 3}), ("knn_geog", {"k": 4, "max_clim": (0.5, math.inf)}), ("knn_clim", {"k": 1}), ("knn_clim", {"k": 5, "max_clim": (3.0, 0.4), "max_geog": 9000.0}), ("knn_geog", {"k": 2, "max_clim": 0.0}),
])
@pytest.mark.parametrize("coords", ["lonlat", "projected"])
def test_nearest_by_radii(spark, monkeypatch, mode, options, coords):
    """Against the nested loop: ties of copies, points without enough matches, a point far from all."""
    f = copies(spark, 40, 2, 5).union(spark.createDataFrame([(8001, 170.0, 89.0, 500.0, 0.4), (8002, 0.0, 0.0, None, 0.4)], "id long, x double, y double, c0 double, c1 double"))
    r = copies(spark, 90, 3, 6).union(copies(spark, 40, 1, 5).selectExpr("id + 1000 AS id", "x", "y", "c0", "c1"))
    want = search(f, r, mode, coord_type=coords, plan="cross", **options, **O)
    for name in ("MERGE_PRODUCT", "RADIUS_PRODUCT"):
        monkeypatch.setattr(engine, name, 0)
    monkeypatch.setattr(candidates, "SMALL_PRODUCT", 0)
    assert rows_of(search(f, r, mode, coord_type=coords, **options, **O)) == rows_of(want)


def test_radii_settle_most_points(spark, monkeypatch):
    """The whole search is left with the few points that no radius settles."""
    left = []
    whole = engine._whole_nearest
    monkeypatch.setattr(engine, "RADIUS_PRODUCT", 0)
    monkeypatch.setattr(engine, "_whole_nearest", lambda f, *a: left.append(f.count()) or whole(f, *a))
    f, r = copies(spark, 300, 1, 7), copies(spark, 900, 1, 8)
    for options in ({"mode": "knn_geog", "k": 3}, {"mode": "knn_clim"}):
        assert search(f, r, coord_type="lonlat", **options, **O).count() == 300 * options.get("k", 1)
    assert sum(left) < 30


def test_hot_cell_of_both_sides_is_dealt(spark, monkeypatch):
    """Points of one cell on both sides: no task has all of their pairs."""
    monkeypatch.setattr(candidates, "SALT_ROWS", 20)
    monkeypatch.setattr(candidates, "SPREAD_PAIRS", 0)
    monkeypatch.setattr(candidates, "SMALL_PRODUCT", 0)
    r = np.random.default_rng(9)
    t = spark.createDataFrame(pd.DataFrame({"id": range(200), "x": r.uniform(0, 1, 200), "y": r.uniform(0, 1, 200), "c0": r.uniform(0, 1, 200)}))
    far = spark.createDataFrame([(900, 500.0, 500.0, 90.0)], t.schema)
    got = search(t.union(far), t.union(far), "all", 0.5, 0.6, coord_type="projected", plan="grid", **O)
    want = search(t.union(far), t.union(far), "all", 0.5, 0.6, coord_type="projected", plan="cross", **O)
    assert rows_of(got) == rows_of(want)
    sizes = got.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert max(sizes) < sum(sizes) / 3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["knn_pervar_ll", "knn_geog_unfiltered_ll", "knn_default_k", "knn_clim_unfiltered_xy", "velocity_xy", "availability_self", "availability_pervar_ll", "mean_invgeog_default_theta_ll"])
def test_large_plans_give_the_same(spark, monkeypatch, name):
    """The catalogue's queries by the paths of large tables."""
    want = rows_of(queries.QUERIES[name](spark, DATA), 5)
    for name_ in ("MERGE_PRODUCT", "RADIUS_PRODUCT"):
        monkeypatch.setattr(engine, name_, 0)
    monkeypatch.setattr(candidates, "SMALL_PRODUCT", 0)
    monkeypatch.setattr(candidates, "SPREAD_PAIRS", 0)
    got = rows_of(queries.QUERIES[name](spark, DATA), 5)
    assert len(got) == len(want) and all(a == pytest.approx(b, abs=2e-5) for a, b in zip(got, want))
