"""Thresholds, ties, missing numbers, shapes, places on the globe."""

import math

import numpy as np
import pandas as pd
import pytest

from climekin import availability, search
from climekin.functions.metrics import euclid, euclid_arrays, haversine_km
from climekin.sources.points import number_rows
from pyspark.sql import functions as F

P = {"coord_type": "projected"}


def points(*rows):
    return pd.DataFrame(rows, columns=["x", "y", *[f"c{i}" for i in range(len(rows[0]) - 2)]])


def indices(df):
    return sorted((r["focal_index"], r["analog_index"]) for r in df.collect())


@pytest.mark.parametrize("plan", ["grid", "cross"])
def test_inclusive(spark, plan):
    f, r = points((0.0, 0.0, 0.0)), points((3.0, 0.0, 1.0))
    assert indices(search(f, r, "all", 1, 3, plan=plan, **P)) == [(1, 1)]
    assert indices(search(f, r, "all", 0.999, 3, plan=plan, **P)) == []
    assert indices(search(f, r, "all", 1, 2.999, plan=plan, **P)) == []


def test_ties_go_to_the_smaller_index(spark):
    r = points((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (-1.0, 0.0, 0.0), (0.0, -1.0, 0.0))
    assert indices(search(points((0.0, 0.0, 0.0)), r, "knn_geog", k=2, **P)) == [(1, 1), (1, 2)]


def test_nothing_within_limits(spark):
    f, r = points((0.0, 0.0, 0.0)), points((9.0, 0.0, 0.0))
    got = search(f, r, "all", 1, 1, **P)
    assert got.count() == 0 and got.columns[-2:] == ["clim_dist", "geog_dist"]
    for mode in ("count", "sum", "mean"):
        assert [x["value"] for x in search(f, r, mode, 1, 1, **P).collect()] == [0.0]


@pytest.mark.parametrize("mode", ["all", "knn_clim", "knn_geog", "count", "sum", "mean"])
def test_one_row_one_variable(spark, mode):
    one = points((1.0, 2.0, 3.0))
    assert search(one, one, mode).count() == 1


@pytest.mark.parametrize("plan", ["grid", "cross", None])
def test_zero_and_negative(spark, plan):
    f, r = points((0.0, 0.0, -0.0)), points((0.0, -0.0, 0.0), (0.0, 1e-12, 0.0), (0.0, 0.0, 1e-12))
    assert indices(search(f, r, "all", max_clim=0, plan=plan, **P)) == [(1, 1), (1, 2)]
    assert indices(search(f, r, "all", max_geog=0, plan=plan, **P)) == [(1, 1), (1, 3)]
    assert indices(search(f, r, "all", max_geog=0, coord_type="lonlat", plan=plan)) == [(1, 1), (1, 3)]
    assert indices(search(f, r, "all", max_clim=-1, plan=plan, **P)) == []
    assert [x["value"] for x in availability(f, r, None, -1, plan=plan, **P).collect()] == [0.0]
    g = points((0.0, 0.0, 0.0, 5.0))
    assert indices(search(g, g, "all", max_clim=(0, -1), plan=plan, **P)) == []


def test_infinite_and_missing_thresholds(spark):
    f, r = points((0.0, 0.0, 0.0, 0.0)), points((50.0, 0.0, 0.4, 99.0), (0.0, 0.0, 0.6, 0.0))
    assert indices(search(f, r, "all", (0.5, math.inf), math.inf, **P)) == [(1, 1)]
    assert indices(search(f, r, "all", (0.5, math.nan), math.nan, **P)) == [(1, 1)]
    assert len(indices(search(f, r, "all", [], [], **P))) == 2


@pytest.mark.parametrize("plan", ["grid", "cross"])
def test_missing_numbers(spark, plan):
    rows = [(1, 0.0, 0.0, 0.0), (2, float("nan"), 0.0, 0.0), (3, 0.0, None, 0.0), (4, 0.0, 0.0, float("nan")), (5, 0.0, 0.0, None)]
    t = spark.createDataFrame(rows, "id int, x double, y double, c0 double")
    o = P | {"focal_id": "id", "ref_id": "id", "plan": plan}
    assert indices(search(t, t, "all", 1, 1, **o)) == [(1, 1)]
    assert [x["value"] for x in availability(t, t, 1, 1, **o).orderBy("focal_index").collect()] == [1, 0, 0, 0, 0]


@pytest.mark.parametrize(("a", "b"), [((179.95, 0.0), (-179.95, 0.0)), ((0.0, 89.95), (180.0, 89.95)), ((359.95, 0.0), (0.05, 0.0))])
@pytest.mark.parametrize("plan", ["grid", "cross"])
def test_around_the_globe(spark, a, b, plan):
    got = search(points((*a, 0.0)), points((*b, 0.0)), "all", max_geog=20, coord_type="lonlat", plan=plan).collect()
    assert [x["geog_dist"] for x in got] == pytest.approx([11.119508], abs=1e-5)


def test_more_neighbours_than_points(spark):
    r = points((3.0, 0.0, 0.0), (1.0, 0.0, 0.0), (2.0, 0.0, 0.0))
    got = search(points((0.0, 0.0, 0.0)), r, "knn_geog", k=10, **P).orderBy("geog_dist").collect()
    assert [x["analog_index"] for x in got] == [2, 3, 1]


def test_names_of_coordinates(spark):
    named = pd.DataFrame({"t": [1.0], "y": [2.0], "p": [3.0], "x": [4.0]})
    got = search(named, named, "count", **P).first()
    assert (got["focal_x"], got["focal_y"]) == (4.0, 2.0)
    got = search(np.array([[7.0, 8.0, 9.0]]), np.array([[7.0, 8.0, 9.0]]), "count", **P).first()
    assert (got["focal_x"], got["focal_y"]) == (7.0, 8.0)


def test_types_are_cast(spark):
    t = spark.createDataFrame([(1, 1, 2, 3.0)], "id long, x int, y short, c0 float")
    got = search(t, t, "all", focal_id="id", ref_id="id", **P)
    assert dict(got.dtypes)["focal_x"] == "double" and got.count() == 1


def test_empty_tables(spark):
    some, none = points((0.0, 0.0, 0.0)), spark.createDataFrame([], "id int, x double, y double, c0 double")
    assert search(some, none, "all", 1, 1, ref_id="id").count() == 0
    assert [r["value"] for r in availability(some, none, 1, 1, ref_id="id").collect()] == [0.0]
    assert search(none, some, "count", 1, 1, focal_id="id").count() == 0


def test_coordinates_are_detected(spark):
    small, big = points((0.0, 0.0, 0.0)), points((200.0, 0.0, 0.0))
    near = points((0.0, 1.0, 0.0))
    assert search(small, near, "all").first()["geog_dist"] == pytest.approx(111.195, rel=1e-4)
    assert search(small, big, "all").first()["geog_dist"] == 200.0


def test_report_dist(spark):
    t = points((0.0, 0.0, 0.0))
    assert len(search(t, t, "all", report_dist=False).columns) == 6


def test_row_numbers(spark):
    df = number_rows(spark.range(0, 1000, 1, 7), "n")
    assert df.where("n <> id + 1").count() == 0


def test_metrics(spark):
    one = spark.range(1)
    assert one.select(euclid([F.lit(0.0), F.lit(0.0)], [F.lit(3.0), F.lit(4.0)])).first()[0] == 5
    assert one.select(euclid_arrays(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0)))).first()[0] == 5
    for lon, lat in ((0.0, 1.0), (1.0, 0.0)):
        assert one.select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(lon), F.lit(lat))).first()[0] == pytest.approx(111.195, rel=1e-3)
    with pytest.raises(ValueError):
        euclid([F.lit(1.0)], [F.lit(1.0), F.lit(2.0)])
    with pytest.raises(Exception):
        one.select(euclid_arrays(F.array(F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0)))).collect()


@pytest.mark.parametrize("options", [{"max_clim": 0.5}, {}])
def test_null_and_repeated_ids_at_every_size(spark, monkeypatch, options):
    """Every focal row is a point of its own, below and above the product from which distances are bounded first."""
    from climekin.operators import search as operator

    focal = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (None, 5.0, 0.0, 0.0), (None, 3.0, 0.0, 0.0), (1, 7.0, 0.0, 0.0)], "id int, x double, y double, c0 double")
    ref = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(1, 9)], "id int, x double, y double, c0 double")
    o = P | {"focal_id": "id", "ref_id": "id"}
    for bound in (1_000_000, 1):
        monkeypatch.setattr(operator, "BOUND_PRODUCT", bound)
        out = search(focal, ref, "knn_geog", k=1, **options, **o).collect()
        assert sorted((x["focal_index"] or 0, x["analog_index"]) for x in out) == [(0, 3), (0, 5), (1, 1), (1, 7)]
    counts = availability(focal, ref, max_geog=1.5, **o).collect()
    assert sorted((x["focal_index"] or 0, x["focal_x"], x["value"]) for x in counts) == [(0, 3.0, 3.0), (0, 5.0, 3.0), (1, 0.0, 1.0), (1, 7.0, 3.0)]


@pytest.mark.parametrize(("mode", "coords"), [("knn_geog", "projected"), ("knn_geog", "lonlat"), ("knn_clim", "projected")])
def test_boxes_find_the_nearest(spark, monkeypatch, mode, coords):
    """Against brute force: dense and empty places, ties, a hot place that is dealt over tasks."""
    from climekin.operators import boxes

    monkeypatch.setattr(boxes, "SALT_ROWS", 50)
    r = np.random.default_rng(3)
    ref = pd.DataFrame(np.vstack((r.normal(0, 3, (400, 5)), np.tile([1.0, 1.0, 0.5, 0.5, 0.5], (150, 1)), r.uniform(-80, 80, (100, 5)))), columns=["x", "y", "c0", "c1", "c2"])
    focal = pd.DataFrame(np.vstack((r.normal(0, 3, (40, 5)), r.uniform(-85, 85, (40, 5)), [[1.0, 1.0, 0.5, 0.5, 0.5]])), columns=ref.columns)
    for k in (1, 7):
        a, b = (sorted((x["focal_index"], x["analog_index"]) for x in search(focal, ref, mode, k=k, coord_type=coords, plan=p).collect()) for p in (None, "cross"))
        assert a == b and len(a) == k * len(focal)


def test_hot_cells_are_dealt(spark, monkeypatch):
    """Neither side is broadcast, and a third of the points lies in one cell."""
    from climekin.operators import candidates

    r = np.random.default_rng(4)
    ref = pd.DataFrame(np.vstack((r.normal(0, 3, (200, 4)), np.tile([1.0, 1.0, 0.5, 0.5], (100, 1)))), columns=["x", "y", "c0", "c1"])
    focal = ref.iloc[::3].reset_index(drop=True)
    want = indices(search(focal, ref, "all", 0.7, 1.0, plan="cross", **P))
    monkeypatch.setattr(candidates, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(candidates, "SALT_ROWS", 10)
    monkeypatch.setattr(candidates, "SMALL_PRODUCT", 0)
    for f, g in ((focal, ref), (ref, focal)):
        got = indices(search(f, g, "all", 0.7, 1.0, plan="grid", **P))
        assert got == (want if f is focal else sorted((b, a) for a, b in want)) and len(got) > 100
