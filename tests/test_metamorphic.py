"""Relations between searches on random points."""

import numpy as np
import pandas as pd
import pytest

from climekin import search
from climekin.operators import search as engine
from climekin.plans.spec import SearchSpec
from climekin.sources.points import normalise

KEYS = ["focal_index", "analog_index"]


def table(seed, n, lonlat):
    r = np.random.default_rng(seed)
    x, y = (r.uniform(-180, 180, n), np.degrees(np.arcsin(r.uniform(-1, 1, n)))) if lonlat else (r.normal(0, 5, n), r.normal(0, 5, n))
    return pd.DataFrame({"x": x, "y": y, "a": np.round(r.normal(0, 1, n), 1), "b": r.normal(0, 1, n)})


def frame(df):
    return df.toPandas().sort_values(KEYS if "analog_index" in df.columns else ["focal_index"]).reset_index(drop=True)


@pytest.fixture(scope="module", params=[True, False], ids=["lonlat", "planar"])
def data(spark, request):
    lonlat = request.param
    return table(1, 40, lonlat), table(2, 300, lonlat), {"coord_type": "lonlat" if lonlat else "projected"}, 1500.0 if lonlat else 2.0


@pytest.mark.parametrize("limits", [(0.8, None), (None, 1), ((0.5, 0.7), None), (0.8, 1), ((0.0, 9.0), 1)])
def test_grid_equals_cross(data, limits):
    f, r, o, g = data
    for mode, k in (("all", None), ("count", None), ("knn_geog", 2)):
        a, b = (frame(search(f, r, mode, limits[0], limits[1] and g, k, plan=p, **o)) for p in ("grid", "cross"))
        pd.testing.assert_frame_equal(a, b)


def test_counts_agree(data):
    f, r, o, g = data
    every = frame(search(f, r, "all", 1.0, g, **o)).groupby("focal_index").size().reindex(range(1, 41), fill_value=0)
    count = frame(search(f, r, "count", 1.0, g, **o))["value"]
    assert count.tolist() == every.tolist()
    assert frame(search(f, r, "sum", 1.0, g, **o))["value"].tolist() == count.tolist()
    total = frame(search(f, r, "sum", 1.0, g, weight="inverse_clim", theta=0.1, **o))["value"]
    mean = frame(search(f, r, "mean", 1.0, g, weight="inverse_clim", theta=0.1, **o))["value"]
    assert mean.tolist() == pytest.approx((total / count.where(count > 0, 1)).tolist())


def test_nearest(data):
    f, r, o, g = data
    three, four, most = (frame(search(f, r, "knn_clim", None, g, k, **o)) for k in (3, 4, 1000))
    merged = three.merge(four, on=KEYS)
    assert len(merged) == len(three)
    assert len(most) == search(f, r, "all", None, g, **o).count()


def test_symmetry(data):
    f, r, o, g = data
    a = {(x["focal_index"], x["analog_index"]) for x in search(f, r, "all", 1.0, g, **o).collect()}
    b = {(x["analog_index"], x["focal_index"]) for x in search(r, f, "all", 1.0, g, **o).collect()}
    assert a == b


def test_shift(data):
    f, r, o, g = data
    move = 360.0 if o["coord_type"] == "lonlat" else 64.0
    a, b = frame(search(f, r, "all", 1.0, g, **o)), frame(search(f.assign(x=f.x + move), r.assign(x=r.x + move), "all", 1.0, g, **o))
    assert a[KEYS].values.tolist() == b[KEYS].values.tolist()


@pytest.mark.parametrize("k", [1, 3, 50])
def test_bounded_first(data, monkeypatch, k):
    f, r, o, _ = data
    spec = SearchSpec.make("knn_clim", 1.0, k=k, coord_type=o["coord_type"])
    a = frame(engine.run(normalise(f), normalise(r), spec))
    monkeypatch.setattr(engine, "BOUND_PRODUCT", 0)
    b = frame(engine.run(normalise(f), normalise(r), spec))
    pd.testing.assert_frame_equal(a, b)
