"""Fixed data with fixed results."""

import pytest

from climekin import availability, impact, index_stats, intensity, search, velocity
from tests.golden import FOCAL, REF, rows

SCHEMA = "id int, x double, y double, c0 double, c1 double"
ID = {"focal_id": "id", "ref_id": "id", "coord_type": "projected"}


@pytest.fixture(scope="module", params=["grid", "cross"])
def data(spark, request):
    return spark.createDataFrame(rows(FOCAL), SCHEMA), spark.createDataFrame(rows(REF), SCHEMA), ID | {"plan": request.param}


def values(df):
    return [r["value"] for r in df.orderBy("focal_index").collect()]


def test_availability(data):
    f, r, o = data
    assert values(availability(f, r, 2, 2, **o)) == [5, 23, 23, 23, 25]


def test_count_per_variable(data):
    f, r, o = data
    assert values(availability(f, r, (0.5, 1.0), 2, **o)) == [0, 9, 4, 5, 4]


def test_intensity(data):
    f, r, o = data
    got = values(intensity(f, r, 2, 2, "inverse_clim", **o))
    assert got == pytest.approx([4.080915983, 30.392694354, 23.010552958, 21.202608468, 24.387133678], rel=1e-6)
    got = values(search(f, r, "sum", 2, 2, weight="inverse_geog", **o))
    assert got == pytest.approx([4.442613869, 20.432823594, 26.313076758, 18.364051790, 22.510519403], rel=1e-6)


def test_mean(data):
    f, r, o = data
    got = values(search(f, r, "mean", 2, 2, weight="inverse_clim", **o))
    assert got == pytest.approx([0.816183197, 1.321421494, 1.000458824, 0.921852542, 0.975485347], rel=1e-6)


def test_impact(data):
    f, r, o = data
    got = impact(f, r, 1, 1, **o).orderBy("focal_index").collect()
    assert [x["analog_index"] for x in got] == [16, 33, 31, 4, 13]
    assert [x["clim_dist"] for x in got] == pytest.approx([1.389428786, 0.222176564, 0.400939862, 0.283436457, 0.625857656], abs=1e-6)
    assert [x["geog_dist"] for x in got] == pytest.approx([0.881878223, 0.590597105, 0.915850033, 0.550570574, 0.861595990], abs=1e-6)


def test_velocity(data):
    f, r, o = data
    got = velocity(f, r, 1, 1, **o).orderBy("focal_index").collect()
    assert [x["analog_index"] for x in got] == [11, 33, 25, 4, 13]
    assert [x["geog_dist"] for x in got] == pytest.approx([1.297165078, 0.590597105, 0.371814184, 0.550570574, 0.861595990], abs=1e-6)


def test_all_and_knn(data):
    f, r, o = data
    assert search(f, r, "all", 2, 2, **o).count() == 99
    got = search(f, r, "knn_clim", 2, 2, 3, **o).orderBy("focal_index", "clim_dist").collect()
    assert [x["analog_index"] for x in got] == [11, 17, 16, 33, 15, 30, 31, 10, 36, 4, 34, 30, 50, 26, 13]


@pytest.mark.parametrize(("limits", "bins", "average", "most"), [((2, 2), 256, 0.1953125, 8), ((None, 1), 4356, 0.0114784206, 1), ((1, None), 4356, 0.0114784206, 2)])
def test_index_stats(spark, limits, bins, average, most):
    f, r = spark.createDataFrame(rows(FOCAL), SCHEMA), spark.createDataFrame(rows(REF), SCHEMA)
    got = index_stats(f, r, max_clim=limits[0], max_geog=limits[1], **ID).first()
    assert (got["total_bins"], got["max_bin_occupancy"], got["min_bin_occupancy"]) == (bins, most, 1)
    assert got["avg_bin_occupancy"] == pytest.approx(average)


def test_index_stats_without_thresholds(spark):
    f, r = spark.createDataFrame(rows(FOCAL), SCHEMA), spark.createDataFrame(rows(REF), SCHEMA)
    got = index_stats(f, r, **ID).first()
    assert (got["binning_method"], got["total_bins"], got["avg_bin_occupancy"]) == ("none", 1, 50)
