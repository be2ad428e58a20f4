"""Catalogue of queries on the driver's tables, each with its SQL.

The SQL states the plain definition (every pair, then the filter), so that
it is independent of how candidates are made here.  Outputs are rounded to
six places in both; ranks are taken on unrounded distances.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climekin import api
from climekin.functions.metrics import euclid, euclid_arrays, haversine_km
from climekin.sources.points import extent, looks_lonlat, normalise
from climekin.sources.synthetic import grid, layers, raster_cells, sample
from climekin.streaming.focals import search_stream_once


def _place(spark: SparkSession, sf_dir: str, table: str, p: str) -> DataFrame:
    """Suppliers or customers spread over the globe, with two climate variables."""
    k = F.col(f"{p}_{'suppkey' if p == 's' else 'custkey'}")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(
        (k + 1).cast("int").alias("id"),
        ((k * 7919) % 36000 / 100.0 - 180.0).alias("x"),
        ((k * 104729) % 18000 / 100.0 - 90.0).alias("y"),
        (F.col(f"{p}_acctbal").cast("double") / 1000.0).alias("c0"),
        (F.col(f"{p}_nationkey").cast("double") / 2.5).alias("c1"),
    )


def _ll(spark, sf_dir):
    return _place(spark, sf_dir, "supplier", "s"), _place(spark, sf_dir, "customer", "c")


def _self(spark, sf_dir):
    s = _place(spark, sf_dir, "supplier", "s")
    return s, s


def _vectors(spark, sf_dir, scale: float = 1.0) -> DataFrame:
    v = [(F.element_at("embedding", i + 1).cast("double") * 10.0 * (scale if i < 2 else 1.0)).alias(n) for i, n in enumerate(["x", "y", "c0", "c1", "c2"])]
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") + 1).cast("int").alias("id"), *v)


def _xy(spark, sf_dir, scale: float = 1.0):
    """Every vector against all of them."""
    v = _vectors(spark, sf_dir, scale)
    return v, v


def _grid(spark, sf_dir):
    """Two eras of a synthetic raster; its size follows the supplier table."""
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    side = max(20, int(math.sqrt(40 * n)))
    return grid(spark, side, 1), grid(spark, side, 2)


_TABLES = {"ll": (_ll, 2, True), "xy": (_xy, 3, False), "self": (_self, 2, True)}


def _sql_place(table: str, p: str, key: str) -> str:
    return (
        f"SELECT CAST({key} + 1 AS INTEGER) AS id, (({key} * 7919) % 36000) / 100.0e0 - 180.0e0 AS x, (({key} * 104729) % 18000) / 100.0e0 - 90.0e0 AS y, "
        f"CAST({p}_acctbal AS DOUBLE) / 1000.0e0 AS c0, CAST({p}_nationkey AS DOUBLE) / 2.5e0 AS c1 FROM {table}"
    )


_SUPPLIER, _CUSTOMER = _sql_place("supplier", "s", "s_suppkey"), _sql_place("customer", "c", "c_custkey")
_VECTORS = "SELECT CAST(vec_id + 1 AS INTEGER) AS id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * 10.0e0 AS {n}" for i, n in enumerate(["x", "y", "c0", "c1", "c2"])) + " FROM embeddings"
_SOURCES = {"ll": (_SUPPLIER, _CUSTOMER), "self": (_SUPPLIER, _SUPPLIER), "xy": (_VECTORS, _VECTORS)}
_HAVERSINE = (
    "2.0e0 * 6371.0088e0 * asin(sqrt(least(1.0e0, sin(radians(r.y - f.y) / 2) * sin(radians(r.y - f.y) / 2) + "
    "cos(radians(f.y)) * cos(radians(r.y)) * sin(radians(r.x - f.x) / 2) * sin(radians(r.x - f.x) / 2))))"
)
_PLANAR = "sqrt((f.x - r.x) * (f.x - r.x) + (f.y - r.y) * (f.y - r.y))"


def _sql(tables: str, mode: str, max_clim=None, max_geog=None, k=None, weight=None, theta=None, report_dist=True) -> str:
    _, variables, lonlat = _TABLES[tables]
    focal, ref = _SOURCES[tables]
    clim = "sqrt(" + " + ".join(f"(f.c{i} - r.c{i}) * (f.c{i} - r.c{i})" for i in range(variables)) + ")"
    tests = ["true"]
    if isinstance(max_clim, tuple):
        tests += [f"abs(f.c{i} - r.c{i}) <= {t!r}" for i, t in enumerate(max_clim) if t != math.inf]
    elif max_clim is not None:
        tests.append(f"{clim} <= {float(max_clim)!r}")
    if max_geog is not None:
        tests.append(f"{_HAVERSINE if lonlat else _PLANAR} <= {float(max_geog)!r}")
    head = (
        f"WITH f AS ({focal}), r AS ({ref}), p AS (SELECT f.id AS focal_index, f.x AS focal_x, f.y AS focal_y, r.id AS analog_index, r.x AS analog_x, r.y AS analog_y, "
        f"{clim} AS clim, {_HAVERSINE if lonlat else _PLANAR} AS geog FROM f, r WHERE {' AND '.join(tests)}) "
    )
    dist = ", round(clim, 6) AS clim_dist, round(geog, 6) AS geog_dist" if report_dist else ""
    cols = f"focal_index, round(focal_x, 6) AS focal_x, round(focal_y, 6) AS focal_y, analog_index, round(analog_x, 6) AS analog_x, round(analog_y, 6) AS analog_y{dist}"
    if mode == "all":
        return head + f"SELECT {cols} FROM p"
    if mode.startswith("knn"):
        key = "clim" if mode == "knn_clim" else "geog"
        return head + f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY focal_index ORDER BY {key}, analog_index) AS n FROM p) WHERE n <= {k or 1}"
    # The fixed defaults of theta.
    w = {"inverse_clim": f"1.0e0 / (clim + {theta or 1e-12!r})", "inverse_geog": f"1.0e0 / (geog + {theta or 1e-6!r})"}.get(weight, "1.0e0")
    value = {"count": "CAST(count(focal_index) AS DOUBLE)", "sum": f"sum({w})", "mean": f"avg({w})"}[mode]
    return head + (
        f"SELECT f.id AS focal_index, round(f.x, 6) AS focal_x, round(f.y, 6) AS focal_y, round(coalesce(a.value, 0.0e0), 6) AS value "
        f"FROM f LEFT JOIN (SELECT focal_index, {value} AS value FROM p GROUP BY focal_index) a ON f.id = a.focal_index"
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _query(tables: str, mode: str, **options) -> Callable:
    make, _, lonlat = _TABLES[tables]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        focal, ref = make(spark, sf_dir)
        return _rounded(api.search(focal, ref, mode, coord_type="auto" if lonlat else "projected", focal_id="id", ref_id="id", **options))

    return run


_INF = math.inf
#: name -> (tables, mode, options)
CATALOGUE = {
    "velocity_ll": ("ll", "knn_geog", {"max_clim": 0.5, "k": 1}),
    "velocity_ll_k5": ("ll", "knn_geog", {"max_clim": 1.0, "max_geog": 5000.0, "k": 5}),
    "velocity_xy": ("xy", "knn_geog", {"max_clim": 1.5, "k": 1}),
    "impact_ll": ("ll", "knn_clim", {"max_geog": 2000.0, "k": 20}),
    "impact_xy": ("xy", "knn_clim", {"max_geog": 1.0, "k": 20}),
    "knn_clim_unfiltered_xy": ("xy", "knn_clim", {"k": 3}),
    "knn_geog_unfiltered_ll": ("ll", "knn_geog", {"k": 3}),
    "knn_default_k": ("ll", "knn_clim", {}),
    "all_ll": ("ll", "all", {"max_clim": 1.0, "max_geog": 2000.0}),
    "all_xy": ("xy", "all", {"max_clim": 1.5, "max_geog": 2.0}),
    "all_xy_nodist": ("xy", "all", {"max_clim": 1.5, "max_geog": 2.0, "report_dist": False}),
    "all_xy_zero_clim": ("xy", "all", {"max_clim": 0.0}),
    "availability_ll": ("ll", "count", {"max_clim": 1.0, "max_geog": 2000.0}),
    "availability_xy": ("xy", "count", {"max_clim": 1.0, "max_geog": 1.0}),
    "availability_self": ("self", "count", {"max_clim": 1.0, "max_geog": 2000.0}),
    "availability_pervar_ll": ("ll", "count", {"max_clim": (0.5, 0.4)}),
    "intensity_uniform_pervar_xy": ("xy", "sum", {"max_clim": (1.0, 0.5, 2.0), "weight": "uniform"}),
    "intensity_invclim_ll": ("ll", "sum", {"max_clim": 1.0, "max_geog": 2000.0, "weight": "inverse_clim", "theta": 0.1}),
    "intensity_invclim_xy": ("xy", "sum", {"max_clim": 1.5, "max_geog": 2.0, "weight": "inverse_clim", "theta": 0.1}),
    "intensity_invgeog_ll": ("ll", "sum", {"max_clim": 1.0, "max_geog": 2000.0, "weight": "inverse_geog", "theta": 1.0}),
    "mean_uniform_ll": ("ll", "mean", {"max_clim": 1.0, "max_geog": 2000.0}),
    "mean_invgeog_ll": ("ll", "mean", {"max_clim": 1.0, "max_geog": 2000.0, "weight": "inverse_geog", "theta": 1.0}),
    "mean_invgeog_xy": ("xy", "mean", {"max_clim": 1.5, "max_geog": 2.0, "weight": "inverse_geog", "theta": 0.1}),
    "pervar_partial_ll": ("ll", "count", {"max_clim": (0.5, _INF)}),
    "antimeridian_ll": ("ll", "all", {"max_geog": 100.0}),
    "intensity_default_theta_ll": ("ll", "sum", {"max_clim": 1.0, "max_geog": 2000.0, "weight": "inverse_clim"}),
    "mean_invclim_ll": ("ll", "mean", {"max_clim": 1.0, "max_geog": 2000.0, "weight": "inverse_clim", "theta": 0.1}),
    "mean_invgeog_default_theta_ll": ("ll", "mean", {"max_clim": (0.5, 0.3), "weight": "inverse_geog"}),
    "all_pervar_ll": ("ll", "all", {"max_clim": (0.5, 0.3), "max_geog": 4000.0}),
    "knn_pervar_ll": ("ll", "knn_geog", {"max_clim": (0.5, _INF), "k": 4}),
    "impact_pervar_xy": ("xy", "knn_clim", {"max_clim": (1.0, 0.5, 2.0), "max_geog": 3.0, "k": 3}),
    "nothing_matches_ll": ("ll", "all", {"max_clim": -1.0}),
}


def coord_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, (f, r) in (("ll", _ll(spark, sf_dir)), ("xy", _xy(spark, sf_dir)), ("xy_1000", _xy(spark, sf_dir, 1000.0))):
        rows.append((name, "lonlat" if looks_lonlat(extent(normalise(f, "id"), normalise(r, "id"))) else "projected"))
    return spark.createDataFrame(rows, "tables string, coord_type string")


def _side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, r = _ll(spark, sf_dir)
    return f.select(*[F.col(c).alias(f"f_{c}") for c in f.columns]).join(r.select(*[F.col(c).alias(f"r_{c}") for c in r.columns]), F.col("f_id") == F.col("r_id"))


def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The longitude is shifted by the climate variable, as places of equal keys coincide.
    d = haversine_km(F.col("f_x"), F.col("f_y"), F.col("r_x") + F.col("r_c0"), F.col("r_y"))
    return _rounded(_side_by_side(spark, sf_dir).select(F.col("f_id").alias("id"), d.alias("km")))


def euclid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = euclid([F.col(f"f_{c}") for c in ("c0", "c1")], [F.col(f"r_{c}") for c in ("c0", "c1")])
    return _rounded(_side_by_side(spark, sf_dir).select(F.col("f_id").alias("id"), d.alias("distance")))


def _index_stats(**options) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f, r = _ll(spark, sf_dir)
        out = api.index_stats(f, r, focal_id="id", ref_id="id", **options)
        limits = F.concat_ws(";", F.transform(F.coalesce("max_clim", F.array().cast("array<double>")), lambda t: t.cast("string"))).alias("max_clim")
        return _rounded(out.select("n_focal", "n_ref", "n_clim", "max_geog", limits, "geo_mode", "binning_method", "total_bins", "avg_bin_occupancy", "min_bin_occupancy", "max_bin_occupancy", "mode", "weight", "theta"))

    return run


def _index_sql(max_clim=None, max_geog=None, mode="knn_clim", weight=None, theta=None) -> str:
    head = f"WITH f AS ({_SUPPLIER}), r AS ({_CUSTOMER})"
    counts = "(SELECT count(*) FROM f) AS n_focal, (SELECT count(*) FROM r) AS n_ref, CAST(2 AS INTEGER) AS n_clim, 'lonlat' AS geo_mode, "
    counts += f"CAST({'NULL' if max_geog is None else repr(max_geog)} AS DOUBLE) AS max_geog, '{'' if max_clim is None else max_clim}' AS max_clim, '{mode}' AS mode, "
    counts += f"CAST({'NULL' if weight is None else repr(weight)} AS VARCHAR) AS weight, CAST({'NULL' if theta is None else repr(theta)} AS DOUBLE) AS theta"
    if max_clim is None and max_geog is None:
        n = "(SELECT CAST(count(*) AS DOUBLE) FROM r)"
        return f"{head} SELECT {counts}, 'none' AS binning_method, 1.0e0 AS total_bins, {n} AS avg_bin_occupancy, {n} AS min_bin_occupancy, {n} AS max_bin_occupancy"
    dims = [("x", max_geog), ("y", max_geog), ("c0", max_clim), ("c1", max_clim)]
    widths = ", ".join(f"{t!r} AS w_{c}" if t else f"(max({c}) - min({c})) / 10 AS w_{c}" for c, t in dims)
    spans = ", ".join(f"min({c}) AS lo_{c}, max({c}) - min({c}) AS span_{c}" for c, _ in dims)
    number = " * ".join(f"(ceil(span_{c} / w_{c}) + 1)" for c, _ in dims)
    bins = ", ".join(f"floor((r.{c} - lo_{c}) / w_{c}) AS b_{c}" for c, _ in dims)
    return (
        f"{head}, e AS (SELECT {spans}, {widths} FROM r), b AS (SELECT {bins} FROM r, e), "
        f"o AS (SELECT count(*) AS n FROM b GROUP BY {', '.join(f'b_{c}' for c, _ in dims)}) "
        f"SELECT {counts}, 'lattice' AS binning_method, CAST({number} AS DOUBLE) AS total_bins, round((SELECT count(*) FROM r) / ({number}), 6) AS avg_bin_occupancy, "
        f"(SELECT CAST(min(n) AS DOUBLE) FROM o) AS min_bin_occupancy, (SELECT CAST(max(n) AS DOUBLE) FROM o) AS max_bin_occupancy FROM e"
    )


def velocity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The harness query: all cells of one era against all cells of the next."""
    a, b = _grid(spark, sf_dir)
    return _rounded(api.velocity(a, b, 0.5, coord_type="projected", focal_id="id", ref_id="id"))


def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of tables without ids, which are numbered in their order: here the suppliers', whose keys ascend."""
    f = _place(spark, sf_dir, "supplier", "s").orderBy("id").coalesce(1).drop("id")
    return _rounded(api.search(f, f, "all", 1.0, 2000.0, coord_type="lonlat"))


def euclid_of_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each vector from itself turned round, over whole arrays."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return _rounded(v.select("vec_id", euclid_arrays(F.col("v"), F.reverse("v")).alias("distance")))


def _long_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a raster in long form: a row for each place and layer; place and layers follow the key."""
    k = F.col("c_custkey").cast("long")
    cells = spark.read.parquet(f"{sf_dir}/customer.parquet").select((k % 40 + 0.5).alias("x"), (F.floor(k / 40) + 0.5).alias("y"), F.col("c_acctbal").cast("double").alias("a"), (F.col("c_nationkey") + 1).cast("double").alias("b"), k.alias("k"))
    layers_ = F.array(F.struct(F.lit("a").alias("layer"), F.col("a").alias("value")), F.struct(F.lit("b").alias("layer"), F.when(F.col("k") % 7 != 0, F.col("b")).alias("value")), F.struct(F.lit("d").alias("layer"), (F.col("b") + 2).alias("value")))
    return cells.withColumn("l", F.explode(layers_)).select("x", "y", "l.layer", "l.value")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster_cells(_long_raster(spark, sf_dir), names=["a", "b", "d"]))


def raster_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster_cells(_long_raster(spark, sf_dir), names=["a", "b", "d"])
    return _rounded(layers(cells, {"mean": ["b", "d"], "logged": ["d"]}, ["logged"], (5.0, 30.0, 0.0, 1e9)).drop("a"))


def grid_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: its size, and that its cells are different ones of the grid."""
    a, _ = _grid(spark, sf_dir)
    s = sample(a, 100)
    return s.join(a.select("id"), "id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))


#: What a search's arguments may be: (case, arguments, whether they are refused).
_ARGUMENTS = [
    ("mode unknown", {"mode": "nearest"}, True),
    ("coordinates unknown", {"coord_type": "polar"}, True),
    ("k below one", {"k": 0}, True),
    ("k of two values", {"k": [1, 2]}, True),
    ("k missing", {"k": math.nan}, True),
    ("k fractional", {"k": 2.9}, False),
    ("k default", {}, False),
    ("k for a count", {"mode": "count", "k": 3}, True),
    ("weight for neighbours", {"weight": "uniform"}, True),
    ("weight for a count", {"mode": "count", "weight": "uniform"}, True),
    ("weight unknown", {"mode": "sum", "weight": "heavy"}, True),
    ("weight default", {"mode": "mean"}, False),
    ("theta for uniform weights", {"mode": "sum", "weight": "uniform", "theta": 1.0}, True),
    ("theta of zero", {"mode": "sum", "weight": "inverse_clim", "theta": 0.0}, True),
    ("theta for neighbours", {"theta": 1.0}, True),
    ("threshold infinite", {"max_geog": math.inf}, False),
    ("threshold negative", {"max_clim": -1.0}, False),
    ("threads ignored", {"n_threads": 3}, False),
    ("bands of another number", {"max_clim": (1.0, 1.0, 1.0)}, True),
    ("variables of another number", {"variables": 1}, True),
]


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each rule refuses its arguments, on the driver's tables."""
    f, r = _ll(spark, sf_dir)
    rows = []
    for name, options, _ in _ARGUMENTS:
        options = dict(options)
        focal = f.drop("c1") if options.pop("variables", None) else f
        try:
            api.search(focal, r, focal_id="id", ref_id="id", **options)
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "argument string, refused boolean")


def stream_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """availability_ll with the focal points arriving as a stream."""
    return _rounded(search_stream_once(spark, *_ll(spark, sf_dir), mode="count", max_clim=1.0, max_geog=2000.0, coord_type="lonlat"))


QUERIES: dict[str, Callable] = {n: _query(t, m, **o) for n, (t, m, o) in CATALOGUE.items()}
QUERIES |= {
    "coord_detect": coord_detect,
    "haversine_pairs": haversine_pairs,
    "euclid_pairs": euclid_pairs,
    "index_stats_ll": _index_stats(max_clim=1.0, max_geog=2000.0),
    "index_stats_weighted": _index_stats(mode="sum", max_clim=1.0, max_geog=2000.0, weight="inverse_geog", theta=0.5),
    "index_stats_ll_clim": _index_stats(max_clim=0.5),
    "index_stats_none": _index_stats(),
    "velocity_grid": velocity_grid,
    "row_numbers": row_numbers,
    "euclid_arrays": euclid_of_arrays,
    "raster_cells": raster,
    "raster_layers": raster_layers,
    "grid_sample": grid_sample,
    "validation": validation,
    "stream_availability": stream_availability,
}

ORACLE_SQL: dict[str, str] = {n: _sql(t, m, **o) for n, (t, m, o) in CATALOGUE.items()}
_JOINED = f"FROM ({_SUPPLIER}) f JOIN ({_CUSTOMER}) r ON f.id = r.id"
_CELLS = (
    "SELECT CAST(row_number() OVER (ORDER BY y DESC, x) AS INTEGER) AS id, * FROM (SELECT (c_custkey % 40) + 0.5e0 AS x, (c_custkey // 40) + 0.5e0 AS y, CAST(c_acctbal AS DOUBLE) AS a, "
    "CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey + 1.0e0 END AS b, c_nationkey + 3.0e0 AS d FROM customer)"
)
_GRID = (
    "WITH s AS (SELECT greatest(20, CAST(floor(sqrt(40 * (SELECT count(*) FROM supplier))) AS BIGINT)) AS d), "
    "n AS (SELECT unnest(range(d * d)) AS i, d FROM s), "
    "g AS (SELECT CAST(i + 1 AS INTEGER) AS id, (i % d) + 0.5e0 AS x, d - (i // d + 1) + 0.5e0 AS y, sin((i % d + 1) / 40.0e0) + cos((i // d + 1) / 20.0e0) AS t, CAST(i // d + 1 AS DOUBLE) AS p FROM n), "
    "m AS (SELECT avg(t) AS mean_t, stddev_samp(t) AS sd_t, avg(p) AS mean_p, stddev_samp(p) AS sd_p FROM g), "
    "a AS (SELECT id, x, y, (t - mean_t) / sd_t AS c0, (p - mean_p) / sd_p AS c1 FROM g, m), "
)
ORACLE_SQL |= {
    "coord_detect": "SELECT * FROM (VALUES ('ll', 'lonlat'), ('xy', 'lonlat'), ('xy_1000', 'projected')) t(tables, coord_type)",
    "haversine_pairs": "SELECT id, round(km, 6) AS km FROM (SELECT f.id, "
    + _HAVERSINE.replace("r.x - f.x", "r.x + r.c0 - f.x") + f" AS km {_JOINED})",
    "euclid_pairs": f"SELECT f.id, round(sqrt((f.c0 - r.c0) * (f.c0 - r.c0) + (f.c1 - r.c1) * (f.c1 - r.c1)), 6) AS distance {_JOINED}",
    "index_stats_ll": _index_sql(1.0, 2000.0),
    "index_stats_weighted": _index_sql(1.0, 2000.0, "sum", "inverse_geog", 0.5),
    "index_stats_ll_clim": _index_sql(0.5),
    "index_stats_none": _index_sql(),
    # The least distance of each focal cell, then the least index at it: no pair is sorted.
    "velocity_grid": _GRID
    + "p AS (SELECT f.id AS focal_index, f.x AS focal_x, f.y AS focal_y, r.id AS analog_index, r.x AS analog_x, r.y AS analog_y, "
    + "sqrt((f.c0 - (r.c0 + 0.5e0)) * (f.c0 - (r.c0 + 0.5e0)) + (f.c1 - r.c1 * 0.5e0) * (f.c1 - r.c1 * 0.5e0)) AS clim, " + _PLANAR + " AS geog "
    + "FROM a f, a r WHERE sqrt((f.c0 - (r.c0 + 0.5e0)) * (f.c0 - (r.c0 + 0.5e0)) + (f.c1 - r.c1 * 0.5e0) * (f.c1 - r.c1 * 0.5e0)) <= 0.5), "
    + "b AS (SELECT focal_index AS i, arg_min(analog_index, struct_pack(d := geog, a := analog_index)) AS n FROM p GROUP BY focal_index), "
    + "q AS (SELECT f.id AS focal_index, f.x AS focal_x, f.y AS focal_y, r.id AS analog_index, r.x AS analog_x, r.y AS analog_y, "
    + "sqrt((f.c0 - (r.c0 + 0.5e0)) * (f.c0 - (r.c0 + 0.5e0)) + (f.c1 - r.c1 * 0.5e0) * (f.c1 - r.c1 * 0.5e0)) AS clim, " + _PLANAR + " AS geog "
    + "FROM a f JOIN b ON f.id = b.i JOIN a r ON r.id = b.n) "
    + "SELECT focal_index, focal_x, focal_y, analog_index, analog_x, analog_y, round(clim, 6) AS clim_dist, round(geog, 6) AS geog_dist FROM q",
    "stream_availability": ORACLE_SQL["availability_ll"],
    "row_numbers": _sql("self", "all", max_clim=1.0, max_geog=2000.0),
    "euclid_arrays": "SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))), 6) AS distance FROM embeddings",
    "raster_cells": f"SELECT id, x, y, round(a, 6) AS a, round(b, 6) AS b, round(d, 6) AS d FROM ({_CELLS})",
    "raster_layers": f"SELECT id, x, y, round((b + d) / 2, 6) AS mean, round(ln(d), 6) AS logged FROM ({_CELLS}) WHERE x BETWEEN 5 AND 30",
    "grid_sample": "SELECT CAST(100 AS BIGINT) AS rows, CAST(100 AS BIGINT) AS ids",
    "validation": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(bad).lower()})" for n, _, bad in _ARGUMENTS) + ") t(argument, refused)",
}
