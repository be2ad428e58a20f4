"""What an index over the reference table looks like, as a one-row frame.

Bins follow the thresholds: a bounded dimension has bins as wide as its
threshold, an unbounded one a tenth of its span; their number is
ceil(span / width) + 1, or 1 without a span.  The average is over all bins,
empty ones included; least and greatest are over occupied bins.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climekin.plans.spec import SearchSpec
from climekin.sources.points import climate, extent, known, looks_lonlat

STATS = (
    "n_focal long, n_ref long, n_clim int, max_geog double, max_clim array<double>, geo_mode string, binning_method string, "
    "total_bins double, avg_bin_occupancy double, min_bin_occupancy double, max_bin_occupancy double, mode string, weight string, theta double"
)


def index_stats(focal: DataFrame, ref: DataFrame, spec: SearchSpec) -> DataFrame:
    spark = ref.sparkSession
    variables = len(climate(ref))
    spec.check_arity(len(climate(focal)), variables)
    stats = extent(focal, ref.where(known(ref)))
    lonlat = spec.coord_type.value == "lonlat" or spec.coord_type.value == "auto" and looks_lonlat(stats)
    n_focal, n_ref = stats["focal"]["n"], stats["ref"]["n"]
    bands = spec.bands(variables)
    head = (n_focal, n_ref, variables, spec.max_geog, list(spec.max_clim) if isinstance(spec.max_clim, tuple) else None if spec.max_clim is None else [spec.max_clim], "lonlat" if lonlat else "projected")
    tail = (spec.mode.value, spec.weight.value if spec.weight else None, spec.theta)
    if spec.max_geog is None and all(t is None for t in bands) or not n_ref:
        return spark.createDataFrame([(*head, "none", 1.0, float(n_ref), float(n_ref), float(n_ref), *tail)], STATS)
    total, bins = 1.0, []
    for name, limit in [("x", spec.max_geog), ("y", spec.max_geog), *((f"c{i}", t) for i, t in enumerate(bands))]:
        low, high = stats["ref"][name]
        span = high - low
        width = limit if limit is not None and limit > 0 else span / 10 if span > 0 else 1.0
        number = math.ceil(span / width) + 1 if span > 0 else 1
        total *= number
        bins.append(F.greatest(F.lit(0), F.least(F.lit(number - 1), F.floor((F.col(name) - F.lit(low)) / F.lit(width)))))
    keys = [b.alias(f"b{i}") for i, b in enumerate(bins)]
    filled = ref.where(known(ref)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    return spark.createDataFrame([(*head, "lattice", total, n_ref / total, float(filled["a"]), float(filled["b"]), *tail)], STATS)
