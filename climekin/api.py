"""The searches that users call.

``focal`` and ``ref`` are Spark or pandas frames or NumPy arrays (see
``sources.points``).  Distances are kilometres for longitude and latitude,
else coordinate units.  Thresholds are inclusive; a point matches itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from climekin.operators import diagnostics
from climekin.operators import search as engine
from climekin.plans.spec import SearchSpec
from climekin.sources.points import normalise, warn_names


def _tables(focal, ref, focal_id, ref_id) -> tuple[DataFrame, DataFrame]:
    f, r = normalise(focal, focal_id, what="focal"), normalise(ref, ref_id, what="ref")
    warn_names(f, r)
    return f, r


def search(focal, ref, mode: str = "knn_clim", max_clim=None, max_geog=None, k=None, weight=None, theta=None, report_dist: bool = True, coord_type: str = "auto", n_threads=None, focal_id: str | None = None, ref_id: str | None = None, plan: str | None = None) -> DataFrame:
    """Any search.  ``plan`` forces "grid" or "cross" candidates; both give the same result.

    Pair modes (all, knn_clim, knn_geog) give focal_index, focal_x, focal_y,
    analog_index, analog_x, analog_y and, with ``report_dist``, clim_dist and
    geog_dist; focal points without a match have no row.  count, sum and mean
    give focal_index, focal_x, focal_y, value for every focal point.
    """
    spec = SearchSpec.make(mode, max_clim, max_geog, k, weight, theta, report_dist, coord_type, n_threads)
    return engine.run(*_tables(focal, ref, focal_id, ref_id), spec, plan)


def velocity(focal, ref, max_clim, k=1, max_geog=None, coord_type: str = "auto", report_dist: bool = True, n_threads=None, **options) -> DataFrame:
    """The k geographically nearest points of similar climate."""
    return search(focal, ref, "knn_geog", max_clim, max_geog, k, None, None, report_dist, coord_type, n_threads, **options)


def impact(focal, ref, max_geog, k=20, max_clim=None, coord_type: str = "auto", report_dist: bool = True, n_threads=None, **options) -> DataFrame:
    """The k climatically nearest points within a geographic radius."""
    return search(focal, ref, "knn_clim", max_clim, max_geog, k, None, None, report_dist, coord_type, n_threads, **options)


def availability(focal, ref, max_clim=None, max_geog=None, coord_type: str = "auto", n_threads=None, **options) -> DataFrame:
    """How many points lie within the limits."""
    return search(focal, ref, "count", max_clim, max_geog, None, None, None, True, coord_type, n_threads, **options)


def intensity(focal, ref, max_clim=None, max_geog=None, weight: str = "uniform", theta=None, coord_type: str = "auto", n_threads=None, **options) -> DataFrame:
    """The summed weights of the points within the limits."""
    return search(focal, ref, "sum", max_clim, max_geog, None, weight, theta, True, coord_type, n_threads, **options)


def index_stats(focal, ref, mode: str = "knn_clim", max_clim=None, max_geog=None, coord_type: str = "auto", focal_id: str | None = None, ref_id: str | None = None, **options) -> DataFrame:
    """Diagnostics of the search's bins over ``ref`` as one row."""
    spec = SearchSpec.make(mode, max_clim, max_geog, coord_type=coord_type, **options)
    return diagnostics.index_stats(*_tables(focal, ref, focal_id, ref_id), spec)
