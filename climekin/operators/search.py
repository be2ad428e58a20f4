"""From matching pairs to results: all pairs, nearest ones, aggregates."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from climekin.functions.metrics import weight
from climekin.operators import boxes
from climekin.operators.candidates import Plan, by_chord, candidates, choose, matches, measured
from climekin.plans.spec import Mode, SearchSpec
from climekin.sources.points import climate, extent, known, looks_lonlat, number_rows

#: From so many pairs in the product on, nearest neighbours take a first pass
#: of hash aggregations that bounds each focal point's k-th distance.
BOUND_PRODUCT = 1_000_000
#: From so many on they are sought within growing radii.
RADIUS_PRODUCT = 100_000_000
#: Focal points whose k-th distance is taken to choose the radii; the result doesn't depend on them.
PROBES = 128
#: From so many pairs in the product on, points that are alike are merged, if there
#: are this many times fewer without them.
MERGE_PRODUCT, MERGE_FROM = 2_000_000, 1.5


def _pair_columns(spec: SearchSpec) -> list:
    named = [("f_id", "focal_index"), ("f_x", "focal_x"), ("f_y", "focal_y"), ("r_id", "analog_index"), ("r_x", "analog_x"), ("r_y", "analog_y")]
    return [F.col(a).alias(b) for a, b in named] + ([F.col("clim_dist"), F.col("geog_dist")] if spec.report_dist else [])


def _nearest(pairs: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy("f_row").orderBy(key, "r_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _bounds(pairs: DataFrame, key: str, k: int) -> DataFrame:
    """row, bound: a distance that the k-th nearest can't exceed, where known.

    References fall into buckets; the k-th of the buckets' least distances is
    the distance of one of k different points.  No match is sorted for it.
    """
    buckets = 1 if k == 1 else 4 * k
    least = pairs.groupBy(F.col("f_row").alias("row"), F.pmod(F.xxhash64("r_id"), F.lit(buckets)).alias("bucket")).agg(F.min(key).alias("d"))
    return least.groupBy("row").agg(F.get(F.sort_array(F.collect_list("d")), F.lit(k - 1)).alias("bound"))


def _rows(focal: DataFrame) -> DataFrame:
    """focal with ``row``, which tells its rows apart: the id, or a number where ids repeat or are null."""
    again = focal.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null")
    return number_rows(focal, "row") if not again.isEmpty() else focal.withColumn("row", F.col("id"))


def _alike(df: DataFrame, need: list[str], *more) -> DataFrame:
    """One row for points that agree in ``need``; their other numbers play no part."""
    rest = [F.min(c).alias(c) for c in df.columns if c not in need]
    return df.groupBy(*need).agg(*rest, *more).select(*df.columns, *[F.col("times") for _ in more])


def _merges(side: dict, product: int, need: list[str]) -> bool:
    return bool(need) and product >= MERGE_PRODUCT and side["different"] * MERGE_FROM <= side["n"]


def _pairs(focal: DataFrame, ref: DataFrame, plan: Plan, stats: dict, spec: SearchSpec, lonlat: bool, variables: int) -> DataFrame:
    return matches(candidates(focal, ref, plan, stats, by_chord(spec, lonlat)), spec, lonlat, variables)


def _sized(stats: dict, **n: int) -> dict:
    return stats | {side: {**stats[side], "n": rows} for side, rows in n.items()}


def _whole_nearest(focal: DataFrame, ref: DataFrame, spec: SearchSpec, lonlat: bool, variables: int, stats: dict, force: str | None) -> DataFrame:
    """The k nearest of each focal row, sought among all that the thresholds let through."""
    key = "clim_dist" if spec.mode is Mode.KNN_CLIM else "geog_dist"
    plan = choose(spec, lonlat, stats, variables, force)
    if not plan.grid and force is None and spec.unbounded and boxes.usable(stats["ref"], stats["focal"]):
        # No threshold prunes: boxes of points do.
        pairs = matches(boxes.candidates(focal, ref, spec.mode is Mode.KNN_GEOG, lonlat, spec.k, stats), spec, lonlat, variables)
        return _nearest(pairs.where(F.col(key) <= F.col("bound")), key, spec.k)
    pairs = _pairs(focal, ref, plan, stats, spec, lonlat, variables)
    if stats["focal"]["n"] * stats["ref"]["n"] >= BOUND_PRODUCT:
        bounded = focal.join(_bounds(pairs, key, spec.k), "row")
        pairs = _pairs(bounded, ref, plan, stats, spec, lonlat, variables)
        pairs = pairs.where(F.col("f_bound").isNull() | (F.col(key) <= F.col("f_bound")))
    return _nearest(pairs, key, spec.k)


def _radii(focal: DataFrame, ref: DataFrame, spec: SearchSpec, lonlat: bool, variables: int, stats: dict) -> list[float]:
    """Ascending radii within which a half, most and about all focal points have their k nearest."""
    key = "clim_dist" if spec.mode is Mode.KNN_CLIM else "geog_dist"
    some = focal.orderBy(F.xxhash64("row"), "row").limit(PROBES).localCheckpoint()
    stats = _sized(stats, focal=PROBES)
    pairs = _pairs(some, ref, choose(spec, lonlat, stats, variables, "cross"), stats, spec, lonlat, variables)
    far = sorted(r["bound"] for r in _bounds(pairs, key, spec.k).where("bound is not null").collect())
    return sorted({far[len(far) // 2], far[len(far) * 4 // 5], far[len(far) * 19 // 20], far[-1] * 1.5}) if far else []


def _nearest_by_radii(focal: DataFrame, ref: DataFrame, spec: SearchSpec, lonlat: bool, variables: int, stats: dict) -> DataFrame:
    """The same by thresholds on the distance itself.

    Points with k matches within a radius are done, ties included; the others
    go on to a larger one, and those that no radius settles to the whole
    search.  So a point meets few others however large the tables are.
    """
    key = "clim_dist" if spec.mode is Mode.KNN_CLIM else "geog_dist"
    out, left = [], stats["focal"]["n"]
    for radius in _radii(focal, ref, spec, lonlat, variables, stats):
        near, stats = spec.within(radius), _sized(stats, focal=left)
        plan = choose(near, lonlat, stats, variables, "grid")
        if not left or not plan.grid:
            break
        top = _nearest(_pairs(focal, ref, plan, stats, near, lonlat, variables), key, spec.k)
        full = top.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("f_row"))).where(F.col("found") == spec.k).drop("found", *[f"{s}_u{i}" for s in "fr" for i in range(3)])
        out.append(full.localCheckpoint())
        focal = focal.join(out[-1].select(F.col("f_row").alias("row")).distinct(), "row", "left_anti").select(*focal.columns).localCheckpoint()
        left = focal.count()
    if left or not out:
        whole = _whole_nearest(focal, ref, spec, lonlat, variables, _sized(stats, focal=left), None)
        columns = out[0].columns if out else whole.columns
        out.append(whole.select(*columns))
    return functools.reduce(DataFrame.unionByName, out)


def _all_nearest(focal: DataFrame, ref: DataFrame, spec: SearchSpec, lonlat: bool, variables: int, stats: dict, force: str | None) -> DataFrame:
    need, product = spec.needs(variables), stats["focal"]["n"] * stats["ref"]["n"]
    merge_ref, merge = (force is None and _merges(stats[s], product, need) for s in ("ref", "focal"))
    asked = focal
    if merge_ref:
        # Of points that are alike the k with the least ids stand before all others.
        order = Window.partitionBy(*need).orderBy("id")
        ref = ref.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= spec.k).drop("rank").localCheckpoint()
        stats = _sized(stats, ref=ref.count())
    if merge:
        asked = _alike(focal, need).localCheckpoint()
        stats = _sized(stats, focal=asked.count())
    if force is None and stats["focal"]["n"] * stats["ref"]["n"] >= RADIUS_PRODUCT:
        top = _nearest_by_radii(asked, ref, spec, lonlat, variables, stats)
    else:
        top = _whole_nearest(asked, ref, spec, lonlat, variables, stats, force)
    if not merge:
        return top
    top = top.select(*[F.col(f"f_{c}").alias(f"k_{c}") for c in need], *[f"r_{c}" for c in ref.columns])
    own = focal.select(*[F.col(c).alias(f"f_{c}") for c in focal.columns])
    return measured(own.join(top, [F.col(f"f_{c}") == F.col(f"k_{c}") for c in need]), lonlat, variables)


def run(focal: DataFrame, ref: DataFrame, spec: SearchSpec, force: str | None = None) -> DataFrame:
    """The result of a search over normalised tables.

    Reference points with a missing number never match; focal points with one
    match nothing and keep their row in aggregates.  Every focal row is a point
    of its own, also where ids repeat or are null.
    """
    variables = len(climate(ref))
    spec.check_arity(len(climate(focal)), variables)
    need = spec.needs(variables)
    stats = extent(focal, ref, need)
    lonlat = spec.coord_type.value == "lonlat" or spec.coord_type.value == "auto" and looks_lonlat(stats)
    focal = _rows(focal)
    good_focal, good_ref = focal.where(known(focal)), ref.where(known(ref))
    if spec.mode.nearest:
        return _all_nearest(good_focal, good_ref, spec, lonlat, variables, stats, force).select(*_pair_columns(spec))
    if spec.mode is Mode.ALL:
        plan = choose(spec, lonlat, stats, variables, force)
        return _pairs(good_focal, good_ref, plan, stats, spec, lonlat, variables).select(*_pair_columns(spec))
    product = stats["focal"]["n"] * stats["ref"]["n"]
    merge_ref, merge = (force is None and _merges(stats[s], product, need) for s in ("ref", "focal"))
    asked = good_focal
    if merge_ref:
        good_ref = _alike(good_ref, need, F.count(F.lit(1)).alias("times"))
        stats = _sized(stats, ref=stats["ref"]["different"])
    if merge:
        asked = _alike(good_focal, need)
        stats = _sized(stats, focal=stats["focal"]["different"])
    plan = choose(spec, lonlat, stats, variables, force)
    pairs = _pairs(asked, good_ref, plan, stats, spec, lonlat, variables)
    w, times = weight(spec, F.col("clim_dist"), F.col("geog_dist")), F.col("r_times") if merge_ref else F.lit(1)
    if spec.mode is Mode.COUNT:
        value = F.sum(times).cast("double") if merge_ref else F.count(F.lit(1)).cast("double")
    elif spec.mode is Mode.SUM:
        value = F.sum(w * times)
    else:
        value = F.sum(w * times) / F.sum(times)
    found = pairs.groupBy(F.col("f_row").alias("m_row")).agg(value.alias("m_value"))
    points = focal.select("row", F.col("id").alias("focal_index"), F.col("x").alias("focal_x"), F.col("y").alias("focal_y"), *[F.col(c).alias(f"p_{c}") for c in need], known(focal).alias("known"))
    if merge:
        names = [F.col(c).alias(f"m_{c}") for c in need]
        found = asked.select("row", *names).join(found, F.col("row") == F.col("m_row")).drop("row", "m_row")
        on = [F.col(f"p_{c}") == F.col(f"m_{c}") for c in need] + [F.col("known")]
    else:
        on = [F.col("row") == F.col("m_row")]
    return points.join(found, on, "left").select("focal_index", "focal_x", "focal_y", F.coalesce("m_value", F.lit(0.0)).alias("value"))
