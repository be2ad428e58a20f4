"""Candidate pairs: a grid equi-join where a threshold prunes, else a nested loop.

A threshold t on a dimension lets only points within one cell of width t
match, so each point of the smaller side goes to its own cell and the
neighbouring ones, and meets the other side by equality of cells.  Cells of
different offsets are disjoint, so no pair comes twice.  Longitude and
latitude are binned on the unit sphere by the chord of the radius, which has
neither an antimeridian nor poles.  Widths are a little larger than the
threshold, so that rounding never puts a match two cells away.

A table of a few MB is read by one task, and adaptive execution makes one task
of a few MB of shuffled rows.  So where many pairs are expected, both sides are
dealt over a number of tasks that follows the pairs.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from climekin.functions.metrics import EARTH_KM, euclid, geographic, unit_sphere
from climekin.plans.spec import SearchSpec

#: Most cells that a point of the smaller side is sent to.
MAX_COPIES = 250
#: What sending a point to a cell costs, in pairs looked at.
COPY_COST = 20
#: Cells of the unit sphere around a point that can hold others, about: of 27, those on the surface.
SPHERE_COPIES = 10
#: Up to so many pairs the nested loop is as good as a grid.
SMALL_PRODUCT = 2_000_000
#: Points of either side in a cell from which on that side is dealt over several tasks.
SALT_ROWS = 10_000
#: A side of at most so many rows (8 bytes a column) is broadcast.
BROADCAST_CELLS = 2_000_000
#: From so many expected pairs on, they are dealt over the cluster.
SPREAD_PAIRS = 20_000_000
#: Pairs and rows of a task, about.
TASK_PAIRS, TASK_ROWS = 20_000_000, 200_000
MAX_TASKS = 2000


@dataclass(frozen=True)
class Plan:
    """How candidates are made: the dimensions of the grid, or none for the nested loop, and about how many pairs that gives."""

    keys: tuple[str, ...]
    widths: tuple[float, ...]
    pairs: float = 0.0

    @property
    def grid(self) -> bool:
        return bool(self.keys)


def choose(spec: SearchSpec, lonlat: bool, stats: dict, variables: int, force: str | None = None) -> Plan:
    """The grid with least pairs and copies of points over the reference's extent; force: "grid" or "cross"."""
    product = float(stats["focal"]["n"] * stats["ref"]["n"])
    nested = Plan((), (), product)
    if force == "cross":
        return nested

    def cells(name: str, width: float) -> float:
        low, high = stats["ref"][name]
        return 1.0 if low is None or not math.isfinite(high - low) else 1.0 + (high - low) / width

    # (share of the pairs that is left, cells a point goes to, keys and widths)
    place: list[tuple[float, int, list[tuple[str, float]]]] = []
    single: list[tuple[float, int, list[tuple[str, float]]]] = []

    def add(name: str, limit: float) -> None:
        w = limit * (1 + 1e-6)
        if limit == 0:
            single.append((1e-6, 1, [(name, 0.0)]))
        elif limit > 0 and (n := cells(name, w)) > 1.5:
            single.append((min(1.0, 3 / n), 3, [(name, w)]))

    if spec.max_geog is not None and lonlat:
        angle = spec.max_geog / (2 * EARTH_KM)
        if angle < math.pi / 4:
            chord = 2 * math.sin(angle) * (1 + 1e-6) + 1e-12
            place.append((min(1.0, 9 * chord * chord / (4 * math.pi)), SPHERE_COPIES, [(s, chord) for s in ("s0", "s1", "s2")]))
    elif spec.max_geog is not None:
        for c in ("x", "y"):
            add(c, spec.max_geog)
    for i, t in enumerate(spec.bands(variables)):
        if t is not None:
            add(f"c{i}", t)
    groups = [*place, *sorted(single, key=lambda g: g[0])[:5]]
    small = min(stats["focal"]["n"], stats["ref"]["n"])
    best, least = nested, math.inf if force == "grid" else product
    if force != "grid" and product <= SMALL_PRODUCT:
        return nested
    for n in range(1, len(groups) + 1):
        for some in itertools.combinations(groups, n):
            copies, pairs = math.prod(g[1] for g in some), product * math.prod(g[0] for g in some)
            if copies <= MAX_COPIES and pairs + COPY_COST * small * copies < least:
                least = pairs + COPY_COST * small * copies
                dims = [d for g in some for d in g[2]]
                best = Plan(tuple(d[0] for d in dims), tuple(d[1] for d in dims), pairs)
    return best


def _cells(df: DataFrame, plan: Plan) -> list[Column]:
    """A point's cell in each dimension of the grid; for a width of 0 a number of its value."""
    sphere = unit_sphere(F.col("x"), F.col("y"))
    out = []
    for key, width in zip(plan.keys, plan.widths):
        value = sphere[int(key[1])] if key[0] == "s" else F.col(key)
        # Different values of one number meet, too, and are told apart by the exact filter.
        out.append(F.floor(value / F.lit(width)) if width else F.xxhash64(value + F.lit(0.0)))
    return out


def _wide(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])


def _small(n: int, columns: int) -> bool:
    return n * columns <= BROADCAST_CELLS


def tasks(spark: SparkSession, pairs: float, rows: float) -> int:
    """Over how many tasks so many pairs of so many rows are dealt."""
    return int(min(MAX_TASKS, max(pairs / TASK_PAIRS, rows / TASK_ROWS, 4 * spark.sparkContext.defaultParallelism)))


def _on_surface(keys: list[str], width: float) -> Column:
    """Whether a cell of the unit cube meets the sphere."""
    low, high = ([F.col(k) * F.lit(width) for k in keys], [(F.col(k) + 1) * F.lit(width) for k in keys])
    near = functools.reduce(operator.add, [F.greatest(F.lit(0.0), a, -b) * F.greatest(F.lit(0.0), a, -b) for a, b in zip(low, high)])
    far = functools.reduce(operator.add, [F.greatest(a * a, b * b) for a, b in zip(low, high)])
    return (near <= F.lit(1 + 1e-6)) & (far >= F.lit(1 - 1e-6))


def _placed(small: DataFrame, plan: Plan, keys: list[str]) -> DataFrame:
    """Each point once for each cell that can hold what it matches."""
    out = small.withColumns(dict(zip(keys, _cells(small, plan))))
    sphere = [k for k, name in zip(keys, plan.keys) if name[0] == "s"]
    other = [k for k, name, w in zip(keys, plan.keys, plan.widths) if name[0] != "s" and w]
    for some in (sphere, other):
        if some:
            shifts = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(some, o)]) for o in itertools.product((-1, 0, 1), repeat=len(some))])
            out = out.withColumn("shift", F.explode(shifts))
            out = out.withColumns({k: F.col(k) + F.col(f"shift.{k}") for k in some}).drop("shift")
        if some and some is sphere:
            out = out.where(_on_surface(sphere, plan.widths[plan.keys.index("s0")]))
    return out


def _salted(placed: DataFrame, binned: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with salts: each side's points of a hot cell are dealt, and the other's repeated for each share."""
    counts = [df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias(n)) for df, n in ((placed, "shares"), (binned, "salts"))]
    hot = counts[0].join(counts[1], keys).where("shares > 1 or salts > 1")
    # At most two cells for every SALT_ROWS points.
    if 2 * (rows // SALT_ROWS + 1) * (len(keys) + 2) <= BROADCAST_CELLS:
        hot = F.broadcast(hot)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        number, repeats = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        mine = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), number).cast("int")
        out = df.join(hot, keys, "left").withColumns({f"{own}_": mine, f"{other}_": F.explode(F.sequence(F.lit(0), repeats - 1))})
        return out.drop("shares", "salts").withColumnsRenamed({"shares_": "share", "salts_": "salt"})

    return dealt(placed, "shares", "salts"), dealt(binned, "salts", "shares")


def candidates(focal: DataFrame, ref: DataFrame, plan: Plan, stats: dict, sphere: bool = False) -> DataFrame:
    """Pairs with columns f_id, f_x, ..., r_id, r_x, ...; a superset of the matches.

    ``sphere`` adds places on the unit sphere, f_u0, ..., by which ``matches`` drops most pairs.
    """
    spark = ref.sparkSession
    n_focal, n_ref = stats["focal"]["n"], stats["ref"]["n"]
    if sphere:
        focal, ref = (df.withColumns({f"u{i}": u for i, u in enumerate(unit_sphere(F.col("x"), F.col("y")))}) for df in (focal, ref))
    width = len(ref.columns)
    focal_first = n_focal <= n_ref
    small, large = (focal, ref) if focal_first else (ref, focal)
    n_small, n_large = sorted((n_focal, n_ref))
    spread = plan.pairs >= SPREAD_PAIRS
    if not plan.grid:
        number = tasks(spark, plan.pairs, n_large) if spread else 0
        if _small(n_small, width):
            large = large.repartition(number) if spread else large
            f, r = _wide(small if focal_first else large, "f"), _wide(large if focal_first else small, "r")
            return r.join(F.broadcast(f)) if focal_first else f.join(F.broadcast(r))
        number = math.ceil(math.sqrt(number))
        f, r = (_wide(df.repartition(number) if spread else df, s) for df, s in ((focal, "f"), (ref, "r")))
        return f.crossJoin(r)
    keys = [f"g{i}" for i in range(len(plan.keys))]
    copies = math.prod(3 for w in plan.widths if w) if "s0" not in plan.keys else SPHERE_COPIES * math.prod(3 for k, w in zip(plan.keys, plan.widths) if w and k[0] != "s")
    placed = _placed(small, plan, keys)
    binned = large.withColumns(dict(zip(keys, _cells(large, plan))))
    shuffled = spread or not _small(n_small * copies, width)
    if shuffled:
        placed, binned = _salted(placed, binned, keys, n_small * copies + n_large)
        keys = [*keys, "share", "salt"]
    a, b = (placed, binned) if focal_first else (binned, placed)
    f, r = _wide(a, "f"), _wide(b, "r")
    on = [F.col(f"f_{k}") == F.col(f"r_{k}") for k in keys]
    if shuffled:
        # A number that is asked for is kept by adaptive execution.
        number = tasks(spark, plan.pairs, n_small * copies + n_large)
        f, r = (df.repartition(number, *[F.col(f"{s}_{k}") for k in keys]) for df, s in ((f, "f"), (r, "r")))
        f, r = (f, r.hint("shuffle_hash")) if focal_first else (f.hint("shuffle_hash"), r)
    else:
        f, r = (F.broadcast(f), r) if focal_first else (f, F.broadcast(r))
    return f.join(r, on).drop(*[f"{s}_{k}" for s in "fr" for k in keys])


def distances(variables: int, lonlat: bool) -> tuple[Column, Column]:
    """(climate, geographic) distance of a candidate pair."""
    clim = euclid([F.col(f"f_c{i}") for i in range(variables)], [F.col(f"r_c{i}") for i in range(variables)])
    return clim, geographic(lonlat, F.col("f_x"), F.col("f_y"), F.col("r_x"), F.col("r_y"))


def measured(pairs: DataFrame, lonlat: bool, variables: int) -> DataFrame:
    clim, geog = distances(variables, lonlat)
    return pairs.withColumns({"clim_dist": clim, "geog_dist": geog})


def by_chord(spec: SearchSpec, lonlat: bool) -> bool:
    """Whether chords on the unit sphere can stand for most distances: up to a quarter of the globe."""
    return lonlat and spec.max_geog is not None and 0 <= spec.max_geog <= 1.5 * EARTH_KM


def _within(spec: SearchSpec, geog: Column) -> list[Column]:
    """The geographic test, taken by the chord unless rounding might decide."""
    chord = 2 * math.sin(spec.max_geog / EARTH_KM / 2)
    slack = 1e-9 * chord * chord + 1e-14 * chord + 1e-28
    square = functools.reduce(operator.add, [(F.col(f"f_u{i}") - F.col(f"r_u{i}")) * (F.col(f"f_u{i}") - F.col(f"r_u{i}")) for i in range(3)])
    return [square <= F.lit(chord * chord + slack), (square <= F.lit(chord * chord - slack)) | (geog <= F.lit(spec.max_geog))]


def matches(pairs: DataFrame, spec: SearchSpec, lonlat: bool, variables: int) -> DataFrame:
    """The exact filter, cheap tests first; adds clim_dist and geog_dist."""
    if spec.nothing:
        return pairs.where(F.lit(False)).withColumns({"clim_dist": F.lit(0.0), "geog_dist": F.lit(0.0)})
    clim, geog = distances(variables, lonlat)
    tests = []
    if isinstance(spec.max_clim, tuple):
        tests += [F.abs(F.col(f"f_c{i}") - F.col(f"r_c{i}")) <= F.lit(t) for i, t in enumerate(replace(spec, clim_radius=None).bands(variables)) if t is not None]
    elif spec.max_clim is not None:
        tests.append(clim <= F.lit(spec.max_clim))
    if spec.clim_radius is not None:
        tests.append(clim <= F.lit(spec.clim_radius))
    if spec.max_geog is not None:
        if lonlat:
            # A degree of latitude is 111 km everywhere: cheap, and exact as a bound.
            tests.append(F.abs(F.col("f_y") - F.col("r_y")) <= F.lit(math.degrees(spec.max_geog / EARTH_KM) * (1 + 1e-9) + 1e-9))
        tests += _within(spec, geog) if "f_u0" in pairs.columns and by_chord(spec, lonlat) else [geog <= F.lit(spec.max_geog)]
    kept = pairs.where(functools.reduce(operator.and_, tests)) if tests else pairs
    return measured(kept, lonlat, variables)
