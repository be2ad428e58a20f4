"""Candidates of a nearest-neighbour search that no threshold bounds.

Both tables are cut into cells at the reference's quantiles, so that cells
follow its density.  The points of a cell have a tight box; of two boxes the
least and the greatest distance of their points are known.  For each focal
cell the reference cells are taken by greatest distance until they hold k
points: no k-th nearest point of the cell lies further than the last of them,
and only cells whose least distance is within that bound are joined, by
equality of cells.  This is exact, ties included.

Longitude and latitude are cut and compared as places on the unit sphere,
where the chord grows with the distance.  At most ``MAX_CELLS`` boxes of each
table and what they say of each other pass through the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climekin.functions.metrics import EARTH_KM, unit_sphere
from climekin.operators.candidates import BROADCAST_CELLS, _small, _wide
from climekin.sources.points import climate

MAX_CELLS = 4096
#: Most cells along one dimension that quantiles cut.
MAX_CUTS = 64
#: Reference points of a cell for each neighbour sought, about.
CELL_ROWS = 4
#: A larger cell is dealt over several tasks.
SALT_ROWS = 100_000


def dimensions(df: DataFrame, geographic: bool, lonlat: bool) -> list[Column]:
    """What distances are taken over: all variables, the coordinates, or places on the sphere."""
    if not geographic:
        return [F.col(c) for c in climate(df)]
    return unit_sphere(F.col("x"), F.col("y")) if lonlat else [F.col("x"), F.col("y")]


def _bucket(value: Column, cuts: list[float], base: int = 0) -> Column:
    """Number of cuts at or below a value, by halving."""
    if not cuts:
        return F.lit(base)
    m = len(cuts) // 2
    return F.when(value < F.lit(cuts[m]), _bucket(value, cuts[:m], base)).otherwise(_bucket(value, cuts[m + 1 :], base + m + 1))


def _boxes(df: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell, rows, low, high) of the cells that have points."""
    ends = [f(f"d{i}").alias(f"{n}{i}") for n, f in (("a", F.min), ("b", F.max)) for i in range(size)]
    rows = df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).collect()
    table = np.array([[float(x) for x in r[2:]] for r in rows], float).reshape(len(rows), 2 * size)
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), table[:, :size], table[:, size:]


def meetings(f_low, f_high, r_low, r_high, r_rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(focal box, reference box, bound): boxes that may hold one of the k nearest, and how far these are at most."""
    out = []
    for a in range(0, len(f_low), 256):
        fl, fh = f_low[a : a + 256, None, :], f_high[a : a + 256, None, :]
        least = np.sqrt((np.maximum(0, np.maximum(fl - r_high[None], r_low[None] - fh)) ** 2).sum(axis=2))
        most = np.sqrt((np.maximum(np.abs(fh - r_low[None]), np.abs(r_high[None] - fl)) ** 2).sum(axis=2))
        order = np.argsort(most, axis=1)
        enough = np.cumsum(r_rows[order], axis=1) >= k
        last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(r_rows) - 1)
        bound = np.where(enough.any(axis=1), most[np.arange(len(order)), order[np.arange(len(order)), last]], np.inf)
        # Wider than rounding can be wrong.
        bound = bound * (1 + 1e-9) + 1e-12
        i, j = np.nonzero(least <= bound[:, None])
        out.append((i + a, j, bound[i]))
    return tuple(np.concatenate(x) for x in zip(*out))


def candidates(focal: DataFrame, ref: DataFrame, geographic: bool, lonlat: bool, k: int, stats: dict) -> DataFrame:
    """Pairs f_.., r_.. with ``bound``, which the distance of a k-th nearest point can't exceed."""
    spark = ref.sparkSession
    n_focal, n_ref = stats["focal"]["n"], stats["ref"]["n"]
    dims = dimensions(ref, geographic, lonlat)
    size = len(dims)
    r = ref.withColumns({f"d{i}": d for i, d in enumerate(dims)})
    f = focal.withColumns({f"d{i}": d for i, d in enumerate(dimensions(focal, geographic, lonlat))})
    # Cut the widest dimensions, three at most.
    spans = {i: 2.0 if lonlat and geographic else (lambda e: e[1] - e[0] if e[0] is not None else 0.0)(stats["ref"][("x", "y")[i] if geographic else f"c{i}"]) for i in range(size)}
    cut = sorted(spans, key=lambda i: -spans[i])[:3]
    cells = max(1, min(MAX_CELLS, n_ref // (CELL_ROWS * k)))
    each = min(MAX_CUTS, max(1, round(cells ** (1 / len(cut)))))
    shares = [i / each for i in range(1, each)]
    found = r.agg(*[F.percentile_approx(f"d{i}", F.array(*[F.lit(s) for s in shares]), F.lit(1000)) for i in cut]).first() if shares else [[]] * len(cut)
    cuts = [sorted(set(c or [])) for c in found]

    def celled(df: DataFrame) -> DataFrame:
        number = F.lit(0)
        for i, c in zip(cut, cuts):
            number = number * (len(c) + 1) + _bucket(F.col(f"d{i}"), c)
        return df.withColumn("cell", number)

    f, r = celled(f), celled(r)
    f_cell, _, f_low, f_high = _boxes(f, size)
    r_cell, r_rows, r_low, r_high = _boxes(r, size)
    i, j, bound = meetings(f_low, f_high, r_low, r_high, r_rows, k) if len(f_cell) and len(r_cell) else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    if geographic and lonlat:
        bound = 2 * EARTH_KM * np.arcsin(np.minimum(1, bound / 2)) * (1 + 1e-9) + 1e-6
    salts = np.maximum(1, -(-r_rows // SALT_ROWS))
    times = salts[j]
    salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    table = pa.table({"meet": np.repeat(f_cell[i], times), "cell": np.repeat(r_cell[j], times), "salt": salt, "bound": np.repeat(bound, times)})
    pairs = spark.createDataFrame(table)
    if 4 * table.num_rows <= BROADCAST_CELLS:
        pairs = F.broadcast(pairs)
    asked = f.withColumnRenamed("cell", "own").join(pairs, F.col("own") == F.col("meet")).drop("own", "meet", *[f"d{n}" for n in range(size)])
    hot = [x for c, s in zip(r_cell.tolist(), salts.tolist()) if s > 1 for x in (F.lit(c), F.lit(s))]
    dealt = F.pmod(F.xxhash64(*ref.columns), F.coalesce(F.try_element_at(F.create_map(*hot), F.col("cell").cast("long")), F.lit(1))) if hot else F.lit(0)
    r = r.withColumn("salt", dealt.cast("long")).drop(*[f"d{n}" for n in range(size)])
    a, b = _wide(asked, "f"), _wide(r, "r")
    if _small(int(n_focal * max(1.0, len(i) / max(1, len(f_cell)))), len(focal.columns)):
        a = F.broadcast(a)
    out = a.join(b, (F.col("f_cell") == F.col("r_cell")) & (F.col("f_salt") == F.col("r_salt")))
    return out.withColumnRenamed("f_bound", "bound").drop("f_cell", "r_cell", "f_salt", "r_salt")


def usable(ref_stats: dict, focal_stats: dict) -> bool:
    """Whether all numbers are finite, as boxes need."""
    return all(low is None or math.isfinite(low) and math.isfinite(high) for s in (ref_stats, focal_stats) for c, e in s.items() if c not in ("n", "different") for low, high in [e])
