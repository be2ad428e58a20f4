"""Point tables: an id, two coordinates, one climate variable or more.

Any frame becomes (id, x, y, c0, c1, ...) with doubles.  Columns named ``x``
and ``y`` are the coordinates wherever they stand, else the first two are;
all others are climate variables in their order.  The two tables of a search
are aligned by position, not by name.
"""

from __future__ import annotations

import functools
import operator
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType)


def to_frame(data, spark: SparkSession | None = None, what: str = "data") -> DataFrame:
    """A DataFrame from a Spark or pandas frame or a two-dimensional array."""
    if isinstance(data, DataFrame):
        return data
    import numpy as np
    import pandas as pd

    if isinstance(data, np.ndarray):
        if data.ndim != 2:
            raise TypeError(f"{what}: an array must have two dimensions")
        data = pd.DataFrame(data, columns=[f"v{i + 1}" for i in range(data.shape[1])])
    if isinstance(data, pd.DataFrame):
        spark = spark or SparkSession.builder.getOrCreate()
        return spark.createDataFrame(data.assign(__row=range(1, len(data) + 1)).astype({"__row": "int32"}).rename(columns=str))
    raise TypeError(f"{what} must be a Spark or pandas DataFrame or a NumPy array; got {type(data).__name__}")


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Consecutive numbers from 1 in the source's order of rows.

    The order is that of files and splits; number rows yourself where that
    means nothing.  One row for each partition is collected.
    """
    place = F.monotonically_increasing_id()
    marked = df.withColumn(name, place)
    counts = marked.groupBy(F.shiftright(name, 33).alias("p")).count().collect()
    before, total = {}, 0
    for p, n in sorted((r["p"], r["count"]) for r in counts):
        before[p], total = total, total + n
    offsets = df.sparkSession.createDataFrame([(p, n) for p, n in before.items()], "p long, before long")
    number = F.col("before") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    kind = "int" if total < 1 << 31 else "long"
    numbered = marked.join(F.broadcast(offsets), F.shiftright(name, 33) == F.col("p"))
    return numbered.withColumn(name, number.cast(kind)).drop("p", "before")


def normalise(data, id_col: str | None = None, spark: SparkSession | None = None, what: str = "data") -> DataFrame:
    """(id, x, y, c0, ...) of a table of points."""
    df = to_frame(data, spark, what)
    if id_col is None and "__row" in df.columns:
        id_col = "__row"
    if id_col is not None and id_col not in df.columns:
        raise ValueError(f"{what} has no column {id_col!r}")
    names = [c for c in df.columns if c not in (id_col, "__row")]
    xy = ["x", "y"] if "x" in names and "y" in names else names[:2]
    if len(xy) < 2:
        raise ValueError(f"{what} needs two coordinate columns")
    clim = [c for c in names if c not in xy]
    if not clim:
        raise ValueError(f"{what} needs at least one climate variable")
    if id_col is None:
        df, id_col = number_rows(df, "__row"), "__row"
    kept = df.schema[id_col].dataType
    ident = F.col(f"`{id_col}`")
    ident = ident.cast("int") if isinstance(kept, _INTEGERS) else ident if isinstance(kept, T.StringType) else ident.cast("long")
    columns = [F.col(f"`{c}`").cast("double").alias(n) for c, n in zip([*xy, *clim], ["x", "y", *(f"c{i}" for i in range(len(clim)))])]
    out = df.select(ident.alias("id"), *columns)
    out.climate_names = clim
    return out


def climate(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("c")]


def known(df: DataFrame) -> Column:
    """Whether all of a point's numbers are there: neither null nor NaN."""
    return functools.reduce(operator.and_, [F.col(c).isNotNull() & ~F.isnan(c) for c in df.columns if c not in ("id", "row")])


def warn_names(focal: DataFrame, ref: DataFrame) -> None:
    a, b = getattr(focal, "climate_names", None), getattr(ref, "climate_names", None)
    if a and b and a != b and set(a) == set(b):
        warnings.warn(f"climate variables are matched by position: {a} with {b}", stacklevel=3)


def extent(focal: DataFrame, ref: DataFrame, alike: Sequence[str] = ()) -> dict:
    """Counts of both tables and the least and greatest value of every column of each: one job.

    ``different`` is about how many points differ in the columns ``alike``.
    """
    cols = [c for c in ref.columns if c != "id"]
    both = focal.select(F.lit(0).alias("side"), *cols).unionByName(ref.select(F.lit(1).alias("side"), *cols))
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in cols}
    rows = both.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*alike) if alike else F.lit(1)).alias("different"), *[f(clean[c]).alias(f"{p}_{c}") for c in cols for p, f in (("min", F.min), ("max", F.max))]
    ).collect()
    out = {s: {"n": 0, "different": 0, **{c: (None, None) for c in cols}} for s in (0, 1)}
    for r in rows:
        out[r["side"]] = {"n": r["n"], "different": min(r["n"], r["different"]), **{c: (r[f"min_{c}"], r[f"max_{c}"]) for c in cols}}
    return {"focal": out[0], "ref": out[1]}


def looks_lonlat(stats: dict) -> bool:
    """Longitude and latitude if all coordinates are finite and lie in [-180, 180] and [-90, 90]."""
    for side in ("focal", "ref"):
        for c, bound in (("x", 180.0), ("y", 90.0)):
            low, high = stats[side][c]
            if low is not None and not (-bound <= low and high <= bound):
                return False
    return any(stats[s]["x"][0] is not None for s in ("focal", "ref")) and any(stats[s]["y"][0] is not None for s in ("focal", "ref"))
