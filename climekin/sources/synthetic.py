"""Generators and preparation of point tables for benchmarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardise columns by mean and sample deviation; null, NaN and infinite values don't count and become null."""
    clean = {c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in columns}
    stats = df.agg(*[f(clean[c]).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    # One row.
    return df.join(F.broadcast(stats)).withColumns({c: (clean[c] - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in columns}).drop(*stats.columns)


def grid(spark: SparkSession, side: int, era: int = 1) -> DataFrame:
    """side x side cells, row by row from the top: id, centre x, y and two standardised variables.

    The first variable waves along columns and rows, the second grows with
    the row; the second era adds 0.5 to one and halves the other.
    """
    i = F.col("id")
    row, col = F.floor(i / side) + 1, i % side + 1
    cells = spark.range(side * side).select(
        (i + 1).cast("int").alias("id"), (col - 0.5).alias("x"), (side - row + 0.5).alias("y"),
        (F.sin(col / 40.0) + F.cos(row / 20.0)).alias("t"), row.cast("double").alias("p"),
    )
    out = zscore(cells, ["t", "p"])
    return out if era == 1 else out.withColumns({"t": F.col("t") + 0.5, "p": F.col("p") * 0.5})


def layers(df: DataFrame, means: dict[str, Sequence[str]], logs: Sequence[str] = (), box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A raster in long form prepared for a search.

    Crops to (x0, x1, y0, y1), averages groups of layers into named ones and
    takes logarithms of some.  Cells with missing layers stay, as null.
    """
    if box:
        df = df.where(F.col("x").between(box[0], box[1]) & F.col("y").between(box[2], box[3]))

    def mean(columns: Sequence[str]) -> Column:
        total = F.col(columns[0]).cast("double")
        for c in columns[1:]:
            total = total + F.col(c)
        return total / len(columns)

    made = {n: mean(c) for n, c in means.items()}
    keep = [c for c in df.columns if c not in {x for cs in means.values() for x in cs}]
    return df.select(*keep, *[(F.log(v) if n in logs else v).alias(n) for n, v in made.items()])


def sample(df: DataFrame, n: int, id_col: str = "id", seed: int = 0) -> DataFrame:
    """n rows without replacement, the same in every run."""
    return df.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(n)


def raster_cells(df: DataFrame, x: str = "x", y: str = "y", layer: str = "layer", value: str = "value", names: Sequence[str] | None = None) -> DataFrame:
    """One row a cell from one row a cell and layer; cells are numbered by row from the top, missing layers are null."""
    wide = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).pivot(layer, list(names) if names else None).agg(F.first(value))
    # Rows of the raster are numbered by y, and cells within each by x.
    heights = wide.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    before = heights.select(F.col("y").alias("hy"), (F.sum("n").over(Window.orderBy(F.desc("y"))) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("y").orderBy("x"))
    placed = wide.withColumn("cell", inner).join(before, F.col("y") == F.col("hy"))
    return placed.withColumn("id", (F.col("before") + F.col("cell")).cast("int")).drop("cell", "before", "hy").select("id", "x", "y", *[c for c in wide.columns if c not in ("x", "y")])
