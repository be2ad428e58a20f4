"""Mixing sources to target weights, in DataFrame operations only.

Targets: capped water-filling.  All words are shared by weight; a source
whose share exceeds ``max_epochs`` times its size is clamped there and the
excess goes to the others by weight, until none is above.  In one pass:
order sources by size/weight and take the first prefix of clamped sources
after which the common level no longer exceeds the next one's cap.

Sampling: a source with rate r = target / size takes every document floor(r)
times.  For the fraction it takes documents once more in the order of a
seeded hash, as long as the middle of the document lies within the missing
words; so its taken words differ from the target by half a document at most.
The cut is found by radix steps over hash prefixes, each a partial
aggregation, so that no task ever orders a whole source.

Defined cases: null text has size 0; the null source is a source and comes
last; a source of size 0 has target 0; an empty table gives no rows; rows
that repeat a key and text share one decision; other columns pass through
``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from climekin.llm.scratch import new_path, stage_at, with_columns_free

#: Fixed by the task: weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def size_of_text(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(key: Column, seed: str) -> Column:
    """60 bits of a seeded MD5 of the key; any SQL engine computes the same."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """source, source_size -> source, source_size, target; one row a source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(rest)
    return (
        sources.withColumn("w", weight)
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("ratio", max_epochs * F.col("source_size") / F.col("w"))
        .withColumn("level", level)
        # The level is right from the first source that stays below its cap.
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.partitionBy()))
        .select("source", "source_size", F.least(F.lit(float(max_epochs)) * F.col("source_size"), F.coalesce(F.col("final.level"), F.lit(0.0)) * F.col("w")).alias("target"))
    )


def _cut(slim: DataFrame, sources: DataFrame, bits: int = 8, steps: int = 2) -> DataFrame:
    """source -> source_size, target, whole (repetitions of all), last (largest hash taken once more; null: none)."""
    spark = slim.sparkSession
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = sources.withColumn("whole", F.floor(rate).cast("long")).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    at = at.withColumn("prefix", F.lit(0).cast("long")).withColumn("base", F.lit(0).cast("long"))
    for step in range(1, steps + 1):
        # In the bucket that holds the cut, words by the next bits of the hash.
        high, low = F.shiftright("h", 60 - bits * (step - 1)), F.shiftright("h", 60 - bits * step)
        a, d = at.alias("a"), slim.withColumn("high", high).withColumn("low", low).groupBy("source", "high", "low").agg(F.sum("size").alias("n")).alias("d")
        inside = d.join(a, F.col("d.source").eqNullSafe(F.col("a.source")) & (F.col("d.high") == F.col("a.prefix")))
        upto = F.sum("n").over(Window.partitionBy("a.source").orderBy("low"))
        found = inside.withColumn("end", F.col("base") + upto).where(F.col("end") - F.col("n") <= F.col("extra"))
        last = found.groupBy(F.col("a.source").alias("source")).agg(F.max(F.struct("low", (F.col("end") - F.col("n")).alias("begin"))).alias("m"))
        b = last.alias("b")
        at = at.alias("a").join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "left").select(
            "a.source", "source_size", "target", "whole", "extra", F.col("m.low").alias("prefix"), F.col("m.begin").alias("base")
        )
        at = stage_at(at, new_path(spark, "mix-cut"))
    a, d = at.alias("a"), slim.where("size > 0").withColumn("low", F.shiftright("h", 60 - bits * steps)).groupBy("source", "low", "h").agg(F.sum("size").alias("n")).alias("d")
    inside = d.join(a, F.col("d.source").eqNullSafe(F.col("a.source")) & (F.col("d.low") == F.col("a.prefix")))
    upto = F.sum("n").over(Window.partitionBy("a.source").orderBy("h"))
    taken = inside.withColumn("mid", F.col("base") + upto - F.col("n") / 2).where(F.col("mid") <= F.col("extra"))
    last = taken.groupBy(F.col("a.source").alias("source")).agg(F.max("h").alias("h")).alias("b")
    # Without a document in the cut's own bucket, all buckets before it are taken.
    below = F.shiftleft("prefix", 60 - bits * steps) - 1
    return at.alias("a").join(last, F.col("a.source").eqNullSafe(F.col("b.source")), "left").select(
        "a.source", "source_size", "target", "whole", F.when(F.col("extra") > 0, F.coalesce("b.h", below)).alias("last")
    )


def plan(docs: DataFrame, weights=WEIGHTS, max_epochs: int = 3, seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(slim table of key, source, size, h; one row a source with its target and cut)."""
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of_text(F.col(text)).alias("size"), order_hash(F.col(key), seed).alias("h"))
    slim = stage_at(slim, new_path(spark, "mix-slim"))
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stage_at(targets(sources, weights, max_epochs), new_path(spark, "mix-targets"))
    return slim, stage_at(_cut(slim, sources), new_path(spark, "mix-plan"))


def _salted(rows: DataFrame, source: str, h: str, cut: DataFrame, salts: int = 32) -> DataFrame:
    """rows with the columns of their source's plan.

    Spark broadcasts the plan if its files are small enough; else both sides
    are dealt by source and salt, so that a hot source spreads.
    """
    n = with_columns_free(["salt", "source", "psalt"], [*rows.columns, *cut.columns])
    left = rows.withColumn(n["salt"], F.pmod(F.col(h), F.lit(salts)).cast("int"))
    right = cut.withColumnRenamed("source", n["source"]).withColumn(n["psalt"], F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    on = F.col(source).eqNullSafe(F.col(n["source"])) & (F.col(n["salt"]) == F.col(n["psalt"]))
    return left.join(right, on).drop(n["salt"], n["source"], n["psalt"])


def _repeats() -> Column:
    return F.col("whole") + F.coalesce((F.col("h") <= F.col("last")).cast("long"), F.lit(0))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """key, size, source_size, target, taken (words, repeats counted) of every row."""
    slim, cut = plan(docs, **options)
    key = options.get("key", "doc_id")
    rows = _salted(slim, "source", "h", cut)
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * _repeats()).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves, each as often as the mix takes it, with the columns of ``docs``."""
    _, cut = plan(docs, **options)
    key, source = options.get("key", "doc_id"), options.get("source", "source")
    n = with_columns_free(["h", "whole", "last", "times"], docs.columns)
    cut = cut.select(F.col("source"), F.col("whole").alias(n["whole"]), F.col("last").alias(n["last"]))
    rows = _salted(docs.withColumn(n["h"], order_hash(F.col(key), options.get("seed", SEED))), source, n["h"], cut)
    times = F.col(n["whole"]) + F.coalesce((F.col(n["h"]) <= F.col(n["last"])).cast("long"), F.lit(0))
    times = F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn(n["times"], F.explode(times)).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0e0 WHEN 1 THEN 2.0e0 ELSE 1.0e0 END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size / w AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s
), l AS (
  SELECT *, (total - 3 * coalesce(CAST(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
            / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), t AS (
  SELECT source, source_size, least(3.0e0 * source_size, coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), 0.0e0) * w) AS target FROM l
), x AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), y AS (
  SELECT d.doc_id, d.size, x.source_size, x.target, x.whole, x.target - x.whole * x.source_size AS extra,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS UNBOUNDED PRECEDING) AS DOUBLE) - d.size / 2.0e0 AS mid
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN extra > 0 AND mid <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM y
"""
