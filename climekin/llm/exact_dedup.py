"""Exact deduplication as a stateful stream, in DataFrame operations only.

Keys go through a Structured Streaming aggregation whose state lies on disk
(RocksDB) and never expires: for each digest it retains the stable
identifier and the locator (file and row) of the row that stays, and the
number of rows.  With a lasting ``state`` folder a later run goes on from
that state, so new documents are held against all earlier ones.

A hit is a digest with more than one row.  The full bytes of the run's hits are
then compared, also with those of an earlier run's row, which is read through
the locator that the state has retained.  A digest whose rows differ is noted in the state
and resolved by full texts, those of earlier runs' rows among them.

Earlier rows are known by file and place, so that a run that is repeated over
one state counts no row twice.  A frame without files is written first; a
``run`` name makes a repeated call find those rows again.  Files of earlier
runs have to stay readable where a lasting state refers to them.

Defined cases: null text equals the empty text; the largest key stays, a
null key only if the group has no other; of rows that repeat key and text
the one that comes last by file and row stays; an empty table gives no rows;
other columns pass through ``deduplicate``, also one named ``_metadata``.

Scale: the stream shuffles one partial row for each digest and task, so a
hot group arrives pre-aggregated; texts are shuffled for hits only, again
pre-aggregated.  The joins back are plain equi-joins whose large side is the
documents' digests; Spark splits a hot digest (skew join).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from climekin.llm.scratch import Tables, exists, new_path, remove, small, stage, stage_at, with_columns_free

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # Many partitions have little state each; 4 MB set aside for each one's log would be most of the disk.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def on_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs itself if files back it, so that its rows have places; else a copy, written to ``path`` unless it is there."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        path = path or new_path(docs.sparkSession, "dedup-rows")
        if not exists(docs.sparkSession, f"{path}/_SUCCESS"):
            docs.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return docs.sparkSession.read.schema(docs.schema).parquet(path)


def _renamed(docs: DataFrame) -> DataFrame:
    """docs, a column of Spark's own name for places being called otherwise."""
    free = with_columns_free(["metadata_column"], docs.columns)["metadata_column"]
    return docs.toDF(*[free if c.lower() == "_metadata" else c for c in docs.columns])


def located(docs: DataFrame, file: str, row: str) -> DataFrame:
    """docs with each row's file and place in it."""
    return docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))


def _stream(spark: SparkSession, schema: StructType, state: str) -> None:
    """Bring the keyed state up to date with the folders of keys in it; changed keys go to its folder of groups."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).parquet(f"{state}/keys/*")
        keyed = rows.groupBy("digest").agg(_last(), F.count(F.lit(1)).alias("n"))

        def put(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{state}/groups/batch={batch}")

        query = keyed.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _last() -> Column:
    """Of rows the one that stays."""
    return F.max(F.struct(F.col("key").isNotNull().alias("known"), "key", "file", "row")).alias("last")


def _texts_at(places: DataFrame, text: str) -> DataFrame:
    """places (file, row, ..) with the ``content`` found there.

    The names of the files go through the driver, as Spark's own listing of them did.
    """
    spark = places.sparkSession
    files = [r["file"] for r in places.select("file").distinct().collect()]
    there = spark.read.parquet(*files).select(F.coalesce(F.col(text), F.lit("")).alias("content"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return there.join(small(places), ["file", "row"])


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", state: str | None = None, digest=sha256, run: str | None = None) -> DataFrame:
    """key, file, row, digest, keep_id, keep_file, keep_row, group_size of every row of ``docs``.

    ``digest`` maps a text column to a binary one; any function gives right
    results, a weaker one costs more byte checks.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    lasting, state = state is not None, state or new_path(spark, "dedup-state")
    content = F.coalesce(F.col(text), F.lit(""))
    if "_metadata" in map(str.lower, docs.columns):
        docs = docs.select(F.col(key).alias("key"), F.col(text).alias("content"))
        key, text, content = "key", "content", F.coalesce(F.col("content"), F.lit(""))
    docs = on_files(docs, f"{state}/rows/{run}" if lasting and run else None)
    n = with_columns_free(["file", "row"], docs.columns)
    rows = located(docs, n["file"], n["row"])
    rows = rows.select(F.col(key).alias("key"), digest(content).alias("digest"), F.col(n["file"]).alias("file"), F.col(n["row"]).alias("row"), content.alias("content"))
    keys, history = f"{state}/keys/{uuid.uuid4().hex}", exists(spark, f"{state}/keys")
    slim = stage_at(rows.drop("content"), f"{state}/dealt/{uuid.uuid4().hex}" if history else keys)
    if history:
        # Rows that the state has counted before are left out.
        before = spark.read.schema(slim.schema).parquet(f"{state}/keys/*")
        own = before.join(small(tables.stage(slim.select("file").distinct(), "dedup-files")), "file", "left_semi").select("file", "row")
        stage_at(slim.join(own, ["file", "row"], "left_anti"), keys)
    groups = slim.select("digest", F.struct(F.lit(True).alias("known"), "key", "file", "row").alias("last"), F.lit(0).cast("long").alias("n")).schema
    if not slim.isEmpty():
        _stream(spark, slim.schema, state)
    there = exists(spark, f"{state}/groups")
    found = spark.read.schema(groups).parquet(f"{state}/groups") if there else spark.createDataFrame([], groups)
    # Groups only grow, so that the last change of a key has the most rows.
    found = found.groupBy("digest").agg(F.max(F.struct("n", "last")).alias("m")).select("digest", "m.last", "m.n")
    if history:
        found = found.join(slim.select("digest").distinct(), "digest", "left_semi")
    found = tables.stage(found, "dedup-groups")

    hits = small(tables.stage(found.where("n > 1").select(F.col("digest").alias("hit")), "dedup-hits"))
    # Full bytes of the hits: equal if the least and the greatest text are.
    checked = rows.join(hits, F.col("digest") == F.col("hit"), "left_semi").select("digest", "content")
    clashes, noted = f"{state}/clashes", None
    if history:
        # One earlier row of each hit will do: those of a digest that isn't noted are equal.
        earlier = spark.read.schema(slim.schema).parquet(f"{state}/keys/*").join(hits, F.col("digest") == F.col("hit"), "left_semi")
        earlier = earlier.join(slim.select("file", "row"), ["file", "row"], "left_anti").groupBy("digest").agg(F.max(F.struct("file", "row")).alias("m"))
        old = tables.stage(earlier.select("digest", "m.file", "m.row"), "dedup-kept")
        if not old.isEmpty():
            checked = checked.unionByName(_texts_at(old, text).select("digest", "content"))
        if exists(spark, clashes):
            noted = spark.read.schema("digest binary").parquet(f"{clashes}/*").distinct()
    checked = checked.groupBy("digest").agg(F.min("content").alias("a"), F.max("content").alias("b"))
    clash = checked.where("a <> b").select("digest")
    if noted is not None:
        clash = clash.union(noted.join(slim.select("digest").distinct(), "digest", "left_semi")).distinct()
    clash = tables.stage(clash, "dedup-clash")

    cols = ["key", "file", "row", "digest", F.col("last.key").alias("keep_id"), F.col("last.file").alias("keep_file"), F.col("last.row").alias("keep_row"), F.col("n").alias("group_size")]
    if clash.isEmpty():
        out = slim.join(found, "digest").select(*cols)
    else:
        good = slim.join(clash, "digest", "left_anti").join(found, "digest").select(*cols)
        bad = rows.join(clash, "digest", "left_semi")
        held = bad.select("content", "key", "file", "row")
        if history:
            before = spark.read.schema(slim.schema).parquet(f"{state}/keys/*").join(clash, "digest", "left_semi")
            before = tables.stage(before.join(slim.select("file", "row"), ["file", "row"], "left_anti").select("key", "file", "row"), "dedup-earlier")
            if not before.isEmpty():
                held = held.unionByName(_texts_at(before, text).select("content", "key", "file", "row"))
        exact = held.groupBy("content").agg(_last(), F.count(F.lit(1)).alias("n"))
        out = good.unionByName(bad.join(exact, "content").select(*cols))
        if lasting:
            stage_at(clash, f"{clashes}/{uuid.uuid4().hex}")
    out = tables.result(out, "dedup-result")
    if not lasting:
        remove(spark, state)
    return out


def _stays() -> Column:
    return (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256 of every row."""
    found = classes(docs, key, text, **options)
    return found.select(F.col("key").alias(key), "keep_id", "group_size", _stays().alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", state: str | None = None, run: str | None = None, **options) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    columns, plain = docs.columns, _renamed(docs)
    key, text = (plain.columns[columns.index(c)] for c in (key, text))
    docs = on_files(plain if plain.columns != columns else docs, f"{state}/rows/{run}" if state and run else None)
    n = with_columns_free(["file", "row", "drop_file", "drop_row"], docs.columns)
    rows = located(docs, n["file"], n["row"])
    found = classes(docs, key, text, state=state, run=run, **options)
    dropped = small(stage(found.where(~_stays()).select(F.col("file").alias(n["drop_file"]), F.col("row").alias(n["drop_row"])), "dedup-dropped"))
    out = rows.join(dropped, (F.col(n["file"]) == F.col(n["drop_file"])) & (F.col(n["row"]) == F.col(n["drop_row"])), "left_anti")
    return out.drop(n["file"], n["row"]).toDF(*columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
