"""Token counts through a digest cache.

The cache is a Parquet dataset (digest, tokenizer, n_tokens): the SHA-256 of
the normalised content, the digest of the tokenizer's version, the count.
A run joins its documents to the cache, encodes one document for each
distinct digest that misses, appends those counts, and joins again.  Content
is normalised only where that can't change a count: null becomes empty.

Defined cases: null text counts as empty (0 tokens); rows that repeat a text
or a key each get a row; null keys are kept; an empty table gives no rows;
other columns are ignored.  Concurrent runs may append a count twice; reads
take one row for each digest.

Scale: one pass over the texts makes a slim table of digests; a second pass
encodes the misses that stand alone where they lie.  Of the texts that repeat
one row each is encoded, after an aggregation that leaves one for each task
and digest.  The table of digests to leave out is broadcast while it takes at
most scratch.BROADCAST_BYTES; beyond, texts are shuffled by digest once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climekin.llm.encoding import counter, file_digest
from climekin.llm.scratch import Tables, exists, new_path, small

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def _cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache) if exists(spark, cache) else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row; appends to ``cache``."""
    spark = docs.sparkSession
    version = file_digest(tokenizer)
    content = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(key).alias("k"), F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("t"))
    tables = Tables(spark)
    slim = tables.stage(keyed.select("k", "digest", F.octet_length("t").cast("long").alias("n_bytes")), "count-digests")
    hits = _cached(spark, cache, version).select("digest", F.lit(True).alias("hit"))
    state = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).join(hits, "digest", "left")
    state = tables.stage(state.select("digest", "n", F.coalesce("hit", F.lit(False)).alias("hit")).where("hit or n > 1"), "count-state")

    # A digest that misses is encoded once: where it lies if one row has it, else as one row of those that have it.
    known, repeated = (small(tables.stage(state.where(c).select("digest"), "count-part")) for c in ("true", "not hit"))
    alone = keyed.join(known, "digest", "left_anti").select("digest", "t")
    others = keyed.join(repeated, "digest", "left_semi").groupBy("digest").agg(F.first("t").alias("t"))

    def encode(batches):
        count = counter(tokenizer)
        for batch in batches:
            numbers = [count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(numbers), pa.string()), pa.array(numbers, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    for misses in (alone, others):
        misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    out = slim.join(_cached(spark, cache, version), "digest").select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    return tables.result(out, "counts")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an empty cache, so that its time is that of encoding every distinct text."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "count-cache"))
