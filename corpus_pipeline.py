"""A training-corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept,
and gives rows with the columns of documents; the last one gives the packed
pieces.  ``run`` writes each stage's rows to the shared scratch folder as
Parquet and rereads them, so that a lost executor never sends the work back
over several stages; a stage's rows are deleted once its successor's are written.

Defined cases: a null text counts as empty and passes a stage like any other
(empty texts are one group of exact copies); of rows that repeat id and text
one stays; rows of one id with different texts are documents each; a null id
stays unless its text has a copy with an id; labels that are missing, null or
contradict each other aren't used, and without any all documents pass the
first stage; empty tables give no rows; other columns pass up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from climekin.llm import exact_dedup, mixing, near_dedup, packing, quality
from climekin.llm.scratch import Tables


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts; it is fitted on the labelled ones that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    return quality.keep_good(docs, quality.fit_on(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 of five-word shingles) the row with the smallest id."""
    return near_dedup.deduplicate(docs, percent=80, bands=30, rows=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the source mix takes them."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, function in STAGES:
        after = Tables(spark)
        docs = after.stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before:
            before.drop()
        before = after
    return docs
