"""Quality scores learned from preference pairs (Bradley-Terry).

A document's strength is linear in its features.  Fitting draws seeded pairs
of a good and a bad labelled document and minimises the logistic loss on the
difference of their features; so only the order of strengths counts.  The
strengths of the labelled rows then give the threshold: the quantile that
leaves below it as large a share as the bad labels have, chosen between the
neighbours with fewest errors.  Scores are a logistic of strength, placed so
that the threshold maps to ``THRESHOLD``.

Features come from the text alone: shares of character kinds, words and
lines, and their repetition.  Whole texts are read.

Defined cases: null text counts as empty and gets the score of its features
like any other; labelled rows whose label or id is null, or whose document is
missing, are not used; labels that all agree (or none) give the score 0.5 to
every text; rows that repeat an id get a score each, an id with labels that differ
isn't used to fit, and of a labelled id each different text is; an empty table gives no
rows; other columns pass through ``keep_good``.

Bound: at most ``FIT_ROWS`` labelled rows (the smallest seeded hashes) are
used to fit and are the only rows that reach the driver, as features.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climekin.llm.scratch import release_memory, with_columns_free

#: Labelled rows used to fit, at most.
FIT_ROWS = 12_000
#: Preference pairs drawn.
PAIRS = 20_000
THRESHOLD = 0.3

_MARKS = [ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
_RUN = re.compile(rb"([^\s\w])\1\1")


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a text; none depends on the language's words."""
    b = (text or "").encode()
    n = max(1, len(b))
    h = np.bincount(np.frombuffer(b, np.uint8), minlength=256) if b else np.zeros(256, np.int64)
    words = b.split()
    w = max(1, len(words))
    distinct = len(set(words))
    lines = [x for x in b.split(b"\n") if x.strip()]
    ln = max(1, len(lines))
    upper, lower, digits = h[65:91].sum(), h[97:123].sum(), h[48:58].sum()
    marks = h[_MARKS]
    pairs = len(set(zip(words, words[1:])))
    out = [
        math.log1p(len(b)), math.log1p(len(words)), upper / n, lower / n, digits / n, h[128:].sum() / n, (h[:32].sum() - h[10]) / n,
        upper / max(1, upper + lower), marks.sum() / n, len(b) / w, distinct / w, pairs / max(1, w - 1), math.log(w / max(1, distinct) ), math.log(max(1, w - 1) / max(1, pairs)),
        len(set(lines)) / ln, math.log1p(ln), math.log1p(len(b) / ln), len(_RUN.findall(b)) / w, h[10] / n, float(not words),
    ]
    # Shares of marks by word, bounded, since one kind may dominate.
    return np.concatenate((out, np.minimum(marks / w, 2.0)))


class Model:
    """Weights of a fitted ranking; ``score`` maps feature rows to 0..1."""

    def __init__(self, mean, std, weights, threshold, slope):
        self.mean, self.std, self.weights, self.threshold, self.slope = mean, std, weights, threshold, slope

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -6, 6)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self._scaled(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        z = self.slope * (self.strength(x) - self.threshold) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7, steps: int = 150, decay: float = 1e-4) -> Model:
    """Bradley-Terry weights from feature rows and 0/1 labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(None, None, None, None, None)
    mean, std = x.mean(axis=0), x.std(axis=0)
    model = Model(mean, np.where(std > 1e-9, std, 1.0), np.zeros(x.shape[1]), 0.0, 1.0)
    rng, s = np.random.default_rng(seed), model._scaled(x)
    d = s[rng.choice(good, pairs)] - s[rng.choice(bad, pairs)]
    # Adam on the whole set of pairs; the loss is convex.
    w, m, v = model.weights, 0.0, 0.0
    for t in range(1, steps + 1):
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -500, 500))))[:, None]).mean(axis=0) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights = w
    r = s @ w
    # The quantile at the share of bad labels, or the near one with fewest errors.
    share = len(bad) / len(y)
    cuts = np.quantile(r, np.clip(np.linspace(0.5 * share, min(1.0, 1.5 * share), 201), 0, 1))
    errors = [(np.mean(r[good] < c) + np.mean(r[bad] >= c), abs(i - 100)) for i, c in enumerate(cuts)]
    best = min(range(len(cuts)), key=errors.__getitem__)
    below, above = r[r < cuts[best]], r[r >= cuts[best]]
    model.threshold = (below.max() + above.min()) / 2 if len(below) and len(above) else cuts[best]
    model.slope = 1.0 / max(1e-9, r.std())
    return model


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Model:
    """A model from labelled documents, on at most ``rows`` of them."""
    spark = docs.sparkSession
    got = labels.select(F.col(key).cast("long").alias("lk"), F.col(label).cast("int").alias("y")).where("lk is not null and y in (0, 1)")
    some = got.groupBy("lk").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    some = some.orderBy(F.xxhash64("lk", F.lit(17)), "lk").limit(rows)
    texts = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # The broadcast side has at most ``rows`` rows.
    labelled = texts.join(F.broadcast(some), F.col("k") == F.col("lk")).select("k", "y", "t")

    def measure(batches):
        for batch in batches:
            x = [features(t.as_py()).tolist() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["k", "y", "x"])

    measured = labelled.mapInArrow(measure, "k long, y int, x array<double>").distinct()
    # The bound holds for rows that repeat labelled ids, too.
    table = measured.orderBy(F.xxhash64("k", F.lit(17)), "k", "x").limit(rows).toPandas()
    if table.empty:
        return Model(None, None, None, None, None)
    table = table.sort_values("k", kind="stable")
    return fit(np.array(table["x"].tolist()), table["y"].to_numpy())


def _scorer(model: Model):
    def score(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)])
            s = model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["k", "score"])

    return score


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    texts = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return texts.mapInArrow(_scorer(model), "k long, score double").withColumnRenamed("k", key)


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with the columns of ``docs``."""
    n = with_columns_free(["good"], docs.columns)["good"]

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t) for t in texts])) >= threshold if len(texts) else [], dtype=bool)
        release_memory()

    return docs.withColumn(n, good(F.col(text))).where(n).drop(n)


def held_out(key: str = "doc_id"):
    """Whether crc32 of the id as text leaves 0 modulo 5."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = score_documents(docs, fit_on(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
