"""Focal points as a stream against a static reference table.

Each micro-batch is a search of its own: the result for a focal point
depends on no other, so no state is kept and late points are as good as
early ones.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from climekin import api


def search_stream(focal: DataFrame, ref: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Start a search of a streaming ``focal``; results go to Parquet under ``out``, a folder for each batch.

    A batch that runs again after a failure overwrites its own folder.
    ``options`` are those of ``api.search``; give ``coord_type``, as a batch
    alone may not show it.
    """

    def run(batch: DataFrame, number: int) -> None:
        api.search(batch, ref, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return focal.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def search_stream_once(spark: SparkSession, focal: DataFrame, ref: DataFrame, **options) -> DataFrame:
    """Run ``focal`` through a stream once and return all results."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/climekin-scratch"
    path = f"{base.rstrip('/')}/climekin/stream-{uuid.uuid4().hex}"
    focal.write.parquet(f"{path}/in")
    rows = spark.readStream.schema(focal.schema).parquet(f"{path}/in")
    search_stream(rows, ref, f"{path}/out", f"{path}/state", focal_id="id", ref_id="id", **options).awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")
