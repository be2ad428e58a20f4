"""Connected components of a link table, without collecting it anywhere.

Every task first reduces its own links with union-find to a spanning forest.
Then rounds of hooking and pointer jumping follow: each node points to its
smallest neighbour, pointers jump once, links are rewritten to where their
ends point, and links within one target vanish.  Tables shrink by half or
more in a round.  Rounds read written tables, so lineage stays short.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climekin.llm.scratch import Tables


def _forest(batches):
    """Links of one task -> (node, root) for its nodes that aren't roots."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "v"])


def connect(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """links (u long, v long) -> (node, root): the smallest node that each node reaches, for nodes other than roots.

    The result and what lies behind it are scratch tables of ``tables``.
    """
    spark = links.sparkSession
    stage = (tables or Tables(spark)).stage
    links = stage(links.select("u", "v").where("u <> v").mapInArrow(_forest, "u long, v long").distinct(), "links")
    labels = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("root"))
    while not links.isEmpty():
        parents = links.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("p"))
        up = parents.select(F.col("x").alias("px"), F.col("p").alias("pp"))
        jumped = stage(parents.join(up, F.col("p") == F.col("px"), "left").select("x", F.coalesce("pp", "p").alias("to")), "jumped")
        a, b = (jumped.select(F.col("x").alias(f"x{i}"), F.col("to").alias(f"to{i}")) for i in "ab")
        ends = links.join(a, F.col("u") == F.col("xa")).join(b, F.col("v") == F.col("xb"), "left")
        ends = ends.select(F.col("toa").alias("s"), F.coalesce("tob", "v").alias("t")).where("s <> t")
        nxt = stage(ends.select(F.greatest("s", "t").alias("u"), F.least("s", "t").alias("v")).mapInArrow(_forest, "u long, v long").distinct(), "links")
        moved = labels.join(a, F.col("root") == F.col("xa"), "left").select("node", F.coalesce("toa", "root").alias("root"))
        new = jumped.select(F.col("x").alias("node"), F.col("to").alias("root")).join(labels.select("node"), "node", "left_anti")
        labels = stage(moved.unionByName(new), "labels")
        links = nxt
    return labels


def relabel(labels: DataFrame, links: DataFrame, tables: Tables) -> DataFrame:
    """Labels after more links: (node, root) of ``labels`` and ``links`` together."""
    if links.isEmpty():
        return labels
    a, b = (labels.select(F.col("node").alias(f"n{i}"), F.col("root").alias(f"r{i}")) for i in "ab")
    roots = links.join(a, F.col("u") == F.col("na"), "left").join(b, F.col("v") == F.col("nb"), "left")
    found = connect(roots.select(F.coalesce("ra", "u").alias("u"), F.coalesce("rb", "v").alias("v")), tables)
    f = found.select(F.col("node").alias("fn"), F.col("root").alias("fr"))
    moved = labels.join(f, F.col("root") == F.col("fn"), "left").select("node", F.coalesce("fr", "root").alias("root"))
    return tables.stage(moved.unionByName(found.join(labels.select("node"), "node", "left_anti")), "labels")
