"""The catalogue's whole searches: every point of the focal table is asked."""

import os

import numpy as np
import pytest

from climekin import queries
from climekin.sources.synthetic import grid

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_velocity_grid_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(queries, "_grid", lambda *_: (grid(spark, 24, 1), grid(spark, 24, 2)))
    f, r = (grid(spark, 24, e).orderBy("id").toPandas() for e in (1, 2))
    clim = np.hypot(f["t"].to_numpy()[:, None] - r["t"].to_numpy(), f["p"].to_numpy()[:, None] - r["p"].to_numpy())
    geog = np.hypot(f["x"].to_numpy()[:, None] - r["x"].to_numpy(), f["y"].to_numpy()[:, None] - r["y"].to_numpy())
    geog[clim > 0.5] = np.inf
    want = {i + 1: int(g.argmin()) + 1 for i, g in enumerate(geog) if g.min() < np.inf}
    got = {x["focal_index"]: x["analog_index"] for x in queries.QUERIES["velocity_grid"](spark, "").collect()}
    assert len(want) > 300 and got == want


@needs_data
def test_every_vector_is_a_focal_point(spark):
    ids = {x["id"] for x in spark.read.parquet(f"{DATA}/embeddings.parquet").selectExpr("CAST(vec_id + 1 AS INT) AS id").collect()}
    names = [n for n, (t, _, _) in queries.CATALOGUE.items() if t == "xy"]
    assert len(names) == 11
    for n in names:
        got = queries.QUERIES[n](spark, DATA).select("focal_index").distinct().collect()
        found = {x["focal_index"] for x in got}
        # Each vector is its own match at distance 0.
        assert found == ids, n
