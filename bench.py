"""Times the headline searches and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from climekin import api, queries  # noqa: E402
from climekin.sources.synthetic import grid, sample  # noqa: E402

HEADLINE = [
    "velocity_ll", "velocity_ll_k5", "impact_ll", "impact_xy", "knn_clim_unfiltered_xy", "knn_geog_unfiltered_ll", "all_ll", "all_xy",
    "availability_ll", "availability_pervar_ll", "intensity_invclim_ll", "intensity_invgeog_ll", "mean_invgeog_xy", "antimeridian_ll",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {n: (lambda n=n: queries.QUERIES[n](spark, sf_dir)) for n in HEADLINE}
    # The harness configuration: a million cells, and a sample of them an era earlier.
    cells, later = grid(spark, 1000, 1).cache(), grid(spark, 1000, 2).cache()
    cells.count(), later.count()
    o = {"coord_type": "projected", "focal_id": "id", "ref_id": "id"}
    for n in (100, 1000, 10_000):
        some = sample(cells, n).cache()
        some.count()
        runs[f"harness_velocity_{n}"] = lambda some=some: api.velocity(some, later, 0.5, **o)
    runs["harness_impact_1000"] = lambda: api.impact(sample(cells, 1000), later, 3.0, **o)
    runs["harness_availability_1000"] = lambda: api.availability(sample(cells, 1000), cells, 0.5, 3.0, **o)
    runs["harness_intensity_1000"] = lambda: api.intensity(sample(cells, 1000), cells, 0.5, 3.0, "inverse_clim", **o)
    times = {}
    runs["velocity_ll"]().write.format("noop").mode("overwrite").save()  # starts the JVM's compiler
    for name, run in runs.items():
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    # The largest harness run is listed, but no part of the total, which stays comparable.
    total = sum(t for n, t in times.items() if not n.endswith("_10000"))
    sf = sf_dir.rstrip("/").rpartition("sf")[2]
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(total, 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
