"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line.

The index (graph, entry vertex, codebook, codes) is prepared first and timed on its own, as a
vector database builds its index before it is queried. One search on a single vector warms the
JVM up, untimed; each query then runs once.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "exact_knn", "filtered_knn", "beam_two_phase", "approx_knn", "beam_batch", "hybrid_search",
    "post_filter_search", "pq_encode", "pq_sdc", "pq_beam", "beam_single", "knn_graph",
]


def session(cpus: str):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    from nearfield.plans.dataset import Dataset
    from nearfield.plans.queries import registered

    data, queries = Dataset(spark, sf_dir), registered()
    rows = data.queries.count()
    prepare = timed(lambda: (data.graph, data.entry, data.codes, data.query_codes, data.lut))
    warmup = timed(lambda: queries["beam_single"](spark, sf_dir).count())
    times = {}
    for name in HEADLINE:
        run = lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = timed(run)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1],
        "prepare_sec": prepare, "warmup_sec": warmup, "query_vectors": rows,
        "qps": {n: round((1 if n == "beam_single" else rows) / t, 1) for n, t in times.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
