"""Headline queries, timed to a no-op sink. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402
from wayfold.session import local_session  # noqa: E402

HEADLINE = (
    "assoc_nearest", "interp_split", "ate_planar_fit", "rpe_planar", "kitti_segments_se3", "health_states",
    "stage_latency", "cumulative_distance", "voxel_first", "voxel_two_level", "deskew", "surface_map", "ndt_score",
    "closest_map_point", "cell_stats", "local_features", "dead_reckon",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
