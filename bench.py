"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR: one warm-up, then $BENCH_REPEATS runs of each; prints one JSON line.

value is the sum of the medians. shuffle_mb is what a run wrote to shuffles. The warm-up runs on the smallest tables.
"""

import json
import os
import statistics
import sys
import time

from landfold.catalogue import spark_queries
from landfold.session import build_session

HEADLINE = (
    "d1_attribute_points", "d4_nearest_line", "d5_nearest_polygon", "d6_smallest_containing", "d7_triangles_to_cells",
    "d8_ray_hits", "d10_overlap_match", "d25_sample_dem_bilinear", "e8_component_stats", "e9_error_stats", "e11_coverage",
    "e15_top_surface", "e17_merge_intervals", "e20_triangulate", "e25_fit_affine", "f6_rolling_quantiles", "g1_nearest_of_type",
    "g3_components", "h4_inventory_diff", "t3_greedy_budget", "k1_attribution_cascade", "k13_identity_audit", "l1_latency_windows",
)


def shuffle_bytes(spark) -> int:
    """Bytes written to shuffles so far, from the stages Spark keeps."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats, warm = int(os.environ.get("BENCH_REPEATS", "1")), int(os.environ.get("BENCH_WARMUP", "1"))
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    catalogue, seconds, moved = spark_queries(), {}, {}
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in HEADLINE:
        for _ in range(warm):  # compiles the plan's code on the smallest tables
            catalogue[name](spark, small if os.path.isdir(small) else folder).write.format("noop").mode("overwrite").save()
        runs, before = [], shuffle_bytes(spark)
        for _ in range(repeats):
            start = time.time()
            out = catalogue[name](spark, folder)
            out.write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        seconds[name] = round(statistics.median(runs), 3)
        moved[name] = round((shuffle_bytes(spark) - before) / 1e6 / repeats, 2)
        print(name, seconds[name], moved[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "shuffle_mb": moved,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


main()
