"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR: folder with the tables (default /root/testdata/sf0.1); BENCH_CPUS: local threads (default 8);
BENCH_QUERIES: comma-separated names instead of the headline list.
"""
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = """a27_basin_report n1_trace_outlets j2_within_distance_best j3_nearest_join j4_nearest_within j6_within_buffer_semi j10_ring_join
j11_exclude_near w1_along_track_distance w2_along_track_prominence w3_planar_prominence w6_hourly_level_change a3_macro_report a7_threshold_sweep
a10_rank_metrics a12_robust_block_overall a14_grid_stats a18_resolve_heights a24_domain_shift a33_compare_runs p3_segment_equal p21_quantise
g2_three_way_split g5_balanced_sample r6_stitch_feather r16_connected_components r18_skeletonize u5_mosaic_in_order w11_tpi""".split()


def main() -> None:
    from bermline.plans.registry import all_queries
    from bermline.session import session

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    todo = all_queries()
    spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the engine
    times = {}
    for n in names:
        t = time.perf_counter()
        todo[n](spark, d).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(n, times[n], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(d).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
