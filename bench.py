"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the tables; BENCH_CPUS: local cores. Each query runs once to
warm up the JVM on its plan and once timed, with the whole result computed. The long
model queries then run once, each at full size. At BENCH_SECONDS (900) the jobs of the one that runs are
cancelled; it and those after it are named in ``left_out``. The line is printed whatever happened, so it is there
even if a query fails: such queries are named in ``failed``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark import InheritableThread

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shelfcast.plans import queries  # noqa: E402
from shelfcast.plans.queries import LONG, all_queries  # noqa: E402
from shelfcast.session import build_session, scratch  # noqa: E402

HEADLINE = (
    "panel",
    "rolling_features",
    "training_frame",
    "lookback_sequence_samples",
    "direct_horizon_windows",
    "dataset_overview",
    "sales_moments",
    "sales_percentiles",
    "sales_histogram",
    "boxplot_stats",
    "extremes",
    "key_counts",
    "standard_scale",
    "minmax_scale_per_series",
    "acf",
    "pacf",
    "panel_acf",
    "naive_metrics",
    "metrics_by_window",
    "horizon_matrix",
    "results_matrix",
    "persistence_forecast",
    "linear_trend_path",
    "holt_winters",
    "recursive_mean_forecast",
    "linear_regression",
    "decision_tree",
    "sequence_huber",
    "recursive_linear_forecast",
    "chosen_pair_scores",
    "per_series_ridge_predictions",
)


def timed(spark, build, folder: str) -> float:
    with scratch(spark):
        started = time.perf_counter()
        build(spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)


def within(spark, seconds: float, work) -> float | None:
    """The result of work, or None if it took longer; its jobs are then cancelled."""
    found = {}

    def run() -> None:
        try:
            found["value"] = work()
        except Exception as error:
            found["error"] = error

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(max(seconds, 0))
    if thread.is_alive():
        spark.sparkContext.cancelAllJobs()
        return None
    if "error" in found:
        raise found["error"]
    return found["value"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or (*HEADLINE, *LONG)
    began, limit = time.perf_counter(), float(os.environ.get("BENCH_SECONDS", "900"))
    left = lambda: limit - (time.perf_counter() - began)
    queries.REUSE_MODELS = False  # every fit is timed
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.scheduler.mode": "FAIR",
            "spark.checkpoint.dir": os.environ.get("BENCH_SCRATCH", "/tmp/shelfcast-bench"),
            # The tables are tiny here: without this, shuffles shrink to fewer tasks than cores.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    registered = all_queries()
    seconds, left_out, failed = {}, [], []
    for name in only:
        for again in (False,) if name in LONG else (False, True):
            try:
                found = None if left() <= 0 else within(spark, left(), lambda: timed(spark, registered[name], folder))
            except Exception as error:
                print(name, str(error)[:300], file=sys.stderr, flush=True)
                failed.append(name)
                break
            if found is None:
                if not again:
                    left_out.append(name)
                break
            seconds[name] = found
        print(name, seconds.get(name), file=sys.stderr, flush=True)
    result = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(s for name, s in seconds.items() if name not in LONG), 3),
        "unit": "sec",
        "queries": seconds,
        "left_out": left_out,
        "failed": failed,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)
    # Threads of a cancelled fit may still wait; nothing is left to do.
    os._exit(0)


if __name__ == "__main__":
    main()
