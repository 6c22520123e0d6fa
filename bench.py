"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the local cores. The tables are
loaded first (stored as typed Parquet, like any import); queries read the stored tables.
Every query runs to the end and all result columns are produced. ``queries`` holds the
median in seconds, building the plan included, of runs after the code is compiled;
``cold`` the first run. ``refresh`` is the time of a dashboard refresh, all its frames run one after
the other, with and without the lines that they share.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from basketry.plans import features, preview, quality, reports, segments
from basketry.session import build_session
from basketry.sources.files import load_tables, write_tables
from basketry.sources.retail import retail_tables

WARM_UP, WARM_RUNS = 3, 5


def _segmented(t):
    return segments.rfm_segment(features.rfm_base(t))


QUERIES = {
    "customer_features": features.customer_features,
    "customer_features_first10": preview.customer_features_first,
    "top_sellers": reports.top_sellers,
    "rfm_base": features.rfm_base,
    "basket_trend": features.basket_trend,
    "basket_changes": features.basket_changes,
    "customer_rank": features.customer_rank,
    "monthly_timeline": reports.monthly_timeline,
    "top_categories": reports.top_categories,
    "top_customers": lambda t: segments.top_customers(_segmented(t)),
    "kpis": lambda t: reports.kpis(t, features.rfm_base(t)),
    "order_ledger": reports.order_ledger,
}


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "basketry-bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory(prefix="bench-") as directory:
        raw = quality.clean(retail_tables(spark, sf_dir))
        # The test files hold one row group each; several files let the scan use all cores.
        spread = {name: df.repartition(int(cpus)) for name, df in raw.items()}
        load = timed(lambda: write_tables(spread, directory))
        tables = load_tables(spark, directory)
        cold, warm = {}, {}
        for name, query in QUERIES.items():

            def run(query=query):
                query(tables).write.format("noop").mode("overwrite").save()

            cold[name] = round(timed(run), 3)
            for _ in range(WARM_UP):
                run()
            warm[name] = round(statistics.median(timed(run) for _ in range(WARM_RUNS)), 3)
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "customer feature view, whole result, warm median",
                "value": warm["customer_features"],
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "load": round(load, 3),
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
