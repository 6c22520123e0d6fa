"""One refresh of all reports that reads the item lines once.

Every report starts from delivered lines, summed by order, seller and product. That table is stored
once per version of the input and takes the place of ``order_items`` in the reports' plans, which
are the same functions as without it. The name of the stored table is a digest of the input's
files, so a refresh after a new load makes a new one and a refresh without one makes none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from basketry.operators.orders import reduced_lines
from basketry.plans import features, reports, segments
from basketry.schema import Tables


def _digest(t: Tables) -> str:
    files = sorted(f for name in ("orders", "order_items") for f in t[name].inputFiles())
    return hashlib.sha256("\n".join(files).encode()).hexdigest()[:32]


def _is_stored(spark: SparkSession, folder: str) -> bool:
    """Whether a write of ``folder`` was completed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def shared_lines(t: Tables, directory: str) -> Tables:
    """The tables with stored, reduced lines in the place of ``order_items``."""
    spark = t["orders"].sparkSession
    folder = f"{directory}/lines-{_digest(t)}"
    lines = reduced_lines(t)
    if not _is_stored(spark, folder):
        lines.write.mode("overwrite").parquet(folder)
    return t | {"order_items": spark.read.schema(lines.schema).parquet(folder)}


def refresh(
    t: Tables, directory: str, years: Sequence[int] | None = None, days: int = segments.CHURN_DAYS
) -> dict[str, DataFrame]:
    """All frames of the dashboard by name, lazy; ``directory`` keeps what they share."""
    shared = shared_lines(t, directory)
    view = features.customer_features(shared)
    return {
        "features": segments.rfm_segment(view),
        "timeline": reports.monthly_timeline(shared, years),
        "states": reports.by_state(shared),
        "review_scores": reports.review_scores(shared),
        "payments": reports.payment_types(shared),
        "sellers": reports.top_sellers(shared),
        "categories": reports.top_categories(shared),
        "kpis": reports.kpis(shared, features.rfm_base(shared), years, days),
    }
