"""Spark settings the plans are written for."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# AQE coalesces small shuffle partitions and splits skewed join partitions; timestamps
# carry no zone, so the session zone only matters for display.
SETTINGS: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(
    app: str = "basketry", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """A session with ``SETTINGS`` and ``conf``; pass ``master`` only outside spark-submit.

    On a large cluster raise ``spark.sql.shuffle.partitions`` until a partition of the
    largest shuffle stays near 200 MB and let AQE merge the small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> str:
    """Send this package to the Python workers of all executors; the archive's path.

    Not needed where the package is installed on every machine. Only operators with Python
    functions import it there; the marketplace plans have none.
    """
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="basketry-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    return str(archive)
