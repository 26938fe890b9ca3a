"""Spark session factory and the few session facts that operators need."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: Of a batch that goes to Python: documents of a few thousand characters fill some MB.
MOST_ROWS, MOST_BYTES = 1000, 8 << 20
ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "tidemill") -> SparkSession:
    """A local session with the settings that the operators assume: UTC, AQE, Arrow."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed (local runs; clusters use --py-files)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of at most MOST_ROWS rows and MOST_BYTES, unless the session asks for smaller ones.

    Spark's own bound is 10,000 rows, whatever their size: with long texts that is what a worker's memory grows by.
    """
    for name, most in (("maxRecordsPerBatch", MOST_ROWS), ("maxBytesPerBatch", MOST_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        number, unit = re.match(r"(-?\d+)([kmgt]?)", spark.conf.get(key).lower()).groups()
        now = int(number) << " kmgt".index(unit or " ") * 10
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder."""
    return f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"
