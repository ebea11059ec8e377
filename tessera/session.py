"""Making the package importable where Spark starts Python workers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> None:
    """Adds the repository to the workers' path; on a cluster it is also sent there by --py-files."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in have:
        env["PYTHONPATH"] = ":".join([*have, ROOT])
