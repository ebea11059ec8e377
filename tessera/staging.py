"""Cutting plans: a result that several later steps read is written to the checkpoint folder, so neither it nor its plan is repeated. Joins of two large sides."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that spark.checkpoint.dir names; a local session without one gets a folder of its own."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join whose two sides grow with the input: rows meet by their keys on the executors, so neither side passes through the driver whatever size is reckoned for it."""
    return df.hint("merge")
