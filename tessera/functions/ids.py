"""Stable ids from content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_id(kind: str, *parts: Column) -> Column:
    """kind- and 12 hex digits of the hash of the parts, joined by a unit separator."""
    return F.concat(F.lit(f"{kind}-"), F.left(F.sha2(F.concat_ws("\u001f", *(p.cast("string") for p in parts)), 256), F.lit(12)))


def with_instance_ids(df: DataFrame, kind: str, key: list[str], order: list[str], name: str = "id") -> DataFrame:
    """Adds an id by key; rows that share a key get their place in order as a last part, a key's only row does not."""
    w = Window.partitionBy(*key)
    place = F.row_number().over(w.orderBy(*order))
    parts = [F.col(k) for k in key]
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", place).withColumn(name, F.when(F.col("_n") == 1, stable_id(kind, *parts)).otherwise(stable_id(kind, *parts, F.col("_i")))).drop("_n", "_i")


def content_id(kind: str, value: Column) -> Column:
    """By the JSON of a struct, whose fields are in a fixed order."""
    return stable_id(kind, F.to_json(value))
