"""Entity matching: unique on both sides, by one key and then by a coarser one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(df: DataFrame, key: list[str], ident: str, side: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias(f"{side}_n"), F.min(ident).alias(f"{side}_id"))


def unique_pairs(a: DataFrame, b: DataFrame, key: list[str], ident: str) -> DataFrame:
    """key, a_n, a_id, b_n, b_id for each key of either side; a pair is unique where both counts are 1. Keys that are null match nothing."""
    there = None
    for k in key:
        there = F.col(k).isNotNull() if there is None else there & F.col(k).isNotNull()
    return _counted(a.where(there), key, ident, "a").join(_counted(b.where(there), key, ident, "b"), key, "full_outer")


def match_entities(a: DataFrame, b: DataFrame, page: list[str], signature: list[str], role: list[str], ident: str = "id") -> DataFrame:
    """page, a_id, b_id, confidence, status for every entity of either side.

    First by signature, where it names exactly one entity on each side (high); the others by role, where that does (medium). What shares its role with
    entities of the other side without being unique is ambiguous, the rest unmatched. Two aggregations and joins for each pass, never all pairs of a key.
    """
    one = unique_pairs(a, b, [*page, *signature], ident).where("a_n = 1 and b_n = 1").select(*page, "a_id", "b_id")
    rest_a = a.join(one.select(F.col("a_id").alias(ident), *page), [*page, ident], "left_anti")
    rest_b = b.join(one.select(F.col("b_id").alias(ident), *page), [*page, ident], "left_anti")
    key = [*page, *role]
    coarse = unique_pairs(rest_a, rest_b, key, ident)
    two = coarse.where("a_n = 1 and b_n = 1").select(*page, "a_id", "b_id")
    open_keys = coarse.where("not (coalesce(a_n, 0) = 1 and coalesce(b_n, 0) = 1)").select(*key, (F.coalesce("a_n", F.lit(0)) * F.coalesce("b_n", F.lit(0)) > 0).alias("both"))
    status = F.when(F.col("both"), "ambiguous").otherwise("unmatched")
    none = F.lit(None)
    left = rest_a.join(open_keys, key).select(*page, F.col(ident).alias("a_id"), none.cast(b.schema[ident].dataType).alias("b_id"), none.cast("string").alias("confidence"), status.alias("status"))
    right = rest_b.join(open_keys, key).select(*page, none.cast(a.schema[ident].dataType).alias("a_id"), F.col(ident).alias("b_id"), none.cast("string").alias("confidence"), status.alias("status"))
    matched = lambda df, c: df.select(*page, "a_id", "b_id", F.lit(c).alias("confidence"), F.lit("matched").alias("status"))
    return matched(one, "high").unionByName(matched(two, "medium")).unionByName(left).unionByName(right)


def near(df: DataFrame, other: DataFrame, on: list[str], x: str, y: str, tolerance: float, how: str = "inner") -> DataFrame:
    """Rows of df with rows of other that share on and lie within tolerance of each other: an equi-join on buckets as wide as the tolerance, looked up with their neighbours.

    df's x and other's y; both tables' other columns must differ in name.
    """
    step = tolerance if tolerance > 0 else 1.0
    own = df.withColumn("_b", F.floor(F.col(x) / step))
    reach = other.withColumn("_b", F.explode(F.array(*(F.floor(F.col(y) / step) + d for d in (-1, 0, 1)))))
    keep = F.abs(F.col(x) - F.col(y)) <= tolerance + 1e-9
    if how == "left_semi":
        return own.join(reach, [own[k] == reach[k] for k in [*on, "_b"]] + [keep], how).drop("_b")
    return own.join(reach, [*on, "_b"], how).where(keep).drop("_b")


def agreement(column: Column, total: Column, least: float = 0.75) -> Column:
    """Whether the most frequent value has so great a share."""
    return F.max(column) / total >= least
