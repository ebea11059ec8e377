"""Differences: named values, scales, maps, neighbouring captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named_diff(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """on, before, after, change: added, removed or changed names; equal values (null equals null) are left out."""
    x = a.select(*on, F.col(value).alias("before"), F.lit(True).alias("_a"))
    y = b.select(*on, F.col(value).alias("after"), F.lit(True).alias("_b"))
    both = x.join(y, on, "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.select(*on, "before", "after", kind.alias("change")).where("change is not null")


def scale_diff(a: DataFrame, b: DataFrame, on: list[str], value: str, place: str) -> DataFrame:
    """on, value, place, change: values that only one side has, with their place there."""
    removed = a.join(b.select(*on, value).distinct(), [*on, value], "left_anti").select(*on, value, place, F.lit("removed").alias("change"))
    added = b.join(a.select(*on, value).distinct(), [*on, value], "left_anti").select(*on, value, place, F.lit("added").alias("change"))
    return removed.unionByName(added)


def palette_match(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """on, name, before, after, change: values on both sides are equal whatever their names; of the rest equal names are changed."""
    left = a.join(b.select(*on, "value").distinct(), [*on, "value"], "left_anti")
    right = b.join(a.select(*on, "value").distinct(), [*on, "value"], "left_anti")
    return named_diff(left, right, [*on, "name"], "value")


def map_changes(a: Column, b: Column) -> Column:
    """Keys whose values differ, with both: map(key, struct(before, after))."""
    both = F.map_zip_with(F.coalesce(a, F.expr("map()").cast("map<string,string>")), F.coalesce(b, F.expr("map()").cast("map<string,string>")), lambda _, x, y: F.struct(x.alias("before"), y.alias("after")))
    return F.map_filter(both, lambda _, v: ~v["before"].eqNullSafe(v["after"]))


def adjacent(df: DataFrame, group: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Each row with its successor's columns as next_...; the last of a group has none and goes."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = df
    for c in cols:
        out = out.withColumn(f"next_{c}", F.lead(c).over(w))
    return out.withColumn("_last", F.lead(F.lit(1)).over(w).isNull()).where(~F.col("_last")).drop("_last")


def structure_distance(a: Column, b: Column) -> Column:
    """One less the Jaccard similarity of two trait sets; 0 for two empty ones."""
    from ..functions.text import jaccard

    return 1 - jaccard(a, b, 1.0)


def rect_moved(a: Column, b: Column, least: float = 0.04) -> Column:
    """Whether a side of two rectangles, in shares of the page, differs by least or more."""
    return F.greatest(*(F.abs(a[k] - b[k]) for k in ("x", "y", "width", "height"))) >= least


def severe_overflow(px: Column, width: Column, content: Column) -> Column:
    return (px >= 64) & (content >= 2.5 * width)
