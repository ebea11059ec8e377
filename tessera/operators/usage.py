"""Weighted usage: a long table of (group, category, value, weight) and what is counted from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the usage categories that vote for an accent colour, and those that vote against.
ACCENT_WEIGHTS = {"primaryActionColor": 20.0, "brandTokenColor": 16.0, "actionColor": 12.0, "accentColor": 8.0, "linkColor": 6.0, "selectedColor": 1.0}
AGAINST_WEIGHTS = {"actionForegroundColor": -50.0, "primaryActionForegroundColor": -50.0, "statusColor": -50.0}


def valid(usage: DataFrame, value: str = "value", weight: str = "weight") -> DataFrame:
    """Rows with a value and a positive finite weight."""
    w = F.col(weight)
    return usage.where(F.col(value).isNotNull() & (F.col(value) != "") & w.isNotNull() & ~F.isnan(w.cast("double")) & (w > 0) & (w < float("inf")))


def frequency(usage: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """by, n: summed weights, map-side combined."""
    return usage.groupBy(*by).agg(F.sum(weight).alias("n"))


def frequency_with_fallback(usage: DataFrame, fallback: DataFrame, group: list[str]) -> DataFrame:
    """group, value, n: observed sums; fallback values that were not observed count 1. fallback: group, value (repeats count where a group has nothing observed)."""
    seen = frequency(valid(usage), [*group, "value"])
    counted = fallback.groupBy(*group, "value").agg(F.count(F.lit(1)).cast("double").alias("c"))
    some = seen.select(*group).distinct().withColumn("_some", F.lit(True))
    filled = counted.join(some, group, "left").withColumn("c", F.when(F.col("_some"), 1.0).otherwise(F.col("c"))).drop("_some")
    both = seen.join(filled, [*group, "value"], "full_outer")
    return both.select(*group, "value", F.coalesce("n", "c").alias("n"))


def combined(usage: DataFrame, group: list[str], weights: dict[str, float]) -> DataFrame:
    """group, value, n: category sums by weight, positive results only."""
    table = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v))))
    some = valid(usage).where(F.col("category").isin(list(weights)))
    return some.groupBy(*group, "value").agg(F.sum(F.col("weight") * F.element_at(table, F.col("category"))).alias("n")).where("n > 0")


def vote_shares(usage: DataFrame, site: list[str], capture: str, url: str) -> DataFrame:
    """site, category, value, weight: each URL has one vote in a category, shared by weight within a capture, averaged over its captures."""
    cap = [*site, url, capture, "category"]
    rows = valid(usage).groupBy(*cap, "value").agg(F.sum("weight").alias("weight"))
    share = rows.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(*cap)))
    captures = rows.groupBy(*site, url, "category").agg(F.count_distinct(capture).alias("captures"))
    by_url = share.groupBy(*site, url, "category", "value").agg(F.sum("share").alias("share")).join(captures, [*site, url, "category"])
    return by_url.groupBy(*site, "category", "value").agg(F.sum(F.col("share") / F.col("captures")).alias("weight"))


def distribution(usage: DataFrame, group: list[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """group, value, share within the group."""
    n = usage.groupBy(*group, value).agg(F.sum(weight).alias("n"))
    total = n.groupBy(*group).agg(F.sum("n").alias("t"))
    return n.join(total, group).select(*group, value, (F.col("n") / F.col("t")).alias("share"))


def distribution_distance(a: DataFrame, b: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """on, distance: half the sum of differences of shares, over values that either side has."""
    both = a.withColumnRenamed("share", "x").join(b.withColumnRenamed("share", "y"), [*on, value], "full_outer")
    gap = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return both.groupBy(*on).agg((F.sum(gap) / 2).alias("distance"))


def dark_mode(light_luminance: Column, dark_luminance: Column, background_distance: Column, text_distance: Column) -> Column:
    """Whether a second look is a dark mode: dark enough, darker than the first, and different in backgrounds or texts."""
    return (dark_luminance < 0.35) & (light_luminance - dark_luminance >= 0.02) & ((background_distance >= 0.08) | (text_distance >= 0.12))


def weighted_median(df: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """group, median: the smallest value at which the running weight reaches half. One row for each distinct value is sorted."""
    n = df.groupBy(*group, value).agg(F.sum(weight).alias("w"))
    running = Window.partitionBy(*group).orderBy(value)
    every = Window.partitionBy(*group)
    r = n.withColumn("run", F.sum("w").over(running)).withColumn("half", F.sum("w").over(every) / 2)
    return r.where("run >= half").groupBy(*group).agg(F.min(value).alias("median"))


def paired_ratio(metric: Column) -> Column:
    """From size|height, both in px: height by size to three places, if over 0 and at most 4."""
    from ..functions.css import length_px
    from ..functions.numbers import half_up

    size, height = length_px(F.get(F.split(metric, r"\|"), F.lit(0))), length_px(F.get(F.split(metric, r"\|"), F.lit(1)))
    ratio = height / F.nullif(size, F.lit(0.0))
    return F.when((ratio > 0) & (ratio <= 4), half_up(ratio, 3))


def merge_components(patterns: DataFrame, key: list[str]) -> DataFrame:
    """key, count, confidence (weighted), evidence: merged component patterns; the representative has the highest rank."""
    return patterns.groupBy(*key).agg(F.sum("count").alias("count"), (F.sum(F.col("confidence") * F.col("count")) / F.sum("count")).alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))


def variant_groups(items: DataFrame, key: list[str], optional: list[str]) -> DataFrame:
    """Counts by key and by those optional columns that vary within the key; the others become null."""
    varying = items.groupBy(*key).agg(*(F.count_distinct(c).alias(f"_{c}") for c in optional))
    some = items.join(varying, key).select(*key, *(F.when(F.col(f"_{c}") > 1, F.col(c)).alias(c) for c in optional))
    return some.groupBy(*key, *optional).agg(F.count(F.lit(1)).alias("count"))
