"""Leader clustering of colours, and connected regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .ranking import top


def leader_clusters(colors: DataFrame, group: list[str], threshold: float = color.CLUSTER, most: int = 20) -> DataFrame:
    """group, leader_ord, value, n, members: clusters in order of weight.

    In order of ord a colour joins the first leader nearer than threshold, or becomes a leader. A cluster is represented by its heaviest member (the earliest of
    equals), which need not be its leader. colors: group, ord, value, n; rows that are no colours are left out. A group is one palette, folded in the JVM.
    """
    c = colors.withColumn("c", color.channels(F.col("value"))).where("c is not null")
    # Equal channels join the same leader as the first of them, so a colour is summed up before it is folded and placed, once for all its rows.
    best = F.struct(F.col("n"), (-F.col("ord")).alias("ord"))
    first = c.groupBy(*group, F.struct("c.r", "c.g", "c.b").alias("_rgb")).agg(
        F.min_by(F.struct("ord", "c"), "ord").alias("row"), F.max(best).alias("_best"), F.max_by("value", best).alias("value"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("members")
    )
    leaders = first.groupBy(*group).agg(F.array_sort(F.collect_list("row")).alias("all"))
    near = lambda a, b: color.distance(a["c"], b["c"]) < threshold
    leaders = leaders.select(*group, F.aggregate("all", F.slice("all", 1, 1), lambda acc, x: F.when(F.exists(acc, lambda lead: near(lead, x)), acc).otherwise(F.array_append(acc, x))).alias("leaders"))
    placed = first.join(leaders, group).withColumn("leader_ord", F.element_at(F.filter("leaders", lambda lead: near(lead, F.col("row"))), 1)["ord"])
    total = placed.groupBy(*group, "leader_ord").agg(F.max_by("value", "_best").alias("value"), F.sum("n").alias("n"), F.sum("members").alias("members"))
    return top(total, group, [F.col("n").desc(), F.col("leader_ord")], most).drop("ord")


def hue_totals(colors: DataFrame, group: list[str]) -> DataFrame:
    """group, family, n, distinct colours, over colours of chroma 24 or more."""
    c = colors.withColumn("c", color.tag_channels(F.col("value"))).where("c is not null")
    some = c.where(color.chroma(F.col("c")) >= 24).withColumn("family", color.hue_family(F.col("c")))
    return some.groupBy(*group, "family").agg(F.sum("n").alias("n"), F.count_distinct("value").alias("colors"))


def neutral_coverage(colors: DataFrame, group: list[str]) -> DataFrame:
    """group, coverage: the share of weight in neutral colours."""
    c = colors.withColumn("c", color.tag_channels(F.col("value"))).where("c is not null")
    return c.groupBy(*group).agg((F.sum(F.when(color.neutral(F.col("c")), F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"))


def run_lengths(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """group, run, value, times: equal neighbours in order become one row."""
    w = Window.partitionBy(*group).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    runs = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w))
    return runs.groupBy(*group, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("times"))
