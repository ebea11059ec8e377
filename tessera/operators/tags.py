"""Feature tags, status roots, roles and statistics that decide by rules over facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feature_tags(rules: dict[str, Column], most: int = 6) -> Column:
    """The names of the rules that hold, in order; a rule that is null does not hold."""
    return F.slice(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))), 1, most)


def layered(levels: Column) -> Column:
    """Three distinct elevations or more, with a spread of 8 and a highest twice the lowest."""
    d = F.array_distinct(levels)
    return (F.size(d) >= 3) & (F.array_max(d) - F.array_min(d) >= 8) & (F.array_max(d) >= 2 * F.array_min(d))


def context_text(*parts: Column) -> Column:
    """Lower-cased parts joined by blanks, empty ones left out."""
    return F.lower(F.concat_ws(" ", *(F.nullif(F.trim(p), F.lit("")) for p in parts)))


def region_score(children: Column, area: Column, repeats: Column, chars: Column, media: Column, actions: Column) -> Column:
    """Points for a region of a page; regions of 4 or more are kept. One with fewer than two visible children has none.

    area: its share of the viewport; repeats: the most children of one tag and class; chars: of its text; media and actions: how many it holds.
    """
    step = lambda c, high, low: F.when(c >= high, 2).when(c >= low, 1).otherwise(0)
    points = step(area, 0.3, 0.08) + step(repeats, 3, 2) + F.when(chars >= 600, 1).otherwise(0) + F.when(media >= 2, 1).otherwise(0) + F.when(actions >= 3, 1).otherwise(0)
    return F.when(children >= 2, points).otherwise(0)


def outermost(elements: DataFrame, group: list[str], locator: str) -> DataFrame:
    """Elements without an ancestor among the others; a locator is its ancestors' with more behind. An equi-join of ancestors, not a join of all pairs."""
    steps = F.split(F.col(locator), " > ")
    above = elements.select(*group, F.col(locator).alias("_full"), F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, 1, i), " > "))).alias(locator)).where(F.instr("_full", " > ") > 0)
    nested = above.join(elements.select(*group, locator).distinct(), [*group, locator], "left_semi").select(*group, F.col("_full").alias(locator)).distinct()
    return elements.join(nested, [*group, locator], "left_anti")


def parent_section(elements: DataFrame, sections: DataFrame, group: list[str], locator: str) -> DataFrame:
    """elements with section: the key of their nearest ancestor that is a section, themselves included. sections: group, locator, key."""
    steps = F.split(F.col(locator), " > ")
    chain = elements.select(*group, F.col(locator).alias("_full"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), " > "))).alias("_depth", locator)).distinct()
    near = chain.join(sections.select(*group, locator, "key"), [*group, locator]).groupBy(*group, F.col("_full").alias(locator)).agg(F.max_by("key", "_depth").alias("section"))
    return elements.join(near, [*group, locator], "left")


def percentile_rank_value(df: DataFrame, group: list[str], value: str, share: float) -> DataFrame:
    """group, p: the nearest-rank percentile."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_r") == F.greatest(F.lit(1), F.ceil(F.col("_n") * share))).select(*group, F.col(value).alias("p"))


def unique_hero(sections: DataFrame, group: list[str]) -> DataFrame:
    """Of the sections that hold one heading the smallest is the hero, the others are content. sections: group, h1, role, area, key."""
    w = Window.partitionBy(*group, "h1").orderBy("area", "key")
    first = F.row_number().over(w)
    return sections.withColumn("_r", first).withColumn("role", F.when((F.col("role") == "hero") & F.col("h1").isNotNull() & (F.col("_r") > 1), "content").otherwise(F.col("role"))).drop("_r")


def crowded(items: DataFrame, group: list[str], part: str, order: list[Column], total: int, each: int) -> DataFrame:
    """The first each items of every part of a group, and of those the first total of the group."""
    inner = Window.partitionBy(*group, part).orderBy(*order)
    some = items.withColumn("_i", F.row_number().over(inner)).where(F.col("_i") <= each)
    return some.withColumn("_o", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_o") <= total).drop("_i", "_o")
