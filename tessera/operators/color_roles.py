"""Colour roles of a site: which observed colours are its actions, statuses, borders, surfaces and accents.

Observations: group columns, ord, role, background, foreground, element; usage: group columns, ord, category, value, n. ord is the order of observation
and decides ties, as in the record. Every rule is an aggregation by the group columns and normal colours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..functions.binding import let

ACTIONS = ("action", "primary-action")
# Contrast that is aimed at, how near to it is near, and colours to fall back on.
TARGET_CONTRAST, NEAR_MISS = 4.5, 0.15
FALLBACKS = ("#1a1a1a", "#000000", "#ffffff")
# Usage categories that count as interface, and as status.
UI_CATEGORIES = ("primaryActionBackgroundColor", "actionBackgroundColor", "primaryActionColor", "actionColor", "selectedColor", "accentColor", "linkColor", "brandTokenColor", "declaredColor", "bgColor", "bgArea", "textColor")
STATUS_CATEGORIES = ("statusBackgroundColor", "statusForegroundColor", "statusColor")


def _contrast(a: Column, b: Column) -> Column:
    """Contrast of two colour texts with alpha ignored; null where either is none."""
    ratio = lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), (F.greatest(x["a"], x["b"]) + 0.05) / (F.least(x["a"], x["b"]) + 0.05))
    return let(F.struct(_luminance(a).alias("a"), _luminance(b).alias("b")), ratio)


def _channels(text: Column) -> Column:
    return let(text, color.token_channels)


def _luminance(text: Column) -> Column:
    return let(_channels(text), lambda c: F.when(c.isNotNull(), color.luminance(c)))


def _neutral(text: Column) -> Column:
    """Greys; text that is no colour is not neutral."""
    return F.coalesce(let(_channels(text), color.neutral), F.lit(False))


def _best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def primary_action(observations: DataFrame, primaries: DataFrame, group: list[str]) -> DataFrame:
    """group, background, foreground, contrast, warning, recommended, recommended_contrast, observations for groups whose primary colour is an observed action background.

    Of the pairs with this background one that a primary action has wins, then the most frequent, then the first seen. A contrast below 4.5 is a warning; one below 4.35 gets
    the first of the group's foreground, near black, black and white that reaches 4.5 and is not the observed one. primaries: group, primary, foreground.
    """
    wanted = primaries.select(*group, color.normal(F.col("primary")).alias("background"), F.col("foreground").alias("own"))
    seen = observations.where(F.col("role").isin(*ACTIONS)).withColumn("background", color.normal(F.col("background"))).join(wanted, [*group, "background"])
    shown = F.coalesce(color.normal(F.col("foreground")), F.col("foreground"))
    pairs = seen.groupBy(*group, "background", color.normal(F.col("foreground")).alias("pair")).agg(
        F.max((F.col("role") == "primary-action").cast("int")).alias("prime"), F.count(F.lit(1)).alias("observations"), F.min("ord").alias("first"), F.min_by(shown, "ord").alias("foreground"), F.first("own").alias("own"))
    best = _best(pairs, group, [F.col("prime").desc(), F.col("observations").desc(), F.col("first")])
    best = best.withColumn("contrast", _contrast(F.col("foreground"), F.col("background")))
    tried = F.transform(F.array(color.normal(F.col("own")), *map(F.lit, FALLBACKS)), lambda v: F.struct(v.alias("value"), _contrast(v, F.col("background")).alias("contrast")))
    good = F.get(F.filter(tried, lambda x: (x["contrast"] >= TARGET_CONTRAST) & (x["value"] != F.col("foreground"))), F.lit(0))
    offer = F.when(F.col("contrast") < TARGET_CONTRAST - NEAR_MISS, good)
    low = F.coalesce(F.col("contrast") < TARGET_CONTRAST, F.lit(False))
    return best.select(*group, "background", "foreground", F.round("contrast", 2).alias("contrast"), low.alias("warning"), offer["value"].alias("recommended"), F.round(offer["contrast"], 2).alias("recommended_contrast"), "observations")


def semantic_pairs(observations: DataFrame, group: list[str]) -> DataFrame:
    """group, name, background, foreground, observations: for each status kind and intent the most frequent pair, the first seen of equals. Deltas have a direction only."""
    kind = F.coalesce("status_kind", F.lit("status"))
    some = observations.where((F.col("role") == "status") & F.col("status_intent").isNotNull() & ((kind != "delta") | F.col("status_intent").isin("positive", "negative")))
    pairs = some.groupBy(*group, F.concat_ws("-", kind, "status_intent").alias("name"), color.normal(F.col("background")).alias("background"), color.normal(F.col("foreground")).alias("foreground"))
    pairs = pairs.agg(F.count(F.lit(1)).alias("observations"), F.min("ord").alias("first"))
    return _best(pairs, [*group, "name"], [F.col("observations").desc(), F.col("first")]).drop("first")


def text_only_accent(observations: DataFrame, group: list[str]) -> DataFrame:
    """group, accent: the most frequent chromatic foreground of actions without a background."""
    some = observations.where(F.col("role").isin(*ACTIONS) & (F.coalesce("background", F.lit("")) == "")).withColumn("accent", color.normal(F.col("foreground")))
    n = some.where(F.col("accent").isNotNull() & ~_neutral(F.col("accent"))).groupBy(*group, "accent").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return _best(n, group, [F.col("n").desc(), F.col("first")]).select(*group, "accent")


def secondary_action(observations: DataFrame, primaries: DataFrame, group: list[str], least: int = 2) -> DataFrame:
    """group, secondary: the chromatic background other than the primary that most action elements have, two at least; the smaller text of equals."""
    other = primaries.select(*group, color.normal(F.col("primary")).alias("primary"))
    some = observations.where(F.col("role") == "action").withColumn("secondary", color.normal(F.col("background"))).join(other, group)
    some = some.where(F.col("secondary").isNotNull() & ~F.col("secondary").eqNullSafe(F.col("primary")) & ~_neutral(F.col("secondary")))
    n = some.groupBy(*group, "secondary").agg(F.count_distinct("element").alias("n")).where(F.col("n") >= least)
    return _best(n, group, [F.col("n").desc(), F.col("secondary")]).select(*group, "secondary")


def has_action_background(observations: DataFrame, group: list[str]) -> DataFrame:
    """group, observed: whether any action has a background."""
    return observations.groupBy(*group).agg(F.max(F.col("role").isin(*ACTIONS) & (F.coalesce("background", F.lit("")) != "")).alias("observed"))


def used_in(values: DataFrame, usage: DataFrame, group: list[str], categories: tuple[str, ...]) -> DataFrame:
    """values with used: whether the colour has usage in one of the categories. values: group, value."""
    there = usage.where(F.col("category").isin(*categories) & (F.col("n") > 0)).select(*group, color.normal(F.col("value")).alias("_k")).where("_k is not null").distinct().withColumn("used", F.lit(True))
    return values.withColumn("_k", color.normal(F.col("value"))).join(there, [*group, "_k"], "left").withColumn("used", F.coalesce("used", F.lit(False))).drop("_k")


def secondary_surface(background: Column, surface: Column, foreground: Column) -> Column:
    """Of background and surface the one nearer to the foreground in luminance; the surface on ties or where one is no colour."""
    levels = F.struct(_luminance(background).alias("b"), _luminance(surface).alias("s"), _luminance(foreground).alias("f"))
    nearer = let(levels, lambda x: F.coalesce(F.abs(x["b"] - x["f"]) < F.abs(x["s"] - x["f"]), F.lit(False)))
    return F.when(nearer, background).otherwise(surface)


def muted_text(background: Column, foreground: Column, candidate: Column) -> Column:
    """Whether a colour stands between foreground and background; false where one is none."""
    levels = F.struct(_luminance(background).alias("b"), _luminance(foreground).alias("f"), _luminance(candidate).alias("c"))
    dark = lambda x: (x["c"] > x["f"] + 0.005) & (x["c"] < x["b"] - 0.05)
    light = lambda x: (x["c"] < x["f"] - 0.005) & (x["c"] > x["b"] + 0.03)
    return F.coalesce(let(levels, lambda x: F.when(x["b"] > x["f"], dark(x)).otherwise(light(x))), F.lit(False))


def border_colors(usage: DataFrame, references: DataFrame, group: list[str]) -> DataFrame:
    """group, border, subtle: the default border and, if another is more frequent, that one as the subtle border.

    Borders outside controls are preferred to all, neutral ones to others; the most frequent with a contrast of 1.1 or more against the reference is the default. references: group, reference (surface or background).
    """
    some = usage.where(F.col("category").isin("structuralBorderColor", "borderColor")).withColumn("neutral", _neutral(F.col("value")))
    w = Window.partitionBy(*group)
    kind = F.col("category") == "structuralBorderColor"
    some = some.withColumn("_s", F.max(kind).over(w)).where(~F.col("_s") | kind)
    some = some.withColumn("_n", F.max("neutral").over(w)).where(~F.col("_n") | F.col("neutral")).join(references.select(*group, "reference"), group, "left")
    rank = F.row_number().over(w.orderBy(F.col("n").desc(), "ord"))
    seen = F.coalesce(_contrast(F.col("value"), F.col("reference")) >= 1.1, F.lit(True))
    out = some.withColumn("r", rank).withColumn("seen", seen).groupBy(*group).agg(F.min_by("value", "r").alias("first"), F.min_by("value", F.when(F.col("seen"), F.col("r"))).alias("visible"))
    border = F.coalesce("visible", "first")
    return out.select(*group, border.alias("border"), F.when(F.col("first") != border, F.col("first")).alias("subtle"))


def palette_rest(palette: DataFrame, taken: DataFrame, group: list[str]) -> DataFrame:
    """group, name, value: palette colours that no role has taken, each once in any notation, named by their place. palette: group, i (from 0), value; taken: group, value."""
    key = F.coalesce(color.normal(F.col("value")), F.col("value"))
    gone = taken.select(*group, key.alias("_k")).distinct()
    left = palette.withColumn("_k", key).join(gone, [*group, "_k"], "left_anti")
    first = left.groupBy(*group, "_k").agg(F.min(F.struct("i", "value")).alias("at"))
    return first.select(*group, F.concat(F.lit("palette-"), (F.col("at.i") + 1).cast("string")).alias("name"), F.col("at.value").alias("value"))


def related_order(colors: DataFrame, group: list[str], muted: bool = False) -> DataFrame:
    """colors (group, ord, value) with place: the first stays, the others follow by distance from it (for muted text, 250 times the relative chroma is added), ties by ord, what is no colour last."""
    w = Window.partitionBy(*group).orderBy("ord")
    c = color.channels(F.col("value"))
    base = F.first("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    far = color.distance(base, F.col("_c")) + (color.relative_chroma(F.col("_c")) * 250 if muted else F.lit(0.0))
    rows = colors.withColumn("_c", c).withColumn("_first", F.row_number().over(w) == 1).withColumn("_far", far)
    order = [F.col("_first").desc(), F.col("_far").asc_nulls_last(), F.col("ord")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).drop("_c", "_first", "_far")


def usable_accent(text: Column) -> Column:
    """Whether a colour can be an accent: not clear, chromatic, neither near black nor near white."""
    def usable(c: Column) -> Column:
        light = color.luminance(c)
        return (c["a"] > 0.1) & (color.chroma(c) >= 32) & (color.relative_chroma(c) >= 0.3) & (light > 0.015) & (light < 0.97)

    return F.coalesce(let(color.channels(text), usable), F.lit(False))


def usage_weight(tokens: DataFrame, usage: DataFrame, group: list[str], tolerance: float = color.MATCH) -> DataFrame:
    """group, token, ui, status: usage of colours within the tolerance of each token's. tokens: group, token, value.

    An equi-join on buckets of the red channel as wide as the tolerance, looked up with their neighbours, then the distance; usage is summed by colour first.
    """
    status = F.col("category").isin(*STATUS_CATEGORIES)
    c = color.tag_channels(F.col("value"))
    some = usage.where((F.col("n") > 0) & (status | F.col("category").isin(*UI_CATEGORIES))).withColumn("c", c).where("c is not null")
    some = some.groupBy(*group, "c").agg(F.sum(F.when(~status, F.col("n"))).alias("ui"), F.sum(F.when(status, F.col("n"))).alias("status")).withColumn("_b", F.floor(F.col("c.r") / tolerance))
    reach = tokens.select(*group, "token", c.alias("t")).withColumn("_b", F.explode(F.array(*(F.floor(F.col("t.r") / tolerance) + i for i in (-1, 0, 1)))))
    found = some.join(reach, [*group, "_b"]).where(color.distance(F.col("c"), F.col("t")) <= tolerance).groupBy(*group, "token").agg(F.sum("ui").alias("ui"), F.sum("status").alias("status"))
    out = tokens.select(*group, "token").join(found, [*group, "token"], "left")
    return out.withColumn("ui", F.coalesce("ui", F.lit(0))).withColumn("status", F.coalesce("status", F.lit(0)))
