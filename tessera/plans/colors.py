"""Colour tokens of a site, from usage and observed roles: clusters by role, accents, and the names that the colours get.

usage: group columns, ord, category, value, n; observations: see operators.color_roles; ord is the order of observation and decides ties. Everything is grouped by the
group columns and colour values; what is folded in one row are the distinct colours of one role of one site.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..operators import clusters, color_roles
from ..staging import cut

# Categories of general frequency in order, weights of what speaks for and against an accent.
GENERAL = ("textColor", "bgColor", "borderColor", "declaredColor")
FOR_WEIGHTS = {"selectedColor": 12, "accentColor": 8, "linkColor": 6}
PRIMARY_WEIGHT, ACTION_WEIGHT, AGAINST_WEIGHT = 20, 16, 50
AGAINST = ("primaryActionForegroundColor", "actionForegroundColor", "statusBackgroundColor", "statusForegroundColor", "statusColor")
SECOND_ACTION, DECORATION = ("primaryActionBackgroundColor", "actionBackgroundColor", "selectedColor"), ("accentColor", "bgColor", "bgArea")
_AFTER = 1 << 40


def _frequency(usage: DataFrame, group: list[str], categories: tuple[str, ...]) -> DataFrame:
    """group, value, n, ord of the positive usage in categories, in their order and then that of observation."""
    at = F.array_position(F.array(*map(F.lit, categories)), F.col("category")) * _AFTER + F.col("ord")
    n = F.col("n").cast("double")
    some = usage.where(F.col("category").isin(*categories) & (n > 0) & ~F.isnan(n) & (n < float("inf")))
    return some.groupBy(*group, "value").agg(F.sum(n).alias("n"), F.min(at).alias("ord"))


def _or_else(first: DataFrame, other: DataFrame, group: list[str]) -> DataFrame:
    """first, and for groups that it lacks, other."""
    return first.unionByName(other.join(first.select(*group).distinct(), group, "left_anti"))


def general_frequency(usage: DataFrame, raw: DataFrame | None, group: list[str]) -> DataFrame:
    """group, value, n, ord: usage as text, background, border or declaration; a colour that was only listed counts once, or as often as it is listed where nothing was used. raw: group, ord, value."""
    seen = _frequency(usage, group, GENERAL)
    if raw is None:
        return seen
    listed = raw.groupBy(*group, "value").agg(F.count(F.lit(1)).cast("double").alias("_n"), F.min(F.col("ord") + 9 * _AFTER).alias("_ord"))
    some = seen.select(*group).distinct().withColumn("_some", F.lit(True))
    both = seen.join(listed, [*group, "value"], "full_outer").join(some, group, "left")
    return both.select(*group, "value", F.coalesce("n", F.when(F.col("_some"), F.lit(1.0)).otherwise(F.col("_n"))).alias("n"), F.coalesce("ord", "_ord").alias("ord"))


def clustered(frequency: DataFrame, group: list[str], threshold: float = color.CLUSTER) -> DataFrame:
    """group, ord (from 1, by weight), value in normal form, n."""
    found = clusters.leader_clusters(frequency, group, threshold)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("n").desc(), "leader_ord"))  # twenty clusters
    return found.select(*group, place.alias("ord"), F.coalesce(color.normal(F.col("value")), F.col("value")).alias("value"), "n")


def accents(usage: DataFrame, general: DataFrame, group: list[str]) -> DataFrame:
    """group, ord, value: colours of primary actions, then of actions, brand variables, selections, and what the weights of all say; usable ones, each once.

    A colour that is the text of actions or tells a status is left out, unless it is also a background of actions, a brand's or a selection's.
    """
    of = lambda *names: _frequency(usage, group, names)
    primary = cut(_or_else(of("primaryActionBackgroundColor"), of("primaryActionColor"), group))
    action = cut(_or_else(of("actionBackgroundColor"), of("actionColor"), group))
    brand, selected, against = of("brandTokenColor"), of("selectedColor"), cut(of(*AGAINST))
    parts = [(primary, PRIMARY_WEIGHT), (action, ACTION_WEIGHT), *((of(c), w) for c, w in FOR_WEIGHTS.items()), (general, 1), (against, -AGAINST_WEIGHT)]
    weighed = reduce(DataFrame.unionByName, (df.select(*group, "value", (F.col("n") * w).alias("n"), (F.col("ord") + i * 16 * _AFTER).alias("ord")) for i, (df, w) in enumerate(parts)))
    weighed = weighed.groupBy(*group, "value").agg(F.sum("n").alias("n"), F.min("ord").alias("ord")).where("n > 0")
    lists = [clustered(f, group).where(color_roles.usable_accent(F.col("value"))).withColumn("_list", F.lit(i)) for i, f in enumerate((primary, action, brand, selected, weighed))]
    first = reduce(DataFrame.unionByName, lists).groupBy(*group, "value").agg(F.min(F.struct("_list", "ord")).alias("_at"))
    named = lambda *dfs: reduce(DataFrame.unionByName, (df.select(*group, color.normal(F.col("value")).alias("value")) for df in dfs)).where("value is not null").distinct()
    banned = named(against).join(named(primary, action, brand, selected), [*group, "value"], "left_anti")
    kept = first.join(banned, [*group, "value"], "left_anti")
    return kept.select(*group, F.row_number().over(Window.partitionBy(*group).orderBy("_at")).alias("ord"), "value")


def cluster_colors(usage: DataFrame, group: list[str], raw: DataFrame | None = None) -> dict[str, DataFrame]:
    """palette, backgrounds, texts, accents: group, ord, value. Backgrounds weigh by area where it is known, and follow by their distance from the first; texts likewise, quieter ones first. Groups without a palette have nothing."""
    general = cut(general_frequency(usage, raw, group))
    palette = cut(clustered(general, group))
    there = palette.select(*group).distinct()
    some = lambda df: df.join(there, group, "left_semi")
    back = clustered(_or_else(_frequency(usage, group, ("bgArea",)), _frequency(usage, group, ("bgColor",)), group), group, color.BACKGROUND_CLUSTER)
    ordered = lambda df, muted: some(color_roles.related_order(df.select(*group, "ord", "value"), group, muted)).select(*group, F.col("place").alias("ord"), "value")
    texts = clustered(_frequency(usage, group, ("textColor",)), group)
    return {"palette": palette, "backgrounds": cut(ordered(back, False)), "texts": cut(ordered(texts, True)), "accents": cut(some(accents(usage, general, group)))}


def _lists(df: DataFrame, group: list[str], name: str) -> DataFrame:
    return df.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias(name))  # twenty values, accents up to a hundred


def color_tokens(usage: DataFrame, observations: DataFrame, group: list[str], raw: DataFrame | None = None) -> DataFrame:
    """group, name, value: background, surface, secondary, foreground, muted-foreground, primary, accent or their editorial kin, border, border-subtle, and palette-<n> for what is left.

    A primary colour needs an observed action with a background; without one the first accent is editorial.
    """
    found = cluster_colors(usage, group, raw)
    base = found["palette"].select(*group).distinct()
    for name in ("backgrounds", "texts", "accents"):
        base = base.join(_lists(found[name], group, name), group, "left")
    b, t, a = (lambda i, n=n: F.get(n, F.lit(i)) for n in ("backgrounds", "texts", "accents"))
    near = F.coalesce(color.related(color.channels(b(0)), color.channels(b(1))), F.lit(False))
    muted = F.get(F.filter(F.slice("texts", 2, 100), lambda c: color_roles.muted_text(F.get("backgrounds", F.lit(0)), F.get("texts", F.lit(0)), c)), F.lit(0))
    known = base.join(color_roles.has_action_background(observations, group), group, "left").withColumns({
        "observed": F.coalesce("observed", F.lit(False)), "background": b(0), "surface": F.when(near, b(1)), "foreground": t(0), "muted": muted, "first": a(0),
    })
    known = cut(known)
    primaries = known.where("observed and first is not null").select(*group, F.col("first").alias("primary"), "foreground")
    rest = found["accents"].where("ord > 1")
    pick = lambda categories, name: color_roles.used_in(rest, usage, group, categories).where("used").groupBy(*group).agg(F.min_by("value", "ord").alias(name))
    whole = known.join(color_roles.secondary_action(observations, primaries.select(*group, "primary"), group), group, "left").join(pick(SECOND_ACTION, "_second"), group, "left")
    whole = whole.join(pick(DECORATION, "_decor"), group, "left").join(color_roles.text_only_accent(observations, group), group, "left")
    whole = whole.join(color_roles.border_colors(usage, known.select(*group, F.coalesce("surface", "background").alias("reference")), group), group, "left")
    acts, some = F.col("observed"), F.col("first").isNotNull()
    named = {
        "background": F.col("background"), "surface": F.col("surface"), "secondary": F.when(F.col("surface").isNotNull(), color_roles.secondary_surface(F.col("background"), F.col("surface"), F.col("foreground"))),
        "foreground": F.col("foreground"), "muted-foreground": F.col("muted"), "primary": F.when(acts, F.col("first")), "accent": F.when(acts & some, F.coalesce("secondary", "_second")),
        "editorial-accent": F.when(some, F.when(~acts, F.col("first"))).otherwise(F.col("accent")), "decorative-accent": F.when(~acts & some, F.col("_decor")), "border": F.col("border"), "border-subtle": F.col("subtle"),
    }
    tokens = cut(whole.select(*group, F.inline(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in named.items())))).where("value is not null"))
    left = color_roles.palette_rest(found["palette"].select(*group, (F.col("ord") - 1).alias("i"), "value"), tokens.select(*group, "value"), group)
    return tokens.unionByName(left)


def color_pairs(tokens: DataFrame, observations: DataFrame, group: list[str]) -> DataFrame:
    """group, name, background, foreground, contrast, warning, recommended, recommended_contrast, observations: the primary action's pair, and those of statuses (without the contrast columns)."""
    of = lambda n: F.max(F.when(F.col("name") == n, F.col("value"))).alias(n)
    primaries = tokens.groupBy(*group).agg(of("primary"), of("foreground")).where("primary is not null")
    main = color_roles.primary_action(observations, primaries, group).withColumn("name", F.lit("primary-action"))
    return main.unionByName(color_roles.semantic_pairs(observations, group), allowMissingColumns=True)
