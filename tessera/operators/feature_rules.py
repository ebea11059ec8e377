"""Feature tags of a site from its tokens and usage, and the claims about its palette that evidence supports.

Every rule is an aggregation by the group columns over tables of values; what is kept as an array are a site's scales, a dozen values each. Tables: tokens (group, kind, ord, value; kinds as of the
scales), colors (group, name, value), usage (group, category, value, n), variables (group, name), rhythm (group, rhythm: array of px).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, css
from ..functions.numbers import plain
from .tags import layered

# Thresholds of the tags and of the palette claims.
LARGE_RADIUS, SMALL_RADIUS, MOST_RADIUS, SMALL_SHARE, RADIUS_NEAR = 12, 4, 64, 0.5, 0.1
LIGHT, BOLD, GREY_STEP, MANY_VARIABLES = 300, 700, 20, 20
CHROMA, DECORATIVE_USES, DECORATIVE_AREA = 24, 2, 0.003
DOMINANT_SHARE, NEUTRAL_SHARE, RICH_FAMILIES = 0.6, 0.75, 3
ACTION_CATEGORIES = ("primaryActionBackgroundColor", "actionBackgroundColor", "primaryActionColor", "actionColor", "brandTokenColor")
STATUS_CATEGORIES = ("statusBackgroundColor", "statusForegroundColor", "statusColor")
COVERAGE_CATEGORIES = ("bgColor", "bgArea", "textColor")

_C = F.col


def representative_radius(tokens: DataFrame, usage: DataFrame, group: list[str]) -> DataFrame:
    """group, radius, small_share: the weighted median of the radius tokens up to MOST_RADIUS px, each weighing its usage (within RADIUS_NEAR) and one at least, and the share of small ones. Shares of a box do not count."""
    radii = tokens.where((_C("kind") == "radii") & ~_C("value").contains("%")).select(*group, "ord", "value", css.length_px(_C("value")).alias("px")).where(_C("px") <= MOST_RADIUS)
    seen = usage.where("category = 'radius' and n > 0").select(*group, _C("value").alias("_v"), css.length_px(_C("value")).alias("_px"), _C("n").cast("double").alias("_n"))
    # A site has five radius tokens at most, so this join has five rows for each used value of the same site.
    near = radii.join(seen, group, "left")
    exact = F.sum(F.when(_C("_v") == _C("value"), _C("_n")))
    about = F.sum(F.when(F.abs(_C("_px") - _C("px")) <= RADIUS_NEAR, _C("_n")))
    weighed = near.groupBy(*group, "ord", "px").agg(F.greatest(F.lit(1.0), F.coalesce(exact, about, F.lit(0.0))).alias("n"))
    w = Window.partitionBy(*group)
    so_far = weighed.withColumns({"sum": F.sum("n").over(w.orderBy("px", "ord")), "total": F.sum("n").over(w)})
    return so_far.groupBy(*group).agg(F.min(F.when(_C("sum") >= _C("total") / 2, _C("px"))).alias("radius"), (F.sum(F.when(_C("px") <= SMALL_RADIUS, _C("n")).otherwise(0.0)) / F.first("total")).alias("small_share"))


def _list(kind: str, value: Column | None = None) -> Column:
    """A scale's values in order."""
    pairs = F.array_sort(F.collect_list(F.when(_C("kind") == kind, F.struct("ord", (_C("value") if value is None else value).alias("v")))))
    return F.transform(pairs, lambda x: x["v"])


def site_tags(tokens: DataFrame, colors: DataFrame, usage: DataFrame, variables: DataFrame, rhythm: DataFrame, group: list[str]) -> DataFrame:
    """group, tags: the tags of every site that has tokens, in a fixed order."""
    level = F.floor(css.shadow_elevation(_C("value")) * 10 + 0.5) / 10
    facts = tokens.groupBy(*group).agg(_list("fontFamilies").alias("fonts"), F.array_compact(_list("shadows", level)).alias("levels"), F.count(F.when(_C("kind") == "shadows", 1)).alias("shadows"), F.array_compact(_list("fontWeights", _C("value").try_cast("double"))).alias("weights"))
    rgb = F.regexp_extract_all("value", F.lit(r"rgba?\((\d+),\s*(\d+),\s*(\d+)"), F.lit(0))
    part = lambda i: F.regexp_extract("value", r"rgba?\((\d+),\s*(\d+),\s*(\d+)", i).try_cast("int")
    grey = F.coalesce((F.size(rgb) > 0) & (F.abs(part(1) - part(2)) < GREY_STEP) & (F.abs(part(2) - part(3)) < GREY_STEP), F.lit(False))
    shades = colors.groupBy(*group).agg(F.bool_and(grey).alias("mono"), F.count(F.lit(1)).alias("shades"))
    named = variables.select(*group, "name").distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("variables"))
    whole = facts
    for other in (shades, named, representative_radius(tokens, usage, group), rhythm.select(*group, "rhythm")):
        whole = whole.join(other, group, "left")
    font = F.lower(F.coalesce(F.get("fonts", F.lit(0)), F.lit("")))
    led = F.concat(F.lit("spacing rhythm led by "), F.array_join(F.transform("rhythm", lambda v: F.concat(plain(v), F.lit("px"))), ", "))
    has = lambda test: F.exists("weights", test)
    rules = [
        (F.size("rhythm") >= 2, led), (font.contains("mono") | font.contains("code"), "monospace typography"), (font.contains("serif") & ~font.contains("sans"), "serif editorial style"), (F.size("fonts") == 1, "single-font system"),
        (_C("mono") & (_C("shades") > 2), "monochrome palette"), (_C("radius") >= LARGE_RADIUS, "large-radius rounded style"), ((_C("radius") <= SMALL_RADIUS) & (_C("small_share") >= SMALL_SHARE), "compact-radius surfaces observed"),
        (_C("shadows") == 0, "no stable shadow scale observed"), (layered(_C("levels")), "layered elevation system"), (has(lambda w: w <= LIGHT) & has(lambda w: w >= BOLD), "weight contrast hierarchy"), (_C("variables") > MANY_VARIABLES, "extensive CSS variable usage"),
    ]
    tags = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(t) if isinstance(t, str) else t) for c, t in rules)))
    return whole.select(*group, tags.alias("tags"))


def _families(usage: DataFrame, group: list[str]) -> DataFrame:
    """usage of chromatic colours with their hue family."""
    c = usage.where("n > 0").withColumn("c", color.tag_channels(_C("value"))).where("c is not null")
    return c.where(color.chroma(_C("c")) >= CHROMA).withColumn("family", color.hue_family(_C("c")))


def palette_facts(usage: DataFrame, primaries: DataFrame, group: list[str]) -> DataFrame:
    """group, action_families, dominant_share, decorative, stable, neutral: hue families of actions and the share of the first, decorative families (neither a status's nor the primary action's), those of them that are used often
    or widely enough, and the share of neutral text and background. primaries: group, primary."""
    hues = _families(usage, group)
    acts = hues.where(_C("category").isin(*ACTION_CATEGORIES)).groupBy(*group, "family").agg(F.sum("n").alias("n"))
    acts = acts.groupBy(*group).agg(F.count(F.lit(1)).alias("action_families"), (F.max("n") / F.sum("n")).alias("dominant_share"))
    own = primaries.select(*group, color.tag_channels(_C("primary")).alias("c")).where("c is not null").select(*group, color.hue_family(_C("c")).alias("family"))
    taken = hues.where(_C("category").isin(*STATUS_CATEGORIES)).select(*group, "family").unionByName(own).distinct()
    of = lambda name: F.coalesce(F.sum(F.when(_C("category") == name, _C("n"))), F.lit(0))
    deco = hues.where(_C("category").isin("bgColor", "bgArea")).groupBy(*group, "family").agg(of("bgColor").alias("uses"), of("bgArea").alias("area")).join(taken, [*group, "family"], "left_anti")
    deco = deco.groupBy(*group).agg(F.count(F.lit(1)).alias("decorative"), F.count(F.when((_C("uses") >= DECORATIVE_USES) | (_C("area") >= DECORATIVE_AREA), 1)).alias("stable"))
    ink = usage.where(_C("category").isin(*COVERAGE_CATEGORIES) & (_C("n") > 0)).withColumn("c", color.tag_channels(_C("value"))).where("c is not null")
    ink = ink.groupBy(*group).agg((F.sum(F.when(color.chroma(_C("c")) < CHROMA, _C("n")).otherwise(0)) / F.sum("n")).alias("neutral"))
    whole = usage.select(*group).distinct()
    for other in (acts, deco, ink):
        whole = whole.join(other, group, "left")
    return whole.fillna(0, ["action_families", "decorative", "stable", "neutral"]).fillna(1.0, ["dominant_share"])


def rich_families(colors: DataFrame, weights: DataFrame, group: list[str]) -> DataFrame:
    """group, significant: hue families of colour tokens that the interface uses, twice as much as statuses do, with at least 3 and 15 percent of the strongest family's weight. weights: group, token (name), ui, status."""
    some = colors.join(weights.select(*group, _C("token").alias("name"), "ui", "status"), [*group, "name"]).withColumn("c", color.tag_channels(_C("value"))).where("c is not null")
    some = some.where((color.chroma(_C("c")) >= CHROMA) & (_C("ui") > 0) & (_C("status") * 2 < _C("ui"))).groupBy(*group, color.hue_family(_C("c")).alias("family")).agg(F.sum("ui").alias("n"))
    most = F.max("n").over(Window.partitionBy(*group))  # twelve families
    return some.withColumn("_m", most).groupBy(*group).agg(F.count(F.when(_C("n") >= F.greatest(F.lit(3.0), _C("_m") * 0.15), 1)).alias("significant"))


def palette_claims(facts: DataFrame, rich: DataFrame, roles: DataFrame, sections: DataFrame, chromatic: DataFrame, group: list[str]) -> DataFrame:
    """group, label, confidence, refs (how many pieces of evidence): what the palette and the sections' treatments show.

    facts: of palette_facts; rich: of rich_families; roles: group, ref (observations of the primary action); sections: group, id, gradient, compound (whether a section has such a treatment); chromatic:
    group, id, kind (component or section with a chromatic background), eight components and four sections at most count. A multicolour palette excludes that of many families.
    """
    count = lambda df, c, name: df.groupBy(*group).agg(F.count(c).alias(name))
    seen = sections.groupBy(*group).agg(F.count(F.when(_C("gradient"), 1)).alias("gradients"), F.count(F.when(_C("compound"), 1)).alias("compounds"), F.count(F.when(_C("gradient") | _C("compound"), 1)).alias("treated"))
    parts = chromatic.groupBy(*group).agg(F.least(F.count(F.when(_C("kind") == "component", 1)), F.lit(8)).alias("comps"), F.least(F.count(F.when(_C("kind") == "section", 1)), F.lit(4)).alias("secs"))
    whole = reduce(lambda x, y: x.join(y, group, "full_outer"), (facts, rich, count(roles.distinct(), F.lit(1), "refs"), seen, parts)).fillna(0).fillna(1.0, ["dominant_share"])
    sure = lambda n, least: F.when(n >= least, "high").otherwise("medium")
    acts = _C("refs") > 0
    multi = acts & (_C("dominant_share") >= DOMINANT_SHARE) & (_C("gradients") > 0) & (_C("stable") >= 2)
    single = acts & ~multi & (_C("action_families") <= 1) & (_C("neutral") >= NEUTRAL_SHARE) & (_C("decorative") == 0)
    held = _C("refs") + _C("comps") + _C("secs")
    kind = F.when((_C("gradients") > 0) & (_C("compounds") > 0), "gradient and compound-radius").when(_C("gradients") > 0, "gradient").otherwise("compound-radius")
    made = [
        (multi, F.lit("single dominant action family with multicolor decorative accents"), sure(_C("refs"), 2), _C("refs") + _C("gradients")), (single, F.lit("neutral palette with a single accent"), sure(_C("refs"), 2), _C("refs")),
        (~multi & (_C("significant") >= RICH_FAMILIES) & (held > 0), F.lit("rich color system"), sure(held, 3), held),
        (_C("treated") > 0, F.concat(F.lit("section-level "), kind, F.lit(" treatments observed")), sure(_C("treated"), 2), _C("treated")),
    ]
    rows = F.array_compact(F.array(*(F.when(c, F.struct(label.alias("label"), confidence.alias("confidence"), n.cast("long").alias("refs"))) for c, label, confidence, n in made)))
    return whole.select(*group, F.inline(rows))
