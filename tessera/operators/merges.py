"""Merging the captures of a site, and the summaries that exports and reports are made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css, url
from .ranking import VIEWPORT_RANK, first_row, representative_breakpoints, top

MOTIONS, SPEC_VALUES, SPEC_REFS = 10, 8, 24


def merge_values(values: DataFrame, group: list[str]) -> DataFrame:
    """group, field, value, ord: the distinct values of each field, where they first occur. values: group, ord, field, value."""
    return values.groupBy(*group, "field", "value").agg(F.min("ord").alias("ord"))


def merge_usage(usage: DataFrame, group: list[str]) -> DataFrame:
    """group, category, value, n: usage counts added up."""
    return usage.groupBy(*group, "category", "value").agg(F.sum("n").alias("n"))


def merge_variables(variables: DataFrame, group: list[str]) -> DataFrame:
    """group, name, value: the last value of each variable. variables: group, ord, name, value."""
    return variables.groupBy(*group, "name").agg(F.max_by("value", "ord").alias("value"))


def merge_observations(observations: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """One row for each capture, element and role: the last one's columns at the first one's place."""
    last = F.max_by(F.struct(*cols), "ord").alias("_last")
    out = observations.groupBy(*group, "capture", "element", "role").agg(F.min("ord").alias("ord"), last)
    return out.select(*group, "capture", "element", "role", "ord", "_last.*")


def labelled_breakpoints(widths: DataFrame, group: list[str]) -> DataFrame:
    """widths (group, width, category) with label: the category, and the width behind it where the category has several."""
    many = F.count(F.lit(1)).over(Window.partitionBy(*group, "category")) > 1
    return widths.withColumn("label", F.when(many, F.concat_ws("-", "category", F.col("width").cast("string"))).otherwise(F.col("category")))


def merge_breakpoints(breakpoints: DataFrame, group: list[str]) -> DataFrame:
    """group, width, label, changes: representative widths of all captures with every layout change seen at them. breakpoints: group, width, change (a row each; null: none)."""
    by = breakpoints.groupBy(*group, "width").agg(F.count_distinct("capture").alias("n"), F.array_sort(F.collect_set("change")).alias("changes"))
    chosen = representative_breakpoints(by.select(*group, "width", "n"), group).select(*group, "width", "category")
    return labelled_breakpoints(chosen, group).join(by.select(*group, "width", "changes"), [*group, "width"]).select(*group, "width", "label", "changes")


def merge_motion(motion: DataFrame, group: list[str], most: int = MOTIONS) -> DataFrame:
    """group, property, duration, easing, n, place: the most frequent triples, the first seen of equals. motion: group, ord, property, duration, easing, n."""
    sums = motion.groupBy(*group, "property", "duration", "easing").agg(F.sum("n").alias("n"), F.min("ord").alias("first"))
    return top(sums, group, [F.col("n").desc(), F.col("first")], most, "place").drop("first")


def spacing_rhythm(spacing: DataFrame, group: list[str]) -> DataFrame:
    """group, rhythm: the three most used spacings of 4 to 96 px, smaller ones first on ties, in ascending order. spacing: group, value, n; unused ones count once."""
    px = css.length_px(F.col("value"))
    some = spacing.withColumn("px", px).where(F.col("px").between(4, 96)).withColumn("n", F.greatest(F.lit(1), F.coalesce("n", F.lit(0))))
    best = top(some, group, [F.col("n").desc(), F.col("px")], 3, "_r")
    return best.groupBy(*group).agg(F.array_sort(F.collect_set("px")).alias("rhythm"))


def recipe_spacing(spacing: DataFrame, group: list[str]) -> DataFrame:
    """group, spacing: the most used spacing of 4 to 24 px, then the nearest to 16 px, then the first; without one the first spacing at all. spacing: group, i, value, n."""
    px = F.when(F.col("value").rlike(r"(?i)^-?\d+(?:\.\d+)?px$"), css.length_px(F.col("value")))
    fits = F.coalesce(px.between(4, 24), F.lit(False))
    order = [fits.desc(), F.when(fits, F.coalesce("n", F.lit(0))).desc(), F.when(fits, F.abs(px - 16)), F.col("i")]
    return first_row(spacing, group, order).select(*group, F.col("value").alias("spacing"))


def export_capture(captures: DataFrame, url_col: str, ident: str, order: str) -> DataFrame:
    """The capture of each URL that documents are made from: desktop, tablet, mobile, others, then the first captured; health does not matter here."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in VIEWPORT_RANK.items() for x in kv)), F.col("viewport")), F.lit(3))
    return first_row(captures, [url_col], [rank, F.col(order), F.col(ident)])


def component_specs(components: DataFrame, group: list[str]) -> DataFrame:
    """group, component, role, instances, pages, styles (map of sorted distinct values), token_refs, evidence_refs: one row for each type and role.

    components: group, id, type, role, url, styles (map), token_refs, evidence_refs (arrays). At most 8 values a property and 24 references are shown.
    """
    key = [*group, "type", "role"]
    c = components.withColumn("role", F.coalesce("role", F.lit("")))
    whole = c.groupBy(*key).agg(F.count(F.lit(1)).alias("instances"), F.count_distinct("url").alias("pages"))
    none = F.array().cast("array<string>")

    def listed(refs: Column, name: str, most: int | None) -> DataFrame:
        each = c.select(*key, F.explode(refs).alias("_ref")).distinct()
        each = each if most is None else top(each, key, [F.col("_ref")], most, "_place")  # no more than most of a task's rows travel
        return each.groupBy(*key).agg(F.array_sort(F.collect_list("_ref")).alias(name))

    # The distinct token references are as many as a site has tokens.
    for refs, name, most in ((F.col("token_refs"), "token_refs", None), (F.array_union(F.array("id"), "evidence_refs"), "evidence_refs", SPEC_REFS)):
        whole = whole.join(listed(refs, name, most), key, "left").withColumn(name, F.coalesce(name, none))
    values = c.select(*key, F.explode("styles").alias("property", "value")).distinct()
    shown = top(values, [*key, "property"], [F.col("value")], SPEC_VALUES).groupBy(*key, "property").agg(F.array_sort(F.collect_list("value")).alias("values"))
    styles = shown.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "values")))).alias("styles"))
    return whole.join(styles, key, "left").withColumnRenamed("type", "component")


def representative_style(styles: DataFrame, group: list[str]) -> DataFrame:
    """group, styles: the style text that ranks highest, then is most frequent, has most detail, is surest, comes first as text. styles: group, styles, rank, detail, confidence."""
    n = styles.groupBy(*group, "styles").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank"), F.max("detail").alias("detail"), F.max("confidence").alias("confidence"))
    return first_row(n, group, [F.col(c).desc() for c in ("rank", "n", "detail", "confidence")] + [F.col("styles")]).select(*group, "styles", "n")


def confidence_summary(tokens: DataFrame, group: list[str]) -> DataFrame:
    """group, high, medium, low: how many tokens have each confidence."""
    return tokens.groupBy(*group).agg(*(F.sum((F.col("confidence") == c).cast("long")).alias(c) for c in ("high", "medium", "low")))


def interaction_metrics(states: DataFrame, observations: DataFrame, group: list[str]) -> DataFrame:
    """group, patterns, passive, safe_active: distinct state styles by kind, and observations by safety. states: group, kind, styles; observations: group, safety."""
    patterns = states.where(F.col("kind").isin("hover", "focus", "active", "disabled")).select(*group, "kind", "styles").distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("patterns"))
    of = lambda s: F.sum((F.col("safety") == s).cast("long"))
    seen = observations.groupBy(*group).agg(of("passive").alias("passive"), of("safe-active").alias("safe_active"))
    return patterns.join(seen, group, "full_outer").fillna(0, ["patterns", "passive", "safe_active"])


def page_key(url_col: Column, viewport: Column) -> Column:
    return F.concat_ws("::", url.route_identity(url_col), viewport)


def source_route(final_url: Column, asked: Column) -> Column:
    """The route of the URL that was reached, else of the one asked for."""
    return url.route_identity(F.coalesce(F.nullif(final_url, F.lit("")), asked))


def capture_reasons(a: Column, b: Column, pages_a: Column, pages_b: Column) -> Column:
    """Why two captures cannot be compared, sorted: missing evidence, schema, route, access, language (only if both have one), page set, coverage, page health.

    a, b: struct(schema, route, access, language, page_coverage, capture_coverage), null without evidence; pages: array of struct(key, health, eligible).
    """
    keys = lambda p: F.array_sort(F.array_distinct(F.transform(p, lambda x: x["key"])))
    either = lambda test: F.coalesce(test(pages_a), F.lit(False)) | F.coalesce(test(pages_b), F.lit(False))
    missing = a.isNull() | b.isNull()
    differ = lambda k: ~a[k].eqNullSafe(b[k])
    partial = lambda s: ~s["page_coverage"].eqNullSafe(F.lit("complete")) | s["capture_coverage"].eqNullSafe(F.lit("partial"))
    rules = (
        ("access-mode-mismatch", differ("access")), ("incomplete-coverage", partial(a) | partial(b)),
        ("language-mismatch", F.coalesce((a["language"] != "") & (b["language"] != "") & (a["language"] != b["language"]), F.lit(False))),
        ("missing-page-health", either(lambda p: F.exists(p, lambda x: x["health"].isNull()))), ("page-set-mismatch", ~keys(pages_a).eqNullSafe(keys(pages_b))),
        ("route-mismatch", differ("route")), ("schema-mismatch", differ("schema")), ("unhealthy-page", either(lambda p: F.exists(p, lambda x: x["health"].isNotNull() & ~x["eligible"]))),
    )
    found = F.array_compact(F.array(*(F.when(test, name) for name, test in rules)))
    return F.when(missing, F.array(F.lit("missing-evidence"))).otherwise(found)


def visual_checks(pages: DataFrame, images: DataFrame, site: list[str]) -> DataFrame:
    """site, check, subject, status of health, overflow, image sizes by page and viewports by URL. pages: site, page, url, viewport, health, overflow, ord; images: site, page, width, height."""
    bad = (F.col("width") <= 0) | (F.col("height") <= 0)
    shots = images.groupBy(*site, "page").agg(F.max(bad).alias("bad"))
    p = pages.join(shots, [*site, "page"], "left")
    row = lambda name, status: p.select(*site, F.lit(name).alias("check"), F.col("page").alias("subject"), status.alias("status"))
    health = F.when(F.col("health") == "unusable", "fail").when(F.col("health") == "degraded", "warning").otherwise("pass")
    overflow = F.when(F.col("overflow"), "warning").otherwise("pass")
    sizes = F.when(F.col("bad"), "fail").when(F.col("bad").isNull(), "warning").otherwise("pass")
    views = pages.groupBy(*site, "url").agg(F.count_distinct("viewport").alias("n"), F.min_by("page", "ord").alias("subject"))
    responsive = views.select(*site, F.lit("responsive").alias("check"), "subject", F.when(F.col("n") >= 2, "pass").otherwise("warning").alias("status"))
    return row("page-health", health).unionByName(row("overflow", overflow)).unionByName(row("screenshot-dimensions", sizes)).unionByName(responsive)


def preview_fit(width: Column, height_a: Column, height_b: Column, most_width: Column, most_pixels: Column) -> Column:
    """struct(width, height_a, height_b, scale) of two images of one width shown within bounds; all sizes follow from one scale. Null for sizes that are not positive."""
    proposed = F.least(F.lit(1.0), most_width / width, F.sqrt(most_pixels / (width * F.greatest(height_a, height_b))))
    shown = F.greatest(F.lit(1), F.floor(width * proposed))
    scale = shown / width
    high = lambda h: F.greatest(F.lit(1), F.floor(h * scale))
    good = (width > 0) & (height_a > 0) & (height_b > 0) & (most_width > 0) & (most_pixels > 0)
    return F.when(good, F.struct(shown.alias("width"), high(height_a).alias("height_a"), high(height_b).alias("height_b"), scale.alias("scale")))


def site_name(named: Column, from_page: Column, address: Column) -> Column:
    """The stored name, a page's, or the host without www."""
    bare = lambda c: F.nullif(F.trim(c), F.lit(""))
    host = F.regexp_replace(F.regexp_extract(address, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), r"^www\.", "")
    return F.coalesce(bare(named), bare(from_page), F.nullif(F.lower(host), F.lit("")), address)
