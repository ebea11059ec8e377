"""Comparing two captures' results: seven categories behind one gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diffs, gates, manifests, matching, merges, pairing
from ..staging import cut

CATEGORIES = ("colors", "typography", "spacing", "radii", "layout", "interaction-states", "responsive")
#: Interaction states and responsive behaviour need evidence that snapshots of tokens and sections do not hold.
COMPARED = ("colors", "typography", "spacing", "radii", "layout")
_OF_GROUP = {"colors": "colors", "fontSizes": "typography", "fontFamilies": "typography", "fontWeights": "typography", "lineHeights": "typography", "spacing": "spacing", "radii": "radii"}


def gate(a: DataFrame, b: DataFrame, on: list[str], fields: list[str], soft: list[str] = ()) -> DataFrame:
    """on, reasons, limitations, comparability of two manifests; soft fields limit without making a comparison inconclusive."""
    both = a.select(*on, *(F.col(f).alias(f"a_{f}") for f in [*fields, *soft])).join(b.select(*on, *(F.col(f).alias(f"b_{f}") for f in [*fields, *soft])), on, "full_outer")
    side = lambda s, names: {n: F.col(f"{s}_{n}") for n in names}
    reasons = gates.field_reasons(side("a", fields), side("b", fields))
    limits = gates.field_reasons(side("a", soft), side("b", soft)) if soft else F.array().cast("array<string>")
    return both.select(*on, reasons.alias("reasons"), limits.alias("limitations")).withColumn("comparability", gates.comparability(F.col("reasons"), F.col("limitations")))


def capture_gate(captures: DataFrame, on: list[str]) -> DataFrame:
    """on, reasons, limitations, comparability of pairs of captures: why their evidence or their manifests cannot be compared.

    captures: on, a, b, pages_a, pages_b (see merges.capture_reasons), manifest_a, manifest_b (see manifests.with_comparability).
    """
    told = manifests.with_comparability(captures)
    own = merges.capture_reasons(F.col("a"), F.col("b"), F.col("pages_a"), F.col("pages_b"))
    out = told.select(*on, F.array_sort(F.array_union(own, F.col("manifest_reasons"))).alias("reasons"), F.col("manifest_limitations").alias("limitations"))
    return out.withColumn("comparability", gates.comparability(F.col("reasons"), F.col("limitations")))


def compare_evidence(a: dict[str, DataFrame], b: dict[str, DataFrame], captures: DataFrame, comparable: DataFrame, on: list[str]) -> DataFrame:
    """on, category, status, changes, limitations of layout, interaction states and responsive behaviour, inconclusive where comparable (of capture_gate) says so.

    a, b: sections (on, page, id, role, parent_id, layout_mode, and the properties of pairing.LAYOUT_PROPERTIES), components (see pairing), interactions (of one row for each changed property),
    changes and observations (responsive ones). captures: on, viewports, mismatch, coverage_differs. Section ids are unique within on.
    """
    page = [*on, "page"]
    signed = [pairing.section_signatures(x["sections"], x["components"], page) for x in (a, b)]
    matches = cut(pairing.match_sections(*signed, page))
    paired = cut(pairing.pairs(matches, page))
    of = lambda c: F.count(F.when(c, 1))
    moved = pairing.layout_changes(paired, a["sections"], b["sections"], page).groupBy(*on).agg(F.count(F.lit(1)).alias("changes"))
    told = matches.groupBy(*on).agg(of(F.col("status") == "matched").alias("_m"), of(F.col("status") != "matched").alias("_u"), of(F.col("confidence") == "medium").alias("_c"))
    layout = captures.select(*on).join(moved, on, "left").join(told, on, "left").fillna(0, ["changes", "_m", "_u", "_c"])
    limits = F.array_compact(F.array(F.lit("section-level-properties-only"), F.when(F.col("_u") > 0, "unresolved-entities-excluded"), F.when(F.col("_c") > 0, "medium-confidence-entity-matches")))
    status = F.when(F.col("changes") > 0, "changed").when(F.col("_m") > 0, "unchanged").otherwise("inconclusive")
    layout = layout.select(*on, status.alias("status"), "changes", limits.alias("limitations"))
    acts = pairing.pair_interactions(*(pairing.interaction_groups(x["interactions"], page) for x in (a, b)), page)
    values = [pairing.responsive_values(x["changes"], x["observations"], x["sections"].select(*on, F.col("id").alias("section"), "role"), on) for x in (a, b)]
    met = pairing.pair_responsive(*values, paired.select(*on, "a_id", "b_id"), on)
    results = {
        "layout": layout, "interaction-states": pairing.interaction_result(acts, captures, on),
        "responsive": pairing.responsive_result(met, values[1], matches, captures, on),
    }
    every = reduce(DataFrame.unionByName, (df.withColumn("category", F.lit(name)) for name, df in results.items()))
    return gates.fail_closed(every.select(*on, "category", "status", "changes", "limitations"), comparable, on)


def compare(tokens_a: DataFrame, tokens_b: DataFrame, sections_a: DataFrame, sections_b: DataFrame, comparable: DataFrame, on: list[str], observed: DataFrame | None = None) -> DataFrame:
    """on, category, status, changes for all categories; inconclusive throughout where comparable says so, and for the categories that are not looked at.

    tokens: on, group, value, ord; sections: on, page, id, signature, role, layoutMode; comparable: on, comparability; observed: of compare_evidence, whose categories stand instead of
    those that tokens and sections tell.
    """
    names = F.create_map(*(F.lit(x) for kv in _OF_GROUP.items() for x in kv))
    some = lambda t: t.withColumn("category", F.element_at(names, F.col("group"))).where("category is not null")
    scales = diffs.scale_diff(some(tokens_a), some(tokens_b), [*on, "category", "group"], "value", "ord").groupBy(*on, "category").agg(F.count(F.lit(1)).alias("changes"))
    matched = matching.match_entities(sections_a, sections_b, [*on, "page"], ["signature"], ["role"])
    a, b = sections_a.select(*on, F.col("id").alias("a_id"), F.col("layoutMode").alias("x")), sections_b.select(*on, F.col("id").alias("b_id"), F.col("layoutMode").alias("y"))
    moved = matched.where("status = 'matched'").join(a, [*on, "a_id"]).join(b, [*on, "b_id"]).where(~F.col("x").eqNullSafe(F.col("y")))
    layout = moved.groupBy(*on).agg(F.count(F.lit(1)).alias("changes")).withColumn("category", F.lit("layout"))
    every = comparable.select(*on, F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    found = every.join(scales.unionByName(layout), [*on, "category"], "left").withColumn("changes", F.coalesce("changes", F.lit(0)))
    told = found.withColumn("status", F.when(~F.col("category").isin(*COMPARED), "inconclusive").when(F.col("changes") > 0, "changed").otherwise("unchanged"))
    if observed is not None:
        seen = observed.select(*on, "category", F.col("status").alias("_status"), F.col("changes").alias("_changes"))
        told = told.join(seen, [*on, "category"], "left").withColumns({"status": F.coalesce("_status", "status"), "changes": F.coalesce("_changes", "changes")}).drop("_status", "_changes")
    return gates.fail_closed(told, comparable, on)
