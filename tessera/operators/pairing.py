"""Pairing two captures' entities on several levels: sections, components inside them, observations of responsive and interactive behaviour.

Every level counts the entities of either side by a key and pairs those that are alone on both; what is not resolved passes its status down to what it holds.
Entities stay rows: a group of a thousand candidates is a thousand rows with the name of their match, never one array, and no two candidates meet.
Sides are called a and b. Tables have the columns on (a comparison) and page (what a page is compared by) besides those named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import css
from ..staging import cut, dealt
from . import roles

#: Properties of a matched section that are compared, fixed values.
LAYOUT_PROPERTIES = ("order", "layoutMode", "display", "position", "maxWidth", "gridTemplateColumns", "childGridTemplateColumns")
GRID_PROPERTIES = ("gridTemplateColumns", "childGridTemplateColumns")
#: What is said of a comparison besides its status, fixed values.
INTERACTION_UNPAIRED, RESPONSIVE_UNPAIRED = "interaction-observations-unpaired", "responsive-observations-unpaired"
ORDER_PROPERTIES = ("order", "sequenceIndex")


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def component_signature(kind: str = "type") -> Column:
    return F.concat_ws("|", _text(kind), _text("element_kind"), _text("role"))


def section_signatures(sections: DataFrame, components: DataFrame, page: list[str]) -> DataFrame:
    """sections with signature: role, layout mode, the parent's role (root without a parent, unknown for one that is not there) and the components it holds, each kind with its number.

    sections: page, id, role, layout_mode, parent_id; components: page, section_id, type, element_kind, role.
    """
    # Both groupings lie within a section, so components are dealt out once.
    held = components.select(*page, "section_id", component_signature().alias("kind")).repartition(*page, "section_id").groupBy(*page, "section_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy(*page, "section_id").agg(F.array_sort(F.collect_list(F.concat_ws("*", "kind", "n"))).alias("_held"))
    above = sections.select(*page, F.col("id").alias("parent_id"), F.col("role").alias("_above"))
    out = sections.join(dealt(above), [*page, "parent_id"], "left").join(dealt(held.withColumnRenamed("section_id", "id")), [*page, "id"], "left")
    parent = F.when(F.col("parent_id").isNull(), F.lit("root")).otherwise(F.coalesce("_above", F.lit("unknown")))
    signature = F.concat_ws("|", _text("role"), _text("layout_mode"), parent, F.array_join(F.coalesce("_held", F.array().cast("array<string>")), ","))
    return out.select(*sections.columns, signature.alias("signature"))


def _sides(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    return a.select(*columns, F.lit("a").alias("side")).unionByName(b.select(*columns, F.lit("b").alias("side")))


def _counted(rows: DataFrame, key: list[str], prefix: str) -> DataFrame:
    """rows with the numbers of either side's rows that share key."""
    number = lambda s: F.count(F.when(F.col("side") == s, 1)).alias(f"{prefix}_{s}")
    return rows.join(dealt(rows.groupBy(*key).agg(number("a"), number("b"))), key)


def _alone(prefix: str) -> Column:
    return (F.col(f"{prefix}_a") == 1) & (F.col(f"{prefix}_b") == 1)


def _both(prefix: str) -> Column:
    return (F.col(f"{prefix}_a") > 0) & (F.col(f"{prefix}_b") > 0)


def _named(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.md5(F.concat_ws("\n", *parts)))


def match_sections(a: DataFrame, b: DataFrame, page: list[str]) -> DataFrame:
    """page, side, id, match, status, confidence, reason for each section of either side: by signature (high), else by role (medium), where that names one section on each side.

    a, b: page, id, role, signature. Sections that share a role with the other side without being alone are ambiguous, the rest unmatched; members of one match share its name.
    """
    told = cut(_sides(a, b, [*page, "id", "role", "signature"]).withColumns({"role": _text("role"), "signature": F.when(F.col("signature").isNotNull(), _named("signature", F.col("signature")))}))
    rows = cut(_counted(told, [*page, "signature"], "sig"))
    exact = rows.where(_alone("sig"))
    rest = _counted(rows.where(~_alone("sig")), [*page, "role"], "role")
    status = F.when(_alone("role"), "matched").when(_both("role"), "ambiguous").otherwise("unmatched")
    said = {
        "status": status, "confidence": F.when(_alone("role"), "medium").otherwise("none"),
        "reason": F.when(_alone("role"), "unique-role").when(_both("role"), "duplicate-semantic-candidates").otherwise("missing-counterpart"),
    }
    first = exact.select(*page, "side", "id", F.col("signature").alias("match"), F.lit("matched").alias("status"), F.lit("high").alias("confidence"), F.lit("exact-semantic-signature").alias("reason"))
    return first.unionByName(rest.select(*page, "side", "id", _named("role", F.col("role")).alias("match"), *(c.alias(n) for n, c in said.items())))


def match_components(a: DataFrame, b: DataFrame, sections: DataFrame, page: list[str]) -> DataFrame:
    """page, side, id, match, status, confidence, reason for each component whose section sections (of match_sections) tells of.

    Inside a matched section components pair by type, kind and role where each side has one. Inside an unresolved one they stay unresolved with it: ambiguous if
    the section is and both sides have components there, else unmatched. a, b: page, id, section_id, type, element_kind, role.
    """
    columns = [*page, "id", "section_id"]
    kinds = [x.withColumn("signature", component_signature()) for x in (a, b)]
    parents = sections.select(*page, "side", F.col("id").alias("section_id"), F.col("match").alias("parent"), F.col("status").alias("parent_status"))
    rows = _sides(*kinds, [*columns, "signature"]).join(dealt(parents), [*page, "side", "section_id"])
    resolved = F.col("parent_status") == "matched"
    name = F.unhex(F.md5(F.concat_ws("\n", "parent", F.when(resolved, F.col("signature")).otherwise(F.lit("")))))
    rows = _counted(rows.select(*page, "side", "id", "parent_status", name.alias("_name")), [*page, "_name"], "n")
    unsettled = (F.col("parent_status") == "ambiguous") & _both("n")
    status = F.when(resolved & _alone("n"), "matched").when((resolved & _both("n")) | (~resolved & unsettled), "ambiguous").otherwise("unmatched")
    reason = F.when(resolved & _alone("n"), "exact-semantic-signature").when(resolved & _both("n"), "duplicate-semantic-candidates").when(~resolved & unsettled, "parent-section-unresolved").otherwise("missing-counterpart")
    confidence = F.when(F.col("status") == "matched", "high").otherwise("none")
    out = rows.select(*page, "side", "id", F.concat(F.lit("component:"), F.lower(F.hex("_name"))).alias("match"), status.alias("status"), reason.alias("reason"))
    return out.select(*page, "side", "id", "match", "status", confidence.alias("confidence"), "reason")


def match_summary(matches: DataFrame, on: list[str], page: list[str]) -> DataFrame:
    """on, matched_pairs, high_confidence_pairs, medium_confidence_pairs, ambiguous_groups, unmatched_entities."""
    pair = (F.col("status") == "matched") & (F.col("side") == "a")
    of = lambda c: F.count(F.when(c, 1))
    groups = matches.groupBy(*page, "match").agg(of(pair).alias("p"), of(pair & (F.col("confidence") == "high")).alias("h"), of(F.col("status") == "unmatched").alias("u"), F.max(F.when(F.col("status") == "ambiguous", 1).otherwise(0)).alias("g"))
    total = lambda c: F.sum(c).cast("long")
    return groups.groupBy(*on).agg(
        total("p").alias("matched_pairs"), total("h").alias("high_confidence_pairs"), total(F.col("p") - F.col("h")).alias("medium_confidence_pairs"),
        total("g").alias("ambiguous_groups"), total("u").alias("unmatched_entities"),
    )


def pairs(matches: DataFrame, page: list[str]) -> DataFrame:
    """page, a_id, b_id, confidence of the matched entities."""
    some = matches.where("status = 'matched'")
    side = lambda s: some.where(F.col("side") == s).select(*page, "match", F.col("id").alias(f"{s}_id"), *(["confidence"] if s == "a" else []))
    return side("a").join(dealt(side("b")), [*page, "match"]).select(*page, "a_id", "b_id", "confidence")


def layout_value(name: str, value: Column) -> Column:
    """A compared property's value: grids by their number of columns, other texts with blanks collapsed; empty is null."""
    plain = F.nullif(F.trim(F.regexp_replace(value.cast("string"), r"\s+", " ")), F.lit(""))
    return F.when(F.length(value) > 0, F.coalesce(css.grid_columns(value).cast("string"), plain)) if name in GRID_PROPERTIES else plain


def layout_changes(paired: DataFrame, a: DataFrame, b: DataFrame, page: list[str]) -> DataFrame:
    """page, a_id, b_id, role, property, before, after for each property of LAYOUT_PROPERTIES that differs between matched sections. a, b: page, id, role and those properties."""
    values = lambda s: [layout_value(p, F.col(f"{s}.{p}")) for p in LAYOUT_PROPERTIES]
    both = paired.alias("p").join(dealt(a.alias("a")), [*(F.col(f"p.{k}") == F.col(f"a.{k}") for k in page), F.col("p.a_id") == F.col("a.id")])
    both = both.join(dealt(b.alias("b")), [*(F.col(f"p.{k}") == F.col(f"b.{k}") for k in page), F.col("p.b_id") == F.col("b.id")])
    told = F.array(*(F.struct(F.lit(p).alias("property"), x.alias("before"), y.alias("after")) for p, x, y in zip(LAYOUT_PROPERTIES, values("a"), values("b"), strict=True)))
    out = both.select(*(F.col(f"p.{k}").alias(k) for k in page), "a_id", "b_id", F.col("a.role").alias("role"), F.inline(told))
    return out.where(~F.col("before").eqNullSafe(F.col("after")))


def responsive_values(changes: DataFrame, observations: DataFrame, sections: DataFrame, on: list[str]) -> DataFrame:
    """on, id, section, from_viewport, to_viewport, path, value: what each observation with a useful change says. Observations of sections that are not there say nothing.

    changes: on, id, ord, property, before, after; observations: on, id, section, from_viewport, to_viewport, change_type; sections: on, section, role. The changes of one
    observation are one group, a few properties.
    """
    known = observations.join(dealt(sections.select(*on, "section", F.col("role").alias("_role"))), [*on, "section"])
    each = changes.join(dealt(known), [*on, "id"]).where(roles.useful_change(F.col("property"), F.col("before"), F.col("after"), F.col("_role")))
    shown = F.concat(F.col("property"), F.lit(": "), F.coalesce("before", F.lit("—")), F.lit(" → "), F.coalesce("after", F.lit("—")))
    key = [*on, "id", "section", "from_viewport", "to_viewport", "change_type", "_role"]
    told = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", shown.alias("text")))).alias("_texts"), F.min(F.col("property").isin(*ORDER_PROPERTIES)).alias("_moved"))
    kind = F.when(F.col("_moved"), "reorder").otherwise(F.col("change_type"))
    path = F.concat(F.lit("responsive."), F.col("_role"), F.lit("."), F.col("from_viewport"), F.lit("-"), F.col("to_viewport"))
    value = F.concat(kind, F.lit(" · "), F.array_join(F.transform("_texts", lambda t: t["text"]), ", "))
    return told.select(*on, "id", "section", "from_viewport", "to_viewport", path.alias("path"), value.alias("value"))


def pair_responsive(a: DataFrame, b: DataFrame, paired: DataFrame, on: list[str]) -> DataFrame:
    """on, a_id, b_id, path, before, after, state (same, changed or unpaired) for each of a's values: its section's match must have exactly one value between the same viewports.

    a, b: of responsive_values; paired: on, a_id, b_id of sections.
    """
    viewports = ["from_viewport", "to_viewport"]
    target = paired.select(*on, F.col("a_id").alias("section"), F.col("b_id").alias("_section"))
    mapped = a.join(dealt(target), [*on, "section"], "left")
    one = b.groupBy(*on, F.col("section").alias("_section"), *viewports).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("b_id"), F.min("value").alias("after")).where("_n = 1")
    met = mapped.join(dealt(one), [*on, "_section", *viewports], "left")
    state = F.when(F.col("b_id").isNull(), "unpaired").when(F.col("value") == F.col("after"), "same").otherwise("changed")
    return met.select(*on, F.col("id").alias("a_id"), "b_id", "path", F.col("value").alias("before"), "after", state.alias("state"))


def responsive_result(met: DataFrame, b: DataFrame, sections: DataFrame, captures: DataFrame, on: list[str]) -> DataFrame:
    """on, status, changes, limitations of the responsive category for each row of captures.

    met: of pair_responsive; b: the other side's values; sections: of match_sections; captures: on, viewports (the smaller number of either side) and mismatch
    (whether either side reports sections that changed their identity). With one viewport a comparison is inconclusive, and where nothing could be paired, unless neither side has values and a section matches.
    """
    of = lambda c: F.count(F.when(c, 1))
    state = F.col("state")
    mine = met.groupBy(*on).agg(F.count(F.lit(1)).alias("_useful"), of(state == "unpaired").alias("_open"), of(state == "changed").alias("changes"), F.count_distinct("b_id").alias("_used"))
    theirs = b.groupBy(*on).agg(F.count(F.lit(1)).alias("_theirs"))
    matched = sections.groupBy(*on).agg(of(F.col("status") == "matched").alias("_matched"), of(F.col("status") != "matched").alias("_unresolved"))
    out = captures.join(mine, on, "left").join(theirs, on, "left").join(matched, on, "left")
    out = out.fillna(0, ["_useful", "_open", "changes", "_used", "_theirs", "_matched", "_unresolved"])
    paired = F.col("_useful") - F.col("_open")
    told = (paired > 0) | ((F.col("_useful") == 0) & (F.col("_theirs") == 0) & (F.col("_matched") > 0))
    single = F.col("viewports") < 2
    unpaired = (F.col("_open") > 0) | (F.col("_used") != F.col("_theirs")) | F.col("mismatch") | (F.col("_unresolved") > 0)
    limits = F.array_compact(F.array(F.lit("matched-responsive-observations-only"), F.when(single, "single-viewport"), F.when(~single & unpaired, RESPONSIVE_UNPAIRED)))
    changes = F.when(single, F.lit(0)).otherwise(F.col("changes"))
    status = F.when(single, "inconclusive").when(changes > 0, "changed").when(told, "unchanged").otherwise("inconclusive")
    return out.select(*on, status.alias("status"), changes.alias("changes"), limits.alias("limitations"))


def interaction_groups(observed: DataFrame, page: list[str]) -> DataFrame:
    """page, driver, trigger, properties, value: what the observations of one driver, trigger and set of properties say together, without repeats and sorted.

    observed: page, id, driver, trigger, property, before, after, a row for each changed property; before is null where the state before was not seen. Where any observation of a group saw it, the others
    do not count. Values of transform are compared as matrices. The properties of one observation are one group, and so are the different values of a page's group.
    """
    normal = lambda c: F.when(F.col("property") == "transform", css.transform_matrix(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("none")))).otherwise(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    shown = lambda c: F.coalesce(F.nullif(normal(F.col(c)), F.lit("")), F.lit("—"))
    text = F.concat(F.col("property"), F.lit(": "), shown("before"), F.lit(" → "), shown("after"))
    one = observed.groupBy(*page, "id", "driver", "trigger").agg(F.array_sort(F.collect_list(F.struct("property", text.alias("text")))).alias("_p"), F.max(F.col("before").isNotNull()).alias("_seen"))
    names, said = F.array_join(F.transform("_p", lambda p: p["property"]), "+"), F.array_join(F.transform("_p", lambda p: p["text"]), ", ")
    key = [*page, "driver", "trigger", "properties"]
    distinct = one.select(*page, "driver", "trigger", names.alias("properties"), said.alias("value"), "_seen").groupBy(*key, "value").agg(F.max("_seen").alias("_seen"))
    values = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("value"))))
    grouped = distinct.groupBy(*key).agg(values(F.col("_seen")).alias("_direct"), values(F.lit(True)).alias("_all"))
    return grouped.select(*key, F.array_join(F.when(F.size("_direct") > 0, F.col("_direct")).otherwise(F.col("_all")), " | ").alias("value"))


def pair_interactions(a: DataFrame, b: DataFrame, page: list[str]) -> DataFrame:
    """page, driver, trigger, properties, before, after, state for each group of either side; a group that only one side has is unpaired, which is no change. a, b: of interaction_groups."""
    key = [*page, "driver", "trigger", "properties"]
    both = a.withColumnRenamed("value", "before").join(b.withColumnRenamed("value", "after"), key, "full_outer")
    state = F.when(F.col("before").isNull() | F.col("after").isNull(), "unpaired").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return both.select(*key, "before", "after", state.alias("state"))


def interaction_result(met: DataFrame, captures: DataFrame, on: list[str]) -> DataFrame:
    """on, status, changes, limitations of the interaction category for each row of captures: on, coverage_differs."""
    of = lambda c: F.count(F.when(c, 1))
    state = F.col("state")
    found = met.groupBy(*on).agg(of(state != "unpaired").alias("_paired"), of(state == "unpaired").alias("_open"), of(state == "changed").alias("changes"))
    out = captures.join(found, on, "left").fillna(0, ["_paired", "_open", "changes"])
    status = F.when(F.col("changes") > 0, "changed").when(F.col("_paired") > 0, "unchanged").otherwise("inconclusive")
    limits = F.array_compact(F.array(F.lit("observed-interaction-styles-only"), F.when((F.col("_open") > 0) | F.col("coverage_differs"), INTERACTION_UNPAIRED)))
    return out.select(*on, status.alias("status"), "changes", limits.alias("limitations"))
