"""More queries over the driver's tables: roles, colour roles, merges and gates, with DuckDB SQL for the same rows.

The stand-in inputs are written once, in SQL that both engines read; the operators and the expected results are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color
from .operators import color_roles, merges, roles

_ROLE_WORDS = ("btn primary", "status up", "delta down trend", "cta", "delete-btn", "warning", "card", "pill action", "healthy", "checkout", "trend positive", "nav_secondary", "x invalid")


def _case(n: str, words) -> str:
    return f"CASE {n} " + " ".join(f"WHEN {i} THEN {'NULL' if w is None else repr(w)}" for i, w in enumerate(words)) + " END"


def _rgb(i: str) -> str:
    return f"printf('rgb(%d, %d, %d)', ({i} * 37 + 20) % 256, ({i} * 91 + 10) % 256, ({i} * 53 + 200) % 256)"


def _hex(i: str) -> str:
    return f"printf('#%02x%02x%02x', ({i} * 37 + 20) % 256, ({i} * 91 + 10) % 256, ({i} * 53 + 200) % 256)"


#: Stand-ins, by name: SQL over the tables.
INPUTS = {
    "elements": "SELECT p_partkey AS id, " + _case(f"p_partkey % {len(_ROLE_WORDS)}", _ROLE_WORDS) + " AS context, " + _case("p_size % 5", ("button", "a", "input", "div", "span")) + " AS tag, "
    + _case("p_partkey % 9", ("button", "status", None, None, "alert", None, None, None, None)) + " AS role, " + _case("p_partkey % 4", ("submit", "text", "button", None)) + " AS input_type, "
    "CASE WHEN p_partkey % 10 > 1 THEN '/x' ELSE '' END AS href, " + _case("p_partkey % 8", (None, "off", None, "polite", None, None, None, None)) + " AS aria, "
    + _case("p_partkey % 3", ("transparent", "rgba(1, 2, 3, 0)", "#fff")) + " AS background, p_size % 3 AS border, p_size * 2 AS width, p_partkey % 60 AS height, p_partkey % 12 AS pad_inline, p_size % 9 AS pad_block FROM part",
    "sections": "SELECT l_orderkey AS page, l_linenumber AS id, " + _case("l_partkey % 13", ("HEADER", "nav", "FOOTER", "ASIDE", "MAIN", "SECTION", "ARTICLE", "DIV", "DIV", "DIV", "SECTION", "DIV", "DIV")) + " AS tag, "
    + _case("l_suppkey % 17", ("banner", "navigation", "contentinfo", "complementary", *[None] * 13)) + " AS aria, l_quantity % 6 = 0 AS h1, l_partkey % 3000 AS top, CASE WHEN l_quantity % 4 = 0 THEN l_quantity * 2000 END AS media, "
    "l_quantity * 4000 + 1 AS area, l_linenumber AS children, l_suppkey % 4 AS alike, l_partkey % 900 AS chars, l_suppkey % 500 AS link_chars, l_linenumber % 3 AS actions FROM lineitem",
    "observations": "SELECT o_custkey % 50 AS site, o_orderkey AS ord, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'primary-action' WHEN '2' THEN 'action' WHEN '3' THEN 'action' ELSE 'status' END AS role, "
    f"CASE WHEN o_orderkey % 11 < 2 THEN NULL WHEN o_orderkey % 2 = 0 THEN {_rgb('((o_custkey * 7 + o_orderkey) % 6)')} ELSE {_hex('((o_custkey * 7 + o_orderkey) % 6)')} END AS background, ((o_custkey * 7 + o_orderkey) % 6) AS bi, "
    f"CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE {_hex('(o_orderkey % 5 + 4)')} END AS foreground, (o_orderkey % 5 + 4) AS fi, CASE o_orderstatus WHEN 'F' THEN 'positive' WHEN 'O' THEN 'warning' ELSE 'negative' END AS status_intent, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'delta' END AS status_kind, CAST(o_custkey AS VARCHAR(20)) AS element FROM orders",
    "primaries": f"SELECT DISTINCT o_custkey % 50 AS site, {_hex('((o_custkey % 50) % 6)')} AS primary, ((o_custkey % 50) % 6) AS pi, {_hex('((o_custkey % 50) % 4 + 3)')} AS foreground, ((o_custkey % 50) % 4 + 3) AS oi FROM orders",
    "colour_usage": f"SELECT c_nationkey AS site, c_custkey AS ord, CASE WHEN c_nationkey % 4 = 0 AND c_custkey % 6 = 0 THEN 'bgColor' ELSE {_case('c_custkey % 6', ('structuralBorderColor', 'borderColor', 'bgColor', 'linkColor', 'statusColor', 'borderColor'))} END AS category, "
    f"{_hex('(c_custkey % 40)')} AS value, c_custkey % 40 AS vi, c_custkey % 97 AS n FROM customer",
    "near_colours": "SELECT c_nationkey AS site, c_custkey AS ord, c_custkey % 40 AS vi, least(255, (c_custkey % 40 * 37 + 20) % 256 + c_custkey % 4 * 8) AS red, "
    "printf('#%02x%02x%02x', least(255, (c_custkey % 40 * 37 + 20) % 256 + c_custkey % 4 * 8), (c_custkey % 40 * 91 + 10) % 256, (c_custkey % 40 * 53 + 200) % 256) AS value FROM customer",
    "motion": "SELECT user_id AS site, event_id AS ord, event_type AS property, printf('%dms', CAST(user_id * 7 + event_id AS BIGINT) % 4 * 100) AS duration, CASE WHEN event_id % 2 = 0 THEN 'ease' ELSE 'linear' END AS easing, event_id % 5 + 1 AS n FROM events",
    "spacings": "SELECT p_brand AS site, p_partkey AS i, CASE WHEN p_partkey % 7 = 0 THEN 'auto' ELSE printf('%dpx', CAST(p_size * 3 AS BIGINT)) END AS value, p_size * 3 AS px, p_partkey % 7 = 0 AS odd, p_partkey % 30 AS n FROM part",
    "variables": "SELECT user_id AS site, event_id AS ord, event_type AS name, CAST(event_id % 10 AS VARCHAR(4)) AS value FROM events",
    "captures": "SELECT event_id AS id, user_id AS url, " + _case("event_id % 4", ("mobile", "tablet", "desktop", "watch")) + " AS viewport, event_id AS ord FROM events",
    "changes": "SELECT l_orderkey AS page, l_linenumber AS id, " + _case("l_partkey % 9", ("rect.x", "height", "boxShadow", "node.heading.fontSize", "borderTop", "gridTemplateColumns", "order", "media.height", "color")) + " AS property, "
    + _case("l_suppkey % 9", ("10px", "0px none", "1px solid red", "", None, "1px solid transparent", "2px solid rgba(0, 0, 0, 0)", "medium none", "0.5px solid red")) + " AS before, " + _case("l_partkey % 4", ("10px", "20px", "repeat(3, 1fr)", "none")) + " AS after, " + _case("l_linenumber % 4", ("header", "hero", "action", "content")) + " AS role FROM lineitem",
}


def _input(spark: SparkSession, d: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("part", "lineitem", "orders", "customer", "events")}
    used = {t: df for t, df in tables.items() if f"FROM {t}" in INPUTS[name]}
    sql = INPUTS[name]
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **used)


def candidate_roles(spark, d):
    e = _input(spark, d, "elements")
    r = roles.candidate_role(*(F.col(c) for c in ("context", "tag", "role", "input_type", "href", "aria", "background", "border", "width", "height", "pad_inline", "pad_block")))
    return e.select("id", r.alias("r")).select("id", "r.element_kind", "r.role", "r.status_kind", "r.status_intent")


def section_roles(spark, d):
    s = _input(spark, d, "sections")
    c = F.col
    role = roles.section_role(c("tag"), c("aria"), c("h1"), c("top"), F.lit(900), c("media"), c("area"), c("children"), c("alike"), c("chars"), c("link_chars"), c("actions"), F.lit(150000.0))
    return s.select("page", "id", role.alias("role"))


def page_roles(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    path = F.concat(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.element_at(F.array(*map(F.lit, ("", "/pricing", "/studio/x", "/profile/", "/dashboard", "/features", "/Blog/1"))), (F.col("page_id") % 7 + 1).cast("int")))
    h = F.col("html")
    i = F.col("page_id")
    role = roles.page_role(path, i % 11 == 0, i * 7 % 900, F.length(h), h.contains("<h1"), h.contains("<form"), h.contains("<table"), h.contains("<nav"), h.contains("<h1"), i % 4)
    return p.select("page_id", role.alias("role"))


def element_geometry(spark, d):
    e = _input(spark, d, "elements")
    r = roles.normalised_rect((F.col("width") * 20 - 100).cast("double"), (F.col("height") * 30).cast("double"), (F.col("width") * 9).cast("double"), F.col("height").cast("double"), F.lit(1200.0), F.lit(1500.0))
    kind = roles.media_kind(F.element_at(F.array(*map(F.lit, ("video", "svg", "canvas", "img", "div"))), (F.col("id") % 5 + 1).cast("int")))
    chrome = F.col("id") % 3 == 0
    out = e.select("id", r.alias("r"), kind.alias("kind"), "width", "height", chrome.alias("chrome"), (F.col("id") % 40 - 4).alias("radius"))
    px = F.concat(F.col("radius").cast("string"), F.lit("px"))
    anchor = roles.section_anchor(F.col("r.x"), F.col("r.width"))
    mode = roles.layout_mode(F.element_at(F.array(*map(F.lit, ("sticky", "fixed", "absolute", "static"))), (F.col("id") % 4 + 1).cast("int")), F.when(F.col("id") % 3 == 0, "auto").otherwise("2"))
    importance = roles.media_importance(F.col("kind"), F.col("width") * 4, F.col("height") * 4, F.lit(400000.0), F.col("chrome"))
    return out.select("id", *(F.round(F.col("r")[k], 6).alias(k) for k in ("x", "y", "width", "height")), anchor.alias("anchor"), "kind", importance.alias("importance"), roles.component_shape(px, F.col("height")).alias("shape"), mode.alias("mode"))


def change_types(spark, d):
    c = _input(spark, d, "changes").withColumn("property", F.when(F.col("property") == "order", "sequenceIndex").when(F.col("property") == "color", "interactionModel").otherwise(F.col("property")))
    kinds = c.groupBy("page").agg(F.collect_set("property").alias("changed"))
    return kinds.select("page", roles.change_type(F.col("changed")).alias("change_type"))


def useful_changes(spark, d):
    c = _input(spark, d, "changes")
    return c.select("page", "id", roles.useful_change(*(F.col(x) for x in ("property", "before", "after", "role"))).alias("useful"))


def ordered_before(spark, d):
    s = _input(spark, d, "sections").select("page", "id", F.upper("tag").alias("role"))
    return roles.ordered_pairs(s, ["page"], ["id", "role"])


def focus_indicators(spark, d):
    e = _input(spark, d, "elements")
    pick = lambda values, by: F.element_at(F.array(*(F.lit(v) for v in values)), (by + 1).cast("int"))
    shadow, style = pick(("none", "0px 0px 3px rgb(1, 2, 3)", None), F.col("id") % 3), pick(("solid", "none", "inherit", None), F.col("id") % 4)
    width, paint = pick(("2px", "0px", "thin", None, "1rem"), F.col("id") % 5), pick(("#123456", "transparent", "inherit", None, "rgba(1, 2, 3, 0)", "red", "blue"), F.col("id") % 7)
    return e.select("id", roles.focus_visible(F.when(F.col("id") % 11 == 0, "hover").otherwise("focus"), shadow, style, width, paint).alias("visible"))


def primary_action_role(spark, d):
    return color_roles.primary_action(_input(spark, d, "observations"), _input(spark, d, "primaries"), ["site"])


def semantic_status_pairs(spark, d):
    return color_roles.semantic_pairs(_input(spark, d, "observations"), ["site"])


def action_accents(spark, d):
    o, p = _input(spark, d, "observations"), _input(spark, d, "primaries")
    text, other, seen = color_roles.text_only_accent(o, ["site"]), color_roles.secondary_action(o, p, ["site"]), color_roles.has_action_background(o, ["site"])
    return seen.join(text, "site", "left").join(other, "site", "left")


def border_roles(spark, d):
    u = _input(spark, d, "colour_usage")
    return color_roles.border_colors(u, u.groupBy("site").agg(F.min_by("value", "ord").alias("reference")), ["site"])


def palette_remainder(spark, d):
    u = _input(spark, d, "colour_usage")
    palette = u.select("site", F.col("ord").alias("i"), F.when(F.col("ord") % 2 == 0, F.upper("value")).otherwise(F.col("value")).alias("value"))
    return color_roles.palette_rest(palette, u.where("vi % 3 = 0").select("site", "value"), ["site"])


def related_colors(spark, d):
    u = _input(spark, d, "colour_usage").select("site", "ord", "value")
    plain, muted = color_roles.related_order(u, ["site"]), color_roles.related_order(u, ["site"], muted=True)
    return plain.join(muted.select("site", "ord", F.col("place").alias("muted_place")), ["site", "ord"])


def color_role_predicates(spark, d):
    u = _input(spark, d, "colour_usage").select("site", "ord", "value")
    other = lambda k: F.format_string("#%02x%02x%02x", *(((F.col("ord") * m + a) % 256).cast("int") for m, a in k))
    surface, ink = other(((3, 7), (5, 1), (11, 4))), other(((13, 2), (17, 9), (19, 30)))
    used = color_roles.used_in(u, _input(spark, d, "colour_usage"), ["site"], ("linkColor", "bgColor"))
    return used.select("site", "ord", "used", color_roles.secondary_surface(F.col("value"), surface, ink).alias("surface"), color_roles.muted_text(surface, ink, F.col("value")).alias("muted"), color_roles.usable_accent(F.col("value")).alias("accent"))


def color_usage_weights(spark, d):
    return color_roles.usage_weight(_input(spark, d, "near_colours").select("site", F.col("ord").alias("token"), "value"), _input(spark, d, "colour_usage"), ["site"])


def merged_motion(spark, d):
    return merges.merge_motion(_input(spark, d, "motion"), ["site"])


def merged_breakpoints(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("site"), F.col("p_partkey").alias("capture"), (F.col("p_size") * 30 + 60).alias("width"), F.col("p_type").alias("change"))
    out = merges.merge_breakpoints(p, ["site"])
    return out.select("site", "width", "label", F.array_join("changes", ",").alias("changes"))


def spacing_rhythm(spark, d):
    s = _input(spark, d, "spacings")
    rhythm, recipe = merges.spacing_rhythm(s, ["site"]), merges.recipe_spacing(s, ["site"])
    return recipe.join(rhythm, "site", "left").select("site", "spacing", F.array_join(F.transform("rhythm", lambda x: x.cast("long").cast("string")), ",").alias("rhythm"))


def merged_variables(spark, d):
    v = _input(spark, d, "variables")
    last = merges.merge_variables(v, ["site"])
    first = merges.merge_values(v.select("site", "ord", F.col("name").alias("field"), "value"), ["site"])
    return first.join(last.select("site", F.col("name").alias("field"), F.col("value").alias("last")), ["site", "field"])


def export_captures(spark, d):
    return merges.export_capture(_input(spark, d, "captures"), "url", "id", "ord").select("url", "id", "viewport")


def component_specs(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    c = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("type"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).alias("role"), (F.col("p_partkey") % 20).alias("url"),
                 F.create_map(F.lit("gap"), F.col("p_size").cast("string"), F.lit("color"), F.col("p_brand")).alias("styles"), F.array(F.concat(F.lit("t"), (F.col("p_size") % 4).cast("string"))).alias("token_refs"), F.array().cast("array<string>").alias("evidence_refs"))
    out = merges.component_specs(c, [])
    return out.select("component", "role", "instances", "pages", F.array_join(F.element_at("styles", "gap"), ",").alias("gaps"), F.array_join("token_refs", ",").alias("token_refs"), F.array_join("evidence_refs", ",").alias("evidence_refs"))


def representative_styles(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    s = p.select(F.col("p_type").alias("type"), F.concat_ws("/", "p_brand", (F.col("p_size") % 5).cast("string")).alias("styles"), (F.col("p_size") % 5 % 2).alias("rank"), F.length("p_brand").alias("detail"), (F.col("p_partkey") % 7).alias("confidence"))
    return merges.representative_style(s, ["type"])


def visual_qa(spark, d):
    e = _input(spark, d, "captures")
    pages = e.select((F.col("url") % 10).alias("site"), F.col("id").alias("page"), "url", "viewport", F.element_at(F.array(*map(F.lit, ("usable", "degraded", "unusable", None))), (F.col("id") % 4 + 1).cast("int")).alias("health"), (F.col("id") % 3 == 0).alias("overflow"), "ord")
    images = e.where("id % 5 > 0").select((F.col("url") % 10).alias("site"), F.col("id").alias("page"), (F.col("id") % 6).alias("width"), F.lit(4).alias("height"))
    return merges.visual_checks(pages, images, ["site"])


def capture_reasons(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").withColumn("k", F.col("c_custkey"))
    side = lambda s: F.when(F.col("k") % 19 != s, F.struct((F.col("k") % (5 + s)).alias("schema"), (F.col("k") % 4 * s).alias("route"), F.lit("public").alias("access"), F.element_at(F.array(*map(F.lit, ("en", "", "de"))), ((F.col("k") + s) % 3 + 1).cast("int")).alias("language"), F.when(F.col("k") % 7 == s, "partial").otherwise("complete").alias("page_coverage"), F.lit("complete").alias("capture_coverage")))
    page = lambda s: F.array(F.struct((F.col("k") % (3 + s)).cast("string").alias("key"), F.when(F.col("k") % 6 != s, "ok").alias("health"), (F.col("k") % 8 != s).alias("eligible")))
    return c.select("c_custkey", F.array_join(merges.capture_reasons(side(0), side(1), page(0), page(1)), ",").alias("reasons"))


QUERIES = {f.__name__: f for f in (
    candidate_roles, section_roles, page_roles, element_geometry, change_types, useful_changes, ordered_before, focus_indicators, primary_action_role, semantic_status_pairs, action_accents, border_roles,
    palette_remainder, related_colors, color_role_predicates, color_usage_weights, merged_motion, merged_breakpoints, spacing_rhythm, merged_variables, export_captures, component_specs, representative_styles, visual_qa, capture_reasons)}


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({INPUTS[n]})" for n in names)


#: The words of the role rules as the expected results take them, apart from the operator's own.
_SAID = {
    "action-hint": "btn|button|cta|pill|action|primary|secondary",
    "primary-action": "primary|cta|submit|confirm|purchase|checkout|continue",
    "destructive-action": "error|danger|destructive|delete|remove|invalid",
    "status": "status|success|successful|warning|warn|error|danger|destructive|delete|remove|healthy|health|ok|invalid",
    "subject": "delta|trend|change",
    "direction": "up|down|positive|negative|increase|decrease|gain|loss",
    "positive": "success|successful|healthy|health|ok|up|positive|increase|gain",
    "warning": "warning|warn",
    "negative": "error|danger|destructive|delete|remove|invalid|down|negative|decrease|loss",
}


def _said(name: str) -> str:
    return rf"regexp_matches(context, '(?:^|[\s_-])(?:{_SAID[name]})(?:$|[\s_-])')"


def _part(c: str, i: str) -> str:
    return {"r": f"(({i} * 37 + 20) % 256)", "g": f"(({i} * 91 + 10) % 256)", "b": f"(({i} * 53 + 200) % 256)"}[c]


def _linear(x: str) -> str:
    return f"(CASE WHEN {x} / 255.0 <= 0.03928 THEN {x} / 255.0 / 12.92 ELSE power(({x} / 255.0 + 0.055) / 1.055, 2.4) END)"


def _light(i: str) -> str:
    return "(" + " + ".join(f"{w} * {_linear(_part(c, i))}" for c, w in zip("rgb", (0.2126, 0.7152, 0.0722), strict=True)) + ")"


def _light_of(*parts: str) -> str:
    return "(" + " + ".join(f"{w} * {_linear(x)}" for x, w in zip(parts, (0.2126, 0.7152, 0.0722), strict=True)) + ")"


def _ratio(a: str, b: str) -> str:
    return f"((greatest({a}, {b}) + 0.05) / (least({a}, {b}) + 0.05))"


def _top(i: str) -> str:
    return "greatest(" + ", ".join(_part(c, i) for c in "rgb") + ")"


def _chroma(i: str) -> str:
    return f"({_top(i)} - least(" + ", ".join(_part(c, i) for c in "rgb") + "))"


def _grey(i: str) -> str:
    return f"({_chroma(i)} <= 24 OR {_chroma(i)} / greatest(1.0, {_top(i)}) <= 0.12)"


def _far(i: str, j: str) -> str:
    return "sqrt(" + " + ".join(f"power({_part(c, i)} - {_part(c, j)}, 2)" for c in "rgb") + ")"


_ACTS = "(tag = 'button' OR (tag = 'input' AND coalesce(input_type, '') IN ('button', 'submit')) OR coalesce(role, '') = 'button' OR (tag = 'a' AND href <> ''))"
_TREND = f"({_said('subject')} AND {_said('direction')})"
_SURFACE = ("((ord * 3 + 7) % 256)", "((ord * 5 + 1) % 256)", "((ord * 11 + 4) % 256)")
_INK = ("((ord * 13 + 2) % 256)", "((ord * 17 + 9) % 256)", "((ord * 19 + 30) % 256)")

ORACLES = {
    "candidate_roles": _with("elements") + f""", x AS (SELECT *, {_ACTS} AS acts, (tag = 'a' AND href <> '') AS anchor, {_TREND} AS trend,
  coalesce(role IN ('status', 'alert'), false) OR (aria IS NOT NULL AND aria <> 'off') AS announces,
  {_said('action-hint')} AND (background = '#fff' OR border > 0 OR (width >= 44 AND height >= 28 AND (pad_inline >= 8 OR pad_block >= 6))) AS linked FROM elements),
y AS (SELECT *, CASE WHEN NOT acts AND (announces OR {_said('status')} OR trend) THEN 's' WHEN acts AND (NOT anchor OR linked) THEN 'a' END AS k FROM x)
SELECT id, CASE k WHEN 's' THEN 'status' WHEN 'a' THEN CASE WHEN anchor THEN 'anchor' WHEN tag = 'input' AND coalesce(input_type, '') IN ('button', 'submit') THEN 'input' WHEN coalesce(role, '') = 'button' AND tag <> 'button' THEN 'role-button' ELSE 'button' END END AS element_kind,
  CASE k WHEN 's' THEN 'status' WHEN 'a' THEN CASE WHEN {_said('primary-action')} THEN 'primary-action' WHEN {_said('destructive-action')} THEN 'destructive-action' ELSE 'action' END END AS role,
  CASE WHEN k = 's' THEN CASE WHEN trend THEN 'delta' ELSE 'status' END END AS status_kind,
  CASE WHEN k = 's' THEN CASE WHEN {_said('positive')} THEN 'positive' WHEN {_said('warning')} THEN 'warning' WHEN {_said('negative')} THEN 'negative' ELSE 'neutral' END END AS status_intent FROM y""",
    "section_roles": _with("sections") + """ SELECT page, id, CASE WHEN upper(tag) = 'HEADER' OR aria = 'banner' THEN 'header' WHEN upper(tag) = 'NAV' OR aria = 'navigation' THEN 'navigation' WHEN upper(tag) = 'FOOTER' OR aria = 'contentinfo' THEN 'footer'
  WHEN upper(tag) = 'ASIDE' OR aria = 'complementary' THEN 'aside' WHEN h1 AND top < 1350 THEN 'hero' WHEN media >= area * 0.45 THEN 'media' WHEN children >= 3 AND alike >= 2 THEN 'feature-group' WHEN chars > 0 AND link_chars >= chars * 0.6 THEN 'navigation'
  WHEN actions > 0 AND chars > 0 AND chars <= 480 AND area / 150000.0 <= 0.35 THEN 'action' WHEN upper(tag) IN ('MAIN', 'ARTICLE', 'SECTION') THEN 'content' ELSE 'unknown' END AS role FROM sections""",
    "page_roles": r"""WITH p AS (SELECT page_id, html, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN '/pricing' WHEN 2 THEN '/studio/x' WHEN 3 THEN '/profile/' WHEN 4 THEN '/dashboard' WHEN 5 THEN '/features' ELSE '/Blog/1' END) AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '/(pricing|plans|billing)(/|$)') THEN 'pricing' WHEN regexp_matches(path, '/(workspace|editor|studio|console|creator)(/|$)') THEN 'workspace' WHEN regexp_matches(path, '/profile(/|$)') THEN 'profile'
  WHEN regexp_matches(path, '/(account|settings|dashboard)(/|$)') THEN 'account' WHEN regexp_matches(path, '/(product|products|features)(/|$)') THEN 'product' WHEN regexp_matches(path, '/(article|blog|docs|guide|about|explore|discover)(/|$)') THEN 'content'
  WHEN page_id % 11 = 0 THEN 'profile' WHEN page_id * 7 % 900 >= 500 THEN 'content' WHEN NOT contains(html, '<h1') AND length(html) >= 500 THEN 'content'
  WHEN contains(html, '<form') AND contains(html, '<table') AND contains(html, '<nav') THEN 'workspace' WHEN contains(html, '<h1') AND page_id % 4 >= 2 THEN 'landing' ELSE 'unknown' END AS role FROM p""",
    "element_geometry": _with("elements") + """, r AS (SELECT id, width * 4 AS w4, height * 4 AS h4, height AS hh, id % 40 - 4 AS rad, least(1200.0, greatest(0.0, width * 20 - 100)) AS x0, least(1500.0, height * 30.0) AS y0, width * 9.0 AS w0, height * 1.0 AS h0,
  CASE id % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'svg' WHEN 2 THEN 'canvas' WHEN 3 THEN 'image' ELSE 'css-background' END AS kind FROM elements),
s AS (SELECT *, x0 / 1200 AS x, y0 / 1500 AS y, greatest(0.0, least(1200 - x0, w0)) / 1200 AS width, greatest(0.0, least(1500 - y0, h0)) / 1500 AS height, w4 * h4 / 400000.0 AS share FROM r)
SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(width, 6) AS width, round(height, 6) AS height, CASE WHEN width >= 0.96 THEN 'full' WHEN abs(x - greatest(0, 1 - width) / 2) <= 0.04 THEN 'center' WHEN x <= greatest(0.06, greatest(0, 1 - width) * 0.3) THEN 'left' ELSE 'right' END AS anchor, kind,
  CASE WHEN (w4 <= 64 AND h4 <= 64) OR (kind = 'svg' AND id % 3 = 0) THEN 'icon' WHEN share >= 0.06 OR (kind NOT IN ('svg', 'canvas') AND id % 3 <> 0 AND share >= 0.015) THEN 'major' WHEN share >= 0.004 THEN 'supporting' ELSE 'icon' END AS importance,
  CASE WHEN hh > 0 AND rad >= greatest(12, hh / 2.0 - 1) THEN 'pill' WHEN rad <> 0 THEN 'rounded' ELSE 'sharp' END AS shape,
  CASE id % 4 WHEN 0 THEN 'sticky' WHEN 1 THEN 'fixed' WHEN 2 THEN CASE WHEN id % 3 = 0 THEN 'flow' ELSE 'overlay' END ELSE 'flow' END AS mode FROM s""",
    "change_types": _with("changes") + """, g AS (SELECT page, list(DISTINCT CASE property WHEN 'order' THEN 'sequenceIndex' WHEN 'color' THEN 'interactionModel' ELSE property END) AS c FROM changes GROUP BY page)
SELECT page, CASE WHEN c = ['interactionModel'] THEN 'interaction' WHEN list_contains(c, 'sequenceIndex') AND len(list_filter(c, lambda x: x NOT IN ('sequenceIndex', 'rect.x', 'rect.y'))) = 0 THEN 'reorder' WHEN list_contains(c, 'interactionModel') THEN 'mixed'
  WHEN len(list_filter(c, lambda x: x IN ('sequenceIndex', 'layoutMode', 'display', 'gridTemplateColumns', 'rect.x', 'rect.y'))) > 0 THEN 'reflow' WHEN len(list_filter(c, lambda x: x NOT IN ('height', 'rect.width', 'rect.height', 'maxWidth', 'paddingTop', 'paddingRight', 'paddingBottom', 'paddingLeft', 'gap'))) = 0 THEN 'scale' ELSE 'mixed' END AS change_type FROM g""",
    "useful_changes": _with("changes") + """ SELECT page, id, CASE WHEN property = 'rect.x' OR before IS NOT DISTINCT FROM after THEN false WHEN property = 'gridTemplateColumns' THEN coalesce(before, '') <> '' AND NOT (after IN ('10px', '20px') AND before = '10px')
    AND NOT (after = 'repeat(3, 1fr)' AND before IN ('1px solid red', '1px solid transparent', '2px solid rgba(0, 0, 0, 0)', '0.5px solid red')) WHEN property IN ('node.heading.fontSize', 'order') THEN true WHEN property IN ('height', 'media.height') THEN role IN ('header', 'action') AND coalesce(before, '') = '10px' AND after IN ('10px', '20px')
    WHEN property = 'borderTop' THEN coalesce(before IN ('10px', '1px solid red', '0.5px solid red'), false) OR after <> 'none' ELSE property = 'boxShadow' END AS useful FROM changes""",
    "ordered_before": _with("sections") + """ SELECT * FROM (SELECT page, id, upper(tag) AS role, lead(id) OVER w AS next_id, lead(upper(tag)) OVER w AS next_role, row_number() OVER w AS place FROM sections WINDOW w AS (PARTITION BY page ORDER BY id, upper(tag))) WHERE place <= 4 AND next_id IS NOT NULL""",
    "focus_indicators": _with("elements") + """, v AS (SELECT id, CASE id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS shade, id % 4 AS s, id % 5 AS w, id % 7 AS p FROM elements),
o AS (SELECT *, CASE WHEN s = 3 AND w = 3 AND p = 3 THEN NULL WHEN s = 1 OR w = 1 OR p IN (1, 4) THEN false WHEN s IN (2, 3) OR w IN (2, 3) OR p IN (2, 3) THEN NULL ELSE true END AS line FROM v)
SELECT id, CASE WHEN id % 11 = 0 THEN NULL WHEN shade OR line THEN true WHEN shade = false AND line = false THEN false END AS visible FROM o""",
    "primary_action_role": _with("observations", "primaries") + f""", m AS (SELECT o.site, o.ord, o.role, pi, oi, CASE WHEN o.foreground IS NULL THEN NULL ELSE fi END AS f FROM observations o JOIN primaries p ON o.site = p.site AND o.bi = p.pi WHERE o.role IN ('action', 'primary-action') AND o.background IS NOT NULL),
g AS (SELECT site, pi, oi, f, max(CASE WHEN role = 'primary-action' THEN 1 ELSE 0 END) AS prime, count(*) AS observations, min(ord) AS first FROM m GROUP BY ALL),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY site ORDER BY prime DESC, observations DESC, first) = 1),
c AS (SELECT *, {_light('f')} AS lf, {_light('pi')} AS lp, {_light('oi')} AS lo FROM b),
d AS (SELECT *, {_ratio('lf', 'lp')} AS con, {_ratio('lo', 'lp')} AS c0, {_ratio(_light_of('26', '26', '26'), 'lp')} AS c1, {_ratio('0.0', 'lp')} AS c2, {_ratio('1.0', 'lp')} AS c3 FROM c),
e AS (SELECT *, CASE WHEN f IS NULL OR con >= 4.35 THEN NULL WHEN c0 >= 4.5 AND oi <> f THEN 0 WHEN c1 >= 4.5 THEN 1 WHEN c2 >= 4.5 THEN 2 WHEN c3 >= 4.5 THEN 3 END AS pick FROM d)
SELECT site, {_hex('pi')} AS background, CASE WHEN f IS NULL THEN NULL ELSE {_hex('f')} END AS foreground, CASE WHEN f IS NULL THEN NULL ELSE round(con, 2) END AS contrast, coalesce(f IS NOT NULL AND con < 4.5, false) AS warning,
  CASE pick WHEN 0 THEN {_hex('oi')} WHEN 1 THEN '#1a1a1a' WHEN 2 THEN '#000000' WHEN 3 THEN '#ffffff' END AS recommended, round(CASE pick WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 END, 2) AS recommended_contrast, observations FROM e""",
    "semantic_status_pairs": _with("observations") + f""", g AS (SELECT site, coalesce(status_kind, 'status') || '-' || status_intent AS name, CASE WHEN background IS NULL THEN NULL ELSE bi END AS b, CASE WHEN foreground IS NULL THEN NULL ELSE fi END AS f, count(*) AS observations, min(ord) AS first
  FROM observations WHERE role = 'status' AND (status_kind IS NULL OR status_intent IN ('positive', 'negative')) GROUP BY ALL)
SELECT site, name, CASE WHEN b IS NULL THEN NULL ELSE {_hex('b')} END AS background, CASE WHEN f IS NULL THEN NULL ELSE {_hex('f')} END AS foreground, observations FROM g QUALIFY row_number() OVER (PARTITION BY site, name ORDER BY observations DESC, first) = 1""",
    "action_accents": _with("observations", "primaries") + f""", t AS (SELECT site, fi, count(*) AS n, min(ord) AS first FROM observations WHERE role IN ('action', 'primary-action') AND background IS NULL AND foreground IS NOT NULL AND NOT {_grey('fi')} GROUP BY ALL),
s AS (SELECT o.site, bi, count(DISTINCT element) AS n FROM observations o JOIN primaries p ON o.site = p.site WHERE role = 'action' AND background IS NOT NULL AND bi <> pi AND NOT {_grey('bi')} GROUP BY ALL HAVING count(DISTINCT element) >= 2)
SELECT site, observed, (SELECT {_hex('fi')} FROM t WHERE t.site = a.site ORDER BY n DESC, first LIMIT 1) AS accent, (SELECT {_hex('bi')} FROM s WHERE s.site = a.site ORDER BY n DESC, {_hex('bi')} LIMIT 1) AS secondary
FROM (SELECT site, max(role IN ('action', 'primary-action') AND background IS NOT NULL) AS observed FROM observations GROUP BY site) a""",
    "border_roles": _with("colour_usage") + f""", b AS (SELECT *, {_grey('vi')} AS grey FROM colour_usage WHERE category IN ('structuralBorderColor', 'borderColor')),
c AS (SELECT * FROM b QUALIFY category = 'structuralBorderColor' OR NOT max(category = 'structuralBorderColor') OVER (PARTITION BY site)),
e AS (SELECT * FROM c QUALIFY grey OR NOT max(grey) OVER (PARTITION BY site)),
f AS (SELECT e.*, (SELECT arg_min(vi, ord) FROM colour_usage u WHERE u.site = e.site) AS ri FROM e),
h AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, ord) AS r, {_ratio(_light('vi'), _light('ri'))} >= 1.1 AS seen FROM f),
i AS (SELECT site, arg_min(value, r) AS first, arg_min(value, r) FILTER (seen) AS visible FROM h GROUP BY site)
SELECT site, coalesce(visible, first) AS border, CASE WHEN first <> coalesce(visible, first) THEN first END AS subtle FROM i""",
    "palette_remainder": _with("colour_usage") + """ SELECT site, 'palette-' || (min(ord) + 1) AS name, arg_min(CASE WHEN ord % 2 = 0 THEN upper(value) ELSE value END, ord) AS value FROM colour_usage u
WHERE NOT EXISTS (SELECT 1 FROM colour_usage t WHERE t.site = u.site AND t.vi = u.vi AND t.vi % 3 = 0) GROUP BY site, vi""",
    "related_colors": _with("colour_usage") + f""", b AS (SELECT *, first_value(vi) OVER (PARTITION BY site ORDER BY ord) AS base, row_number() OVER (PARTITION BY site ORDER BY ord) > 1 AS later FROM colour_usage),
f AS (SELECT *, round({_far('base', 'vi')}, 9) AS far, round({_far('base', 'vi')} + CASE WHEN {_top('vi')} > 0 THEN {_chroma('vi')} * 1.0 / {_top('vi')} ELSE 0 END * 250, 9) AS far_muted FROM b)
SELECT site, ord, value, row_number() OVER (PARTITION BY site ORDER BY later, far, ord) AS place, row_number() OVER (PARTITION BY site ORDER BY later, far_muted, ord) AS muted_place FROM f""",
    "color_role_predicates": _with("colour_usage") + f""", l AS (SELECT *, {_light('vi')} AS lv, {_light_of(*_SURFACE)} AS ls, {_light_of(*_INK)} AS li, printf('#%02x%02x%02x', {', '.join(_SURFACE)}) AS other FROM colour_usage)
SELECT site, ord, EXISTS (SELECT 1 FROM colour_usage u WHERE u.site = l.site AND u.vi = l.vi AND u.n > 0 AND u.category IN ('linkColor', 'bgColor')) AS used, CASE WHEN abs(lv - li) < abs(ls - li) THEN value ELSE other END AS surface,
  CASE WHEN ls > li THEN lv > li + 0.005 AND lv < ls - 0.05 ELSE lv < li - 0.005 AND lv > ls + 0.03 END AS muted, {_chroma('vi')} >= 32 AND {_chroma('vi')} * 1.0 / {_top('vi')} >= 0.3 AND lv > 0.015 AND lv < 0.97 AS accent FROM l""",
    "color_usage_weights": _with("colour_usage", "near_colours") + f""", s AS (SELECT site, vi, sum(CASE WHEN category <> 'statusColor' THEN n END) AS ui, sum(CASE WHEN category = 'statusColor' THEN n END) AS status FROM colour_usage WHERE category IN ('bgColor', 'linkColor', 'statusColor') AND n > 0 GROUP BY ALL)
SELECT t.site, t.ord AS token, CAST(coalesce(sum(s.ui), 0) AS BIGINT) AS ui, CAST(coalesce(sum(s.status), 0) AS BIGINT) AS status FROM near_colours t
LEFT JOIN s ON s.site = t.site AND sqrt(power(t.red - {_part('r', 's.vi')}, 2) + power({_part('g', 't.vi')} - {_part('g', 's.vi')}, 2) + power({_part('b', 't.vi')} - {_part('b', 's.vi')}, 2)) <= 20 GROUP BY ALL""",
    "merged_motion": _with("motion") + """, g AS (SELECT site, property, duration, easing, CAST(sum(n) AS BIGINT) AS n, min(ord) AS first FROM motion GROUP BY ALL)
SELECT site, property, duration, easing, n, row_number() OVER (PARTITION BY site ORDER BY n DESC, first) AS place FROM g QUALIFY place <= 10""",
    "merged_breakpoints": """WITH b AS (SELECT p_brand AS site, p_size * 30 + 60 AS width, count(DISTINCT p_partkey) AS n, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS changes FROM part GROUP BY ALL),
k AS (SELECT *, CASE WHEN width <= 480 THEN 'mobile' WHEN width <= 768 THEN 'tablet-sm' WHEN width <= 1024 THEN 'tablet' WHEN width <= 1280 THEN 'desktop' ELSE 'wide' END AS cat, CASE WHEN width % 16 = 0 THEN 3 WHEN width % 8 = 0 THEN 2 WHEN width % 4 = 0 THEN 1 ELSE 0 END AS round FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY site, cat ORDER BY n DESC, round DESC, width) = 1 AS first FROM k),
p AS (SELECT *, max(CASE WHEN first THEN width END) OVER (PARTITION BY site, cat) AS prime FROM f),
c AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY site, cat ORDER BY first DESC, (cat = 'mobile' AND width = 480) OR (cat = 'tablet-sm' AND width = 768) OR (cat = 'tablet' AND width = 1024) OR (cat = 'desktop' AND width = 1280) DESC, round DESC, n DESC, abs(width - prime) DESC, width) <= 2),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY site ORDER BY width) <= 10)
SELECT site, width, CASE WHEN count(*) OVER (PARTITION BY site, cat) > 1 THEN cat || '-' || width ELSE cat END AS label, changes FROM t""",
    "spacing_rhythm": _with("spacings") + """, r AS (SELECT site, px FROM spacings WHERE NOT odd AND px BETWEEN 4 AND 96 QUALIFY row_number() OVER (PARTITION BY site ORDER BY greatest(1, n) DESC, px) <= 3),
q AS (SELECT site, value AS spacing FROM (SELECT *, NOT odd AND px BETWEEN 4 AND 24 AS fits FROM spacings) QUALIFY row_number() OVER (PARTITION BY site ORDER BY fits DESC, CASE WHEN fits THEN n END DESC, CASE WHEN fits THEN abs(px - 16) END, i) = 1)
SELECT site, spacing, (SELECT string_agg(CAST(px AS VARCHAR), ',' ORDER BY px) FROM (SELECT DISTINCT px FROM r WHERE r.site = q.site)) AS rhythm FROM q""",
    "merged_variables": _with("variables") + """ SELECT site, name AS field, value, min(ord) AS ord, any_value(last) AS last FROM (SELECT *, last_value(value) OVER (PARTITION BY site, name ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM variables) GROUP BY site, name, value""",
    "export_captures": _with("captures") + """ SELECT url, id, viewport FROM captures QUALIFY row_number() OVER (PARTITION BY url ORDER BY CASE viewport WHEN 'desktop' THEN 0 WHEN 'tablet' THEN 1 WHEN 'mobile' THEN 2 ELSE 3 END, ord, id) = 1""",
    "component_specs": """WITH c AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS component, CASE WHEN p_size % 3 > 0 THEN p_brand ELSE '' END AS role, p_partkey % 20 AS url, CAST(p_size AS VARCHAR) AS gap, 't' || (p_size % 4) AS ref FROM part)
SELECT component, role, count(*) AS instances, count(DISTINCT url) AS pages, array_to_string(list_sort(list(DISTINCT gap))[1:8], ',') AS gaps, array_to_string(list_sort(list(DISTINCT ref)), ',') AS token_refs, array_to_string(list_sort(list(DISTINCT id))[1:24], ',') AS evidence_refs FROM c GROUP BY ALL""",
    "representative_styles": """WITH g AS (SELECT p_type AS type, p_brand || '/' || (p_size % 5) AS styles, count(*) AS n, max(p_size % 5 % 2) AS rank, max(length(p_brand)) AS detail, max(p_partkey % 7) AS confidence FROM part GROUP BY ALL)
SELECT type, styles, n FROM g QUALIFY row_number() OVER (PARTITION BY type ORDER BY rank DESC, n DESC, detail DESC, confidence DESC, styles) = 1""",
    "visual_qa": _with("captures") + """, p AS (SELECT * FROM captures)
SELECT url % 10 AS site, 'page-health' AS "check", id AS subject, CASE id % 4 WHEN 2 THEN 'fail' WHEN 1 THEN 'warning' ELSE 'pass' END AS status FROM p UNION ALL SELECT url % 10, 'overflow', id, CASE WHEN id % 3 = 0 THEN 'warning' ELSE 'pass' END FROM p
UNION ALL SELECT url % 10, 'screenshot-dimensions', id, CASE WHEN id % 5 = 0 THEN 'warning' WHEN id % 6 = 0 THEN 'fail' ELSE 'pass' END FROM p
UNION ALL SELECT url % 10, 'responsive', min(id), CASE WHEN count(DISTINCT viewport) >= 2 THEN 'pass' ELSE 'warning' END FROM p GROUP BY url""",
    "capture_reasons": """WITH k AS (SELECT c_custkey, c_custkey AS k FROM customer)
SELECT c_custkey, CASE WHEN k % 19 IN (0, 1) THEN 'missing-evidence' ELSE array_to_string(list_filter([CASE WHEN k % 7 IN (0, 1) THEN 'incomplete-coverage' END, CASE WHEN k % 3 = 2 THEN 'language-mismatch' END, CASE WHEN k % 6 IN (0, 1) THEN 'missing-page-health' END,
  CASE WHEN k % 3 <> k % 4 THEN 'page-set-mismatch' END, CASE WHEN k % 4 <> 0 THEN 'route-mismatch' END, CASE WHEN k % 5 <> k % 6 THEN 'schema-mismatch' END, CASE WHEN (k % 6 <> 0 AND k % 8 = 0) OR (k % 6 <> 1 AND k % 8 = 1) THEN 'unhealthy-page' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM k""",
}
