"""Queries over captures' parts: stylesheets, nested elements, overflow, matches of several levels; with DuckDB SQL for the same rows.

The stand-in inputs are SQL over the driver's tables that both engines read; what the SQL expects is worked out from the tables, without the operators' text or constants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import color_groups, components, diffs, element_usage, feature_rules, lookup, manifests, merges, nesting, page_facts, pairing, roles, tags, token_refs
from .plans import colors
from .sources import discovery, stylesheets
from .staging import cut, dealt

TABLES = ("pages", "part", "supplier", "lineitem", "orders", "customer", "events", "embeddings", "documents")


def _s(number: str) -> str:
    return f"CAST({number} AS VARCHAR(20))"


_BRAND = "printf('#%02x%02x%02x', p % 256, p * 7 % 256, 9)"
#: One sheet for each page, with comments, strings, an address, and blocks inside blocks.
_SHEET = " || ".join([
    "'/* a { b:c } '", _s("p"), "' */ :root{--brand-primary:'", _BRAND, "';--primary-hover:#010203;--gap:4px;--note:\"};{\"} '",
    "CASE WHEN p % 3 = 0 THEN 'html{--brand-primary:rgb(' || " + _s("p % 200") + " || ', 7, 9)} ' ELSE '' END", "':root{--accent:var(--brand-primary)} @media (min-width:'",
    _s("p % 7 * 100 + 320"), "'px) and (max-width:64em){.a:hover,.b:focus{color:red;background-color:url(data:x;y}z);width:'", _s("p % 5"),
    "'px !important;content:\"}\"} @container card (width >= '", _s("p % 5 * 16 + 200"), "'px){.d:active{outline-offset:'", _s("p % 4"),
    "'px;color:blue} .c{transition:w'", _s("p % 13"), "' .2s ease-in,color 100ms}}} @keyframes k{from{opacity:0}} .e{animation:spin '", _s("p % 3 + 1"), "'s linear infinite}'",
])

def _pick(by: str, *texts: str | None) -> str:
    return f"CASE ({by}) % {len(texts)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if t is None else f"'{t}'") for i, t in enumerate(texts)) + " END"


#: A page's elements in document order: each holds as many numbers after its own as its lowest set bit tells, the first one all.
_BOXES = (
    "SELECT *, CASE WHEN pre = 0 THEN 100000000 ELSE pre + (pre & -pre) - 1 END AS last FROM ("
    "SELECT o_orderkey % 20 AS page, o_orderkey AS id, CAST((o_orderkey - o_orderkey % 20) / 20 AS BIGINT) AS pre, o_custkey AS c FROM orders)"
)
#: A section of either side; b's pages and values differ for some.
_SIDE = (
    "SELECT p_partkey AS id, {page} AS page, p_brand || '-' || " + _s("p_size % 7") + " AS role, " + _pick("p_size", "flow", "grid") + " AS layout_mode, "
    "CASE WHEN p_partkey >= 60 AND p_size % 3 = 0 THEN p_partkey - 60 END AS parent_id, " + _s("p_size + {shift} * (p_partkey % 5)") + " AS order_, "
    + _pick("p_size + {shift} * p_partkey", "block", "grid", None) + " AS display, " + _pick("p_partkey * {shift}", "static", "sticky", "static", "") + " AS position, "
    + _pick("p_size + {shift} * (p_partkey % 2)", "1fr  1fr", "repeat(3, 1fr)", "none", "200px 300px", "") + " AS grid, p_partkey AS k FROM part"
)
_HELD = "SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS section_id, {page} AS page, {type} AS type, l_linestatus AS element_kind, 's' || " + _s("l_suppkey % 40") + " AS role FROM lineitem"
_MOVED = "CASE WHEN {k} % 13 = 0 THEN {k} % 60 + 60 ELSE {k} % 60 END"
#: What sections do between two viewports, a row for each changed property of an observation.
_SEEN = (
    "SELECT {k} AS page, p_partkey AS id, p_partkey - p_partkey % 2 * 60 AS section, " + _pick("p_size", "mobile", "tablet") + " AS to_viewport, "
    + _pick("p_partkey", "order", "gridTemplateColumns", "rect.x", "position", "height") + " AS property, " + _pick("p_size + {shift} * (p_partkey % 3)", "40px", "1fr 1fr", "300px") + " AS before, "
    + _pick("p_size", "50px", "1fr 1fr 1fr", None) + " AS after FROM part"
)
#: What pointer and keyboard do to elements of a page.
_ACTS = (
    "SELECT user_id AS page, event_id AS id, event_type AS driver, " + _pick("event_id", "mouse", "key") + " AS trigger, " + _pick("event_id + user_id", "color", "transform") + " AS property, "
    + _pick("event_id", "none", None, "red") + " AS before, " + _pick("user_id + {shift} * (user_id % 3)", "translateX(4px)", " blue ", "matrix(1, 0, 0, 1, 4, 0)", "none") + " AS after FROM events"
)

INPUTS = {
    "sheets": f"SELECT p AS page_id, p % 4 AS site, {_SHEET} AS css FROM (SELECT page_id AS p FROM pages)",
    "boxes": f"SELECT page, id, pre, last, CAST((c * 37 % 6 + 1) * 1000 AS DOUBLE) AS area, c % 3 = 0 AS landmark FROM ({_BOXES}) b",
    "elements": (
        "SELECT page, id, pre, last, CASE WHEN pre > 0 THEN (pre & (pre - 1)) * 20 + page END AS parent_id, " + _pick("c + pre", "div", "a", "button", "section", "input", "nav", "div", "li", "img", "div", "dialog") + " AS tag, "
        + _pick("c * 3 + pre", *[None] * 11, "button", "textbox", "grid", "region", "tab", "list") + " AS role, " + _pick("c", "text", "submit", "hidden") + " AS input_type, id % 3 > 0 AS has_href, "
        + _pick("c + id", "btn", "card", "item", "modal-box", "card") + " AS class, id % 5 = 0 AS onclick, " + _pick("id + c", "0", None, "-1") + " AS tabindex, " + _pick("c", None, None, None, "true") + " AS aria_modal, "
        "id % 11 <> 4 AS visible, CAST(100 + c % 7 * 60 AS DOUBLE) AS width, CAST(40 + c % 5 * 40 AS DOUBLE) AS height, CAST(400 AS DOUBLE) AS viewport_width, CAST(300 AS DOUBLE) AS viewport_height, CAST(c % 20 AS INT) AS text_chars, "
        "c % 4 = 0 AS main_child, " + _pick("c + id", "transparent", "rgba(0, 0, 0, 0)", "rgb(1, 2, 3)", "#fff", "rgb(1, 2, 3)", "#eee") + " AS background, " + _pick("id", "none", "0 1px 2px red", "none") + " AS shadow, "
        + _pick("c", "static", "fixed") + " AS position, " + _pick("id", "auto", "3") + " AS z_index, CAST(c % 3 AS DOUBLE) AS line, " + _pick("c + id", "solid", "none", "solid") + " AS style, CAST(c % 4 * 3 AS DOUBLE) AS corner, "
        f"CAST(id % 3 * 8 AS DOUBLE) AS pad FROM ({_BOXES}) b"
    ),
    "layers": "SELECT *, x0 + width AS x1 FROM (SELECT page, id, pre, last, c, CASE c % 7 WHEN 0 THEN -30.5 WHEN 1 THEN -3 ELSE 0 END AS x0, 900 + c % 90 * 3 AS width, 1000 AS viewport, "
    "id % 10 <> 3 AS visible, " + _pick("c % 23 * 2", "fixed", *["static"] * 44) + " AS position, " + _pick("c", "hidden", "auto", *["visible"] * 15) + " AS overflow_x, 1000 + c % 9 AS scroll_width, 1000 AS client_width, "
    f"pre = 0 AS body, false AS root FROM ({_BOXES}) b) w",
    "rects": "SELECT p_partkey % 40 AS page, p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_size END AS section, CAST(p_size % 9 AS DOUBLE) / 8 AS x, CAST(p_partkey % 7 AS DOUBLE) / 8 AS y, 0.125 AS w, CAST(p_size % 2 AS DOUBLE) / 4 AS h FROM part",
    "crops": "SELECT c_custkey % 40 AS page, c_custkey AS crop, c_custkey % 97 AS ord, c_custkey % 60 AS section, CAST(c_custkey % 6 AS DOUBLE) / 8 AS x, CAST(c_nationkey % 5 AS DOUBLE) / 8 AS y, CAST(c_custkey % 5 AS DOUBLE) / 8 AS w, CAST(c_nationkey % 4 AS DOUBLE) / 8 AS h FROM customer",
    "tones": "SELECT c_nationkey AS site, c_custkey AS ord, " + _pick("c_custkey", "textColor", "bgColor", "borderColor", "declaredColor", "bgArea", "actionBackgroundColor", "linkColor", "structuralBorderColor", "statusColor")
    + " AS category, printf('#%02x%02x%02x', CAST(c_custkey * 37 % 9 * 28 AS INT), CAST(c_custkey * 91 % 7 * 36 AS INT), CAST(c_custkey * 53 % 5 * 50 AS INT)) AS value, c_custkey % 97 AS n FROM customer",
    "raw_tones": "SELECT s_nationkey AS site, s_suppkey AS ord, printf('#%02x0000', CAST(s_suppkey % 250 AS INT)) AS value FROM supplier",
    "acts_seen": "SELECT c_nationkey AS site, c_custkey AS ord, " + _pick("c_custkey", "action", "primary-action", "status") + " AS role, 'status' AS status_kind, 'warning' AS status_intent, "
    "printf('#%02x%02x%02x', CAST(c_custkey * 37 % 9 * 28 AS INT), CAST(c_custkey * 91 % 7 * 36 AS INT), CAST(c_custkey * 53 % 5 * 50 AS INT)) AS background, '#ffffff' AS foreground, c_name AS element FROM customer",
    "manifests": "SELECT o_orderkey AS k FROM orders",
    "facts": "SELECT o_orderkey AS k, " + _pick("o_orderkey", "https://e.com/a", "https://e.com/login", "https://e.com/x/SSO/y?q", "https://e.com/author", "https://e.com/#/sign-in", "about:blank", None) + " AS final_url, "
    "CAST(CASE o_custkey % 11 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN NULL ELSE 200 END AS INT) AS status FROM orders",
    "spaced": "SELECT p_partkey % 20 AS site, CAST((p_partkey - p_partkey % 20) / 20 AS BIGINT) AS k FROM part",
    "texts": "SELECT p_partkey AS id, " + _pick("p_partkey", "4px", "0px", "0", "50%", "") + " AS corner, " + _pick("p_size", None, "8px", "url(x)", "0em") + " AS other, "
    + _pick("p_partkey", "Mozilla Chrome/120.1 Safari", "x Edg/99.0 Chrome/98", "HeadlessChrome/9.9", "Chromium/7.1", "curl", None) + " AS agent, " + _pick("p_size", None, "/opt/msedge/x", "/usr/bin/chromium", "C:/google chrome/a", "/bin/sh") + " AS path FROM part",
    "drawn": "SELECT o_custkey % 30 AS page, o_orderkey AS id, CAST(o_custkey % 9 * 20 - 60 AS DOUBLE) AS x0, CAST(o_custkey % 9 * 20 - 60 + o_orderkey % 5 * 40 AS DOUBLE) AS x1, CAST(o_orderkey % 7 * 30 - 30 AS DOUBLE) AS y0, CAST(o_orderkey % 7 * 30 + 10 AS DOUBLE) AS y1, "
    "CAST(100 AS DOUBLE) AS viewport_width, CAST(100 AS DOUBLE) AS viewport_height, " + _pick("o_custkey", "#ffffff", "transparent", "rgb(1, 2, 3)", "#fff", None) + " AS background, " + _pick("o_orderkey", "1px", "0px", "2.5px") + " AS w1, "
    + _pick("o_custkey", "0px", "1px") + " AS w2, " + _pick("o_orderkey", "solid", "none", "dashed", "hidden") + " AS s1, " + _pick("o_custkey", "solid", "none", "solid") + " AS s2, " + _pick("o_orderkey", "#ff0000", "rgba(9, 9, 9, 0)") + " AS p1, "
    + _pick("o_custkey", "#ff0000", "#00ff00", "inherit") + " AS p2, o_orderkey % 3 = 0 AS interactive, " + _pick("o_custkey", "Arial", "", None, "Serif") + " AS font_family, CAST(o_orderkey % 6 AS INT) AS text_chars, "
    + _pick("o_orderkey", "4px", "normal", "0px", "8px") + " AS g, " + _pick("o_custkey", "4px", None, "auto") + " AS m FROM orders",
    "named_tones": "SELECT site, ord, CASE WHEN ord % 5 = 0 THEN 'palette-' || " + _s("ord") + " WHEN ord % 11 = 1 THEN 'primary' WHEN ord % 11 = 2 THEN 'accent' WHEN ord % 11 = 3 THEN 'border-' || " + _s("ord") + " WHEN ord % 11 = 4 THEN 'badge-' || " + _s("ord")
    + " ELSE 'c-' || " + _s("ord") + " END || CASE WHEN ord % 11 IN (1, 2) AND ord % 5 > 0 AND ord > 11 THEN '-' || " + _s("ord") + " ELSE '' END AS name, value FROM (SELECT c_nationkey AS site, c_custkey AS ord, "
    "printf('#%02x%02x%02x', CAST(c_custkey * 37 % 9 * 28 AS INT), CAST(c_custkey * 91 % 7 * 36 AS INT), CAST(c_custkey * 53 % 5 * 50 AS INT)) AS value FROM customer) c",
    "graph": "SELECT o_orderkey % 4 AS site, o_custkey AS url, (o_custkey * 7 + o_orderkey) % 150 AS target FROM orders",
    "cited": "SELECT l_suppkey % 6 AS site, CASE l_linenumber % 4 WHEN 0 THEN 's' ELSE 'e' END || " + _s("l_partkey") + " AS id, " + _s("l_partkey % 40") + " AS page, 's' || " + _s("(l_partkey * 3 + 1) % 200")
    + " AS section, l_linenumber % 4 AS kind, 'k' || " + _s("l_orderkey % 50") + " AS claim, l_partkey AS place FROM (SELECT DISTINCT l_suppkey % 6 AS l_suppkey, l_partkey, l_partkey % 4 AS l_linenumber, l_orderkey % 50 AS l_orderkey FROM lineitem) l",
    "cited_pages": "SELECT DISTINCT s.l_suppkey % 6 AS site, " + _s("s.l_partkey % 37") + " AS page, 'https://e.com/' || " + _s("s.l_partkey % 37 % 7") + " AS url, " + _pick("s.l_partkey % 37", "desktop", "mobile", "tablet") + " AS viewport FROM lineitem s",
    "sections_a": _SIDE.format(page="p_partkey % 60", shift=0), "sections_b": _SIDE.format(page=_MOVED.format(k="p_partkey"), shift=1),
    "held_a": _HELD.format(page="l_partkey % 60", type="l_returnflag"),
    "held_b": _HELD.format(page=_MOVED.format(k="l_partkey"), type="CASE WHEN l_orderkey % 50 = 0 THEN 'Z' ELSE l_returnflag END"),
    "seen_a": _SEEN.format(k="p_partkey % 60", shift=0), "seen_b": _SEEN.format(k=_MOVED.format(k="p_partkey"), shift=1),
    "acts_a": _ACTS.format(shift=0), "acts_b": _ACTS.format(shift=1),
}


def _input(spark: SparkSession, d: str, name: str) -> DataFrame:
    sql, used = INPUTS[name].replace("{", "{{").replace("}", "}}"), {}
    for t in TABLES:
        if f"FROM {t}" in sql:
            used[t] = spark.read.parquet(f"{d}/{t}.parquet")
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **used)


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return stylesheets.rules(_input(spark, d, "sheets"), ["page_id", "site"])


def stylesheet_declarations(spark, d):
    rows = stylesheets.styled(_parsed(spark, d))
    return rows.select("page_id", F.array_join("stack", " ").alias("media"), "selector", "property", "value", "important")


def stylesheet_states(spark, d):
    found = stylesheets.state_rules(_parsed(spark, d), ["page_id"])
    styles = F.array_join(F.transform(F.array_sort(F.map_entries("styles")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ";")
    return found.select("page_id", "state", "selector", styles.alias("styles"))


def stylesheet_breakpoints(spark, d):
    return stylesheets.breakpoint_counts(_parsed(spark, d), ["site"])


def stylesheet_motion(spark, d):
    return stylesheets.top_motion(stylesheets.motion_rules(_parsed(spark, d), ["site", "page_id"]), ["site"], ["page_id", "rule"])


def variable_colors(spark, d):
    variables = stylesheets.root_variables(_parsed(spark, d), ["page_id"], [])
    return stylesheets.variable_colors(stylesheets.resolved(variables, ["page_id"]), ["page_id"])


def page_stylesheets(spark, d):
    """The style elements of the pages as they are stored."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    rows = stylesheets.rules(stylesheets.sheets(pages, ["page_id"]), ["page_id", "sheet"])
    return stylesheets.styled(rows).select("page_id", "sheet", "selector", "property", "value")


def suppressed_sections(spark, d):
    return nesting.suppressed_sections(_input(spark, d, "boxes"), ["page"]).select("page", "id", "suppressed")


def overflow_sources(spark, d):
    over = cut(nesting.overflowing(_input(spark, d, "layers").withColumnsRenamed({"x0": "left", "x1": "right"}), ["page"]))
    sections = _input(spark, d, "boxes").select("page", F.col("id").alias("section"), F.when(F.col("landmark"), "main").otherwise("content").alias("role"), "pre", "last", "area", F.col("pre").alias("ord"))
    found = nesting.overflow_report(over, nesting.overflow_sources(over, ["page"]), sections, ["page"])
    return found.join(nesting.content_width(over, ["page"]), "page")


def detected_components(spark, d):
    e = _input(spark, d, "elements")
    kids = e.where("parent_id is not null").groupBy("page", F.col("parent_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", "tag"))), lambda x: x["tag"]).alias("child_tags"))
    none = F.array().cast("array<string>")
    e = e.join(dealt(kids), ["page", "id"], "left").withColumns({
        "child_tags": F.coalesce("child_tags", none), "classes": F.array("class"), "border_width": F.array("line"), "border_style": F.array("style"), "radius": F.array("corner"), "padding": F.array("pad"),
    })
    found = components.detect_components(e, ["page"])
    return found.select("page", "id", "type", F.round("confidence", 6).alias("confidence"), F.array_join("reasons", ",").alias("reasons"))


def status_roots(spark, d):
    e = _input(spark, d, "elements").select("page", "id", "pre", "last", (F.col("text_chars") % 5 == 0).alias("native"), (F.col("line") > 0).alias("strong"), (F.col("corner") < 9).alias("drawn"))
    return components.status_roots(e, ["page"]).select("page", "id", "root")


def crop_of_rect(spark, d):
    return nesting.crop_of(_input(spark, d, "rects"), _input(spark, d, "crops"), ["page"])


def _sections(spark, d):
    frames = [(_input(spark, d, f"sections_{x}"), _input(spark, d, f"held_{x}")) for x in "ab"]
    return frames, cut(pairing.match_sections(*(pairing.section_signatures(s, c, ["page"]) for s, c in frames), ["page"]))


def section_matches(spark, d):
    return _sections(spark, d)[1].drop("match")


def component_matches(spark, d):
    frames, sections = _sections(spark, d)
    return pairing.match_components(frames[0][1], frames[1][1], sections, ["page"]).drop("match")


def match_summaries(spark, d):
    return pairing.match_summary(_sections(spark, d)[1].withColumn("site", F.col("page") % 7), ["site"], ["site", "page"])


def layout_property_changes(spark, d):
    frames, sections = _sections(spark, d)
    named = [s.select("page", "id", "role", F.col("order_").alias("order"), F.col("layout_mode").alias("layoutMode"), "display", "position", F.lit(None).cast("string").alias("maxWidth"),
                      F.col("grid").alias("gridTemplateColumns"), F.col("display").alias("childGridTemplateColumns")) for s, _ in frames]
    return pairing.layout_changes(pairing.pairs(sections, ["page"]), *named, ["page"])


def responsive_pairs(spark, d):
    frames, sections = _sections(spark, d)
    values = []
    for x, (known, _) in zip("ab", frames, strict=True):
        seen = _input(spark, d, f"seen_{x}").withColumns({"from_viewport": F.lit("desktop"), "change_type": F.lit("reflow"), "ord": F.lit(0)})
        roles = known.select("page", F.col("id").alias("section"), F.when(F.col("id") % 4 == 0, "header").otherwise(F.col("role")).alias("role"))
        values.append(pairing.responsive_values(seen.select("page", "id", "ord", "property", "before", "after"), seen.drop("property", "before", "after", "ord"), roles, ["page"]))
    return pairing.pair_responsive(*values, pairing.pairs(sections, ["page"]), ["page"])


def interaction_pairs(spark, d):
    return pairing.pair_interactions(*(pairing.interaction_groups(_input(spark, d, f"acts_{x}"), ["page"]) for x in "ab"), ["page"])


def color_tokens(spark, d):
    u = _input(spark, d, "tones")
    return colors.color_tokens(u, _input(spark, d, "acts_seen"), ["site"])


def general_colors(spark, d):
    return colors.general_frequency(_input(spark, d, "tones"), _input(spark, d, "raw_tones"), ["site"]).select("site", "value", F.col("n").cast("long").alias("n"))


def manifest_differences(spark, d):
    pairs = _input(spark, d, "manifests")
    names = (*manifests.INCONCLUSIVE, *manifests.LIMITING)
    held = lambda s: F.struct(F.lit(1).alias("schema"), F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*((F.when((F.col("k") + i) % (7 + s * (i % 3)) == 0, "x").otherwise("y")) for i in range(len(names))))).alias("fields"))
    made = pairs.select("k", F.when(F.col("k") % 19 > 0, held(0)).alias("manifest_a"), held(1).alias("manifest_b"))
    told = manifests.with_comparability(made)
    return told.select("k", F.array_join("manifest_reasons", ",").alias("reasons"), F.array_join("manifest_limitations", ",").alias("limitations"), F.coalesce(F.size("differences"), F.lit(0)).alias("n"))


def usage_of_elements(spark, d):
    e = _input(spark, d, "drawn").withColumnsRenamed({"x0": "left", "x1": "right", "y0": "top", "y1": "bottom"})
    e = e.withColumns({"border_width": F.array("w1", "w2", "w1", "w2"), "border_style": F.array("s1", "s1", "s2", "s2"), "border_color": F.array("p1", "p1", "p2", "p1"), "spacing": F.create_map(F.lit("gap"), F.col("g"), F.lit("marginTop"), F.col("m"))})
    found = element_usage.element_usage(e, ["page"])
    return found.select("page", "category", "value", F.round("weight", 6).alias("weight"))


def color_name_groups(spark, d):
    u = _input(spark, d, "tones").select("site", "category", "value", "n")
    tokens = _input(spark, d, "named_tones")
    sources = tokens.where("ord % 4 = 0").select("site", "name", F.lit("usage:linkColor").alias("source"))
    found = color_groups.color_groups(tokens, u, sources, tokens.select("site", "name", (F.col("ord") % 3).alias("observations")), ["site"])
    return found.select("site", "label", "label_order", "place", "name", F.col("score").cast("long").alias("score"))


def page_frontier(spark, d):
    seeds = _input(spark, d, "graph").where("url < 20").select("site", F.col("url").cast("string").alias("url")).distinct()
    links = _input(spark, d, "graph").select("site", F.col("url").cast("string").alias("url"), F.col("target").cast("string").alias("target"), F.lit(0.0).alias("rank"))
    return discovery.frontier(seeds, links, rounds=6)


def _index(spark, d):
    c = _input(spark, d, "cited")
    pages = _input(spark, d, "cited_pages")
    sections = c.where("kind = 0").select("site", "id", "page", F.lit(None).cast("string").alias("section"))
    others = c.where("kind > 0").select("site", "id", F.when(F.col("kind") < 3, F.col("page")).alias("page"), "section", "kind")
    parts = {"sections": sections} | {n: others.where(F.col("kind") == k).drop("kind") for k, n in ((1, "components"), (2, "media"), (3, "responsive"))}
    return lookup.id_index(parts, pages, ["site"])


def evidence_index(spark, d):
    return _index(spark, d)


def claim_scopes(spark, d):
    cites = _input(spark, d, "cited").select("site", F.col("claim"), "id")
    return lookup.claim_scopes(cites, _index(spark, d), ["site"]).select("site", "claim", F.array_join("scopes", ", ").alias("scopes"), F.col("more").cast("long").alias("more"))


def dangling_evidence(spark, d):
    refs = _input(spark, d, "cited").select("site", F.col("claim").alias("owner"), F.concat("id", F.when(F.col("place") % 5 == 0, "x").otherwise("")).alias("id"))
    return lookup.dangling_ids(refs, _index(spark, d), ["site"])


def token_evidence(spark, d):
    c = _input(spark, d, "cited")
    owners = c.select("site", F.col("place").alias("rank"), "id", F.array(F.concat(F.lit("t"), (F.col("place") % 30).cast("string"))).alias("token_refs")).where("kind < 3 and place % 30 < 20")
    tokens = c.groupBy("site", F.concat(F.lit("t"), (F.col("place") % 30).cast("string")).alias("token")).agg(F.collect_set(F.concat(F.lit("https://e.com/"), (F.col("place") % 7).cast("string"), F.lit("?q"))).alias("urls"))
    pages = _input(spark, d, "cited_pages")
    return lookup.evidence_of_tokens(tokens, owners, pages.withColumn("ord", F.col("page").cast("long")), ["site"]).select("site", "token", "place", "id", F.col("more").cast("long").alias("more"))


def corner_texts(spark, d):
    t = _input(spark, d, "texts")
    radius = roles.structural_radius(F.array("corner", "corner", F.coalesce("other", "corner"), "corner"))
    return t.select("id", radius.alias("radius"), roles.browser_product(F.col("agent"), F.col("path")).alias("product"), roles.browser_version(F.col("agent")).alias("version"))


def page_keys(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    final = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("https://e.com/"), F.col("page_id").cast("string"), F.lit("//?q#x")))
    view = F.when(F.col("page_id") % 2 == 0, "desktop").otherwise("mobile")
    fixed = F.concat(F.lit("https://u@e.com/p"), (F.col("page_id") % 9).cast("string"), F.lit("/?a=1"))
    return p.select("page_id", merges.page_key(fixed, view).alias("page_key"), merges.source_route(final, fixed).alias("route"), merges.site_name(F.when(F.col("page_id") % 4 == 0, " Name "), F.when(F.col("page_id") % 5 == 0, ""), fixed).alias("site"))


def moved_rects(spark, d):
    t = _input(spark, d, "rects")
    rect = lambda by: F.struct((F.col("x") + by).alias("x"), F.col("y").alias("y"), F.col("w").alias("width"), F.col("h").alias("height"))
    shift = F.element_at(F.array(*map(F.lit, (0.0, 0.03, 0.05, -0.125))), (F.col("id") % 4 + 1).cast("int"))
    fit = merges.preview_fit(*(c.cast("double") for c in (F.col("id") % 900, F.col("id") % 700 + 1, F.col("id") % 500, F.lit(400), F.lit(90000))))
    out = t.select("id", diffs.rect_moved(rect(F.lit(0.0)), rect(shift)).alias("moved"), diffs.severe_overflow(F.col("id") % 100, F.col("id") % 50, F.col("id") % 200).alias("severe"), fit.alias("f"))
    return out.select("id", "moved", "severe", *(F.col(f"f.{c}").cast("long").alias(c) for c in ("width", "height_a", "height_b")))


def capture_merges(spark, d):
    e = _input(spark, d, "acts_a")
    usage = merges.merge_usage(e.select("page", F.col("driver").alias("category"), F.col("property").alias("value"), (F.col("id") % 7).alias("n")), ["page"])
    seen = merges.merge_observations(e.select("page", F.col("trigger").alias("capture"), F.col("property").alias("element"), F.col("driver").alias("role"), F.col("id").alias("ord"), "after"), ["page"], ["after"])
    last = seen.groupBy("page", F.col("role").alias("category"), F.col("element").alias("value")).agg(F.count(F.lit(1)).alias("observations"), F.min("ord").alias("first"), F.max_by("after", "ord").alias("last"))
    return usage.join(last, ["page", "category", "value"])


def state_metrics(spark, d):
    e = _input(spark, d, "acts_a")
    kinds = F.element_at(F.array(*map(F.lit, ("hover", "focus", "visited"))), (F.col("id") % 3 + 1).cast("int"))
    states = e.select("page", kinds.alias("kind"), F.col("after").alias("styles"))
    seen = e.select("page", F.when(F.col("id") % 4 == 0, "safe-active").when(F.col("id") % 4 == 1, "passive").otherwise("skipped").alias("safety"))
    sure = merges.confidence_summary(e.select("page", F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "low"))), (F.col("id") % 4 + 1).cast("int")).alias("confidence")), ["page"])
    return merges.interaction_metrics(states, seen, ["page"]).join(sure, "page")


def observation_identity(spark, d):
    c = _input(spark, d, "cited").where("site >= 0")
    sections = c.select(F.col("place").cast("string").alias("section"), F.concat(F.lit("role"), (F.col("place") % 3).cast("string")).alias("role")).distinct()
    text = lambda e: F.expr(e).cast("string")
    seen = c.select("place").distinct().select(F.col("place").alias("id"), F.array(text("place"), text("place + 3"), F.when(F.col("place") % 5 == 0, text("place + 1")).otherwise(text("place")), F.lit("gone")).alias("refs"))
    return roles.consistent_identity(seen, sections)


def owner_tokens(spark, d):
    o = _input(spark, d, "sections_a").select("page", F.col("k").alias("ord"), F.col("id").cast("string").alias("id"), F.array(F.concat(F.lit("color."), F.col("order_")), F.concat(F.lit("radius."), F.col("order_")), F.concat(F.lit("color.x"), (F.col("k") % 3).cast("string"))).alias("refs"))
    return roles.owner_refs(o, ["page"], ["ord"], "color.")


def auth_walls(spark, d):
    f = _input(spark, d, "facts")
    login = page_facts.login_only(F.col("k") % 7000, F.col("k") % 40, F.when(F.col("k") % 6 == 0, 1).otherwise(0), F.col("k") % 3, F.col("k") % 4, F.col("k") % 2, F.lit(1))
    wall = page_facts.auth_wall(F.col("final_url"), F.col("status"), F.when(F.col("k") % 13 == 0, 1).otherwise(0), F.col("k") % 17 == 0, login)
    return f.select("k", wall.alias("w")).select("k", "w.detected", "w.confidence", F.array_join("w.reasons", ",").alias("reasons"))


def page_health(spark, d):
    f, k = _input(spark, d, "facts"), F.col("k")
    facts = F.struct(
        (k % 50 / 100.0).alias("overlay_ratio"), page_facts.main_empty(k % 60, k % 160, k % 2).alias("main_empty"), (k % 25 / 100.0).alias("skeleton_ratio"), (k % 9 > 0).alias("fonts_ready"), (k % 45).alias("mutations"),
        F.lit(1000).alias("viewport_width"), (k % 12 + 995).alias("content_width"), (k % 29 == 0).alias("auth_wall"), (k % 31 == 0).alias("captcha"),
    )
    issues = page_facts.health_issues(facts, F.col("status"), F.lit("https://e.com/x"), F.col("final_url"))
    out = f.select("k", issues.alias("i")).select("k", "i", page_facts.health(F.col("i")).alias("h"))
    return out.select("k", F.array_join(F.transform("i", lambda x: F.concat_ws(":", x["code"], x["severity"], x["detail"])), ",").alias("issues"), "h.status", "h.eligible")


def region_scores(spark, d):
    k = F.col("k")
    score = tags.region_score(k % 4, k % 40 / 100.0, k % 5, k % 1200, k % 3, k % 6)
    return _input(spark, d, "facts").select("k", score.cast("int").alias("score"))


def site_feature_tags(spark, d):
    u = _input(spark, d, "spaced")
    scale = lambda kind, test, value: u.where(test).select("site", F.lit(kind).alias("kind"), F.col("k").alias("ord"), value.alias("value"))
    k = F.col("k")
    fonts = F.element_at(F.array(*map(F.lit, ("Fira Code", "Noto Serif", "Inter"))), (F.col("site") % 3 + 1).cast("int"))
    first = k < 3
    tokens = scale("fontFamilies", (k == 0) | ((k == 1) & (F.col("site") % 2 == 0)), fonts).unionByName(scale("shadows", first & (F.col("site") % 4 > 0), F.concat(F.lit("0 "), ((k + 1) * F.col("site") % 9 * 2).cast("string"), F.lit("px 4px red"))))
    tokens = tokens.unionByName(scale("radii", first, F.concat((k * (F.col("site") % 5) * 2 + 2).cast("string"), F.lit("px")))).unionByName(scale("fontWeights", first, (k * (F.col("site") % 4) * 100 + 300).cast("string")))
    colors_ = u.where(first).select("site", k.cast("string").alias("name"), F.format_string("rgb(%d, %d, %d)", (k * 10).cast("int"), (k * 10 + F.col("site") % 3 * 10).cast("int"), (k * 10).cast("int")).alias("value"))
    use = u.select("site", F.lit("radius").alias("category"), F.concat((k % 12 * 2 + 2).cast("string"), F.lit("px")).alias("value"), F.lit(1).alias("n"))
    names = u.select("site", F.concat(F.lit("--v"), (k % (F.col("site") + 5)).cast("string")).alias("name"))
    rhythm = u.groupBy("site").agg(F.array(F.lit(4.0), F.lit(8.0)).alias("rhythm")).where("site % 2 = 0")
    return feature_rules.site_tags(tokens, colors_, use, names, rhythm, ["site"]).select("site", F.array_join("tags", "; ").alias("tags"))


def palette_facts(spark, d):
    u = _input(spark, d, "tones").select("site", F.when(F.col("category") == "structuralBorderColor", "actionColor").otherwise(F.col("category")).alias("category"), "value", (F.col("n") / 100.0).alias("n"))
    primaries = u.where("category = 'actionColor'").groupBy("site").agg(F.min("value").alias("primary"))
    found = feature_rules.palette_facts(u, primaries, ["site"])
    return found.select("site", "action_families", F.round("dominant_share", 6).alias("dominant_share"), "decorative", "stable", F.round("neutral", 6).alias("neutral"))


def element_token_refs(spark, d):
    e, k = _input(spark, d, "spaced"), F.col("k")
    tokens = e.where("k < 12").select("site", F.concat(F.when(k % 3 == 0, "spacing.").when(k % 3 == 1, "radius.").otherwise("typography.font-size."), k.cast("string")).alias("ref"), F.concat((k % 4 * 4 + 4).cast("string"), F.lit("px")).alias("value"))
    pick = lambda m: F.concat((k % m * 4 + 4).cast("string"), F.lit("px"))
    styles = F.create_map(F.lit("gap"), pick(5), F.lit("borderRadius"), F.concat(pick(3), F.lit(" 0px")), F.lit("width"), pick(4), F.lit("fontSize"), pick(4))
    found = token_refs.style_token_refs(e.select("site", k.alias("id"), styles.alias("styles")), tokens, ["site"])
    return found.select("site", "id", F.array_join("refs", ",").alias("refs"))


QUERIES = {f.__name__: f for f in (
    stylesheet_declarations, stylesheet_states, stylesheet_breakpoints, stylesheet_motion, variable_colors, page_stylesheets, suppressed_sections, overflow_sources, crop_of_rect, detected_components, status_roots,
    element_token_refs, auth_walls, page_health, region_scores, site_feature_tags, palette_facts, corner_texts, page_keys, moved_rects, capture_merges, state_metrics, observation_identity, owner_tokens, color_tokens, general_colors, manifest_differences, usage_of_elements, color_name_groups, page_frontier, evidence_index, claim_scopes, dangling_evidence, token_evidence, section_matches, component_matches, match_summaries, layout_property_changes, responsive_pairs, interaction_pairs)}



def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({INPUTS[n]})" for n in names)


#: Sections of both sides with what they hold, and their matches.
_MATCHED = _with("sections_a", "sections_b", "held_a", "held_b", "seen_a", "seen_b") + """,
sections AS (SELECT *, 'a' AS side FROM sections_a UNION ALL SELECT *, 'b' FROM sections_b),
held AS (SELECT *, 'a' AS side, type || '|' || element_kind || '|' || role AS kind FROM held_a UNION ALL SELECT *, 'b', type || '|' || element_kind || '|' || role FROM held_b),
kinds AS (SELECT side, page, section_id, list(kind ORDER BY kind) AS kinds FROM held GROUP BY ALL),
signed AS (
  SELECT s.*, hash(s.role, s.layout_mode, CASE WHEN s.parent_id IS NULL THEN 'root' ELSE coalesce(u.role, 'unknown') END, coalesce(kinds, [])) AS sig
  FROM sections s LEFT JOIN sections u ON u.side = s.side AND u.page = s.page AND u.id = s.parent_id LEFT JOIN kinds k ON k.side = s.side AND k.page = s.page AND k.section_id = s.id),
first AS (SELECT *, count(*) FILTER (side = 'a') OVER w = 1 AND count(*) FILTER (side = 'b') OVER w = 1 AS exact FROM signed WINDOW w AS (PARTITION BY page, sig)),
second AS (SELECT *, count(*) FILTER (side = 'a') OVER w AS na, count(*) FILTER (side = 'b') OVER w AS nb FROM first WHERE NOT exact WINDOW w AS (PARTITION BY page, role)),
matched AS (
  SELECT page, side, id, CAST(sig AS VARCHAR) AS name, 'matched' AS status, 'high' AS confidence, 'exact-semantic-signature' AS reason FROM first WHERE exact
  UNION ALL SELECT page, side, id, role, CASE WHEN na = 1 AND nb = 1 THEN 'matched' WHEN na * nb > 0 THEN 'ambiguous' ELSE 'unmatched' END, CASE WHEN na = 1 AND nb = 1 THEN 'medium' ELSE 'none' END,
    CASE WHEN na = 1 AND nb = 1 THEN 'unique-role' WHEN na * nb > 0 THEN 'duplicate-semantic-candidates' ELSE 'missing-counterpart' END FROM second)"""
_PAIRED = """
paired AS (SELECT a.page, a.id AS a_id, b.id AS b_id FROM matched a JOIN matched b ON a.page = b.page AND a.name = b.name AND a.side = 'a' AND b.side = 'b' AND a.status = 'matched' AND b.status = 'matched'),
shaped AS (SELECT *, CASE grid WHEN '1fr  1fr' THEN '2' WHEN 'repeat(3, 1fr)' THEN '3' WHEN 'none' THEN 'none' WHEN '200px 300px' THEN '2' END AS columns FROM sections)"""
#: The index of ids over the collections: sections, components, media, responsive observations, pages.
_CITED = _with("cited", "cited_pages") + """,
every AS (
  SELECT site, id, page, NULL AS section, 0 AS c, 'sections' AS collection FROM cited WHERE kind = 0 UNION ALL SELECT site, id, CASE WHEN kind < 3 THEN page END, section, kind, ['components', 'media', 'responsive'][kind] FROM cited WHERE kind > 0
  UNION ALL SELECT site, page, page, NULL, 4, 'pages' FROM cited_pages),
one AS (SELECT DISTINCT * FROM every QUALIFY rank() OVER (PARTITION BY site, id ORDER BY c) = 1),
held AS (SELECT site, id AS section, min(page) AS held_page FROM cited WHERE kind = 0 GROUP BY ALL),
idx AS (SELECT o.site, o.id, collection, coalesce(o.page, held_page) AS page, o.section, p.url, p.viewport FROM one o LEFT JOIN held h ON h.site = o.site AND h.section = o.section LEFT JOIN cited_pages p ON p.site = o.site AND p.page = coalesce(o.page, held_page))"""
_P = "WITH x AS (SELECT page_id AS p FROM pages)"
_OUTER = "'@media (min-width:' || p % 7 * 100 + 320 || 'px) and (max-width:64em)'"
_INNER = f"{_OUTER} || ' @container card (width >= ' || p % 5 * 16 + 200 || 'px)'"
ORACLES = {
    "stylesheet_declarations": f"""{_P}
SELECT p AS page_id, '' AS media, ':root' AS selector, '--brand-primary' AS property, {_BRAND} AS value, false AS important FROM x
UNION ALL SELECT p, '', ':root', unnest(['--primary-hover', '--gap', '--note', '--accent']), unnest(['#010203', '4px', '"}};{{"', 'var(--brand-primary)']), false FROM x
UNION ALL SELECT p, '', 'html', '--brand-primary', 'rgb(' || p % 200 || ', 7, 9)', false FROM x WHERE p % 3 = 0
UNION ALL SELECT p, {_OUTER}, '.a:hover,.b:focus', unnest(['color', 'background-color', 'content']), unnest(['red', 'url(data:x;y}}z)', '"}}"']), false FROM x
UNION ALL SELECT p, {_OUTER}, '.a:hover,.b:focus', 'width', p % 5 || 'px', true FROM x
UNION ALL SELECT p, {_INNER}, '.d:active', unnest(['outline-offset', 'color']), unnest([p % 4 || 'px', 'blue']), false FROM x
UNION ALL SELECT p, {_INNER}, '.c', 'transition', 'w' || p % 13 || ' .2s ease-in,color 100ms', false FROM x
UNION ALL SELECT p, '', '.e', 'animation', 'spin ' || p % 3 + 1 || 's linear infinite', false FROM x""",
    "stylesheet_states": f"""{_P}
SELECT p AS page_id, unnest(['hover', 'focus']) AS state, '.a:hover,.b:focus' AS selector, 'color:red;width:' || p % 5 || 'px' AS styles FROM x
UNION ALL SELECT p, 'active', '.d:active', 'color:blue;outline-offset:' || p % 4 || 'px' FROM x""",
    "stylesheet_breakpoints": f"""{_P}
SELECT p % 4 AS site, CAST(width AS INTEGER) AS width, count(*) AS n FROM (SELECT p, unnest([p % 7 * 100 + 320, 1024, p % 5 * 16 + 200]) AS width FROM x) GROUP BY 1, 2""",
    "stylesheet_motion": f"""{_P},
m AS (
  SELECT p, 0 AS k, 'w' || p % 13 || ', color' AS property, '0.2s, 0.1s' AS duration, 'ease-in, ease' AS easing FROM x
  UNION ALL SELECT p, 1, 'animation:spin', p % 3 + 1 || 's', 'linear' FROM x)
SELECT p % 4 AS site, property, duration, easing, count(*) AS n, CAST(row_number() OVER (PARTITION BY p % 4 ORDER BY count(*) DESC, min(p * 2 + k)) AS INTEGER) AS ord
FROM m GROUP BY 1, 2, 3, 4 QUALIFY ord <= 10""",
    "variable_colors": f"""{_P}, v AS (SELECT p, CASE WHEN p % 3 = 0 THEN printf('#%02x0709', p % 200) ELSE {_BRAND} END AS value FROM x)
SELECT p AS page_id, unnest(['declaredColor', 'brandTokenColor']) AS category, value, 2 AS weight FROM v UNION ALL SELECT p, 'declaredColor', '#010203', 1 FROM v""",
    "page_stylesheets": "SELECT page_id, 0 AS sheet, 'p' AS selector, 'margin' AS property, '0' AS value FROM pages WHERE contains(html, '<style>p{margin:0}</style>')",
    "suppressed_sections": _with("boxes") + """,
pairs AS (SELECT a.page, a.id AS outer_id, b.id AS inner_id, a.area AS x, b.area AS y, a.landmark AS m, b.landmark AS n FROM boxes a JOIN boxes b ON a.page = b.page AND a.pre < b.pre AND b.pre <= a.last),
gone AS (SELECT page, CASE WHEN m AND NOT n THEN inner_id ELSE outer_id END AS id FROM pairs WHERE y >= x * 0.85 UNION SELECT page, outer_id FROM pairs WHERE y < x * 0.85 AND NOT m AND n AND y >= x * 0.5)
SELECT page, id, (page, id) IN (SELECT (page, id) FROM gone) AS suppressed FROM boxes""",
    "overflow_sources": _with("layers", "boxes") + """,
free AS (SELECT *, greatest(0, -x0) + greatest(0, x1 - 1000) AS px FROM layers e WHERE visible AND position <> 'fixed' AND NOT EXISTS (SELECT 1 FROM layers a WHERE a.page = e.page AND a.pre < e.pre AND e.pre <= a.last
  AND (a.position = 'fixed' OR (a.pre > 0 AND (a.overflow_x = 'hidden' OR (a.overflow_x = 'auto' AND a.scroll_width > 1004)))))),
over AS (SELECT * FROM free WHERE px > 4),
s1 AS (SELECT * FROM over QUALIFY row_number() OVER (PARTITION BY page ORDER BY body, px DESC, pre) = 1),
r2 AS (SELECT o.* FROM over o JOIN s1 s USING (page) WHERE o.last < s.pre OR s.last < o.pre), s2 AS (SELECT * FROM r2 QUALIFY row_number() OVER (PARTITION BY page ORDER BY body, px DESC, pre) = 1),
r3 AS (SELECT o.* FROM r2 o JOIN s2 s USING (page) WHERE o.last < s.pre OR s.last < o.pre), s3 AS (SELECT * FROM r3 QUALIFY row_number() OVER (PARTITION BY page ORDER BY body, px DESC, pre) = 1),
chosen AS (SELECT *, 1 AS ord FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3),
held AS (SELECT c.page, c.ord, b.id AS section, CASE WHEN b.landmark THEN 'main' ELSE 'content' END AS role FROM chosen c JOIN boxes b ON b.page = c.page AND b.pre <= c.pre AND c.pre <= b.last
  QUALIFY row_number() OVER (PARTITION BY c.page, c.ord ORDER BY b.area, b.pre) = 1),
wide AS (SELECT page, CAST(ceil(max(greatest(1000, x1, 1000 - x0))) AS INTEGER) AS content_width FROM over GROUP BY page)
SELECT page, ord, c.id, CAST(floor(px + 0.5) AS INTEGER) AS overflow_px, CAST(width AS INTEGER) AS width, position, section, role, content_width, content_width > 1004 AS overflows FROM chosen c JOIN held USING (page, ord) JOIN wide USING (page)""",
    "crop_of_rect": _with("rects", "crops") + """
SELECT r.page, r.id, c.crop FROM rects r JOIN crops c ON r.page = c.page AND (r.section = c.section OR (r.x >= c.x AND r.y >= c.y AND r.x + r.w <= c.x + c.w AND r.y + r.h <= c.y + c.h))
QUALIFY row_number() OVER (PARTITION BY r.page, r.id ORDER BY c.ord, c.crop) = 1""",
    "section_matches": _MATCHED + " SELECT page, side, id, status, confidence, reason FROM matched",
    "component_matches": _MATCHED + """,
comps AS (SELECT h.page, h.side, h.id, m.name, m.status AS parent, CASE WHEN m.status = 'matched' THEN kind ELSE '' END AS kind FROM held h JOIN matched m ON m.page = h.page AND m.side = h.side AND m.id = h.section_id),
numbered AS (SELECT *, count(*) FILTER (side = 'a') OVER w AS na, count(*) FILTER (side = 'b') OVER w AS nb FROM comps WINDOW w AS (PARTITION BY page, name, kind))
SELECT page, side, id, CASE WHEN parent = 'matched' AND na = 1 AND nb = 1 THEN 'matched' WHEN parent IN ('matched', 'ambiguous') AND na * nb > 0 THEN 'ambiguous' ELSE 'unmatched' END AS status,
  CASE WHEN parent = 'matched' AND na = 1 AND nb = 1 THEN 'high' ELSE 'none' END AS confidence,
  CASE WHEN parent = 'matched' AND na = 1 AND nb = 1 THEN 'exact-semantic-signature' WHEN parent = 'matched' AND na * nb > 0 THEN 'duplicate-semantic-candidates'
    WHEN parent = 'ambiguous' AND na * nb > 0 THEN 'parent-section-unresolved' ELSE 'missing-counterpart' END AS reason FROM numbered""",
    "match_summaries": _MATCHED + """
SELECT page % 7 AS site, count(*) FILTER (status = 'matched') // 2 AS matched_pairs, count(*) FILTER (confidence = 'high') // 2 AS high_confidence_pairs, count(*) FILTER (confidence = 'medium') // 2 AS medium_confidence_pairs,
  count(DISTINCT CASE WHEN status = 'ambiguous' THEN (page, name) END) AS ambiguous_groups, count(*) FILTER (status = 'unmatched') AS unmatched_entities FROM matched GROUP BY 1""",
    "layout_property_changes": _MATCHED + ", " + _PAIRED + """,
told AS (
  SELECT p.page, a_id, b_id, a.role, unnest(['order', 'display', 'position', 'gridTemplateColumns', 'childGridTemplateColumns']) AS property,
    unnest([a.order_, a.display, nullif(a.position, ''), a.columns, CASE a.display WHEN 'block' THEN '1' WHEN 'grid' THEN '1' END]) AS before, unnest([b.order_, b.display, nullif(b.position, ''), b.columns, CASE b.display WHEN 'block' THEN '1' WHEN 'grid' THEN '1' END]) AS after
  FROM paired p JOIN shaped a ON a.side = 'a' AND a.page = p.page AND a.id = p.a_id JOIN shaped b ON b.side = 'b' AND b.page = p.page AND b.id = p.b_id)
SELECT * FROM told WHERE before IS DISTINCT FROM after""",
    "responsive_pairs": _MATCHED + ", " + _PAIRED + """,
seen AS (SELECT *, 'a' AS side FROM seen_a UNION ALL SELECT *, 'b' FROM seen_b),
useful AS (
  SELECT e.page, e.side, e.id, section, to_viewport, CASE WHEN section % 4 = 0 THEN 'header' ELSE s.role END AS role, CASE WHEN property = 'order' THEN 'reorder' ELSE 'reflow' END || ' · ' || property || ': ' || before || ' → ' || coalesce(after, '—') AS value
  FROM seen e JOIN sections s ON s.side = e.side AND s.page = e.page AND s.id = e.section
  WHERE (property IN ('order', 'position') AND before IS DISTINCT FROM after) OR (property = 'gridTemplateColumns' AND (before <> '1fr 1fr' AND after = '1fr 1fr 1fr' OR before = '1fr 1fr' AND after IN ('50px', '1fr 1fr 1fr')))
    OR (property = 'height' AND section % 4 = 0 AND before = '40px' AND after = '50px')),
one AS (SELECT page, section, to_viewport, min(id) AS b_id, min(value) AS after FROM useful WHERE side = 'b' GROUP BY ALL HAVING count(*) = 1)
SELECT u.page, u.id AS a_id, o.b_id, 'responsive.' || role || '.desktop-' || u.to_viewport AS path, value AS before, after, CASE WHEN o.b_id IS NULL THEN 'unpaired' WHEN value = after THEN 'same' ELSE 'changed' END AS state
FROM useful u LEFT JOIN paired p ON p.page = u.page AND p.a_id = u.section LEFT JOIN one o ON o.page = u.page AND o.section = p.b_id AND o.to_viewport = u.to_viewport WHERE side = 'a'""",
    "interaction_pairs": _with("acts_a", "acts_b") + """,
acts AS (SELECT *, 'a' AS side FROM acts_a UNION ALL SELECT *, 'b' FROM acts_b),
told AS (
  SELECT page, side, driver, trigger, property, before IS NOT NULL AS direct, property || ': ' || CASE WHEN property = 'transform' THEN CASE WHEN before = 'red' THEN 'red' ELSE 'matrix(1, 0, 0, 1, 0, 0)' END ELSE coalesce(before, '—') END || ' → '
    || CASE WHEN property = 'transform' THEN CASE after WHEN ' blue ' THEN 'blue' WHEN 'none' THEN 'matrix(1, 0, 0, 1, 0, 0)' ELSE 'matrix(1, 0, 0, 1, 4, 0)' END ELSE trim(after) END AS value FROM acts),
grouped AS (
  SELECT page, side, driver, trigger, property, coalesce(string_agg(DISTINCT value, ' | ' ORDER BY value) FILTER (direct), string_agg(DISTINCT value, ' | ' ORDER BY value)) AS value FROM told GROUP BY ALL)
SELECT page, driver, trigger, property AS properties, a.value AS before, b.value AS after, CASE WHEN a.value IS NULL OR b.value IS NULL THEN 'unpaired' WHEN a.value = b.value THEN 'same' ELSE 'changed' END AS state
FROM (SELECT * FROM grouped WHERE side = 'a') a FULL JOIN (SELECT * FROM grouped WHERE side = 'b') b USING (page, driver, trigger, property)""",
    "detected_components": _with("elements") + """,
kids AS (SELECT page, parent_id AS id, string_agg(tag, ',' ORDER BY pre) FILTER (k <= 5) AS tags, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY page, parent_id ORDER BY pre) AS k FROM elements WHERE parent_id IS NOT NULL) GROUP BY 1, 2),
known AS (
  SELECT e.*, coalesce(k.tags, '') AS tags, coalesce(k.n, 0) AS n_kids, u.background AS behind, tag IN ('img', 'button', 'input') OR (tag = 'a' AND has_href) OR coalesce(role = 'button', false) AS acts
  FROM elements e LEFT JOIN kids k USING (page, id) LEFT JOIN (SELECT page, id AS parent_id, background FROM elements) u USING (page, parent_id)),
held AS (SELECT a.page, a.id FROM known a JOIN known b ON a.page = b.page AND a.pre < b.pre AND b.pre <= a.last AND b.acts GROUP BY ALL),
alike AS (SELECT page, parent_id, tag, class, tags FROM known WHERE visible AND parent_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
inputs AS (
  SELECT *, tag = 'input' AND input_type = 'text' AS typed FROM known WHERE (tag = 'input' AND input_type = 'text') OR role = 'textbox'),
chain AS (
  SELECT i.page, i.id, i.width AS w0, i.height AS h0, i.background AS paint, i.parent_id AS up, 1 AS level FROM inputs i
  UNION ALL SELECT c.page, c.id, w0, h0, paint, k.parent_id, 2 FROM (SELECT i.page, i.id, i.width AS w0, i.height AS h0, i.background AS paint, i.parent_id AS up FROM inputs i) c JOIN known k ON k.page = c.page AND k.id = c.up
  UNION ALL SELECT c.page, c.id, w0, h0, paint, g.parent_id, 3 FROM (SELECT i.page, i.id, i.width AS w0, i.height AS h0, i.background AS paint, i.parent_id AS up FROM inputs i) c JOIN known k ON k.page = c.page AND k.id = c.up JOIN known g ON g.page = k.page AND g.id = k.parent_id),
boxes AS (
  SELECT c.page, c.id, u.id AS box FROM chain c JOIN known u ON u.page = c.page AND u.id = c.up
  WHERE u.visible AND u.width >= w0 AND u.height >= h0 AND u.width <= greatest(w0 * 1.8, w0 + 160) AND u.height <= greatest(h0 * 3, 72) AND (u.width > w0 + 2 OR u.height > h0 + 2)
    AND ((u.line > 0 AND u.style <> 'none') OR u.corner > 0 OR u.shadow <> 'none' OR (u.background NOT IN ('transparent', 'rgba(0, 0, 0, 0)') AND u.background <> paint))
  QUALIFY row_number() OVER (PARTITION BY c.page, c.id ORDER BY level) = 1),
scored AS (
  SELECT k.page, k.id, h.id IS NOT NULL AS media, a.tag IS NOT NULL AS twice, corner > 4 AS rounded, shadow <> 'none' AS shaded, line > 0 AND style <> 'none' AS lined,
    background NOT IN ('transparent', 'rgba(0, 0, 0, 0)') AND background <> coalesce(behind, '') AS apart, text_chars >= 12 AS content, n_kids >= 2 AS built, width >= 360 AND height >= 150 AS large
  FROM known k LEFT JOIN held h USING (page, id) LEFT JOIN alike a ON a.page = k.page AND a.parent_id = k.parent_id AND a.tag = k.tag AND a.class = k.class AND a.tags = k.tags
  WHERE visible AND k.tag NOT IN ('nav', 'dialog', 'button', 'input') AND width >= 120 AND height >= 72 AND pad >= 12 AND NOT (width >= 360 AND (main_child OR coalesce(role = 'region', false)))),
cards AS (
  SELECT page, id, 'card' AS type, least(0.94, score) AS confidence, 15 AS place, list_filter([CASE WHEN rounded THEN 'rounded-container' END, CASE WHEN shaded THEN 'shadow-boundary' END, CASE WHEN lined THEN 'border-boundary' END, 'contained-spacing',
    CASE WHEN apart THEN 'distinct-surface' END, CASE WHEN content THEN 'content-region' END, CASE WHEN built THEN 'structured-children' END, CASE WHEN twice THEN 'repeated-sibling-structure' END, CASE WHEN media THEN 'media-or-action' END,
    CASE WHEN large THEN 'large-layout-penalty' END], lambda r: r IS NOT NULL) AS reasons
  FROM (SELECT *, 0.16::DOUBLE * rounded::INT + 0.22::DOUBLE * (shaded OR lined)::INT + 0.16::DOUBLE + 0.1::DOUBLE * apart::INT + 0.12::DOUBLE * content::INT + 0.08::DOUBLE * built::INT + 0.12::DOUBLE * twice::INT + 0.08::DOUBLE * media::INT
  - 0.2::DOUBLE * large::INT AS score FROM scored WHERE rounded OR shaded OR lined) WHERE score >= 0.62::DOUBLE),
told AS (
  SELECT page, id, 'button' AS type, 0.98 AS confidence, 0 AS place, ['native-element'] AS reasons FROM known WHERE visible AND (tag = 'button' OR (tag = 'input' AND input_type = 'submit'))
  UNION ALL SELECT page, id, 'button', 0.9, 1, ['aria-role'] FROM known WHERE visible AND role = 'button'
  UNION ALL SELECT page, id, 'button', 0.65, 2, ['class-name', 'interactive-behavior'] FROM known WHERE visible AND class = 'btn' AND ((tag = 'a' AND has_href) OR tag IN ('button', 'input') OR onclick OR coalesce(tabindex = '0', false))
  UNION ALL SELECT page, id, 'navigation', 0.98, 3, ['native-element'] FROM known WHERE visible AND tag = 'nav'
  UNION ALL SELECT i.page, coalesce(b.box, i.id), 'input', CASE WHEN typed THEN 0.98 ELSE 0.88 END, CASE WHEN typed THEN 5 ELSE 6 END, CASE WHEN typed THEN ['native-element'] ELSE ['aria-role'] END FROM inputs i LEFT JOIN boxes b USING (page, id) WHERE i.visible OR b.box IS NOT NULL
  UNION ALL SELECT i.page, coalesce(b.box, i.id), 'input', 0.88, 6, ['aria-role'] FROM inputs i LEFT JOIN boxes b USING (page, id) WHERE (i.visible OR b.box IS NOT NULL) AND typed AND role = 'textbox'
  UNION ALL SELECT page, id, 'table', 0.82, 9, ['aria-grid-role'] FROM known WHERE visible AND role = 'grid'
  UNION ALL SELECT page, id, 'modal', 0.98, 10, ['native-element'] FROM known WHERE visible AND tag = 'dialog'
  UNION ALL SELECT page, id, 'modal', 0.65, 12, ['class-name', 'overlay-position'] FROM known WHERE visible AND class = 'modal-box' AND (coalesce(aria_modal = 'true', false) OR (position = 'fixed' AND z_index = '3'))
  UNION ALL SELECT page, id, 'list', 0.9, 14, ['aria-role'] FROM known WHERE visible AND role = 'list'
  UNION ALL SELECT page, id, type, confidence, place, reasons FROM cards),
each AS (SELECT page, id, type, reason, min(place * 100 + i) AS pos FROM (SELECT page, id, type, place, unnest(reasons) AS reason, unnest(range(len(reasons))) AS i FROM told) GROUP BY ALL)
SELECT page, id, type, round(CAST(c.confidence AS DOUBLE), 6) AS confidence, r.reasons FROM (SELECT page, id, type, max(confidence) AS confidence FROM told GROUP BY ALL) c JOIN (SELECT page, id, type, string_agg(reason, ',' ORDER BY pos) AS reasons FROM each GROUP BY ALL) r USING (page, id, type)""",
    "status_roots": _with("elements") + """,
c AS (SELECT page, id, pre, last, text_chars % 5 = 0 AS native, line > 0 AS strong, corner < 9 AS drawn FROM elements),
up AS (SELECT a.page, a.id AS outer_id, a.strong AS outer_strong, a.pre AS outer_pre, b.id, b.native, b.strong, b.pre FROM c a JOIN c b ON a.page = b.page AND a.pre < b.pre AND b.pre <= a.last),
natives AS (SELECT DISTINCT page, outer_id AS id FROM up WHERE native),
nearest AS (SELECT page, id, max(outer_pre) AS stop FROM up WHERE outer_strong GROUP BY ALL),
counted AS (SELECT u.page, u.outer_id AS id, count(*) AS n FROM up u LEFT JOIN nearest s ON s.page = u.page AND s.id = u.id WHERE u.strong AND u.outer_pre >= coalesce(s.stop, -1) GROUP BY ALL),
preferred AS (SELECT c.* FROM c LEFT JOIN natives n USING (page, id) LEFT JOIN counted k USING (page, id) WHERE drawn AND (native OR (n.id IS NULL AND (strong OR coalesce(k.n, 0) < 2))))
SELECT c.page, c.id, p.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM preferred q WHERE q.page = c.page AND q.pre < c.pre AND c.pre <= q.last) AS root FROM c LEFT JOIN preferred p USING (page, id)""",
    "general_colors": _with("tones", "raw_tones") + """,
seen AS (SELECT site, value, sum(n) AS n FROM tones WHERE category IN ('textColor', 'bgColor', 'borderColor', 'declaredColor') AND n > 0 GROUP BY ALL),
listed AS (SELECT site, value, count(*) AS m FROM raw_tones GROUP BY ALL)
SELECT site, value, CAST(coalesce(n, CASE WHEN site IN (SELECT site FROM seen) THEN 1 ELSE m END) AS BIGINT) AS n FROM seen FULL JOIN listed USING (site, value)""",
    "manifest_differences": _with("manifests") + """,
f AS (SELECT k, unnest(range(22)) AS i FROM manifests),
d AS (
  SELECT k, i, CASE WHEN i < 7 THEN 'request' WHEN i < 14 OR i > 16 THEN 'environment' WHEN i < 16 THEN 'stabilization' ELSE 'tool' END AS family, i >= 16 AS soft
  FROM f WHERE k % 19 > 0 AND ((k + i) % 7 = 0) <> ((k + i) % (7 + i % 3) = 0)),
g AS (SELECT k, count(*) AS n, bool_or(NOT soft) AS hard, bool_or(family = 'request') AS r, bool_or(family = 'environment') AS e, bool_or(family = 'stabilization') AS s, bool_or(family = 'environment' AND soft) AS b, bool_or(family = 'tool') AS t FROM d GROUP BY k)
SELECT k, CASE WHEN k % 19 = 0 THEN 'missing-capture-manifest' ELSE array_to_string(list_filter([CASE WHEN hard AND r THEN 'capture-settings-mismatch' END, CASE WHEN hard AND e THEN 'capture-environment-mismatch' END, CASE WHEN hard AND s THEN 'stabilization-mismatch' END], lambda x: x IS NOT NULL), ',') END AS reasons,
  array_to_string(list_filter([CASE WHEN b THEN 'browser-environment-differs' END, CASE WHEN t THEN 'tool-version-differs' END], lambda x: x IS NOT NULL), ',') AS limitations, CAST(coalesce(n, 0) AS INTEGER) AS n
FROM manifests LEFT JOIN g USING (k)""",
    "usage_of_elements": _with("drawn") + """,
e AS (SELECT *, CASE background WHEN '#ffffff' THEN '#ffffff' WHEN '#fff' THEN '#ffffff' WHEN 'rgb(1, 2, 3)' THEN '#010203' END AS paint, greatest(0, least(x1, 100) - greatest(x0, 0)) * greatest(0, least(y1, 100) - greatest(y0, 0)) / 10000.0 AS share FROM drawn),
sides AS (
  SELECT page, id, interactive, w1 AS w, s1 AS s, p1 AS p, x1 - x0 AS edge FROM e UNION ALL SELECT page, id, interactive, w2, s1, p1, y1 - y0 FROM e
  UNION ALL SELECT page, id, interactive, w1, s2, p2, x1 - x0 FROM e UNION ALL SELECT page, id, interactive, w2, s2, p1, y1 - y0 FROM e),
painted AS (SELECT * FROM sides WHERE w <> '0px' AND edge > 0 AND s IN ('solid', 'dashed') AND p IN ('#ff0000', '#00ff00')),
u AS (
  SELECT page, 'bgColor' AS category, paint AS value, 1.0 AS weight FROM e WHERE paint IS NOT NULL UNION ALL SELECT page, 'bgArea', paint, share FROM e WHERE paint IS NOT NULL AND share > 0
  UNION ALL SELECT page, 'borderColor', p, 1 FROM (SELECT DISTINCT page, id, p FROM painted) UNION ALL SELECT page, 'structuralBorderColor', p, 1 FROM (SELECT DISTINCT page, id, p FROM painted WHERE NOT interactive)
  UNION ALL SELECT page, 'border', b, 1 FROM (SELECT DISTINCT page, id, w || ' ' || s || ' ' || p AS b FROM painted)
  UNION ALL SELECT page, 'fontFamily', font_family, 1 FROM e WHERE font_family <> '' UNION ALL SELECT page, 'fontTextFamily', font_family, text_chars FROM e WHERE font_family <> '' AND text_chars > 0
  UNION ALL SELECT page, 'spacing', g, 1 FROM e WHERE g IN ('4px', '8px') UNION ALL SELECT page, 'spacing', m, 1 FROM e WHERE m = '4px')
SELECT page, category, value, round(CAST(sum(weight) AS DOUBLE), 6) AS weight FROM u GROUP BY ALL""",
    "color_name_groups": _with("tones", "named_tones") + """,
alias AS (
  SELECT site, value, ord, name, min(ord) OVER (PARTITION BY site, value) AS first, row_number() OVER (PARTITION BY site, value ORDER BY CASE WHEN name IN ('primary', 'accent') OR name LIKE 'border-%' OR name LIKE '%badge%' THEN 3 WHEN name LIKE 'palette-%' THEN 0 ELSE 1 END DESC, ord % 3 DESC, name) AS r,
    bool_or(ord % 4 = 0) OVER (PARTITION BY site, value) AS link FROM named_tones),
used AS (
  SELECT site, value, sum(n) FILTER (category = 'actionBackgroundColor') AS action, sum(n) FILTER (category = 'linkColor') AS editorial, sum(n) FILTER (category = 'statusColor') AS status, sum(n) FILTER (category = 'bgColor') AS decorative,
    sum(n) FILTER (category = 'textColor') AS texts, sum(n) FILTER (category IN ('bgColor', 'bgArea')) AS surface, sum(n) FILTER (category IN ('borderColor', 'structuralBorderColor')) AS border,
    sum(n) FILTER (category = 'declaredColor') AS declared, sum(n) FILTER (category <> 'declaredColor') AS rendered FROM tones GROUP BY ALL),
s AS (
  SELECT a.site, a.value, name, first, [coalesce(action, 0), coalesce(editorial, 0) + link::INT, coalesce(status, 0), coalesce(decorative, 0), coalesce(texts, 0), coalesce(surface, 0), coalesce(border, 0), 0] AS scores, coalesce(declared, 0) AS declared, coalesce(rendered, 0) AS rendered,
    bool_or(name = 'primary') OVER (PARTITION BY a.site) AS shown FROM alias a LEFT JOIN used USING (site, value) WHERE r = 1),
p AS (SELECT site, bool_or(name = 'primary') AS has_primary FROM named_tones GROUP BY 1),
l AS (
  SELECT *, CASE WHEN rendered = 0 AND declared > 0 THEN 'declared' WHEN name LIKE '%badge%' THEN 'status' WHEN name = 'accent' THEN CASE WHEN has_primary THEN 'action' ELSE 'decorative' END WHEN name LIKE 'border-%' THEN 'border' WHEN name LIKE 'primary%' THEN 'action'
    WHEN list_max(scores) > 0 THEN ['action', 'editorial', 'status', 'decorative', 'text', 'surface', 'border', 'fallback'][list_position(scores, list_max(scores))] ELSE 'fallback' END AS label FROM s JOIN p USING (site)),
g AS (SELECT *, CAST(greatest(1, CASE WHEN label = 'declared' THEN declared ELSE scores[list_position(['action', 'editorial', 'status', 'decorative', 'text', 'surface', 'border', 'fallback'], label)] END) AS BIGINT) AS score FROM l)
SELECT site, label, CAST(list_position(['action', 'editorial', 'status', 'decorative', 'text', 'surface', 'border', 'declared', 'fallback'], label) AS INTEGER) AS label_order,
  CAST(row_number() OVER (PARTITION BY site, label ORDER BY score DESC, first) AS INTEGER) AS place, name, score FROM g QUALIFY place <= 6""",
    "page_frontier": "WITH RECURSIVE graph AS (" + INPUTS["graph"] + """),
reached AS (SELECT DISTINCT site, url, 0 AS depth FROM graph WHERE url < 20 UNION SELECT r.site, g.target, depth + 1 FROM reached r JOIN graph g USING (site, url) WHERE depth < 6),
least AS (SELECT site, url, min(depth) AS depth FROM reached GROUP BY ALL)
SELECT l.site, CAST(l.url AS VARCHAR) AS url, l.depth, min(CAST(g.url AS VARCHAR)) AS parent FROM least l LEFT JOIN (SELECT p.site, p.url, p.depth, target FROM least p JOIN graph USING (site, url)) g ON g.site = l.site AND g.target = l.url AND g.depth = l.depth - 1 GROUP BY ALL""",
    "evidence_index": _CITED + " SELECT site, id, collection, page, section, url, viewport FROM idx",
    "claim_scopes": _CITED + """,
u AS (SELECT site, claim, url, string_agg(DISTINCT viewport, '/' ORDER BY viewport) AS v FROM cited JOIN idx USING (site, id) WHERE url IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY site, claim ORDER BY url) AS k, count(*) OVER (PARTITION BY site, claim) AS n FROM u)
SELECT site, claim, string_agg(url || ' · ' || v, ', ' ORDER BY url || ' · ' || v) AS scopes, greatest(max(n) - 2, 0) AS more FROM r WHERE k <= 2 GROUP BY ALL""",
    "dangling_evidence": _CITED + """
SELECT site, claim AS owner, c.id || CASE WHEN place % 5 = 0 THEN 'x' ELSE '' END AS id FROM cited c LEFT JOIN idx i USING (site, id) WHERE place % 5 = 0 OR i.url IS NULL""",
    "token_evidence": _CITED + """,
o AS (SELECT DISTINCT site, 't' || place % 30 AS token, id, place AS rank FROM cited WHERE kind < 3 AND place % 30 < 20),
b AS (SELECT DISTINCT c.site, 't' || c.place % 30 AS token, p.page AS id, CAST(p.page AS BIGINT) AS rank FROM cited c JOIN cited_pages p ON p.site = c.site AND p.url = 'https://e.com/' || c.place % 7 WHERE (c.site, 't' || c.place % 30) NOT IN (SELECT (site, token) FROM o)),
r AS (SELECT *, row_number() OVER (PARTITION BY site, token ORDER BY rank, id) AS k, count(*) OVER (PARTITION BY site, token) AS n FROM (SELECT site, token, id, min(rank) AS rank FROM (SELECT * FROM o UNION ALL SELECT * FROM b) GROUP BY ALL))
SELECT site, token, CAST(k AS INTEGER) AS place, id, greatest(n - 8, 0) AS more FROM r WHERE k <= 8""",
    "corner_texts": _with("texts") + """
SELECT id, CASE WHEN corner = '' OR (corner IN ('0px', '0') AND coalesce(other, '0') IN ('0', '0em')) OR coalesce(other, '') = 'url(x)' THEN NULL ELSE corner || ' ' || corner || ' ' || coalesce(other, corner) || ' ' || corner END AS radius,
  CASE WHEN path = '/opt/msedge/x' THEN 'edge' WHEN path = '/usr/bin/chromium' THEN 'chromium' WHEN path = 'C:/google chrome/a' THEN 'chrome' WHEN id % 6 = 1 THEN 'edge' WHEN id % 6 = 3 THEN 'chromium' WHEN id % 6 IN (0, 2) THEN 'chrome' ELSE 'unknown' END AS product,
  CASE id % 6 WHEN 0 THEN '120.1' WHEN 1 THEN '99.0' WHEN 2 THEN '9.9' WHEN 3 THEN '7.1' END AS version FROM texts""",
    "page_keys": """SELECT page_id, 'https://e.com/p' || page_id % 9 || '::' || CASE WHEN page_id % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS page_key, CASE WHEN page_id % 3 > 0 THEN 'https://e.com/' || page_id ELSE 'https://e.com/p' || page_id % 9 END AS route,
  CASE WHEN page_id % 4 = 0 THEN 'Name' ELSE 'e.com' END AS site FROM pages""",
    "moved_rects": _with("rects") + """,
p AS (SELECT id, id % 4 >= 2 AS moved, id % 100 >= 64 AND id % 200 >= 2.5 * (id % 50) AS severe, CAST(id % 900 AS DOUBLE) AS w, CAST(id % 700 + 1 AS DOUBLE) AS a, CAST(id % 500 AS DOUBLE) AS b FROM rects),
q AS (SELECT *, greatest(1, floor(w * least(1.0, 400 / w, sqrt(90000 / (w * greatest(a, b)))))) AS shown FROM p WHERE w > 0 AND b > 0),
f AS (SELECT id, CAST(shown AS BIGINT) AS width, CAST(greatest(1, floor(a * (shown / w))) AS BIGINT) AS height_a, CAST(greatest(1, floor(b * (shown / w))) AS BIGINT) AS height_b FROM q)
SELECT id, moved, severe, width, height_a, height_b FROM p LEFT JOIN f USING (id)""",
    "capture_merges": _with("acts_a") + """,
o AS (SELECT page, trigger, property, driver, min(id) AS ord, arg_max(after, id) AS last FROM acts_a GROUP BY ALL)
SELECT u.*, observations, first, last FROM (SELECT page, driver AS category, property AS value, CAST(sum(id % 7) AS BIGINT) AS n FROM acts_a GROUP BY ALL) u
JOIN (SELECT page, driver AS category, property AS value, count(*) AS observations, min(ord) AS first, arg_max(last, ord) AS last FROM o GROUP BY ALL) USING (page, category, value)""",
    "state_metrics": _with("acts_a") + """
SELECT page, count(DISTINCT (id % 3, after)) FILTER (id % 3 < 2) AS patterns, count(*) FILTER (id % 4 = 1) AS passive, count(*) FILTER (id % 4 = 0) AS safe_active, count(*) FILTER (id % 4 = 0) AS high, count(*) FILTER (id % 4 = 1) AS medium, count(*) FILTER (id % 4 > 1) AS low FROM acts_a GROUP BY page""",
    "observation_identity": _with("cited") + """, k AS (SELECT DISTINCT place FROM cited) SELECT place AS id, NOT (place % 5 = 0 AND place + 1 IN (SELECT place FROM k)) AS consistent FROM k""",
    "owner_tokens": _with("sections_a") + """,
r AS (SELECT page, k, CAST(id AS VARCHAR) AS id, unnest(['color.' || order_, 'color.x' || k % 3]) AS ref, unnest([0, 2]) AS pos FROM sections_a),
f AS (SELECT page, ref, min(k * 4 + pos) AS turn, arg_min(id, k * 4 + pos) AS owner FROM r GROUP BY ALL)
SELECT page, ref, owner, CAST(row_number() OVER (PARTITION BY page ORDER BY turn) AS INTEGER) AS place FROM f QUALIFY place <= 6""",
    "auth_walls": _with("facts") + """,
r AS (
  SELECT k, k % 7 IN (1, 2, 4) AS redirect, coalesce(status IN (401, 403), false) AS denied, k % 13 = 0 AS form, k % 17 = 0 AS dialog,
    k % 7000 > 0 AND k % 7000 < 5000 AND k % 40 <= 30 AND (k % 6 = 0 OR (k % 3 > 0 AND ((k % 4 > 0 AND k % 2 > 0) OR k % 4 >= 2))) AS login FROM facts)
SELECT k, denied OR form OR dialog OR login AS detected, CASE WHEN denied OR form OR dialog THEN 'high' WHEN login THEN 'medium' ELSE 'low' END AS confidence,
  array_to_string(list_filter([CASE WHEN redirect THEN 'login-redirect' END, CASE WHEN denied THEN 'unauthorized-response' END, CASE WHEN form THEN 'password-form' END, CASE WHEN dialog THEN 'blocking-login-dialog' END, CASE WHEN login THEN 'login-only-page' END],
    lambda x: x IS NOT NULL), ',') AS reasons FROM r""",
    "page_health": _with("facts") + """,
i AS (
  SELECT k, list_filter([CASE WHEN k % 50 >= 45 THEN 'large-overlay:error' WHEN k % 50 >= 8 THEN 'large-overlay:warning' END, CASE WHEN k % 60 < 30 AND k % 160 < 80 AND k % 2 = 0 THEN 'main-content-empty:error' END, CASE WHEN k % 25 >= 12 THEN 'skeleton-heavy:warning' END,
    CASE WHEN k % 9 = 0 THEN 'fonts-not-ready:warning' END, CASE WHEN k % 45 >= 30 THEN 'dom-still-mutating:warning:' || k % 45 END, CASE WHEN k % 12 + 995 > 1004 THEN 'horizontal-overflow:warning:1000/' || k % 12 + 995 END, CASE WHEN k % 29 = 0 THEN 'auth-wall:error' END,
    CASE WHEN k % 31 = 0 THEN 'captcha:error' END, CASE WHEN status = 429 THEN 'rate-limited:error' END, CASE WHEN status >= 400 THEN 'error-page:error:' || status END, CASE WHEN k % 7 = 5 THEN 'unexpected-navigation:error:about:blank' END], lambda x: x IS NOT NULL) AS i FROM facts)
SELECT k, array_to_string(i, ',') AS issues, CASE WHEN len(list_filter(i, lambda x: contains(x, ':error'))) > 0 THEN 'unusable' WHEN len(i) > 0 THEN 'degraded' ELSE 'healthy' END AS status,
  len(list_filter(i, lambda x: NOT starts_with(x, 'horizontal-overflow'))) = 0 AS eligible FROM i""",
    "region_scores": _with("facts") + """
SELECT k, CASE WHEN k % 4 < 2 THEN 0 ELSE CASE WHEN k % 40 >= 30 THEN 2 WHEN k % 40 >= 8 THEN 1 ELSE 0 END + CASE WHEN k % 5 >= 3 THEN 2 WHEN k % 5 = 2 THEN 1 ELSE 0 END + (k % 1200 >= 600)::INT + (k % 3 = 2)::INT + (k % 6 >= 3)::INT END AS score FROM facts""",
    "site_feature_tags": _with("spaced") + """,
r AS (SELECT s.site, t.ord, t.ord * (s.site % 5) * 2 + 2 AS px FROM (SELECT DISTINCT site FROM spaced) s, (SELECT unnest(range(3)) AS ord) t),
w AS (SELECT r.site, r.ord, r.px, greatest(1, count(u.k)) AS n FROM r LEFT JOIN spaced u ON u.site = r.site AND u.k % 12 * 2 + 2 = r.px GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY site ORDER BY px, ord) AS run, sum(n) OVER (PARTITION BY site) AS total FROM w),
m AS (SELECT site, min(px) FILTER (run >= total / 2.0) AS radius, sum(n) FILTER (px <= 4) / max(total) AS small FROM c GROUP BY site),
e AS (SELECT s.site, list_distinct(list_transform(range(1, 4), lambda j: CAST(j * s.site % 9 * 2 + 4 AS DOUBLE))) AS levels FROM (SELECT DISTINCT site FROM spaced) s),
v AS (SELECT site, count(DISTINCT k % (site + 5)) AS v FROM spaced GROUP BY site)
SELECT site, array_to_string(list_filter([CASE WHEN site % 2 = 0 THEN 'spacing rhythm led by 4px, 8px' END, CASE WHEN site % 3 = 0 THEN 'monospace typography' END, CASE WHEN site % 3 = 1 THEN 'serif editorial style' END, CASE WHEN site % 2 = 1 THEN 'single-font system' END,
  CASE WHEN site % 3 < 2 THEN 'monochrome palette' END, CASE WHEN radius >= 12 THEN 'large-radius rounded style' WHEN radius <= 4 AND small >= 0.5 THEN 'compact-radius surfaces observed' END,
  CASE WHEN site % 4 = 0 THEN 'no stable shadow scale observed' WHEN len(levels) >= 3 AND list_max(levels) - list_min(levels) >= 8 AND list_max(levels) >= 2 * list_min(levels) THEN 'layered elevation system' END,
  CASE WHEN site % 4 >= 2 THEN 'weight contrast hierarchy' END, CASE WHEN v > 20 THEN 'extensive CSS variable usage' END], lambda x: x IS NOT NULL), '; ') AS tags FROM m JOIN e USING (site) JOIN v USING (site)""",
    "palette_facts": _with("tones") + """,
t AS (
  SELECT site, CASE category WHEN 'structuralBorderColor' THEN 'actionColor' ELSE category END AS category, value, n / 100.0 AS n, ord * 37 % 9 * 28 AS r, ord * 91 % 7 * 36 AS g, ord * 53 % 5 * 50 AS b FROM tones),
h AS (
  SELECT *, greatest(r, g, b) - least(r, g, b) AS c, CAST(floor((CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0 WHEN r >= greatest(g, b) THEN 60 * fmod((g - b) / CAST(r - least(g, b) AS DOUBLE), 6) WHEN g >= b THEN 60 * ((b - r) / CAST(g - least(r, b) AS DOUBLE) + 2)
    ELSE 60 * ((r - g) / CAST(b - least(r, g) AS DOUBLE) + 4) END + 360) % 360 / 30) AS INTEGER) AS family FROM t),
own AS (SELECT site, arg_min(family, value) AS family FROM h WHERE category = 'actionColor' GROUP BY site),
a AS (SELECT site, count(*) AS f, max(n) / sum(n) AS share FROM (SELECT site, family, sum(n) AS n FROM h WHERE n > 0 AND c >= 24 AND category IN ('actionBackgroundColor', 'actionColor') GROUP BY ALL) GROUP BY site),
d AS (SELECT site, family, sum(n) FILTER (category = 'bgColor') AS uses, sum(n) FILTER (category = 'bgArea') AS area FROM h WHERE n > 0 AND c >= 24 AND category IN ('bgColor', 'bgArea') GROUP BY ALL),
k AS (SELECT d.* FROM d WHERE (site, family) NOT IN (SELECT (site, family) FROM h WHERE n > 0 AND c >= 24 AND category = 'statusColor') AND (site, family) NOT IN (SELECT (site, family) FROM own)),
x AS (SELECT site, count(*) AS decorative, count(*) FILTER (coalesce(uses, 0) >= 2 OR coalesce(area, 0) >= 0.003) AS stable FROM k GROUP BY site),
n AS (SELECT site, coalesce(sum(n) FILTER (c < 24), 0) / sum(n) AS neutral FROM h WHERE n > 0 AND category IN ('bgColor', 'bgArea', 'textColor') GROUP BY site)
SELECT s.site, coalesce(f, 0) AS action_families, round(CAST(coalesce(share, 1) AS DOUBLE), 6) AS dominant_share, coalesce(decorative, 0) AS decorative, coalesce(stable, 0) AS stable, round(CAST(coalesce(neutral, 0) AS DOUBLE), 6) AS neutral
FROM (SELECT DISTINCT site FROM tones) s LEFT JOIN a USING (site) LEFT JOIN x USING (site) LEFT JOIN n USING (site)""",
    "element_token_refs": _with("spaced") + """,
t AS (SELECT site, CASE k % 3 WHEN 0 THEN 'spacing.' WHEN 1 THEN 'radius.' ELSE 'typography.font-size.' END || k AS ref, k % 3 AS kind, k % 4 * 4 + 4 AS px FROM spaced WHERE k < 12),
u AS (SELECT site, k AS id, unnest([0, 1, 2]) AS kind, unnest([k % 5 * 4 + 4, k % 3 * 4 + 4, k % 4 * 4 + 4]) AS px FROM spaced),
f AS (SELECT DISTINCT site, id, ref FROM u JOIN t USING (site, kind, px))
SELECT s.site, s.k AS id, coalesce(refs, '') AS refs FROM spaced s LEFT JOIN (SELECT site, id, string_agg(ref, ',' ORDER BY ref) AS refs FROM f GROUP BY ALL) g ON g.site = s.site AND g.id = s.k""",
}
