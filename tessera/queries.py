"""Queries over the driver's tables, one for each operator group, with DuckDB SQL for the same rows.

The tables are no captures: pages feed the URL, link and title operators; the others stand in for usage, sections and
manifests, with the operators' own semantics. They test operators, not the domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import capture_queries, design_queries
from .functions import color, css, ids, text, url
from .operators import clusters, diffs, evidence, gates, images, matching, ranking, usage
from .plans import compare, exports
from .sources import html
from .store import history_page as history

_KINDS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{rx}') THEN '{k}'" for k, rx, _ in url.PAGE_KINDS) + " ELSE 'generic' END"
_BOOST_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {b}" for k, _, b in url.PAGE_KINDS) + f" ELSE {url.GENERIC_BOOST} END"
_EXCLUDED_SQL = "regexp_matches(path, '(?i)" + "|".join(f"(?:{x})" for x in url.EXCLUDED_PATHS) + "')"
_PARTS_SQL = "SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS q FROM pages"


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _usage(spark: SparkSession, d: str) -> DataFrame:
    """events as usage: a user is a URL, a user's day a capture, the event type a category, k a value."""
    e = _read(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    day = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return e.select((F.col("user_id") % 10).alias("site"), F.col("user_id").alias("url"), day.alias("capture"), F.col("event_type").alias("category"), k.alias("value"), F.col("value").alias("weight"))


_USAGE_SQL = "SELECT user_id % 10 AS site, user_id AS url, user_id || '/' || strftime(ts, '%Y-%m-%d') AS capture, event_type AS category, json_extract_string(props, '$.k') AS value, value AS weight FROM events"
_VALID_SQL = f"SELECT * FROM ({_USAGE_SQL}) WHERE value <> '' AND weight > 0"


def _colors(spark: SparkSession, d: str) -> DataFrame:
    """part as colours: rgb() texts for odd keys, hex for even ones."""
    p = _read(spark, d, "part")
    r, g, b = ((F.col("p_partkey") * 37) % 256).cast("int"), ((F.col("p_partkey") * 59) % 256).cast("int"), ((F.col("p_size") * 5) % 256).cast("int")
    value = F.when(F.col("p_partkey") % 2 == 1, F.format_string("rgb(%d, %d, %d)", r, g, b)).otherwise(F.format_string("#%02X%02X%02X", r, g, b))
    return p.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_partkey").alias("ord"), value.alias("value"), F.col("p_size").cast("double").alias("n"))


_COLORS_SQL = "SELECT p_partkey, p_brand AS brand, (p_partkey * 37) % 256 AS r, (p_partkey * 59) % 256 AS g, (p_size * 5) % 256 AS b, CAST(p_size AS DOUBLE) AS n FROM part"
_LIN = "(CASE WHEN {0} / 255.0 <= 0.03928 THEN {0} / 255.0 / 12.92 ELSE power(({0} / 255.0 + 0.055) / 1.055, 2.4) END)"
_LUM = "(0.2126 * " + _LIN.format("r") + " + 0.7152 * " + _LIN.format("g") + " + 0.0722 * " + _LIN.format("b") + ")"


def route_identity(spark, d):
    return _read(spark, d, "pages").select("page_id", url.route_identity(F.col("url")).alias("route"), url.page_identity_url(F.col("url")).alias("page"))


def page_kind_counts(spark, d):
    return _read(spark, d, "pages").select(url.page_kind(url.path(F.col("url"))).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def page_link_candidates(spark, d):
    return html.links(_read(spark, d, "pages"), ["page_id"]).groupBy("page_id", "href", "location").agg(F.count(F.lit(1)).alias("n"))


def _candidates(spark, d):
    return html.candidates(_read(spark, d, "pages"), url.authority(F.col("url")))


def page_link_score(spark, d):
    return _candidates(spark, d).groupBy("site", "url", "kind").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))


def representative_pages(spark, d):
    return ranking.ranked_pages(_candidates(spark, d), "site", 8).select("site", "url", "kind", "score", "ord")


def diverse_pages(spark, d):
    return ranking.diverse_pages(_candidates(spark, d), "site", 12).select("site", "url", "kind", "score", "ord")


def tracking_params_stripped(spark, d):
    return _read(spark, d, "pages").select("page_id", url.crawl_url(F.col("url")).alias("url"))


def redact_urls(spark, d):
    return _read(spark, d, "pages").select("page_id", url.redact_urls(F.concat(F.lit("Seen at "), F.col("url"), F.lit(" and there."))).alias("text"))


def page_identity(spark, d):
    t = html.title(F.col("html"))
    return _read(spark, d, "pages").select("page_id", t.alias("title"), text.meaningful(t).alias("meaningful"))


def stable_ids(spark, d):
    p = _read(spark, d, "pages").select("page_id", url.authority(F.col("url")).alias("host"))
    return ids.with_instance_ids(p, "page", ["host"], ["page_id"]).select("page_id", "id")


def usage_frequency(spark, d):
    n = usage.frequency(usage.valid(_usage(spark, d)), ["site", "category", "value"])
    return n.select("site", "category", "value", F.round("n", 6).alias("n"))


def usage_fallback(spark, d):
    seen = _usage(spark, d).where("category = 'error'").select("site", "value", "weight")
    listed = _read(spark, d, "events").select((F.col("user_id") % 10).alias("site"), F.concat(F.lit("v"), (F.col("event_id") % 7).cast("string")).alias("value"))
    return usage.frequency_with_fallback(seen, listed, ["site"]).select("site", "value", F.round("n", 6).alias("n"))


def accent_votes(spark, d):
    return usage.combined(_usage(spark, d), ["site"], {"click": 20.0, "view": 6.0, "error": -50.0}).select("site", "value", F.round("n", 6).alias("n"))


def vote_normalised_usage(spark, d):
    return usage.vote_shares(_usage(spark, d), ["site"], "capture", "url").select("site", "category", "value", F.round("weight", 6).alias("weight"))


def top_scale_values(spark, d):
    n = usage.frequency(usage.valid(_usage(spark, d)).withColumn("weight", F.lit(1)), ["site", "category", "value"]).withColumn("number", F.col("value").cast("double"))
    return ranking.scale(n, ["site", "category"], 5, "number").select("site", "category", "value", "n", "ord")


def weighted_median(spark, d):
    return usage.weighted_median(_read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_linenumber")


def breakpoint_islands(spark, d):
    p = _read(spark, d, "part").select(F.col("p_brand").alias("brand"), (F.col("p_partkey") * 7 % 1600).alias("width"), "p_size")
    return ranking.representative_breakpoints(p.groupBy("brand", "width").agg(F.sum("p_size").alias("n")), ["brand"])


def distribution_distance(spark, d):
    e = _read(spark, d, "events").select("user_id", "event_type", F.lit(1).alias("w"), (F.col("ts") < F.lit("2024-01-16").cast("timestamp")).alias("early"))
    half = lambda x: usage.distribution(e.where(F.col("early") == x), ["user_id"], "event_type", "w")
    return usage.distribution_distance(half(True), half(False), ["user_id"], "event_type").select("user_id", F.round("distance", 6).alias("distance"))


def color_normalise(spark, d):
    return _colors(spark, d).select("p_partkey", color.normal(F.col("value")).alias("color"))


def color_contrast(spark, d):
    c, white = F.col("c"), F.struct(*(F.lit(255).alias(k) for k in "rgb"), F.lit(1.0).alias("a"))
    return _colors(spark, d).withColumn("c", color.channels(F.col("value"))).select("p_partkey", F.round(color.luminance(c), 6).alias("luminance"), F.round(color.contrast(c, white), 6).alias("contrast"), F.round(color.distance(c, white), 6).alias("distance"))


def hue_families(spark, d):
    return clusters.hue_totals(_colors(spark, d), ["brand"])


def neutral_coverage(spark, d):
    return clusters.neutral_coverage(_colors(spark, d), ["brand"]).select("brand", F.round("coverage", 6).alias("coverage"))


def leader_cluster(spark, d):
    return clusters.leader_clusters(_colors(spark, d), ["brand"])


def subpixel_lengths(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", F.round(css.subpixel(F.col("o_totalprice") / 100), 6).alias("px"))


def token_confidence(spark, d):
    u = usage.valid(_usage(spark, d)).groupBy("category", "value").agg(F.count_distinct("url").alias("pages"), F.count_distinct("capture").alias("captures"), F.count(F.lit(1)).alias("seen"))
    score = gates.token_score(F.col("pages"), F.col("captures"), F.col("seen"), F.col("category") == "click", F.lit(False), F.col("category") == "view")
    return u.select("category", "value", score.alias("score"), gates.confidence(score).alias("confidence"))


def token_provenance(spark, d):
    u = _usage(spark, d).withColumn("source", F.concat(F.lit("usage:"), F.col("site").cast("string"))).withColumn("value", F.concat(F.col("value"), F.lit("px")))
    t = _read(spark, d, "part").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("token"), F.lit("click").alias("category"), F.concat((F.col("p_size") + 0.05).cast("string"), F.lit("px")).alias("value"))
    out = evidence.provenance(t, usage.valid(u), "spacing")
    return out.select("token", F.round("observations", 6).alias("observations"), "pages", "captures", F.array_join(F.transform("page_list", lambda x: x.cast("string")), ",").alias("page_list"), F.array_join("source_list", ",").alias("source_list"))


def near_join(spark, d):
    s = _read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    c = _read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    return matching.near(c, s, ["nation"], "c_acctbal", "s_acctbal", 50.0).select("c_custkey", "s_suppkey")


def _year(spark, d, year):
    o = _read(spark, d, "orders").where(F.year("o_orderdate") == year)
    return o.groupBy("o_orderpriority", F.month("o_orderdate").alias("month")).agg(F.floor(F.count(F.lit(1)) / 10).alias("n"))


def named_diff(spark, d):
    return diffs.named_diff(_year(spark, d, 1995), _year(spark, d, 1996), ["o_orderpriority", "month"], "n")


def scale_diff(spark, d):
    return diffs.scale_diff(_year(spark, d, 1995).select("o_orderpriority", "n", "month").groupBy("o_orderpriority", "n").agg(F.min("month").alias("place")), _year(spark, d, 1996).groupBy("o_orderpriority", "n").agg(F.min("month").alias("place")), ["o_orderpriority"], "n", "place")


def palette_match(spark, d):
    side = lambda odd: _read(spark, d, "part").where((F.col("p_partkey") % 2) == odd).groupBy("p_brand", F.concat(F.lit("palette-"), (F.col("p_size") % 10).cast("string")).alias("name")).agg(F.max("p_size").cast("string").alias("value"))
    return diffs.palette_match(side(0), side(1), ["p_brand"])


def entity_match(spark, d):
    c = _read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("page"), F.floor(F.col("c_acctbal") / 20).alias("sig"), F.floor(F.col("c_acctbal") / 500).alias("role"))
    s = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("page"), F.floor(F.col("s_acctbal") / 20).alias("sig"), F.floor(F.col("s_acctbal") / 500).alias("role"))
    return matching.match_entities(c, s, ["page"], ["sig"], ["role"])


def adjacent_responsive_diff(spark, d):
    e = _read(spark, d, "events").select("user_id", "event_id", F.create_map(F.lit("type"), "event_type", F.lit("k"), F.get_json_object("props", "$.k")).alias("styles"))
    pairs = diffs.adjacent(e, ["user_id"], ["event_id"], ["styles"])
    changed = F.map_keys(diffs.map_changes(F.col("styles"), F.col("next_styles")))
    return pairs.select("user_id", "event_id", F.array_join(F.array_sort(changed), ",").alias("changed"))


def comparability_gate(spark, d):
    c = _read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.floor(F.col("c_acctbal") / 1000).alias("band"))
    out = compare.gate(c, c.withColumn("c_custkey", F.col("c_custkey") + 1), ["c_custkey"], ["segment", "nation"], ["band"])
    return out.select("c_custkey", F.array_join("reasons", ",").alias("reasons"), F.array_join("limitations", ",").alias("limitations"), "comparability")


def cross_page_patterns(spark, d):
    p = _read(spark, d, "pages").select(F.regexp_replace(url.authority(F.col("url")), r"^(www|m|blog)\.", "").alias("site"), F.get(url.segments(url.path(F.col("url"))), F.lit(0)).alias("role"), url.route_identity(F.col("url")).alias("url"))
    return evidence.cross_page(p, ["site"], "role", "url")


def section_sequences(spark, d):
    return evidence.sequences(_read(spark, d, "events"), ["user_id"], ["event_id"], "event_type")


def role_runs(spark, d):
    return clusters.run_lengths(_read(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


def term_similarity(spark, d):
    t = _read(spark, d, "documents").select("source", "doc_id", text.terms(F.col("text")).alias("terms"))
    pairs = diffs.adjacent(t, ["source"], ["doc_id"], ["terms"])
    return pairs.select("source", "doc_id", F.round(text.jaccard(F.col("terms"), F.col("next_terms")), 6).alias("similarity"))


def integrity_errors(spark, d):
    li = _read(spark, d, "lineitem")
    parts = [gates.dangling(li, key, _read(spark, d, table), parent, code) for key, table, parent, code in (("l_orderkey", "orders", "o_orderkey", "unknown-order"), ("l_partkey", "part", "p_partkey", "unknown-part"), ("l_suppkey", "supplier", "s_suppkey", "unknown-supplier"))]
    labels = gates.dangling(_read(spark, d, "documents"), "doc_id", _read(spark, d, "labels"), "doc_id", "unlabelled-document")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(labels)


def component_variants(spark, d):
    p = _read(spark, d, "part").select("p_type", "p_brand", F.when(F.col("p_type") == "ECONOMY", 1).otherwise(F.col("p_size") % 4).alias("size"))
    return usage.variant_groups(p, ["p_type", "p_brand"], ["size"])


def benchmark_confusion(spark, d):
    return gates.confusion(_read(spark, d, "labels"), "quality", "toxic")


def array_diff(spark, d):
    e = _read(spark, d, "embeddings").select("label", "vec_id", "embedding")
    pairs = diffs.adjacent(e, ["label"], ["vec_id"], ["embedding"])
    return pairs.select("vec_id", images.array_diff(F.col("embedding"), F.col("next_embedding"), 0.1).alias("x")).select("vec_id", F.round("x.changed", 6).alias("changed"), F.round("x.mean", 6).alias("mean"))


def history_page(spark, d):
    o = _read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("order "), F.col("o_orderpriority")).alias("url"), F.col("o_custkey").cast("string").alias("theme_id"), F.lit(None).cast("string").alias("site_name"), F.col("o_totalprice").alias("price"))
    c = _read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return history(o, c, 3, 50, "urgent", "price").select("id", "theme_name", "price")


def css_export(spark, d):
    p = _read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.lit("spacing").alias("group"), F.col("p_size").alias("size")).distinct()
    t = ranking.top(p, ["brand"], [F.col("size")], 12).withColumn("value", F.concat(F.col("size").cast("string"), F.lit("px")))
    return exports.css_variables(t, ["brand"])


def canonical_capture(spark, d):
    e = _read(spark, d, "events").select(F.col("user_id").alias("url"), F.when(F.col("event_type") == "click", "desktop").when(F.col("event_type") == "view", "tablet").otherwise("mobile").alias("viewport"), F.col("value").alias("width"), F.col("event_id").alias("id"))
    return ranking.canonical_capture(e, "url", "viewport", "width", "id")


def median_sample(spark, d):
    p = _read(spark, d, "part").select("p_type", "p_brand", "p_partkey", "p_retailprice")
    return ranking.median_sample(p, ["p_type", "p_brand"], ["p_retailprice", "p_partkey"])


def capture_coverage(spark, d):
    e = _read(spark, d, "events").select((F.col("user_id") % 10).alias("site"), F.col("user_id").alias("url"), F.col("event_type").alias("viewport"))
    wanted = e.select("site", "url").distinct().join(e.select("site", "viewport").distinct(), "site")
    return evidence.coverage(e, wanted, ["site"]).withColumn("share", F.round("share", 6))


def fail_closed(spark, d):
    gate = comparability_gate(spark, d).select("c_custkey", "comparability")
    o = _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("changes")).withColumn("status", F.lit("changed"))
    return gates.fail_closed(o, gate, ["c_custkey"]).select("c_custkey", "category", "status", F.col("changes").cast("long").alias("changes"))


_ALL = (
    route_identity, page_kind_counts, page_link_candidates, page_link_score, representative_pages, diverse_pages, tracking_params_stripped,
    redact_urls, page_identity, stable_ids, usage_frequency, usage_fallback, accent_votes, vote_normalised_usage, top_scale_values, weighted_median,
    breakpoint_islands, distribution_distance, color_normalise, color_contrast, hue_families, neutral_coverage, leader_cluster, subpixel_lengths,
    token_confidence, token_provenance, near_join, named_diff, scale_diff, palette_match, entity_match, adjacent_responsive_diff, comparability_gate,
    fail_closed, cross_page_patterns, section_sequences, role_runs, term_similarity, integrity_errors, component_variants, benchmark_confusion,
    array_diff, history_page, css_export, canonical_capture, median_sample, capture_coverage,
)
QUERIES = {f.__name__: f for f in _ALL}

_LINKS_SQL = r"""
bare AS (SELECT page_id, url, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g') AS h FROM pages),
blocks AS (
""" + " UNION ALL ".join(rf"SELECT page_id, url, unnest(regexp_extract_all(h, '(?is)<{t}\b[^>]*>(.*?)</{t}>', 1)) AS block, {s} AS location FROM bare" for t, s in html.PLACE_SCORES.items()) + r"""
 UNION ALL SELECT page_id, url, regexp_replace(h, '(?is)""" + "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in html.PLACE_SCORES) + r"""', '', 'g'), 0 FROM bare),
links AS (SELECT page_id, url, location, unnest(regexp_extract_all(block, '(?is)<a\b[^>]*\bhref=["'']([^"'']*)["'']', 1)) AS href FROM blocks)"""
_SCORED_SQL = f"""
{_LINKS_SQL},
found AS (
  SELECT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site, location,
    coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/$', ''), ''), '/') AS base,
    coalesce(nullif(regexp_replace(regexp_replace(href, '/{{2,}}', '/', 'g'), '/$', ''), ''), '/') AS path
  FROM links WHERE starts_with(href, '/') AND NOT starts_with(href, '//') AND NOT regexp_matches(href, '[\\s"''`<>?#]')),
kinds AS (SELECT *, origin || path AS full_url, {_KINDS_SQL} AS kind, list_filter(str_split(path, '/'), lambda x: x <> '') AS segs, base <> '/' AND starts_with(path, base || '/') AS contextual FROM found WHERE path <> base AND NOT {_EXCLUDED_SQL}),
scored AS (
  SELECT site, full_url AS url, kind, contextual,
    CAST(100 + {_BOOST_SQL} + location
    - greatest(len(segs) - CASE WHEN contextual THEN len(list_filter(str_split(base, '/'), lambda x: x <> '')) ELSE 0 END - 1, 0) * 12
    - CASE WHEN len(list_filter(segs, lambda x: regexp_matches(x, '^[0-9]+$') OR length(x) > 64)) > 0 THEN CASE kind WHEN 'content' THEN 2 ELSE 20 END ELSE 0 END AS BIGINT) AS score
  FROM kinds)"""
_COMBINED = "SELECT site, value, sum(weight * CASE category WHEN 'click' THEN 20.0 WHEN 'view' THEN 6.0 ELSE -50.0 END) AS n FROM v WHERE category IN ('click', 'view', 'error') GROUP BY ALL"
_YEAR_SQL = "SELECT o_orderpriority, month(o_orderdate) AS month, CAST(floor(count(*) / 10.0) AS BIGINT) AS n FROM orders WHERE year(o_orderdate) = {0} GROUP BY ALL"
_GATE_SQL = """
c AS (SELECT c_custkey, c_nationkey AS nation, c_mktsegment AS segment, floor(c_acctbal / 1000) AS band FROM customer),
g AS (SELECT coalesce(a.c_custkey, b.c_custkey + 1) AS c_custkey,
  concat_ws(',', CASE WHEN a.segment IS DISTINCT FROM b.segment THEN 'segment' END, CASE WHEN a.nation IS DISTINCT FROM b.nation THEN 'nation' END) AS reasons,
  CASE WHEN a.band IS DISTINCT FROM b.band THEN 'band' ELSE '' END AS limitations
  FROM c a FULL OUTER JOIN c b ON a.c_custkey = b.c_custkey + 1),
gate AS (SELECT *, CASE WHEN reasons <> '' THEN 'inconclusive' ELSE 'limited' END AS comparability FROM g)"""
_CANON = "CASE WHEN width % 16 = 0 THEN 3 WHEN width % 8 = 0 THEN 2 WHEN width % 4 = 0 THEN 1 ELSE 0 END"

ORACLES = {
    "route_identity": f"SELECT page_id, origin || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END AS route, origin || CASE WHEN path = '' THEN '/' ELSE path END AS page FROM ({_PARTS_SQL})",
    "page_kind_counts": f"SELECT {_KINDS_SQL} AS kind, count(*) AS n FROM ({_PARTS_SQL}) GROUP BY ALL",
    "page_link_candidates": f"WITH {_LINKS_SQL} SELECT page_id, href, location, count(*) AS n FROM links GROUP BY ALL",
    "page_link_score": f"WITH {_SCORED_SQL} SELECT site, url, kind, max(score) AS score, count(*) AS n FROM scored GROUP BY ALL",
    "representative_pages": f"""WITH {_SCORED_SQL}, best AS (SELECT site, url, any_value(kind) AS kind, max(score) AS score, max(contextual) AS contextual FROM scored GROUP BY site, url HAVING max(score) >= 90),
pool AS (SELECT * FROM (SELECT *, max(contextual) OVER (PARTITION BY site) AS a FROM best) WHERE NOT a OR contextual)
SELECT site, url, kind, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, url) AS ord FROM pool) WHERE ord <= 8""",
    "tracking_params_stripped": f"""WITH p AS (SELECT *, list_sort(list_filter(str_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(regexp_extract(x, '^([^=]*)', 1), '(?i)^(fbclid|gclid|mc_cid|mc_eid|ref|source|utm_.+)$'))) AS kept FROM ({_PARTS_SQL}))
SELECT page_id, origin || CASE WHEN regexp_replace(path, '/$', '') = '' THEN '/' ELSE regexp_replace(path, '/$', '') END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM p""",
    "redact_urls": "SELECT page_id, 'Seen at ' || regexp_replace(url, '[?#].*$', '') || ' and there.' AS text FROM pages",
    "page_identity": r"""WITH t AS (SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS raw FROM pages),
c AS (SELECT page_id, nullif(trim(left(trim(regexp_replace(regexp_replace(raw, '[\p{Cc}\p{Cf}]', ' ', 'g'), '\s+', ' ', 'g')), 120)), '') AS title FROM t)
SELECT page_id, title, coalesce(NOT regexp_matches(title, '(?i)^(home|homepage|log\s*in|sign\s*in|403(\s+forbidden)?|access denied|error(\s+\d{3})?)$|\bjust a moment\b|\bcloudflare\b|\bcaptcha\b'), false) AS meaningful FROM c""",
    "stable_ids": f"SELECT page_id, 'page-' || left(sha256(CASE WHEN n = 1 THEN host ELSE host || chr(31) || i END), 12) AS id FROM (SELECT page_id, host, count(*) OVER (PARTITION BY host) AS n, row_number() OVER (PARTITION BY host ORDER BY page_id) AS i FROM ({_PARTS_SQL}))",
    "usage_frequency": f"SELECT site, category, value, round(sum(weight), 6) AS n FROM ({_VALID_SQL}) GROUP BY ALL",
    "usage_fallback": f"""WITH s AS (SELECT site, value, sum(weight) AS n FROM ({_VALID_SQL}) WHERE category = 'error' GROUP BY ALL),
f AS (SELECT user_id % 10 AS site, 'v' || (event_id % 7) AS value, CAST(count(*) AS DOUBLE) AS c FROM events GROUP BY ALL),
g AS (SELECT f.site, value, CASE WHEN f.site IN (SELECT site FROM s) THEN 1.0 ELSE c END AS c FROM f)
SELECT coalesce(s.site, g.site) AS site, coalesce(s.value, g.value) AS value, round(coalesce(n, c), 6) AS n FROM s FULL OUTER JOIN g ON s.site = g.site AND s.value = g.value""",
    "accent_votes": f"WITH v AS ({_VALID_SQL}) SELECT site, value, round(n, 6) AS n FROM ({_COMBINED}) WHERE n > 0",
    "vote_normalised_usage": f"""WITH r AS (SELECT site, url, capture, category, value, sum(weight) AS w FROM ({_VALID_SQL}) GROUP BY ALL),
s AS (SELECT *, w / sum(w) OVER (PARTITION BY site, url, capture, category) AS share FROM r),
c AS (SELECT site, url, category, count(DISTINCT capture) AS n FROM r GROUP BY ALL)
SELECT s.site, s.category, s.value, round(sum(share / n), 6) AS weight FROM s JOIN c USING (site, url, category) GROUP BY ALL""",
    "top_scale_values": f"""WITH n AS (SELECT site, category, value, count(*) AS n FROM ({_VALID_SQL}) GROUP BY ALL),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, category ORDER BY n DESC, value) AS k FROM n) WHERE k <= 5)
SELECT site, category, value, n, row_number() OVER (PARTITION BY site, category ORDER BY CAST(value AS DOUBLE), value) AS ord FROM r""",
    "weighted_median": """WITH n AS (SELECT l_returnflag, l_linestatus, l_quantity AS v, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY v) AS run, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS total FROM n)
SELECT l_returnflag, l_linestatus, min(v) AS median FROM r WHERE 2 * run >= total GROUP BY ALL""",
    "breakpoint_islands": f"""WITH b AS (SELECT p_brand AS brand, p_partkey * 7 % 1600 AS width, CAST(sum(p_size) AS BIGINT) AS n FROM part GROUP BY ALL),
g AS (SELECT *, CASE WHEN width - lag(width) OVER w <= 2 THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY brand ORDER BY width)),
i AS (SELECT *, sum(new) OVER (PARTITION BY brand ORDER BY width) AS island FROM g),
t AS (SELECT *, sum(n) OVER (PARTITION BY brand, island) AS total, row_number() OVER (PARTITION BY brand, island ORDER BY n DESC, {_CANON} DESC, width) AS k FROM i),
r AS (SELECT brand, width, CAST(total AS BIGINT) AS n, CASE WHEN width <= 480 THEN 'mobile' WHEN width <= 768 THEN 'tablet-sm' WHEN width <= 1024 THEN 'tablet' WHEN width <= 1280 THEN 'desktop' ELSE 'wide' END AS category FROM t WHERE k = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY brand, category ORDER BY n DESC, {_CANON} DESC, width) AS k FROM r),
q AS (SELECT *, max(CASE WHEN k = 1 THEN width END) OVER (PARTITION BY brand, category) AS first FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY brand, category ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, CASE WHEN (category, width) IN (('mobile', 480), ('tablet-sm', 768), ('tablet', 1024), ('desktop', 1280)) THEN 0 ELSE 1 END, {_CANON} DESC, n DESC, abs(width - first) DESC, width) AS place FROM q)
SELECT brand, width, n, category FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY width) AS o FROM s WHERE place <= 2) WHERE o <= 10""",
    "distribution_distance": """WITH e AS (SELECT user_id, event_type, ts < TIMESTAMP '2024-01-16' AS early, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id, early) AS share FROM e),
a AS (SELECT * FROM s WHERE early), b AS (SELECT * FROM s WHERE NOT early)
SELECT coalesce(a.user_id, b.user_id) AS user_id, round(sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) / 2, 6) AS distance FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type GROUP BY ALL""",
    "color_normalise": f"SELECT p_partkey, printf('#%02x%02x%02x', r, g, b) AS color FROM ({_COLORS_SQL})",
    "color_contrast": f"SELECT p_partkey, round(l, 6) AS luminance, round(1.05 / (l + 0.05), 6) AS contrast, round(sqrt((255.0 - r) * (255 - r) + (255.0 - g) * (255 - g) + (255.0 - b) * (255 - b)), 6) AS distance FROM (SELECT *, {_LUM} AS l FROM ({_COLORS_SQL}))",
    "hue_families": f"""WITH c AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS d FROM ({_COLORS_SQL})),
h AS (SELECT *, 60.0 * CASE WHEN top = r THEN (g - b) / CAST(d AS DOUBLE) WHEN top = g THEN (b - r) / CAST(d AS DOUBLE) + 2 ELSE (r - g) / CAST(d AS DOUBLE) + 4 END AS hue FROM c WHERE d >= 24)
SELECT brand, CAST(floor(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 30) AS INT) AS family, sum(n) AS n, count(DISTINCT (p_partkey % 2, r, g, b)) AS colors FROM h GROUP BY ALL""",
    "neutral_coverage": f"SELECT brand, round(sum(CASE WHEN greatest(r, g, b) - least(r, g, b) <= 24 OR (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) <= 0.12 THEN n ELSE 0 END) / sum(n), 6) AS coverage FROM ({_COLORS_SQL}) GROUP BY ALL",
    "subpixel_lengths": "SELECT o_orderkey, round(CASE WHEN abs(px - floor(px * 2 + 0.5) / 2) <= 0.1 THEN floor(px * 2 + 0.5) / 2 ELSE floor(px * 1000 + 0.5) / 1000 END, 6) AS px FROM (SELECT o_orderkey, o_totalprice / 100 AS px FROM orders)",
    "token_confidence": f"""WITH u AS (SELECT category, value, count(DISTINCT url) AS p, count(DISTINCT capture) AS c, count(*) AS o FROM ({_VALID_SQL}) GROUP BY ALL),
s AS (SELECT category, value, CAST(CASE WHEN p >= 3 THEN 4 WHEN p >= 2 THEN 3 ELSE 1 END + CASE WHEN o >= 10 THEN 2 WHEN o >= 2 THEN 1 ELSE 0 END + CASE category WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END + CASE WHEN c >= 2 THEN 1 ELSE 0 END AS INT) AS score FROM u)
SELECT *, CASE WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM s""",
    "token_provenance": f"""WITH u AS (SELECT *, CAST(value AS DOUBLE) AS x FROM ({_VALID_SQL}) WHERE category = 'click'), t AS (SELECT 't' || p_partkey AS token, p_size + 0.05 AS y FROM part),
j AS (SELECT token, sum(weight) AS o, count(DISTINCT url) AS p, count(DISTINCT capture) AS c, list_sort(list_distinct(list(url)))[1:8] AS pl, list_sort(list_distinct(list('usage:' || site)))[1:12] AS sl FROM u JOIN t ON abs(x - y) <= 0.1 + 1e-9 GROUP BY token)
SELECT token, round(coalesce(o, 0), 6) AS observations, coalesce(p, 0) AS pages, coalesce(c, 0) AS captures, array_to_string(pl, ',') AS page_list, array_to_string(sl, ',') AS source_list FROM t LEFT JOIN j USING (token)""",
    "near_join": "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 50.0 + 1e-9",
    "named_diff": f"""WITH a AS ({_YEAR_SQL.format(1995)}), b AS ({_YEAR_SQL.format(1996)})
SELECT * FROM (SELECT o_orderpriority, month, a.n AS before, b.n AS after, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n <> b.n THEN 'changed' END AS change FROM a FULL OUTER JOIN b USING (o_orderpriority, month)) WHERE change IS NOT NULL""",
    "scale_diff": f"""WITH a AS (SELECT o_orderpriority, n, min(month) AS place FROM ({_YEAR_SQL.format(1995)}) GROUP BY ALL), b AS (SELECT o_orderpriority, n, min(month) AS place FROM ({_YEAR_SQL.format(1996)}) GROUP BY ALL)
SELECT *, 'removed' AS change FROM a ANTI JOIN b USING (o_orderpriority, n) UNION ALL SELECT *, 'added' FROM b ANTI JOIN a USING (o_orderpriority, n)""",
    "palette_match": """WITH s AS (SELECT p_partkey % 2 AS odd, p_brand, 'palette-' || (p_size % 10) AS name, CAST(max(p_size) AS VARCHAR) AS value FROM part GROUP BY ALL),
l AS (SELECT * FROM (SELECT * FROM s WHERE odd = 0) a ANTI JOIN (SELECT * FROM s WHERE odd = 1) b USING (p_brand, value)), r AS (SELECT * FROM (SELECT * FROM s WHERE odd = 1) a ANTI JOIN (SELECT * FROM s WHERE odd = 0) b USING (p_brand, value))
SELECT coalesce(l.p_brand, r.p_brand) AS p_brand, coalesce(l.name, r.name) AS name, l.value AS before, r.value AS after, CASE WHEN l.name IS NULL THEN 'added' WHEN r.name IS NULL THEN 'removed' ELSE 'changed' END AS change FROM l FULL OUTER JOIN r ON l.p_brand = r.p_brand AND l.name = r.name""",
    "entity_match": """WITH c AS (SELECT c_custkey AS id, c_nationkey AS page, floor(c_acctbal / 20) AS sig, floor(c_acctbal / 500) AS role FROM customer), s AS (SELECT s_suppkey AS id, s_nationkey AS page, floor(s_acctbal / 20) AS sig, floor(s_acctbal / 500) AS role FROM supplier),
k AS (SELECT page, a.id AS a_id, b.id AS b_id FROM (SELECT page, sig, count(*) AS n, min(id) AS id FROM c GROUP BY ALL) a JOIN (SELECT page, sig, count(*) AS n, min(id) AS id FROM s GROUP BY ALL) b USING (page, sig) WHERE a.n = 1 AND b.n = 1),
rc AS (SELECT * FROM c WHERE (page, id) NOT IN (SELECT (page, a_id) FROM k)), rs AS (SELECT * FROM s WHERE (page, id) NOT IN (SELECT (page, b_id) FROM k)),
m AS (SELECT page, role, a.n AS an, a.id AS a_id, b.n AS bn, b.id AS b_id FROM (SELECT page, role, count(*) AS n, min(id) AS id FROM rc GROUP BY ALL) a FULL OUTER JOIN (SELECT page, role, count(*) AS n, min(id) AS id FROM rs GROUP BY ALL) b USING (page, role)),
o AS (SELECT page, role, CASE WHEN an > 0 AND bn > 0 THEN 'ambiguous' ELSE 'unmatched' END AS status FROM m WHERE NOT (coalesce(an, 0) = 1 AND coalesce(bn, 0) = 1))
SELECT page, a_id, b_id, 'high' AS confidence, 'matched' AS status FROM k
UNION ALL SELECT page, a_id, b_id, 'medium', 'matched' FROM m WHERE an = 1 AND bn = 1
UNION ALL SELECT page, rc.id, NULL, NULL, status FROM rc JOIN o USING (page, role)
UNION ALL SELECT page, NULL, rs.id, NULL, status FROM rs JOIN o USING (page, role)""",
    "adjacent_responsive_diff": """WITH e AS (SELECT user_id, event_id, event_type AS t, json_extract_string(props, '$.k') AS k, lead(event_type) OVER w AS nt, lead(json_extract_string(props, '$.k')) OVER w AS nk, lead(1) OVER w AS more FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, concat_ws(',', CASE WHEN k IS DISTINCT FROM nk THEN 'k' END, CASE WHEN t IS DISTINCT FROM nt THEN 'type' END) AS changed FROM e WHERE more = 1""",
    "comparability_gate": f"WITH {_GATE_SQL} SELECT * FROM gate",
    "fail_closed": f"""WITH {_GATE_SQL}, o AS (SELECT o_custkey AS c_custkey, o_orderpriority AS category, count(*) AS n FROM orders GROUP BY ALL)
SELECT o.c_custkey, category, CASE WHEN coalesce(comparability, 'inconclusive') = 'inconclusive' THEN 'inconclusive' ELSE 'changed' END AS status, CASE WHEN coalesce(comparability, 'inconclusive') = 'inconclusive' THEN 0 ELSE n END AS changes FROM o LEFT JOIN gate USING (c_custkey)""",
    "cross_page_patterns": f"SELECT regexp_replace(host, '^(www|m|blog)[.]', '') AS site, split_part(path, '/', 2) AS role, count(DISTINCT origin || regexp_replace(path, '/+$', '')) AS pages FROM ({_PARTS_SQL}) GROUP BY ALL HAVING pages >= 2",
    "section_sequences": "WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, string_agg(event_type, ' > ' ORDER BY event_id) AS sequence FROM e WHERE event_type IS DISTINCT FROM p GROUP BY ALL",
    "role_runs": """WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS c FROM events),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS times FROM r GROUP BY user_id, run""",
    "term_similarity": r"""WITH t AS (SELECT source, doc_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\s-]', ' ', 'g'), '\s+'), lambda x: length(x) >= 3)) AS terms FROM documents),
p AS (SELECT source, doc_id, terms, lead(terms) OVER w AS nt, lead(1) OVER w AS more FROM t WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source, doc_id, round(CASE WHEN len(terms) + len(nt) = 0 THEN 1.0 ELSE len(list_intersect(terms, nt)) / CAST(len(terms) + len(nt) - len(list_intersect(terms, nt)) AS DOUBLE) END, 6) AS similarity FROM p WHERE more = 1""",
    "integrity_errors": """SELECT 'unknown-order' AS code, count(*) AS n FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'unknown-part', count(*) FROM lineitem ANTI JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'unknown-supplier', count(*) FROM lineitem ANTI JOIN supplier ON l_suppkey = s_suppkey UNION ALL SELECT 'unlabelled-document', count(*) FROM documents ANTI JOIN labels USING (doc_id)""",
    "component_variants": """WITH p AS (SELECT p_type, p_brand, CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE p_size % 4 END AS size FROM part), v AS (SELECT p_type, p_brand, count(DISTINCT size) AS k FROM p GROUP BY ALL)
SELECT p_type, p_brand, CASE WHEN k > 1 THEN size END AS size, count(*) AS count FROM p JOIN v USING (p_type, p_brand) GROUP BY 1, 2, 3""",
    "benchmark_confusion": "SELECT quality AS expected, toxic AS actual, count(*) AS n FROM labels GROUP BY ALL",
    "array_diff": """WITH p AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
g AS (SELECT vec_id, list_transform(list_zip(a, b), lambda x: CAST(abs(x[1] - x[2]) AS DOUBLE)) AS gaps FROM p WHERE b IS NOT NULL)
SELECT vec_id, round(len(list_filter(gaps, lambda x: x > 0.1)) / CAST(len(gaps) AS DOUBLE), 6) AS changed, round(list_sum(gaps) / len(gaps), 6) AS mean FROM g""",
    "history_page": """SELECT CAST(o_orderkey AS VARCHAR) AS id, c_name AS theme_name, o_totalprice AS price FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE lower('order ' || o_orderpriority) LIKE '%urgent%' OR lower(c_name) LIKE '%urgent%' ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 50 OFFSET 100""",
    "css_export": """WITH p AS (SELECT DISTINCT p_brand AS brand, p_size FROM part), t AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY p_size) AS ord FROM p)
SELECT brand, ':root {' || chr(10) || string_agg('  --spacing-' || ord || ': ' || p_size || 'px;', chr(10) ORDER BY ord) || chr(10) || '}' || chr(10) AS text FROM t WHERE ord <= 12 GROUP BY brand""",
    "canonical_capture": """SELECT url, viewport, width, id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE viewport WHEN 'desktop' THEN 0 WHEN 'tablet' THEN 1 ELSE 2 END, width DESC, id) AS k
FROM (SELECT user_id AS url, CASE event_type WHEN 'click' THEN 'desktop' WHEN 'view' THEN 'tablet' ELSE 'mobile' END AS viewport, value AS width, event_id AS id FROM events)) WHERE k = 1""",
    "median_sample": "SELECT p_type, p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER (PARTITION BY p_type, p_brand) AS n FROM part) WHERE r = n // 2 + 1",
    "capture_coverage": """WITH e AS (SELECT DISTINCT user_id % 10 AS site, user_id AS url, event_type AS viewport FROM events), w AS (SELECT DISTINCT a.site, a.url, b.viewport FROM e a JOIN e b USING (site))
SELECT w.site, count(DISTINCT w.url) AS pages, count(*) AS expected, count(e.url) AS captured, round(count(e.url) / CAST(count(*) AS DOUBLE), 6) AS share FROM w LEFT JOIN e USING (site, url, viewport) GROUP BY w.site""",
}

QUERIES |= design_queries.QUERIES | capture_queries.QUERIES
ORACLES |= design_queries.ORACLES | capture_queries.ORACLES
