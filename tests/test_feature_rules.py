"""Feature tags and palette claims: the cases that decide."""

from pyspark.sql import functions as F

from tessera.operators import feature_rules as fr
from tessera.operators import page_facts as pf

G = ["site"]


def test_representative_radius(spark):
    tokens = spark.createDataFrame([(1, "radii", 0, "4px"), (1, "radii", 1, "0.5rem"), (1, "radii", 2, "999px"), (1, "radii", 3, "50%"), (2, "radii", 0, "12px"), (3, "radii", 0, "100px")], "site int, kind string, ord int, value string")
    usage = spark.createDataFrame([(1, "radius", "4px", 3.0), (1, "radius", "8.05px", 1.0), (1, "radius", "8px", 2.0), (1, "spacing", "4px", 90.0)], "site int, category string, value string, n double")
    got = {r.site: (r.radius, round(r.small_share, 3)) for r in fr.representative_radius(tokens, usage, G).collect()}
    assert got == {1: (4.0, 0.5), 2: (12.0, 0.0)}  # 3 uses of 4px, 3 about 8px; the large one is a pill


FACTS = "site int, action_families long, dominant_share double, decorative long, stable long, neutral double"


def test_palette_claims(spark):
    f = spark.createDataFrame
    facts = f([(1, 1, 0.9, 3, 2, 0.5), (2, 1, 1.0, 0, 0, 0.8), (3, 2, 0.5, 3, 3, 0.1), (4, 0, 1.0, 0, 0, 0.9), (5, 2, 0.5, 1, 1, 0.9)], FACTS)
    rich = f([(1, 5), (3, 3), (5, 2)], "site int, significant long")
    roles = f([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (5, "a")], "site int, ref string")
    sections = f([(1, "s1", True, False), (1, "s2", False, False), (3, "s3", False, True), (3, "s4", True, True), (4, "s5", False, True)], "site int, id string, gradient boolean, compound boolean")
    chromatic = f([(3, f"c{i}", "component") for i in range(12)] + [(3, "s3", "section")], "site int, id string, kind string")
    got = {(r.site, r.label, r.confidence, r.refs) for r in fr.palette_claims(facts, rich, roles, sections, chromatic, G).collect()}
    assert got == {
        (1, "single dominant action family with multicolor decorative accents", "high", 3), (1, "section-level gradient treatments observed", "medium", 1), (2, "neutral palette with a single accent", "medium", 1),
        (3, "rich color system", "high", 9), (3, "section-level gradient and compound-radius treatments observed", "high", 2), (4, "section-level compound-radius treatments observed", "medium", 1),
    }


def test_rich_families(spark):
    colors = spark.createDataFrame([(1, "a", "#ff0000"), (1, "b", "#00ff00"), (1, "c", "#0000ff"), (1, "d", "#808080"), (1, "e", "#ffff00")], "site int, name string, value string")
    weights = spark.createDataFrame([(1, "a", 100, 0), (1, "b", 15, 7), (1, "c", 14, 0), (1, "d", 900, 0), (1, "e", 50, 25)], "site int, token string, ui long, status long")
    assert [(r.site, r.significant) for r in fr.rich_families(colors, weights, G).collect()] == [(1, 2)]


def test_page_facts_without_records(spark):
    none = F.lit(None)
    row = spark.range(1).select(
        pf.auth_wall(none.cast("string"), none.cast("int"), none.cast("int"), none.cast("boolean"), none.cast("boolean")).alias("w"),
        pf.login_only(none.cast("int"), F.lit(1), F.lit(1), F.lit(1), F.lit(1), F.lit(1), F.lit(1)).alias("l"),
        pf.health(pf.health_issues(none.cast("struct<overlay_ratio:double,main_empty:boolean,skeleton_ratio:double,fonts_ready:boolean,mutations:int,viewport_width:int,content_width:int,auth_wall:boolean,captcha:boolean>"), none.cast("int"), none.cast("string"), none.cast("string"))).alias("h"),
    ).first()
    assert (row.w.detected, row.w.confidence, row.w.reasons, row.l) == (False, "low", [], False) and (row.h.status, row.h.eligible) == ("healthy", True)
