import json

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.operators import claims, tags


def test_catalog_and_integrity(spark):
    ev = spark.createDataFrame([("a", "e1", "u1", True, False, False, ["color.1"]), ("a", "e2", "u2", False, True, False, []), ("a", "e3", "u1", True, True, True, [])], "site string, id string, url string, safe boolean, passive boolean, severe boolean, token_refs array<string>")
    raw = spark.createDataFrame([("a", "k1", 2, 1, "second", "high", ["e1"]), ("a", "k1", 1, 1, "first", "high", ["e2", "e1", "e1", "zz"]), ("a", "k2", 3, 0, "s", "low", [])], "site string, key string, ord int, priority int, statement string, confidence string, evidence_ids array<string>")
    got = {r.key: r for r in claims.catalog(raw, ev, ["site"]).collect()}
    assert got["k1"].statement == "first" and got["k1"].evidence_ids == ["e1", "e2"] and got["k2"].place == 1
    c = spark.createDataFrame([("a", "c1", "high", ["e1"], ["color.1"], "layout"), ("a", "c2", "high", ["e3"], ["color.1"], "layout"), ("a", "c3", "low", ["e2", "no"], [], "avoid"), ("a", "c4", "low", [], [], "x"), ("a", "c4", "low", ["e1"], [], "x")], "site string, claim_id string, confidence string, evidence_ids array<string>, token_refs array<string>, placement string")
    codes = {(r.code, r.claim_id) for r in claims.integrity(c, ev, ["site"]).collect()}
    assert codes == {("severe-page", "c2"), ("passive-high", "c2"), ("unowned-token", "c2"), ("missing-evidence", "c3"), ("unsafe-evidence", "c3"), ("duplicate-id", "c4"), ("no-evidence", "c4")}
    assert {(r.claim_id, r.scope) for r in claims.scope(c.where("claim_id in ('c1', 'c3')"), ev, ["site"]).collect()} == {("c1", "page"), ("c3", "page")}


def test_profile_and_merge(spark):
    c = spark.createDataFrame([("a", f"c{i}", slot, conf, scope, ["e"] * n, f"text {slot} alpha{i}") for i, (slot, conf, scope, n) in enumerate([("thesis", "low", "page", 1), ("thesis", "high", "page", 1), ("signature", "high", "page", 1), ("signature", "high", "cross-page", 1), ("signature", "high", "page", 2), (None, "high", "page", 1)])], "site string, claim_id string, slot string, confidence string, scope string, evidence_ids array<string>, statement string")
    got = [(r.slot, r.place, r.claim_id) for r in claims.profile(c, ["site"]).orderBy("slot", "place").collect()]
    assert got == [("signature", 1, "c3"), ("signature", 2, "c4"), ("thesis", 1, "c1")]
    assert {(r.slot, r.confidence) for r in claims.merged(c.where("slot is not null"), ["slot"]).collect()} == {("thesis", "low"), ("signature", "high")}
    same = claims.profile_similarity(c, c, ["site"]).where("slot = 'thesis'").first()
    assert same.similarity == 1 and same.only_a == []


def test_evaluation(spark):
    e = spark.createDataFrame([("s1", "colors", "changed"), ("s1", "radii", "unchanged"), ("s2", "colors", "inconclusive"), ("s3", "colors", "changed"), ("s4", "colors", "changed")], "scenario string, category string, status string")
    a = spark.createDataFrame([("s1", "colors", "changed"), ("s1", "radii", "changed"), ("s2", "colors", "changed"), ("s3", "colors", "unchanged")], "scenario string, category string, status string")
    out = claims.evaluate(e, a)
    assert {(r.scenario, r.category, r.outcome) for r in out.collect()} == {("s1", "colors", "correct"), ("s1", "radii", "unexpected"), ("s2", "colors", "fail-closed"), ("s3", "colors", "missed"), ("s4", "colors", "failed")}
    assert {(r.outcome, r.passed) for r in claims.policy(out, {"missed": 0, "failed": 1, "inconclusive": 0}).collect()} == {("missed", False), ("failed", True), ("inconclusive", True)}


def test_tags_and_roles(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(tags.feature_tags({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(True)}, 1)) == ["a"]
    assert one(tags.layered(F.array(F.lit(2.0), F.lit(4.0), F.lit(12.0)))) and not one(tags.layered(F.array(F.lit(2.0), F.lit(12.0))))
    assert one(tags.context_text(F.lit("Btn Delete"), F.lit(""), F.lit(None).cast("string"))) == "btn delete"
    score = lambda *v: one(tags.region_score(*map(F.lit, v)))
    assert score(2, 0.3, 3, 600, 2, 3) == 7 and score(2, 0.08, 2, 599, 1, 2) == 2 and score(9, 0.07, 1, 0, 0, 0) == 0 and score(1, 0.9, 9, 900, 9, 9) == 0


def test_ancestors(spark):
    e = spark.createDataFrame([("p", "body > div"), ("p", "body > div > a"), ("p", "body > nav > a"), ("q", "body")], "page string, locator string")
    assert {(r.page, r.locator) for r in tags.outermost(e, ["page"], "locator").collect()} == {("p", "body > div"), ("p", "body > nav > a"), ("q", "body")}
    s = spark.createDataFrame([("p", "body", "root"), ("p", "body > div", "main")], "page string, locator string, key string")
    assert {(r.page, r.locator, r.section) for r in tags.parent_section(e, s, ["page"], "locator").collect()} == {("p", "body > div", "main"), ("p", "body > div > a", "main"), ("p", "body > nav > a", "root"), ("q", "body", None)}
    h = spark.createDataFrame([("p", "t", "hero", 0.5, "a"), ("p", "t", "hero", 0.2, "b")], "page string, h1 string, role string, area double, key string")
    assert {(r.key, r.role) for r in tags.unique_hero(h, ["page"]).collect()} == {("a", "content"), ("b", "hero")}
    m = spark.createDataFrame([(1, s, i) for s in "xy" for i in range(5)], "g int, part string, o int")
    assert tags.crowded(m, ["g"], "part", [F.col("o"), F.col("part")], 5, 3).count() == 5
    assert tags.percentile_rank_value(m, ["g"], "o", 0.95).first()["p"] == 4


def test_cli(spark, tmp_path):
    capture = {"analysisId": "a", "url": "https://e.com/", "viewport": "desktop", "capturedAt": "2024-01-01T00:00:00Z", "styles": {"usageCount": {"spacing:8px": 4}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text(json.dumps(capture))
    (tmp_path / "none").mkdir()
    (tmp_path / "none/x.json").write_text("{}")
    out = str(tmp_path / "out")
    assert cli.run(spark, ["extract", str(tmp_path / "in"), "--out", out, "--formats", "css"]) == 0
    assert "--spacing-1: 8px" in spark.read.parquet(f"{out}/export-css").first()["text"]
    assert cli.run(spark, ["extract", str(tmp_path / "none"), "--out", out]) == 3
    assert cli.run(spark, ["extract", str(tmp_path / "in"), "--out", out, "--formats", "pdf"]) == 2
    assert cli.run(spark, ["nonsense"]) == 2
    assert cli.run(spark, ["extract", str(tmp_path / "missing"), "--out", out]) == 4
    assert cli.run(spark, ["compare", str(tmp_path / "in"), str(tmp_path / "none"), "--out", out]) == 0
    assert [(r.value, r.change) for r in spark.read.parquet(f"{out}/changes").collect()] == [("8px", "removed")]
