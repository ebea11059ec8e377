"""Claims drafted from evidence: one analysis by hand, and what any analysis must hold."""

import random

from tessera.operators import claim_rules as cr
from tessera.operators import claims

ON = ["site"]
S = "site int, id string, page string, place int, role string, layout_mode string, x double, width double, token_refs array<string>, bordered boolean, shadowed boolean, filled boolean"
C = "site int, id string, page string, section string, place int, type string, role string, shape string, variant string, token_refs array<string>, bordered boolean, shadowed boolean, filled boolean"
N = "site int, id string, page string, section string, place int, role string, typed boolean, token_refs array<string>"
I = "site int, id string, page string, place int, driver string, safety string, properties array<string>, transition boolean"  # noqa: E741
M = "site int, id string, page string, place int, kind string, role string, importance string"
P = "site int, page string, url string, viewport string, viewport_width int, content_width int, severe boolean, eligible boolean"
O = "site int, page string, section string"  # noqa: E741


def tables(spark, **rows):
    return {k: spark.createDataFrame(rows.get(k, []), s) for k, s in dict(pages=P, sections=S, components=C, nodes=N, interactions=I, media=M, overflow=O).items()}


def by_hand(spark):
    section = lambda i, page, place, role, mode="flow", x=0.0, w=1.0, refs=(), b=False, f=False: (1, i, page, place, role, mode, x, w, list(refs), b, False, f)
    return tables(
        spark,
        pages=[(1, "p1", "u1", "mobile", 390, 390, False, True), (1, "p2", "u1", "desktop", 1440, 1440, False, True), (1, "p3", "u2", "desktop", 1440, 1440, None, None), (1, "p4", "u3", "desktop", 1000, 3000, True, True), (1, "p5", "u4", "desktop", 1000, 1000, False, False)],
        sections=[
            section("a0", "p2", 0, "hero", refs=["color.x", "radius.r"], f=True), section("a1", "p2", 1, "content", "grid", 0.2, 0.6, ["color.x", "color.y"]), section("a2", "p2", 2, "content", "grid", 0.2, 0.6), section("a3", "p2", 3, "footer", b=True),
            section("b0", "p3", 0, "hero"), section("b1", "p3", 1, "content", "flow", 0.2, 0.6), section("b2", "p3", 2, "footer"), section("z0", "p1", 0, "nav"), section("y0", "p4", 0, "hero"),
        ],
        components=[
            (1, "c1", "p2", "a0", 0, "button", "primary-action", "pill", "primary", ["color.z"], False, True, False), (1, "c2", "p3", "b0", 1, "button", "primary-action", "pill", None, [], False, False, False),
            (1, "c3", "p2", "a1", 2, "card", None, "sharp", None, [], True, False, False), (1, "c4", "p1", "z0", 3, "card", None, "sharp", None, [], True, False, False),
        ],
        nodes=[(1, "n1", "p2", "a0", 0, "heading", True, ["typography.h"]), (1, "n2", "p2", "a0", 1, "text", False, []), (1, "n3", "p1", "z0", 0, "heading", True, [])],
        interactions=[(1, "i1", "p2", 0, "hover", "passive", ["color", "transform"], True), (1, "i2", "p3", 1, "hover", "passive", ["transform", "color"], False), (1, "i3", "p2", 2, "focus", "safe-active", ["aria-expanded"], False), (1, "i4", "p1", 0, "hover", "passive", ["x"], True)],
        media=[(1, "m1", "p2", 0, "image", "hero", "major"), (1, "m2", "p3", 1, "video", "background", "major"), (1, "m3", "p3", 2, "svg", "icon", "icon")],
        overflow=[(1, "p4", "y0"), (1, "p4", None)],
    )


def test_claims_of_one_analysis(spark):
    drafted, assertions = cr.draft_claims(**by_hand(spark), on=ON)
    got = {r.key: r for r in drafted.collect()}
    said = lambda key: (got[key].confidence, got[key].scope, got[key].evidence_ids)
    assert said("observed-section-sequence") == ("high", "cross-page", ["a0", "a1", "a3", "b0", "b1", "b2"])
    assert got["observed-section-sequence"].placements == ["singleton:thesis", "singleton:composition.rhythm", "attention-sequence", "signature"]
    assert got["observed-section-sequence"].subject == {"roles": "hero -> content -> footer", "captures": "2"}
    assert said("observed-entry-section") == ("high", "cross-page", ["a0", "a1", "b0", "b1"])
    assert got["composition-container"].subject == {"count": "7", "width": "100"}
    assert got["composition-alignment"].subject == {"anchor": "full", "count": "4"} and got["composition-alignment"].confidence == "medium"  # 4 of 7 agree
    assert got["composition-density"].subject == {"minimum": "3", "maximum": "4", "captures": "2"}
    assert got["visual-color"].subject == {"count": "3"} and said("visual-color") == ("medium", "page", ["a0", "a1", "c1"])
    assert got["visual-color"].token_refs == ["color.x", "color.y", "color.z", "radius.r"]
    assert got["visual-typography"].subject == {"count": "1", "roles": "heading"}
    assert got["visual-surfaces"].subject == {"count": "4", "bordered": "2", "shadowed": "1"}
    assert got["section-content-composition"].subject == {"role": "content", "count": "3", "layouts": "flow, grid"}
    assert "section-content-rhythm" not in got and got["section-hero-rhythm"].subject == {"role": "hero", "position": "1"}
    assert got["section-hero-transition"].subject["next"] == "content" and "section-content-transition" not in got  # content, then footer
    assert got["component-button-primary-action"].placements == ["component:button:primary-action", "signature", "singleton:attention.action"]
    assert got["component-card-card"].subject["count"] == "1"
    assert said("interaction-hover|passive|color, transform") == ("medium", "cross-page", ["i1", "i2"])
    assert got["interaction-feedback"].subject == {"count": "2", "properties": "color, transform", "passive": "2"}
    assert got["interaction-amplitude"].subject == {"minimum": "2", "maximum": "2"} and got["visual-motion"].subject == {"count": "1"}
    assert said("overflow-p4") == ("high", "page", ["p4", "y0"]) and said("visual-imagery") == ("high", "cross-page", ["m1", "m2"])
    order = [r.key for r in drafted.orderBy("place").collect()]
    assert order[:2] == ["observed-section-sequence", "observed-entry-section"] and order.index("component-button-primary-action") < order.index("overflow-p4") < order.index("section-hero-composition") < order.index("visual-motion")
    told = {(r.key, r.kind, r.predicate, r.property, tuple(r.value or ()), tuple(r.evidence), r.scope) for r in assertions.collect()}
    assert ("observed-section-sequence", "section", "ordered-before", None, ("content",), ("a0", "a1"), "page") in told
    assert ("composition-density", "evidence", "supports", "detected-section-count-range", ("3", "4"), ("a0", "a1", "a2", "a3", "b0", "b1", "b2"), "cross-page") in told
    assert ("overflow-p4", "responsive", "horizontal-overflow", None, ("1000", "3000"), ("p4", "y0"), "page") in told
    assert ("visual-imagery", "evidence", "supports", "media-kind-role", ("video", "background"), ("m2",), "page") in told
    assert ("interaction-focus|safe-active|aria-expanded", "interaction", "executed", None, (), ("i3",), "page") in told


def test_any_analysis_keeps_its_promises(spark):
    rng, rows = random.Random(3), {k: [] for k in ("pages", "sections", "components", "nodes", "interactions", "media", "overflow")}
    for site in range(4):
        for p in range(rng.choice([1, 2, 5])):
            page = f"p{p}"
            rows["pages"].append((site, page, f"u{rng.randrange(3)}", rng.choice(["desktop", "mobile", "x"]), rng.choice([None, 390, 1440]), 1440, rng.random() < 0.2, rng.choice([None, True, True, False])))
            for k in range(rng.randint(0, 12)):
                ident = f"{page}s{k}"
                rows["sections"].append((site, ident, page, k, rng.choice(["hero", "content", "list", "unknown"]), rng.choice(["flow", "grid"]), rng.choice([0.0, 0.2, 0.4]), rng.choice([0.5, 0.6, 1.0]), rng.sample(["color.a", "color.b", "spacing.c"], 2), *(rng.random() < 0.3 for _ in range(3))))
                rows["components"].append((site, f"{ident}c", page, ident, k, rng.choice(["button", "card"]), rng.choice([None, "", "cta"]), "pill", rng.choice([None, "primary"]), ["color.a"], False, False, True))
                rows["interactions"].append((site, f"{ident}i", page, k, rng.choice(["scroll", "hover"]), rng.choice(["passive", "safe-active"]), rng.sample(["color", "aria-x", "width"], rng.randint(0, 2)), rng.random() < 0.3))
    drafted, assertions = cr.draft_claims(**tables(spark, **rows), on=ON)
    all_claims = drafted.collect()
    cited = {(r.site, r.key): set(r.evidence_ids) for r in all_claims}
    assert len(cited) == len(all_claims) > 30 and len({(r.site, r.claim_id) for r in all_claims}) == len(all_claims)
    for r in assertions.collect():
        assert set(r.evidence) <= cited[r.site, r.key] and (r.evidence or r.scope == "instance")
    urls = {(x[0], x[1]): x[2] for x in rows["pages"]}
    for r in all_claims:
        spread = {urls[r.site, i.split("s")[0]] for i in r.evidence_ids}
        assert r.scope == ("cross-page" if len(spread) > 1 else "page") and (r.confidence == "medium" or len(spread) > 1 or r.key.startswith("overflow"))
    t = tables(spark, **rows)
    owned = cr.evidence_index(t["pages"], t["sections"], t["components"], t["nodes"], t["interactions"], t["media"], ON)
    evidence = owned.selectExpr("site", "id", "true AS safe", "false AS passive", "false AS severe", "token_refs")
    placed = drafted.selectExpr("site", "claim_id", "confidence", "evidence_ids", "token_refs", "'x' AS placement")
    assert claims.integrity(placed, evidence, ON).count() == 0
    empty, none = cr.draft_claims(**tables(spark), on=ON)
    assert empty.count() == none.count() == 0


def test_uncertainties(spark):
    t = by_hand(spark)
    a = spark.createDataFrame([(1, "complete", "partial", "complete", True, False), (2, "partial", "complete", "partial", False, True)], "site int, page_coverage string, capture_coverage string, asset_coverage string, absent boolean, mismatch boolean")
    got = {}
    for r in cr.uncertainties(a, t["pages"], t["sections"], t["interactions"], ON).orderBy("site", "place").collect():
        got.setdefault(r.site, []).append(r.topic)
    assert got == {1: ["capture-coverage", "capture-health", "responsive-presence", "overflow"], 2: ["page-coverage", "asset-coverage", "cross-page", "interaction", "responsive-identity", "sections"]}


def test_snapshots_to_claims(spark, tmp_path):
    import json

    from tessera import cli

    def capture(url, viewport):
        section = lambda k, role, i, paint: {"key": k, "role": role, "layoutMode": "flow", "order": i, "rect": {"x": 0.0, "y": 0.1 * i, "width": 1.0, "height": 0.1}, "styles": {"backgroundColor": paint, "paddingTop": "8px"}}
        return {
            "analysisId": "a", "url": url, "viewport": viewport, "viewportWidth": 1440.0, "styles": {"usageCount": {"spacing:8px": 4, "bgColor:rgb(255, 255, 255)": 5, "textColor:rgb(17, 17, 17)": 5}}, "health": {"status": "healthy", "issues": []},
            "sections": [section("h", "hero", 0, "rgb(255, 255, 255)"), section("c", "content", 1, None)], "components": [{"key": "b", "sectionKey": "h", "type": "button", "role": "cta", "styles": {"borderRadius": "99px"}, "confidence": 0.9}],
        }

    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text("\n".join(json.dumps(capture(f"https://e.com/{u}", v)) for u in "xy" for v in ("desktop", "mobile")))
    out = str(tmp_path / "out")
    assert cli.run(spark, ["extract", str(tmp_path / "in"), "--out", out, "--formats", "css,json"]) == 0
    got = {r.key: r for r in spark.read.parquet(f"{out}/claims").collect()}
    assert got["observed-section-sequence"].confidence == "high" and got["observed-section-sequence"].subject["roles"] == "hero -> content" and len(got["observed-section-sequence"].evidence_ids) == 4  # one capture for each URL
    assert got["visual-color"].token_refs == ["color.background", "spacing.1"] and got["component-button-cta"].subject["shapes"] == "pill"
    assert spark.read.parquet(f"{out}/assertions").where("predicate = 'ordered-before'").count() >= 2
    css = spark.read.parquet(f"{out}/export-css").first().text
    assert "--color-background: #ffffff;" in css and "--spacing-1: 8px;" in css
    assert json.loads(spark.read.parquet(f"{out}/export-json").first().text)["colors"]["foreground"]["$value"] == "#111111"
