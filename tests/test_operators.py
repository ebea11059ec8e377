import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import store
from tessera.operators import clusters, diffs, evidence, gates, images, matching, ranking, usage
from tessera.plans import analysis, compare, exports
from tessera.sources import html, snapshots
from tessera.streaming import ingest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_frequency_with_fallback(spark):
    seen = spark.createDataFrame([("s", "a", 2.0), ("s", "a", 1.0), ("s", "", 5.0), ("s", "n", float("nan")), ("s", "z", -1.0)], "g string, value string, weight double")
    listed = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "b"), ("t", "c"), ("t", "c")], "g string, value string")
    assert rows(usage.frequency_with_fallback(seen, listed, ["g"])) == [("s", "a", 3.0), ("s", "b", 1.0), ("t", "c", 2.0)]


def test_vote_shares_give_each_url_one_vote(spark):
    u = spark.createDataFrame([("x", "p", "p1", "c", "a", 3.0), ("x", "p", "p1", "c", "b", 1.0), ("x", "p", "p2", "c", "a", 10.0), ("x", "q", "q1", "c", "b", 500.0)], "site string, url string, capture string, category string, value string, weight double")
    got = {r.value: r.weight for r in usage.vote_shares(u, ["site"], "capture", "url").collect()}
    assert got == {"a": pytest.approx(0.875), "b": pytest.approx(1.125)}
    shuffled = {r.value: r.weight for r in usage.vote_shares(u.repartition(7).orderBy(F.rand(3)), ["site"], "capture", "url").collect()}
    assert shuffled == pytest.approx(got)


def test_distribution_distance(spark):
    mk = lambda xs: usage.distribution(spark.createDataFrame(xs, "g int, value string, weight double"), ["g"])
    assert rows(usage.distribution_distance(mk([(1, "a", 1.0)]), mk([(1, "b", 1.0)]), ["g"])) == [(1, 1.0)]
    assert rows(usage.distribution_distance(mk([(1, "a", 1.0), (1, "b", 1.0)]), mk([(1, "a", 2.0)]), ["g"])) == [(1, 0.5)]


def test_weighted_median_is_the_first_to_reach_half(spark):
    d = spark.createDataFrame([(1, 2.0, 5), (1, 4.0, 5), (1, 8.0, 1)], "g int, v double, w int")
    assert rows(usage.weighted_median(d, ["g"], "v", "w")) == [(1, 4.0)]


def test_breakpoints(spark):
    b = spark.createDataFrame([(1, 766, 1), (1, 768, 5), (1, 771, 9), (1, 600, 2), (1, 500, 2)], "g int, width int, n int")
    got = [(r.width, r.n, r.category) for r in ranking.representative_breakpoints(b, ["g"]).orderBy("width").collect()]
    assert got == [(600, 2, "tablet-sm"), (768, 6, "tablet-sm"), (771, 9, "tablet")] or got[-1] == (771, 9, "tablet")
    assert all(sum(c == k for _, _, c in got) <= 2 for k in {c for _, _, c in got})


def greedy(pool, most):
    pool, out = sorted(pool, key=lambda r: (-r[1], r[0])), []
    while pool and len(out) < most:
        adjust = (lambda r: r[1] - 12 * sum(o[2] == r[2] for o in out) - 4 * sum(o[3] == r[3] != "" for o in out)) if len(out) < 32 else (lambda r: 0)
        best = max(pool, key=lambda r: (adjust(r), r[1])) if len(out) < 32 else pool[0]
        pool.remove(best)
        out.append(best)
    return [r[0] for r in out]


def test_diverse_pages(spark):
    rng = random.Random(1)
    pages = [(f"https://e.com/{i}", rng.randint(90, 140), rng.choice(["docs", "blog", "generic"]), rng.choice(["", "x", "y", "z"])) for i in range(200)]
    table = spark.createDataFrame([("s", *p, "dom", False) for p in pages], "site string, url string, score long, kind string, family string, source string, contextual boolean")
    for most in (5, 32, 60):
        got = [r.url for r in ranking.diverse_pages(table, "site", most).orderBy("ord").collect()]
        assert got == greedy(list(pages), most)


def test_contextual_pages_come_alone(spark):
    t = spark.createDataFrame([("s", "u1", 100, False, "dom"), ("s", "u2", 95, True, "dom"), ("s", "u3", 80, True, "dom")], "site string, url string, score long, contextual boolean, source string")
    assert [r.url for r in ranking.page_pool(t, "site").collect()] == ["u2"]


def test_leader_clusters(spark):
    def brute(palette):
        leaders = []
        for o, v, n in sorted(palette):
            c = np.array([int(v[i : i + 2], 16) for i in (1, 3, 5)], float)
            for lead in leaders:
                if np.sqrt(((lead[0] - c) ** 2).sum()) < 30:
                    lead[1].append((n, -o, v))
                    break
            else:
                leaders.append((c, [(n, -o, v)], o))
        return sorted(((sum(m[0] for m in ms), o, max(ms)[2], len(ms)) for _, ms, o in leaders), key=lambda x: (-x[0], x[1]))[:20]

    rng = random.Random(4)
    palette = [(i, f"#{rng.randrange(256):02x}{rng.randrange(64):02x}{rng.randrange(64):02x}", float(rng.randint(1, 9))) for i in range(120)]
    t = spark.createDataFrame([("g", *p) for p in palette], "g string, ord int, value string, n double").repartition(5)
    got = [(r.n, r.leader_ord, r.value, r.members) for r in clusters.leader_clusters(t, ["g"]).orderBy(F.desc("n"), "leader_ord").collect()]
    assert got == brute(palette)


def test_named_and_palette_diff(spark):
    a = spark.createDataFrame([("s", "palette-1", "#1"), ("s", "palette-2", "#2"), ("s", "palette-3", None)], "g string, name string, value string")
    b = spark.createDataFrame([("s", "palette-2", "#1"), ("s", "palette-1", "#9"), ("s", "palette-3", None)], "g string, name string, value string")
    assert {tuple(r) for r in diffs.named_diff(a, b, ["g", "name"], "value").collect()} == {("s", "palette-1", "#1", "#9", "changed"), ("s", "palette-2", "#2", "#1", "changed")}
    got = {(r.name, r.change) for r in diffs.palette_match(a, b, ["g"]).collect()}
    assert {("palette-1", "added"), ("palette-2", "removed")} <= got


def test_map_changes_treat_missing_as_null(spark):
    r = spark.range(1).select(diffs.map_changes(F.expr("map('a', '1', 'b', '2')"), F.expr("map('a', '1', 'c', '3')")).alias("m")).first()["m"]
    assert set(r) == {"b", "c"}


def test_matching(spark):
    a = spark.createDataFrame([("p", 1, "s1", "hero"), ("p", 2, "s2", "nav"), ("p", 3, "s3", "card"), ("p", 4, "s3", "card"), ("p", 5, None, "foot")], "page string, id int, sig string, role string")
    b = spark.createDataFrame([("p", 11, "s1", "hero"), ("p", 12, "x2", "nav"), ("p", 13, "s3", "card"), ("q", 14, "s9", "hero")], "page string, id int, sig string, role string")
    got = {(r.a_id, r.b_id, r.confidence, r.status) for r in matching.match_entities(a, b, ["page"], ["sig"], ["role"]).collect()}
    assert got == {(1, 11, "high", "matched"), (2, 12, "medium", "matched"), (3, None, None, "ambiguous"), (4, None, None, "ambiguous"), (None, 13, None, "ambiguous"), (5, None, None, "unmatched"), (None, 14, None, "unmatched")}


def test_near_join_equals_the_range_join(spark):
    rng = random.Random(2)
    xs, ys = [(rng.randint(0, 2), rng.uniform(-3, 3)) for _ in range(80)], [(rng.randint(0, 2), rng.uniform(-3, 3)) for _ in range(80)]
    got = {(r.x, r.y) for r in matching.near(spark.createDataFrame(xs, "g int, x double"), spark.createDataFrame(ys, "g int, y double"), ["g"], "x", "y", 0.1).collect()}
    assert got == {(x, y) for g, x in xs for h, y in ys if g == h and abs(x - y) <= 0.1}


def test_gate_blanks_everything(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "x", "l")], "k int, f string, soft string")
    b = spark.createDataFrame([(1, "x", None), (2, "y", "m")], "k int, f string, soft string")
    gate = compare.gate(a, b, ["k"], ["f"], ["soft"])
    assert {(r.k, r.comparability, tuple(r.reasons), tuple(r.limitations)) for r in gate.collect()} == {(1, "limited", (), ()), (2, "inconclusive", ("f",), ("soft",))}
    t = spark.createDataFrame([(1, "spacing", "4px", 1), (2, "spacing", "4px", 1)], "k int, group string, value string, ord int")
    u = spark.createDataFrame([(1, "spacing", "8px", 1), (2, "spacing", "8px", 1)], "k int, group string, value string, ord int")
    s = spark.createDataFrame([(1, "p", "i", "s", "hero", "flow")], "k int, page string, id string, signature string, role string, layoutMode string")
    moved = spark.createDataFrame([(1, "p", "j", "s", "hero", "sticky")], s.schema)
    got = {(r.k, r.category): (r.status, r.changes) for r in compare.compare(t, u, s, moved, gate, ["k"]).collect()}
    assert got[1, "spacing"] == ("changed", 2)
    assert got[1, "layout"] == ("changed", 1)
    assert got[1, "colors"] == ("unchanged", 0)
    assert all(got[2, c] == ("inconclusive", 0) for c in compare.CATEGORIES)


def test_sequences_and_runs(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate(["nav", "nav", "unknown", "hero", "card", "card", "nav"])], "p int, o int, role string")
    assert rows(evidence.sequences(d, ["p"], ["o"], "role")) == [(1, "nav > hero > card > nav")]
    assert [(r.role, r.times) for r in clusters.run_lengths(d, ["p"], ["o"], "role").orderBy("run").collect()] == [("nav", 2), ("unknown", 1), ("hero", 1), ("card", 2), ("nav", 1)]


def test_style_refs(spark):
    styles = spark.createDataFrame([("e1", {"color": "rgb(255, 0, 0)", "border": "1px solid #00ff00"}), ("e2", {"color": "blue"})], "id string, styles map<string,string>")
    tokens = spark.createDataFrame([("color.1", "#ff0000"), ("color.2", "#0f0"), ("space.1", "16px")], "ref string, value string")
    got = {r.id: r.refs for r in evidence.style_refs(styles, tokens).collect()}
    assert got == {"e1": ["color.1", "color.2"], "e2": []}


def test_visual_diff(spark):
    base = np.zeros((60, 48, 4), np.uint8)
    changed = base.copy()
    changed[0:12, 0:12, :3] = 200
    changed[12:24, 12:24, :3] = 200
    faint = base.copy()
    faint[..., 0] = 17
    taller = np.concatenate((base[:30], np.full((6, 48, 4), 255, np.uint8), base[30:]))
    textured = np.random.default_rng(3).integers(0, 255, (60, 48, 4)).astype(np.uint8)
    other = np.random.default_rng(4).integers(0, 255, (70, 48, 4)).astype(np.uint8)
    clear = base.copy()
    clear[..., 3] = 255
    dot = base.copy()
    dot[58:60, 47, :] = 255
    inserted = np.concatenate((textured[:30], np.full((6, 48, 4), 255, np.uint8), textured[30:]))
    cases = {"same": base, "region": changed, "faint": faint, "alpha": clear, "dot": dot, "longer": taller}
    t = spark.createDataFrame([(k, 48, 60, bytearray(base.tobytes()), 48, len(v), bytearray(v.tobytes())) for k, v in cases.items()] + [(k, 48, 60, bytearray(textured.tobytes()), 48, len(v), bytearray(v.tobytes())) for k, v in {"inserted": inserted, "another": other}.items()] + [("wide", 48, 60, bytearray(base.tobytes()), 40, 60, bytearray(b"x"))], "id string, width int, height int, data binary, other_width int, other_height int, other_data binary")
    got = {r.id: r for r in images.visual_diff(t).collect()}
    assert got["same"].changed == got["faint"].changed == 0
    assert len(got["region"].regions) == 1
    assert got["alpha"].changed == 1.0
    assert [tuple(x) for x in got["dot"].regions] == [(0, 58, 48, 2)]  # two pixels do not make a tile
    assert got["inserted"].status == "shifted" and got["inserted"].changed_pixels == 6 * 48 and got["inserted"].changed == pytest.approx(6 / 66)
    assert [tuple(x) for x in got["inserted"].regions] == [(0, 24, 48, 12)]  # the marker
    assert got["another"].status == "compared" and got["another"].changed > 0.9
    assert got["longer"].status == "shifted" and got["longer"].changed_pixels == 6 * 48
    assert got["wide"].status == "width-mismatch"
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    assert tuple(spark.createDataFrame([(bytearray(png),)], "c binary").select(images.png_size(F.col("c")).alias("s")).first()["s"]) == (640, 480)


def test_html(spark):
    page = '<!-- <a href="/no"> --><nav><a href="/pricing">P</a></nav><p><a href="/docs?ref=x#y">D</a></p><footer><a href="https://o.com/x">O</a></footer><title>Acme &amp; Co</title>'
    t = spark.createDataFrame([("https://e.com/", page)], "url string, html string")
    assert {(r.href, r.location) for r in html.links(t, ["url"]).collect()} == {("/pricing", 24), ("/docs?ref=x#y", 0), ("https://o.com/x", -20)}
    assert {(r.url, r.score) for r in html.candidates(t, F.lit("e")).collect()} == {("https://e.com/pricing", 160), ("https://e.com/docs", 126)}
    assert t.select(html.title(F.col("html")).alias("t")).first()["t"] == "Acme & Co"
    assert spark.range(1).select(html.sitemap_urls(F.lit("<url><loc> https://e.com/a?x=1&amp;y=2 </loc></url>")).alias("u")).first()["u"] == ["https://e.com/a?x=1&y=2"]
    assert spark.range(1).select(html.breakpoints(F.lit("@media (min-width: 48em) and (max-width:1023px){} @media (width >= 600px){}")).alias("u")).first()["u"] == [768, 1023, 600]
    rules = spark.range(1).select(html.interaction_rules(F.lit("a:hover{color:red} b:focus{background:url(x)} i{x:y}")).alias("u")).first()["u"]
    assert [(r["state"], r["body"]) for r in rules] == [("hover", "color:red")]


def _capture(i, viewport, health="healthy"):
    return {"analysisId": "a", "url": f"https://e.com/{i}", "viewport": viewport, "viewportWidth": 1440.0, "capturedAt": "2024-01-01T00:00:00Z", "styles": {"usageCount": {"spacing:8px": 4, "spacing:16px": 2, "textColor:rgb(0, 0, 0)": 5, "textColor:#010101": 1, "fontSize:12px": 3}}, "health": {"status": health, "issues": []}, "sections": [{"key": "k", "role": "hero", "layoutMode": "flow", "order": 0}], "components": [{"key": "c", "type": "button", "confidence": 0.9}]}


def test_analysis_of_snapshots(spark, tmp_path):
    lines = [json.dumps(_capture(i, v)) for i in (1, 2) for v in ("desktop", "mobile")] + [json.dumps(_capture(3, "desktop", "unusable")), "{broken"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text("\n".join(lines))
    captures = snapshots.read_snapshots(spark, str(tmp_path / "in")).cache()
    assert captures.where("_corrupt_record is not null").count() == 1
    out = analysis.analyse(captures)
    assert [(r.group, r.value, r.ord) for r in out["tokens"].orderBy("group", "ord").collect()] == [("fontSizes", "12px", 1), ("spacing", "8px", 1), ("spacing", "16px", 2)]
    assert [(r.value, r.members) for r in out["palette"].collect()] == [("#000000", 2)]
    found = {r.token: (r.pages, r.captures, r.confidence) for r in out["token_evidence"].collect()}
    assert found["a/spacing.0"] == (2, 4, "high")  # 3 for pages, 2 for 16 observations, 1 for captures
    cover = out["coverage"].first()
    assert (cover.expected, cover.captured) == (6, 4)
    css = exports.export(out["tokens"].select("analysisId", "group", "ord", "value"), ["analysisId"], "all")
    assert css["css"].first()["text"] == ":root {\n  --font-size-1: 12px;\n  --spacing-1: 8px;\n  --spacing-2: 16px;\n}\n"
    assert json.loads(css["json"].first()["text"])["spacing"]["2"] == {"$type": "dimension", "$value": "16px"}
    with pytest.raises(ValueError, match="unknown"):
        exports.export(out["tokens"], ["analysisId"], "pdf")
    captures.unpersist()


def test_stream_ingest_drops_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(_capture(i, "desktop")) for i in (1, 1, 2)))
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2
        (tmp_path / "in/2.json").write_text(json.dumps(_capture(2, "desktop")))


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.read("analyses").count() == 0
    themes = spark.createDataFrame([("t1", "Dark", False, False, None), ("t2", "dark", False, False, None)], store.THEMES).withColumn("updated_at", F.when(F.col("id") == "t2", F.lit("2024-02-01").cast("timestamp")).otherwise(F.lit("2024-01-01").cast("timestamp")))
    s.write("themes", themes)
    made = spark.createDataFrame([(f"a{i}", f"https://u:p@e.com/x{i}/?q=1", None, None, "t1", None, 12.5 if i else -1.0, "{}", None) for i in range(5)], store.ANALYSES)
    s.save(made)
    got = {r.id: r for r in s.read("analyses").collect()}
    assert got["a1"].url == "https://e.com/x1/" and got["a1"].route == "https://e.com/x1" and got["a1"].duration_ms == 13 and got["a0"].duration_ms is None
    s.merge_themes()
    assert {r.theme_id for r in s.read("analyses").collect()} == {"t2"} and s.read("themes").count() == 1
    s.delete(spark.createDataFrame([("a0",)], "id string"))
    page = store.history_page(s.read("analyses"), s.read("themes"), 9, 3, "E.com/x", order="id").collect()
    assert [r.id for r in page] == ["a1"] and page[0].theme_name == "dark"


def test_gates(spark):
    r = spark.range(1).select(gates.evidence_eligible(F.lit("degraded"), F.array(F.lit("horizontal-overflow"))).alias("ok"), gates.evidence_eligible(F.lit("degraded"), F.array(F.lit("captcha"))).alias("no"), gates.comparability(F.array(), F.array()).alias("c")).first()
    assert r.ok and not r.no and r.c == "limited"


def test_leader_clusters_place_a_colour_once(spark):
    """Three colours, each a thousand times, meet the leaders as three rows."""
    t = spark.range(3000).selectExpr("1 AS g", "id AS ord", "concat('rgb(', id % 3 * 90, ', 0, 0)') AS value", "1D AS n")
    got = clusters.leader_clusters(t, ["g"])
    assert [(r.leader_ord, r.n, r.members) for r in got.orderBy("leader_ord").collect()] == [(i, 1000.0, 1000) for i in range(3)]
    got.collect()

    def joined(plan):
        while plan.nodeName() == "AdaptiveSparkPlan" or plan.nodeName().endswith("QueryStage"):
            plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan()
        own = [plan.metrics().get("numOutputRows").get().value()] if "Join" in plan.nodeName() else []
        return own + [n for i in range(plan.children().size()) for n in joined(plan.children().apply(i))]

    assert joined(got._jdf.queryExecution().executedPlan()) == [3]
