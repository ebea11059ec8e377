"""Pairing of two captures: the levels against plain dictionaries, and the cases that decide a category."""

import random
from collections import Counter

from tessera.operators import pairing as pr

SECTION = "on int, page string, id string, role string, layout_mode string, parent_id string"
COMPONENT = "on int, page string, id string, section_id string, type string, element_kind string, role string"
PAGE = ["on", "page"]


def capture(rng, side):
    sections, components = [], []
    for page in ("p", "q", "r"):
        if rng.random() < 0.9:
            ids = [f"{side}{page}{i}" for i in range(rng.randint(0, 9))]
            for i, ident in enumerate(ids):
                parent = rng.choice([None, None, *ids[:i], "gone"])
                sections.append((1, page, ident, rng.choice(["hero", "nav", "content", "footer", "x", None]), rng.choice(["flow", "grid"]), parent))
                for k in range(rng.choice([0, 0, 1, 2, 3])):
                    components.append((1, page, f"{ident}c{k}", ident, rng.choice(["button", "card"]), rng.choice([None, "a"]), rng.choice([None, "cta"])))
    return sections, components


def plain(a, b):
    out = {}
    (sa, ca), (sb, cb) = a, b
    kind = lambda c: "|".join(x or "" for x in c[4:])

    def signature(s, side):
        sections, components = side
        above = {(x[1], x[2]): x[3] for x in sections}
        parent = "root" if s[5] is None else above.get((s[1], s[5])) or "unknown"
        held = Counter(kind(c) for c in components if c[1] == s[1] and c[3] == s[2])
        return "|".join([s[3] or "", s[4], parent, ",".join(sorted(f"{k}*{n}" for k, n in held.items()))])

    for page in ("p", "q", "r"):
        mine = {"a": [s for s in sa if s[1] == page], "b": [s for s in sb if s[1] == page]}
        sig = {"a": {s[2]: signature(s, a) for s in mine["a"]}, "b": {s[2]: signature(s, b) for s in mine["b"]}}
        number = {x: Counter(sig[x].values()) for x in "ab"}
        groups = {}
        for x in "ab":
            for s in mine[x]:
                exact = number["a"][sig[x][s[2]]] == number["b"][sig[x][s[2]]] == 1
                groups.setdefault(("s", sig[x][s[2]]) if exact else ("r", s[3] or ""), []).append((x, s[2]))
        for (way, _), members in groups.items():
            n = Counter(x for x, _ in members)
            if way == "s":
                said = ("matched", "high", "exact-semantic-signature")
            elif n["a"] == n["b"] == 1:
                said = ("matched", "medium", "unique-role")
            elif n["a"] and n["b"]:
                said = ("ambiguous", "none", "duplicate-semantic-candidates")
            else:
                said = ("unmatched", "none", "missing-counterpart")
            for m in members:
                out[m] = said
            inside = [(x, c) for x, cs in (("a", ca), ("b", cb)) for c in cs if (x, c[3]) in members]
            parts = {}
            for x, c in inside:
                parts.setdefault(kind(c) if said[0] == "matched" else "", []).append((x, c[2]))
            for held in parts.values():
                n = Counter(x for x, _ in held)
                if said[0] == "matched":
                    one = ("matched", "high", "exact-semantic-signature") if n["a"] == n["b"] == 1 else ("ambiguous", "none", "duplicate-semantic-candidates") if n["a"] and n["b"] else ("unmatched", "none", "missing-counterpart")
                else:
                    one = ("ambiguous", "none", "parent-section-unresolved") if said[0] == "ambiguous" and n["a"] and n["b"] else ("unmatched", "none", "missing-counterpart")
                for m in held:
                    out[m] = one
    return out


def matched(spark, a, b):
    frames = [(spark.createDataFrame(s, SECTION), spark.createDataFrame(c, COMPONENT)) for s, c in (a, b)]
    signed = [pr.section_signatures(s, c, PAGE) for s, c in frames]
    sections = pr.match_sections(*signed, PAGE)
    return sections, pr.match_components(frames[0][1], frames[1][1], sections, PAGE)


def test_levels_equal_plain_matching(spark):
    seen = Counter()
    for seed in range(6):
        rng = random.Random(seed)
        a, b = capture(rng, "a"), capture(rng, "b")
        sections, components = matched(spark, a, b)
        got = {(r.side, r.id): (r.status, r.confidence, r.reason) for r in sections.unionByName(components).collect()}
        want = plain(a, b)
        assert got == want
        seen.update(v[2] for v in want.values())
        s = pr.match_summary(sections, ["on"], PAGE).collect()
        mine = {k: v for k, v in want.items() if "c" not in k[1]}
        if mine:
            pairs = sum(v[0] == "matched" for v in mine.values()) // 2
            assert (s[0].matched_pairs, s[0].high_confidence_pairs + s[0].medium_confidence_pairs, s[0].unmatched_entities) == (pairs, pairs, sum(v[0] == "unmatched" for v in mine.values()))
        assert pr.pairs(sections, PAGE).count() == sum(v[0] == "matched" for v in mine.values()) // 2
    assert len(seen) == 5


def test_layout_changes(spark):
    schema = "on int, page string, id string, role string, order int, layoutMode string, display string, position string, maxWidth string, gridTemplateColumns string, childGridTemplateColumns string"
    a = spark.createDataFrame([(1, "p", "a1", "hero", 0, "flow", "grid", "static", " 10px  1em", "1fr 1fr", None), (1, "p", "a2", "nav", 1, "flow", "", "", "", "none", "")], schema)
    b = spark.createDataFrame([(1, "p", "b1", "hero", 0, "flow", "block", "static", "10px 1em", "200px 300px", "repeat(3, 1fr)"), (1, "p", "b2", "nav", 2, "flow", None, "", None, "none", None)], schema)
    pairs = spark.createDataFrame([(1, "p", "a1", "b1", "high"), (1, "p", "a2", "b2", "high")], "on int, page string, a_id string, b_id string, confidence string")
    got = sorted((r.a_id, r.property, r.before, r.after) for r in pr.layout_changes(pairs, a, b, PAGE).collect())
    assert got == [("a1", "childGridTemplateColumns", None, "3"), ("a1", "display", "grid", "block"), ("a2", "order", "1", "2")]


def responsive(spark, rows):
    """rows: (on, id, section, property, before, after)."""
    changes = spark.createDataFrame([(on, i, k, p, x, y) for k, (on, i, _, p, x, y) in enumerate(rows)], "on int, id string, ord int, property string, before string, after string")
    observed = spark.createDataFrame(sorted({(on, i, s, "desktop", "mobile", "reflow") for on, i, s, *_ in rows}), "on int, id string, section string, from_viewport string, to_viewport string, change_type string")
    sections = spark.createDataFrame(sorted({(on, s, "header") for on, _, s, *_ in rows if s != "gone"}), "on int, section string, role string")
    return pr.responsive_values(changes, observed, sections, ["on"])


def test_responsive_pairing(spark):
    a = [
        (1, "a1", "s1", "gridTemplateColumns", "1fr 1fr", "1fr"), (1, "a1", "s1", "rect.x", "1", "2"), (2, "a2", "s2", "order", "1", "2"), (2, "a2", "s2", "sequenceIndex", "0", "1"),
        (3, "a3", "s3", "height", "60px", "40px"), (4, "a4", "s4", "position", "static", "fixed"), (5, "a5", "s5", "height", "60px", "900px"), (6, "a6", "gone", "position", "x", "y"),
    ]
    b = [(1, "b1", "t1", "gridTemplateColumns", "1fr 1fr", "1fr"), (2, "b2", "t2", "order", "1", "3"), (3, "b3", "t3", "height", "60px", "40px"), (3, "b4", "t3", "position", "a", "b"), (5, "b5", "t5", "visibility", "a", "b")]
    va, vb = responsive(spark, a), responsive(spark, b)
    assert {r.id: r.value for r in va.collect()} == {
        "a1": "reflow · gridTemplateColumns: 1fr 1fr → 1fr", "a2": "reorder · order: 1 → 2, sequenceIndex: 0 → 1", "a3": "reflow · height: 60px → 40px", "a4": "reflow · position: static → fixed",
    }
    paired = spark.createDataFrame([(i, f"s{i}", f"t{i}") for i in range(1, 6)], "on int, a_id string, b_id string")
    met = pr.pair_responsive(va, vb, paired, ["on"])
    assert {r.a_id: r.state for r in met.collect()} == {"a1": "same", "a2": "changed", "a3": "unpaired", "a4": "unpaired"}
    sections = spark.createDataFrame([(i, "matched") for i in (1, 2, 3, 4, 5, 7)] + [(4, "unmatched"), (8, "unmatched")], "on int, status string")
    captures = spark.createDataFrame([(i, 1 if i == 7 else 2, i == 1) for i in range(1, 9)], "on int, viewports int, mismatch boolean")
    got = {r.on: (r.status, r.changes, len(r.limitations)) for r in pr.responsive_result(met, vb, sections, captures, ["on"]).collect()}
    assert got == {1: ("unchanged", 0, 2), 2: ("changed", 1, 1), 3: ("inconclusive", 0, 2), 4: ("inconclusive", 0, 2), 5: ("unchanged", 0, 1), 6: ("inconclusive", 0, 1), 7: ("inconclusive", 0, 2), 8: ("inconclusive", 0, 2)}


OBSERVED = "on int, page string, id string, driver string, trigger string, property string, before string, after string"


def test_interaction_groups(spark):
    rows = [
        (1, "p", "o1", "hover", "mouse", "transform", "none", "translateX(4px)"), (1, "p", "o2", "hover", "mouse", "transform", "matrix(1, 0, 0, 1, 0, 0)", "matrix(1,0,0,1,4,0)"), (1, "p", "o3", "hover", "mouse", "transform", None, "scale(2)"),
        (1, "p", "o4", "focus", "key", "color", None, " red "), (1, "p", "o4", "focus", "key", "outline", None, None), (1, "p", "o5", "focus", "key", "outline", None, "2px"), (1, "p", "o5", "focus", "key", "color", None, "blue"),
    ]
    got = {(r.driver, r.properties): r.value for r in pr.interaction_groups(spark.createDataFrame(rows, OBSERVED), PAGE).collect()}
    assert got == {
        ("hover", "transform"): "transform: matrix(1, 0, 0, 1, 0, 0) → matrix(1, 0, 0, 1, 4, 0)",
        ("focus", "color+outline"): "color: — → blue, outline: — → 2px | color: — → red, outline: — → —",
    }


def test_interaction_results(spark):
    row = lambda on, page, value: (on, page, "o", "hover", "mouse", "color", "red", value)
    a = spark.createDataFrame([row(1, "p", "blue"), row(2, "p", "blue"), row(2, "q", "blue"), row(3, "p", "blue"), row(4, "p", "blue")], OBSERVED)
    b = spark.createDataFrame([row(1, "p", "blue"), row(2, "p", "green"), row(3, "q", "blue"), row(4, "p", "blue")], OBSERVED)
    met = pr.pair_interactions(pr.interaction_groups(a, PAGE), pr.interaction_groups(b, PAGE), PAGE)
    captures = spark.createDataFrame([(i, i == 4) for i in range(1, 6)], "on int, coverage_differs boolean")
    got = {r.on: (r.status, r.changes, pr.INTERACTION_UNPAIRED in r.limitations) for r in pr.interaction_result(met, captures, ["on"]).collect()}
    assert got == {1: ("unchanged", 0, False), 2: ("changed", 1, True), 3: ("inconclusive", 0, True), 4: ("unchanged", 0, True), 5: ("inconclusive", 0, False)}


def test_no_side_is_sent_whole_whatever_its_reckoned_size(spark):
    """A few rows, whose joins Spark would make by sending one side to all."""
    matches = spark.range(40).selectExpr("1 AS page", "IF(id % 2 = 0, 'a', 'b') AS side", "id", "CAST(id DIV 2 AS STRING) AS match", "'matched' AS status", "'high' AS confidence")
    seen = spark.range(40).selectExpr("1 AS page", "id", "id AS section", "'d' AS from_viewport", "'m' AS to_viewport", "'p' AS path", "'v' AS value")
    paired = pr.pairs(matches, ["page"])
    met = pr.pair_responsive(seen, seen, paired, ["page"])
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert {(r.a_id, r.b_id) for r in met.where("state = 'same'").collect()} == {(i, i + 1) for i in range(0, 40, 2)}
