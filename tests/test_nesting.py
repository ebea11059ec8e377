"""Nested elements: every rule against its quadratic form."""

import random

from pyspark.sql import functions as F

from tessera.operators import nesting

ELEMENTS = "page int, id string, pre int, last int, area double, landmark boolean"


def tree(rng, n):
    """pre -> last of a random tree in document order."""
    parent = [None] + [rng.randrange(max(0, i - rng.choice([1, 2, 9, 99])), i) for i in range(1, n)]
    last = list(range(n))
    stack_ok = []
    for i in range(n):  # keep only parents that are still open, so that numbers are a document order
        while stack_ok and parent[i] is not None and stack_ok[-1] != parent[i] and parent[i] in stack_ok:
            stack_ok.pop()
        parent[i] = stack_ok[-1] if stack_ok else None
        stack_ok.append(i)
    for i in range(n - 1, 0, -1):
        if parent[i] is not None:
            last[parent[i]] = max(last[parent[i]], last[i])
    return last


def contains(a, b):
    return a["pre"] < b["pre"] <= a["last"]


def test_suppression_equals_the_quadratic_rule(spark):
    rng, rows = random.Random(5), []
    for page in range(12):
        last = tree(rng, rng.choice([1, 2, 40, 130]))
        rows += [{"page": page, "id": f"e{i}", "pre": i * 3, "last": last[i] * 3 + 2, "area": rng.choice([None, 100.0, 85.0, 50.0, 49.9, 42.5, 72.25]), "landmark": rng.random() < 0.4} for i in range(len(last)) if rng.random() < 0.8]
    want = set()
    for a in rows:
        for d in rows:
            if a["page"] != d["page"] or not contains(a, d) or a["area"] is None or d["area"] is None:
                continue
            if d["area"] >= a["area"] * 0.85:
                gone = d if a["landmark"] and not d["landmark"] else a
                want.add((gone["page"], gone["id"]))
            elif not a["landmark"] and d["landmark"] and d["area"] >= a["area"] * 0.5:
                want.add((a["page"], a["id"]))
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ELEMENTS)
    got = nesting.suppressed_sections(df, ["page"])
    assert {(r.page, r.id) for r in got.where("suppressed").collect()} == want and want
    assert got.count() == len(rows)
    assert nesting.suppressed_sections(df.where("false"), ["page"]).count() == 0


def test_overflow_equals_the_greedy_choice(spark):
    rng, rows, sections = random.Random(6), [], []
    for page in range(15):
        last = tree(rng, rng.choice([1, 3, 60, 150]))
        for i in range(len(last)):
            left = rng.choice([0, 0, 0, -3, -30.4, 10])
            width = rng.choice([50, 90, 100, 104, 104.5, 130, 130])
            rows.append((page, i, i, last[i], float(left), float(left + width), float(width), 100.0, rng.random() < 0.9, rng.choice(["static"] * 9 + ["fixed", None]), rng.choice(["visible"] * 8 + ["auto", "hidden", "scroll", None]), rng.choice([90, 104, 105]), 100, i == 1, i == 0))
            if rng.random() < 0.3:
                sections.append((page, f"s{i}", rng.choice(["hero", "content"]), i, last[i], rng.choice([10.0, 20.0]), len(sections)))
    names = ("page", "id", "pre", "last", "left", "right", "width", "viewport", "visible", "position", "overflow_x", "scroll_width", "client_width", "body", "root")
    els = [dict(zip(names, r, strict=True)) for r in rows]
    want, widths = [], {}
    for page in range(15):
        mine = [e for e in els if e["page"] == page]
        free = []
        for e in mine:
            up = [a for a in mine if contains(a, e)]
            clip = any(not a["body"] and not a["root"] and (a["overflow_x"] in ("hidden", "clip") or (a["overflow_x"] in ("auto", "scroll") and a["scroll_width"] > a["client_width"] + 4)) for a in up)
            px = max(0, -e["left"]) + max(0, e["right"] - 100)
            if e["visible"] and not clip and not any(a["position"] == "fixed" for a in [*up, e]) and px > 4:
                free.append((e["body"], -px, e["pre"], e))
        chosen = []
        for *_, e in sorted(free, key=lambda f: f[:3]):
            if len(chosen) < 3 and not any(contains(c, e) or contains(e, c) for c in chosen):
                chosen.append(e)
        for k, e in enumerate(chosen, 1):
            held = sorted((s for s in sections if s[0] == page and s[3] <= e["pre"] <= s[4]), key=lambda s: (s[5], s[6]))
            px = max(0, -e["left"]) + max(0, e["right"] - 100)
            want.append((page, k, e["id"], int(px + 0.5), int(e["width"] + 0.5), e["position"], held[0][1] if held else None, held[0][2] if held else None))
        if free:
            widths[page] = -int(-max(100, *(f[3]["right"] for f in free), *(100 - f[3]["left"] for f in free)) // 1)
    schema = "page int, id int, pre int, last int, left double, right double, width double, viewport double, visible boolean, position string, overflow_x string, scroll_width int, client_width int, body boolean, root boolean"
    over = nesting.overflowing(spark.createDataFrame(rows, schema), ["page"])
    table = spark.createDataFrame(sections, "page int, section string, role string, pre int, last int, area double, ord int")
    got = nesting.overflow_report(over, nesting.overflow_sources(over, ["page"]), table, ["page"])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 20
    assert {r.page: r.content_width for r in nesting.content_width(over, ["page"]).collect()} == widths


def test_crops_equal_the_first_that_fits(spark):
    rng = random.Random(7)
    part = lambda: rng.choice([0.0, 0.125, 0.25, 0.3, 0.5, 0.75, 1.0])
    targets = [(p, i, rng.choice([None, "a", "b"]), part(), part(), part() / 2, part() / 2) for p in range(6) for i in range(40)]
    crops = [(p, f"c{i}", i, rng.choice([None, "a", "z"]), part(), part(), part(), part()) for p in range(5) for i in range(7)]
    want = {}
    for p, i, s, x, y, w, h in targets:
        for q, c, _, t, cx, cy, cw, ch in crops:
            fits = x >= cx - 1e-6 and y >= cy - 1e-6 and x + w <= cx + cw + 1e-6 and y + h <= cy + ch + 1e-6
            if p == q and (fits or (s is not None and s == t)):
                want[p, i] = c
                break
    got = nesting.crop_of(spark.createDataFrame(targets, "page int, id int, section string, x double, y double, w double, h double"), spark.createDataFrame(crops, "page int, crop string, ord int, section string, x double, y double, w double, h double"), ["page"])
    assert {(r.page, r.id): r.crop for r in got.collect()} == want and len(want) > 50


def sends_no_side_whole(df):
    return "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def numbered(spark, n):
    """A few elements, whose joins Spark would make by sending one side to all."""
    return spark.range(n).selectExpr("1 AS page", "id", "id AS pre", "id + (id & -id) AS last", "CAST(id % 5 AS DOUBLE) AS area", "id % 3 = 0 AS landmark")


def test_blocks_are_dealt_out_whatever_the_reckoned_size(spark):
    some, measures = numbered(spark, 200), {"n": ("max", F.col("pre"))}
    for met in (nesting.over_descendants(some, some, ["page"], "id", measures), nesting.over_ancestors(some, some, ["page"], "id", measures)):
        assert sends_no_side_whole(some.join(met, ["page", "id"], "left"))


def test_plans_are_as_long_for_any_numbers(spark):
    """The driver plans and compiles the same steps however far a page's numbers go."""
    measures, lengths, found = {"n": ("max", F.col("id"))}, [], []
    for digits in (6, 46):
        some = numbered(spark, 50).withColumns({c: F.call_function("shiftleft", F.col(c), F.lit(digits - 5)) for c in ("pre", "last")})
        for met in (nesting.over_descendants(some, some, ["page"], "id", measures), nesting.over_ancestors(some, some, ["page"], "id", measures)):
            lengths.append(len(met._jdf.queryExecution().optimizedPlan().toString()))
            found.append({(r.id, r.n) for r in met.collect()})
    assert max(lengths[2:]) < 1.2 * max(lengths[:2]) < 6000
    assert found[:2] == found[2:] and all(found)


def test_intervals_of_any_bounds_equal_the_quadratic_rule(spark):
    rng = random.Random(8)
    rows = [(p, i, rng.choice([0, 1, 7, 8, 63, 64, 65, i]), rng.choice([None, -5, 0, 6, 7, 8, 62, 63, 64, 511, 4000, 2**40])) for p in range(3) for i in range(90)]
    df = spark.createDataFrame(rows, "page int, id long, pre long, last long")
    pairs = [(a, d) for a in rows for d in rows if a[0] == d[0] and a[3] is not None and a[2] < d[2] <= a[3]]
    inside, around = {}, {}
    for a, d in pairs:
        inside[a[:2]] = max(inside.get(a[:2], 0), d[1])
        around[d[:2]] = min(around.get(d[:2], 999), a[1])
    got = nesting.over_descendants(df, df, ["page"], "id", {"n": ("max", F.col("id"))})
    assert {(r.page, r.id): r.n for r in got.collect()} == inside and inside
    got = nesting.over_ancestors(df, df, ["page"], "id", {"n": ("min", F.col("id"))})
    assert {(r.page, r.id): r.n for r in got.collect()} == around
    assert nesting.over_ancestors(df.where("false"), df, ["page"], "id", {"n": ("min", F.col("id"))}).count() == 0


def most_rows(plan):
    """Of all steps of a plan that has run."""
    while plan.nodeName() == "AdaptiveSparkPlan" or plan.nodeName().endswith("QueryStage"):
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan()
    rows = plan.metrics().get("numOutputRows")
    below = [most_rows(plan.children().apply(i)) for i in range(plan.children().size())]
    return max([rows.get().value() if rows.isDefined() else 0, *below])


def test_equal_rectangles_meet_once(spark):
    """Four shapes of targets and three of crops, each a thousand times: matched one by one the copies would be millions of pairs."""
    targets = spark.range(4000).selectExpr("1 AS page", "id", "CAST(NULL AS INT) AS section", "id % 4 / 8D AS x", "0D AS y", "0.125D AS w", "0.125D AS h")
    crops = spark.range(3000).selectExpr("1 AS page", "id AS crop", "id % 7 AS ord", "1 AS section", "id % 3 / 8D AS x", "0D AS y", "0.25D AS w", "0.5D AS h")
    got = nesting.crop_of(targets, crops, ["page"])
    want = {0: 0, 1: 0, 2: 7, 3: 14}
    assert {(r.id % 4, r.crop) for r in got.collect()} == set(want.items()) and got.count() == 4000
    assert got.collect() and most_rows(got._jdf.queryExecution().executedPlan()) <= 4000
