"""Component detection against plain rules over random pages."""

import random
import re

from tessera import capture_queries
from tessera.operators import components as co

SCHEMA = (
    "page int, id string, parent_id string, pre int, last int, tag string, role string, input_type string, has_href boolean, classes array<string>, onclick boolean, tabindex string, aria_modal string, "
    "visible boolean, width double, height double, viewport_width double, viewport_height double, text_chars int, child_tags array<string>, main_child boolean, background string, shadow string, position string, "
    "z_index string, border_width array<double>, border_style array<string>, radius array<double>, padding array<double>, radius_text string, in_main boolean, status_root boolean, status_candidate boolean, "
    "status_role string, action_role string, native_action boolean, styled_link boolean"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
PAGE = ["page"]


def page_of(rng, page, n):
    parent, last = [None], list(range(n))
    for i in range(1, n):
        p = i - 1
        while parent[p] is not None and rng.random() < 0.45:
            p = parent[p]
        parent.append(p)
    for i in range(n - 1, 0, -1):
        last[parent[i]] = max(last[parent[i]], last[i])
    out = []
    for i in range(n):
        tag = rng.choice(["div", "div", "div", "section", "a", "button", "input", "nav", "ul", "table", "dialog", "img", "select", "article"])
        kind = rng.random() < 0.1
        out.append(dict(
            page=page, id=f"e{i}", parent_id=None if parent[i] is None else f"e{parent[i]}", pre=i, last=last[i], tag=tag, role=rng.choice([None] * 8 + ["button", "navigation", "textbox", "grid", "dialog", "list", "tab", "region", "combobox"]),
            input_type=rng.choice([None, "text", "submit", "hidden", "BUTTON"]) if tag == "input" else None, has_href=tag == "a" and rng.random() < 0.5, classes=rng.sample(["btn", "button", "card", "modal-x", "item", "z" * 60], rng.randint(0, 2)),
            onclick=rng.random() < 0.2, tabindex=rng.choice([None, "0", "-1"]), aria_modal=rng.choice([None, None, "true"]), visible=rng.random() < 0.9, width=float(rng.choice([50, 130, 200, 300, 950])), height=float(rng.choice([20, 66, 80, 100, 500])),
            viewport_width=1000.0, viewport_height=800.0, text_chars=rng.choice([0, 11, 12, 90]), child_tags=[], main_child=rng.random() < 0.3, background=rng.choice(["transparent", "rgba(0, 0, 0, 0)", "rgb(1, 2, 0)", "rgb(9, 9, 9)", "#fff"]),
            shadow=rng.choice(["none", "none", "0 1px 2px red"]), position=rng.choice(["static", "fixed"]), z_index=rng.choice(["auto", "3"]), border_width=[float(rng.choice([0, 0, 1])) for _ in range(4)], border_style=[rng.choice(["none", "solid", "hidden"]) for _ in range(4)],
            radius=[float(rng.choice([0, 4, 8])) for _ in range(4)], padding=[float(rng.choice([0, 8, 12])) for _ in range(4)], radius_text=rng.choice(["0px", "8px"]), in_main=rng.random() < 0.8,
            status_root=kind and rng.random() < 0.5, status_candidate=kind, status_role="status-neutral", action_role="action", native_action=tag == "button", styled_link=tag == "a" and rng.random() < 0.5,
        ))
    for e in out:
        e["child_tags"] = [c["tag"] for c in out if c["parent_id"] == e["id"]]
    return out


def clear(paint):
    return paint.strip().lower() == "transparent" or bool(re.match(r"(?i)^rgba?\([^)]*(?:,|/)\s*0(?:\.0+)?\s*\)$", paint.strip()))


class Page:
    def __init__(self, elements):
        self.all, self.by = elements, {e["id"]: e for e in elements}

    def inside(self, e):
        return [d for d in self.all if e["pre"] < d["pre"] <= e["last"]]

    def box(self, e):
        at = self.by.get(e["parent_id"])
        for _ in range(3):
            if at is None:
                break
            close = at["width"] >= e["width"] and at["height"] >= e["height"] and at["width"] <= max(e["width"] * 1.8, e["width"] + 160) and at["height"] <= max(e["height"] * 3, 72)
            framed = (at["border_width"][0] > 0 and at["border_style"][0] not in ("none", "hidden")) or at["radius"][0] > 0 or at["shadow"] != "none" or (not clear(at["background"]) and at["background"] != e["background"])
            if at["visible"] and close and framed and (at["width"] > e["width"] + 2 or at["height"] > e["height"] + 2):
                return at
            at = self.by.get(at["parent_id"])
        return e

    def behind(self, e):
        return self.by[e["parent_id"]]["background"] if e["parent_id"] else ""

    def acts(self, e):
        return any(d["tag"] in ("img", "picture", "svg", "button", "input", "textarea", "select") or (d["tag"] == "a" and d["has_href"]) or d["role"] == "button" for d in self.inside(e))

    def wide(self, e):
        return e["width"] >= 900 and (e["main_child"] or e["role"] == "region")

    def detect(self):
        found = {}

        def add(kind, e, confidence, reasons):
            if e["visible"]:
                old = found.setdefault((e["id"], kind), [0, []])
                old[0] = max(old[0], confidence)
                old[1] += [r for r in reasons if r not in old[1]]

        typed = lambda e: e["tag"] in ("textarea", "select") or (e["tag"] == "input" and (e["input_type"] or "").lower() not in ("hidden", "button", "submit", "reset"))
        rules = [
            ("button", 0.98, ["native-element"], lambda e: e["tag"] == "button" or (e["tag"] == "input" and (e["input_type"] or "").lower() in ("button", "submit", "reset"))), ("button", 0.9, ["aria-role"], lambda e: e["role"] == "button"),
            ("button", 0.65, ["class-name", "interactive-behavior"], lambda e: {"btn", "button"} & set(e["classes"]) and (e["has_href"] or e["tag"] in ("button", "input") or e["onclick"] or e["tabindex"] == "0")),
            ("navigation", 0.98, ["native-element"], lambda e: e["tag"] == "nav"), ("navigation", 0.9, ["aria-role"], lambda e: e["role"] == "navigation"), ("input", 0.98, ["native-element"], typed),
            ("input", 0.88, ["aria-role"], lambda e: e["role"] in ("textbox", "searchbox", "combobox", "spinbutton")), ("table", 0.98, ["native-element"], lambda e: e["tag"] == "table"), ("table", 0.82, ["aria-grid-role"], lambda e: e["role"] == "grid"),
            ("modal", 0.98, ["native-element"], lambda e: e["tag"] == "dialog"), ("modal", 0.9, ["aria-role"], lambda e: e["role"] == "dialog"),
            ("modal", 0.65, ["class-name", "overlay-position"], lambda e: "modal-x" in e["classes"] and (e["aria_modal"] == "true" or (e["position"] == "fixed" and e["z_index"] != "auto"))),
            ("list", 0.98, ["native-element"], lambda e: e["tag"] == "ul"), ("list", 0.9, ["aria-role"], lambda e: e["role"] == "list"),
        ]
        for kind, confidence, reasons, test in rules:
            for e in self.all:
                if test(e):
                    add(kind, self.box(e) if kind == "input" else e, confidence, reasons)
        sign = lambda e: (e["parent_id"], e["tag"], tuple(sorted(c for c in e["classes"] if len(c) <= 48)[:3]), tuple(e["child_tags"][:5]))
        for e in self.all:
            if e["tag"] in co.NO_CARDS or not e["visible"] or e["width"] < 120 or e["height"] < 72 or self.wide(e):
                continue
            rounded, shadowed, padded = max(e["radius"]) > 4, e["shadow"] != "none", max(e["padding"]) >= 12
            bordered = max(e["border_width"]) > 0 and any(s != "none" for s in e["border_style"])
            if not padded or not (rounded or shadowed or bordered):
                continue
            total, reasons = 0.0, []
            paint = e["background"]
            distinct = not (paint == "transparent" or paint.endswith(", 0)")) and paint != self.behind(e)
            twice = e["parent_id"] is not None and sum(sign(x) == sign(e) for x in self.all if x["visible"]) >= 2
            for score, test, why in (
                (0.16, rounded, ["rounded-container"]), (0.22, shadowed or bordered, ["shadow-boundary"] * shadowed + ["border-boundary"] * bordered), (0.16, True, ["contained-spacing"]), (0.1, distinct, ["distinct-surface"]),
                (0.12, e["text_chars"] >= 12, ["content-region"]), (0.08, len(e["child_tags"]) >= 2, ["structured-children"]), (0.12, twice, ["repeated-sibling-structure"]), (0.08, self.acts(e), ["media-or-action"]),
                (-0.2, e["width"] >= 900 and e["height"] >= 400, ["large-layout-penalty"]),
            ):
                if test:
                    total += score
                    reasons += why
            if total >= 0.62:
                add("card", e, min(0.94, total), reasons)
        return {(i, k, round(c, 9), tuple(r)) for (i, k), (c, r) in found.items()}

    def collect(self):
        out = []
        taken = lambda e: any(x[0] == e["id"] for x in out)
        typed = lambda e: e["tag"] in ("textarea", "select") or (e["tag"] == "input" and (e["input_type"] or "").lower() not in ("hidden", "button", "submit"))
        first = [
            ("status", lambda e: e["status_root"], "status", 0.94), ("tab", lambda e: e["role"] == "tab", "button", 0.98), ("button", lambda e: e["native_action"] and not e["status_candidate"], None, 0.98),
            ("button", lambda e: e["styled_link"] and not e["status_candidate"], "anchor", 0.9), ("navigation", lambda e: e["tag"] == "nav" or e["role"] == "navigation", "", 0.98),
        ]
        later = [("table", lambda e: e["tag"] == "table" or e["role"] in ("table", "grid"), "", 0.96), ("modal", lambda e: e["tag"] == "dialog" or e["role"] in ("dialog", "alertdialog"), "", 0.96), ("list", lambda e: e["tag"] in ("ul", "ol") or e["role"] == "list", "", 0.9)]

        def go(ways):
            for kind, test, how, confidence in ways:
                for e in self.all:
                    if e["visible"] and test(e) and not taken(e):
                        role = e["status_role"] if kind == "status" else e["action_role"] if kind == "button" else e["role"]
                        if how is None:
                            how_ = "input" if e["tag"] == "input" else "role-button" if e["role"] == "button" and e["tag"] != "button" else "button"
                        out.append((e["id"], kind, role, (how_ if how is None else how) or None, confidence))

        go(first)
        for e in self.all:
            if e["visible"] and (typed(e) or e["role"] in ("textbox", "combobox")):
                b = self.box(e)
                if not any(x[0] == b["id"] and x[1] == "input" for x in out):
                    out.append((b["id"], "input", e["role"], "input", 0.96))
        go(later)
        known, cards = {x[0] for x in out}, []
        for e in self.all:
            line = e["border_width"][0] > 0 and e["border_style"][0] not in ("none", "hidden")
            rounded, shadowed = e["radius"][0] > 4, e["shadow"] != "none"
            if e["tag"] in co.NO_DEEP_CARDS or not e["visible"] or not e["in_main"] or e["id"] in known or not e["parent_id"] or self.wide(e) or not (rounded or shadowed or line) or max(e["padding"]) < 8 or e["width"] < 120 or e["height"] < 64:
                continue
            distinct = not clear(e["background"]) and e["background"] != self.behind(e)
            score = (0.16 if rounded else 0) + (0.22 if shadowed or line else 0) + 0.16 + (0.1 if distinct else 0) + (0.12 if e["text_chars"] >= 12 else 0) + (0.08 if len(e["child_tags"]) >= 2 else 0) + (0.08 if self.acts(e) else 0) - (0.2 if e["width"] >= 900 and e["height"] >= 400 else 0)
            cards.append((e, (e["parent_id"], e["tag"], e["background"], e["radius_text"], e["border_width"][0]), score))
        for e, key, score in cards:
            score += 0.12 if sum(k == key for _, k, _ in cards) >= 2 else 0
            if score >= 0.62:
                out.append((e["id"], "card", None, None, min(0.94, score)))
        return {(*x[:4], round(x[4], 9)) for x in out}


def test_detectors_equal_plain_rules(spark):
    pages = [page_of(random.Random(seed), seed, n) for seed, n in enumerate([1, 2, 70, 150, 150])]
    table = spark.createDataFrame([tuple(e[n] for n in NAMES) for p in pages for e in p], SCHEMA)
    got = co.detect_components(table, PAGE).collect()
    for k, p in enumerate(pages):
        assert {(r.id, r.type, round(r.confidence, 9), tuple(r.reasons)) for r in got if r.page == k} == Page(p).detect()
    assert {r.type for r in got} == {"button", "navigation", "input", "table", "modal", "list", "card"}
    assert co.detect_components(table.where("false"), PAGE).count() == 0
    some = co.collect_components(table, PAGE).collect()
    for k, p in enumerate(pages):
        assert {(r.id, r.type, r.role, r.element_kind, round(r.confidence, 9)) for r in some if r.page == k} == Page(p).collect()
    assert sum(r.type == "card" for r in some) > 3


def exchanged(df):
    """The names of the columns of each exchange of the plan."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().length())]
        if "Exchange" in node.nodeName():
            out.append({node.output().apply(i).name() for i in range(node.output().length())})
    return out


def test_wide_elements_stay_where_they_are_read(spark):
    table = spark.createDataFrame([tuple(e[n] for n in NAMES) for e in page_of(random.Random(3), 0, 40)], SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for how in (co.detect_components, co.collect_components):
            moved = exchanged(how(table, PAGE))
            assert len(moved) > 5
            assert not set().union(*moved) & {"classes", "child_tags", "text_chars", "viewport_width", "shadow", "border_style", "border_width", "radius", "padding", "main_child"}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_no_side_is_sent_whole(spark):
    """Whatever size is reckoned for a side, rows of elements don't pass through the driver."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for how in (capture_queries.detected_components, capture_queries.suppressed_sections):
            names, todo = [], [how(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()]
            while todo:
                node = todo.pop()
                names.append(node.nodeName())
                todo += [node.children().apply(i) for i in range(node.children().length())]
            assert "Exchange" in names and "BroadcastExchange" not in names
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_boxes_of_unseen_parts_and_elements_without_a_page(spark):
    """A hidden box frames nothing but is passed on the way up, and what has no page is still found."""
    one = next(e for e in page_of(random.Random(4), 0, 9) if e["parent_id"]) | dict(role=None, classes=[], has_href=False, child_tags=[], background="transparent", shadow="none", border_width=[0.0], border_style=["none"], radius=[0.0], padding=[0.0], visible=True)
    make = lambda i, up, **more: one | dict(id=i, parent_id=up, pre=int(i), last=9, tag="div", input_type=None) | more
    rows = [
        make("0", None, width=300.0, height=60.0, shadow="0 1px 2px red"), make("1", "0", width=250.0, height=50.0, shadow="0 1px 2px red", visible=False),
        make("2", "1", width=200.0, height=40.0, tag="input", input_type="text", visible=False), make("3", None, page=None, tag="textarea"), make("4", None, page=None, tag="textarea", visible=False),
    ]
    got = co.detect_components(spark.createDataFrame([tuple(e[n] for n in NAMES) for e in rows], SCHEMA), PAGE).collect()
    assert {(r.page, r.id, r.type, r.confidence, tuple(r.reasons)) for r in got} == {(0, "0", "input", 0.98, ("native-element",)), (None, "3", "input", 0.98, ("native-element",))}


def test_status_roots_equal_plain_rules(spark):
    rows = []
    for page in range(25):
        rng = random.Random(page)
        rows += [(page, e["id"], e["pre"], e["last"], rng.random() < 0.25, rng.random() < 0.4, rng.random() < 0.85) for e in page_of(rng, page, 30) if rng.random() < 0.7]
    table = spark.createDataFrame(rows, "page int, id string, pre int, last int, native boolean, strong boolean, drawn boolean")
    want = set()
    for page in range(25):
        mine = [r for r in rows if r[0] == page]
        up = {a[1]: [b for b in mine if b[2] < a[2] <= b[3]][::-1] for a in mine}  # nearest first
        native_inside = {b[1] for a in mine if a[4] for b in up[a[1]]}
        counts = {}
        for a in mine:
            if a[5]:
                for b in up[a[1]]:
                    counts[b[1]] = counts.get(b[1], 0) + 1
                    if b[5]:
                        break
        preferred = {a[1] for a in mine if a[6] and (a[4] or (a[1] not in native_inside and (a[5] or counts.get(a[1], 0) < 2)))}
        want |= {(page, a[1]) for a in mine if a[1] in preferred and not any(b[1] in preferred for b in up[a[1]])}
    assert {(r.page, r.id) for r in co.status_roots(table, PAGE).where("root").collect()} == want and len(want) > 40


def test_styles_of_a_type(spark):
    df = spark.sql("SELECT 'card' AS t, map('padding', '1px', 'color', 'red') AS s UNION ALL SELECT 'button', map('padding', '1px', 'color', 'red') UNION ALL SELECT 'list', map('padding', '1px')")
    assert {r.t: r.s for r in df.select("t", co.component_styles(df["t"], df["s"]).alias("s")).collect()} == {"card": {"padding": "1px"}, "button": {"padding": "1px", "color": "red"}, "list": {}}
