"""Colour tokens end to end, against plain lists, and from snapshots."""

import json
import random
import re

from tessera.operators import color_roles  # noqa: F401
from tessera.plans import analysis, colors, exports
from tessera.sources import snapshots

G = ["site"]
USAGE = "site int, ord int, category string, value string, n double"
OBSERVED = "site int, ord int, role string, status_kind string, status_intent string, background string, foreground string, element string"


def rgb(v):
    m = re.match(r"rgba?\((\d+),\s*(\d+),\s*(\d+)(?:,\s*([\d.]+))?\)", v)
    if m:
        return (*map(int, m.groups()[:3]), float(m[4] or 1))
    m = re.match(r"^#([0-9a-f]{6})$", v)
    return (*(int(m[1][i : i + 2], 16) for i in (0, 2, 4)), 1.0) if m else None


def normal(v):
    c = rgb(v)
    if c is None:
        return None
    return f"rgba({c[0]}, {c[1]}, {c[2]}, {c[3]:.3f}".rstrip("0").rstrip(".") + ")" if c[3] < 0.999 else "#%02x%02x%02x" % c[:3]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a[:3], b[:3], strict=True)) ** 0.5


def cluster(freq, threshold=30):
    found = []
    for v, n in freq.items():
        if rgb(v):
            near = next((c for c in found if far(rgb(c[0][0]), rgb(v)) < threshold), None)
            (near.append((v, n)) if near else found.append([(v, n)]))
    found = sorted(found, key=lambda c: -sum(n for _, n in c))[:20]
    return [normal(max(c, key=lambda m: m[1])[0]) for c in found]


def chroma(c):
    return max(c[:3]) - min(c[:3])


def light(c):
    r, g, b = (x / 255 / 12.92 if x / 255 <= 0.03928 else ((x / 255 + 0.055) / 1.055) ** 2.4 for x in c[:3])
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def usable(v):
    c = rgb(v)
    return c[3] > 0.1 and chroma(c) >= 32 and chroma(c) / max(1, *c[:3]) >= 0.3 and 0.015 < light(c) < 0.97


def plain(rows):
    """rows: (category, value, n) in order."""

    def of(*names):
        out = {}
        for name in names:
            for c, v, n in rows:
                if c == name and n > 0:
                    out[v] = out.get(v, 0) + n
        return out

    general = of("textColor", "bgColor", "borderColor", "declaredColor")
    palette = cluster(general)
    if not palette:
        return {"palette": [], "backgrounds": [], "texts": [], "accents": []}
    back, texts = cluster(of("bgArea") or of("bgColor"), 12), cluster(of("textColor"))
    back[1:] = sorted(back[1:], key=lambda v: far(rgb(back[0]), rgb(v)))
    texts[1:] = sorted(texts[1:], key=lambda v: far(rgb(texts[0]), rgb(v)) + chroma(rgb(v)) / max(1, *rgb(v)[:3]) * 250)
    primary, action = of("primaryActionBackgroundColor") or of("primaryActionColor"), of("actionBackgroundColor") or of("actionColor")
    against = of(*colors.AGAINST)
    total = {}
    for part, w in ((primary, 20), (action, 16), (of("selectedColor"), 12), (of("accentColor"), 8), (of("linkColor"), 6), (general, 1), (against, -50)):
        for v, n in part.items():
            total[v] = total.get(v, 0) + n * w
    total = {v: n for v, n in total.items() if n > 0}
    brand, selected = of("brandTokenColor"), of("selectedColor")
    accents = []
    for part in (primary, action, brand, selected, total):
        accents += [v for v in cluster(part) if usable(v) and v not in accents]
    allowed = {normal(v) for part in (primary, action, brand, selected) for v in part}
    banned = {normal(v) for v in against} - allowed
    return {"palette": palette, "backgrounds": back, "texts": texts, "accents": [v for v in accents if v not in banned]}


def test_clusters_equal_plain_lists(spark):
    names = [*colors.GENERAL, "bgArea", "primaryActionBackgroundColor", "primaryActionColor", "actionBackgroundColor", "actionColor", "selectedColor", "accentColor", "linkColor", "brandTokenColor", *colors.AGAINST]
    rows = {}
    for site in range(14):
        rng = random.Random(site)
        tone = lambda: rng.choice([f"rgb({rng.randrange(0, 256, 25)}, {rng.randrange(0, 256, 51)}, {rng.randrange(0, 256, 85)})", "#%02x%02x%02x" % (rng.randrange(0, 256, 17), 40, 90), "rgba(10, 20, 30, 0.5)", "inherit"])
        some = {(rng.choice(names[: rng.choice([4, 5, len(names)])]), tone()) for _ in range(rng.choice([0, 3, 60, 150]))}
        rows[site] = [(c, v, float(rng.randint(1, 40) * 1000 + k)) for k, (c, v) in enumerate(sorted(some))]
    table = spark.createDataFrame([(site, i, *r) for site, part in rows.items() for i, r in enumerate(part)], USAGE)
    found = {k: df.collect() for k, df in colors.cluster_colors(table, G).items()}
    for site, part in rows.items():
        want = plain(part)
        for k, got in found.items():
            mine = [r.value for r in sorted((r for r in got if r.site == site), key=lambda r: r.ord)]
            assert mine == want[k], (site, k)


def test_names_of_colours(spark):
    usage = [
        (1, "bgArea", "#ffffff", 50), (1, "bgArea", "#f4f4f4", 20), (1, "textColor", "#111111", 40), (1, "textColor", "#777777", 9), (1, "bgColor", "#ffffff", 9), (1, "actionBackgroundColor", "#1050c0", 5), (1, "actionBackgroundColor", "#c01050", 2),
        (1, "structuralBorderColor", "#fefefe", 9), (1, "structuralBorderColor", "#cccccc", 5), (1, "declaredColor", "#00aa00", 1),
        (2, "bgColor", "#000000", 3), (2, "textColor", "#ffffff", 3), (2, "linkColor", "#ee3300", 8), (2, "textColor", "#ee3300", 2), (3, "borderColor", "inherit", 1),
    ]
    seen = [(1, "action", None, None, "#1050c0", "#ffffff", "e1"), (1, "action", None, None, "#c01050", "#ffffff", "e2"), (1, "action", None, None, "#c01050", "#ffffff", "e3"), (1, "status", "status", "warning", "#ffee00", "#000000", "e4")]
    u = spark.createDataFrame([(s, i, c, v, float(n)) for i, (s, c, v, n) in enumerate(usage)], USAGE)
    o = spark.createDataFrame([(s, i, *r) for i, (s, *r) in enumerate(seen)], OBSERVED)
    tokens = colors.color_tokens(u, o, G)
    got = {(r.site, r.name): r.value for r in tokens.collect()}
    assert got == {
        (1, "background"): "#ffffff", (1, "surface"): "#f4f4f4", (1, "secondary"): "#f4f4f4", (1, "foreground"): "#111111", (1, "muted-foreground"): "#777777", (1, "primary"): "#1050c0", (1, "accent"): "#c01050",
        (1, "border"): "#cccccc", (1, "border-subtle"): "#fefefe", (1, "palette-4"): "#00aa00",
        (2, "background"): "#000000", (2, "foreground"): "#ffffff", (2, "muted-foreground"): "#ee3300", (2, "editorial-accent"): "#ee3300",
    }
    pairs = {(r.name, r.background, r.foreground, r.warning) for r in colors.color_pairs(tokens, o, G).collect()}
    assert pairs == {("primary-action", "#1050c0", "#ffffff", False), ("status-warning", "#ffee00", "#000000", None)}


def test_raw_colours_fill_in(spark):
    u = spark.createDataFrame([(1, 0, "textColor", "#111111", 3.0)], USAGE)
    raw = spark.createDataFrame([(1, 0, "#111111"), (1, 1, "#ff0000"), (1, 2, "#ff0000"), (2, 0, "#00ff00"), (2, 1, "#00ff00")], "site int, ord int, value string")
    got = {(r.site, r.value): r.n for r in colors.general_frequency(u, raw, G).collect()}
    assert got == {(1, "#111111"): 3.0, (1, "#ff0000"): 1.0, (2, "#00ff00"): 2.0}


def test_analysis_has_colour_tokens(spark, tmp_path):
    act = {"captureId": "c", "elementRef": "e", "elementKind": "button", "role": "primary-action", "background": "rgb(16, 80, 192)", "foreground": "rgb(255, 255, 255)"}
    counts = {"bgColor:rgb(255, 255, 255)": 9, "textColor:rgb(17, 17, 17)": 9, "primaryActionBackgroundColor:rgb(16, 80, 192)": 2, "spacing:8px": 4}
    lines = [json.dumps({"analysisId": "a", "url": f"https://e.com/{i}", "viewport": "desktop", "styles": {"usageCount": counts, "colorRoleObservations": [act]}, "health": {"status": "healthy", "issues": []}}) for i in range(2)]
    (tmp_path / "x.json").write_text("\n".join(lines))
    out = analysis.analyse(snapshots.read_snapshots(spark, str(tmp_path)))
    assert {r.name: r.value for r in out["colors"].collect()} == {"background": "#ffffff", "foreground": "#111111", "primary": "#1050c0"}
    assert [(r.name, r.background, r.observations) for r in out["color_pairs"].collect()] == [("primary-action", "#1050c0", 2)]
    named = out["colors"].selectExpr("analysisId", "'colors' AS `group`", "name AS ord", "value")
    css = exports.export(named, ["analysisId"], "css")["css"].first()["text"] if "css" in exports.export(named, ["analysisId"], "css") else ""
    assert "#1050c0" in css
