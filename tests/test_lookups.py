"""Element usage, colour groups, discovery over stored pages, evidence lookups: against plain versions."""

import random
from collections import Counter

from tessera.operators import color_groups as cg
from tessera.operators import element_usage as eu
from tessera.operators import lookup
from tessera.sources import discovery

ELEMENT = (
    "page int, id int, left double, top double, right double, bottom double, viewport_width double, viewport_height double, background string, border_width array<string>, border_style array<string>, "
    "border_color array<string>, interactive boolean, font_family string, text_chars int, spacing map<string,string>"
)


def test_element_usage(spark):
    none = ["0px"] * 4
    rows = [
        (1, 1, -50.0, 0.0, 50.0, 100.0, 100.0, 100.0, "rgb(1, 2, 3)", ["1px", "2px", "1px", "0px"], ["solid", "solid", "solid", "solid"], ["#ff0000", "#ff0000", "#00ff00", "#0000ff"], False, "Arial", 7, {"marginTop": "4px", "gap": "normal", "rowGap": "4px", "other": "9px"}),
        (1, 2, 0.0, 0.0, 100.0, 0.0, 100.0, 100.0, "transparent", ["1px"] * 4, ["none", "solid", "hidden", "solid"], ["#ff0000", "#ff0000", "#ff0000", "rgba(1, 2, 3, 0)"], True, "Arial", 0, {"paddingLeft": "auto"}),
        (1, 3, 200.0, 0.0, 300.0, 50.0, 100.0, 100.0, "#010203", ["x", "1.5px", None, "1px"], ["solid"] * 4, ["#ff0000", "#ff0000", "#ff0000", "none"], True, "", None, None), (2, 4, 0.0, 0.0, 10.0, 10.0, 0.0, 0.0, None, none, none, none, None, None, None, {}),
    ]
    got = {(r.page, r.category, r.value): round(r.weight, 6) for r in eu.element_usage(spark.createDataFrame(rows, ELEMENT), ["page"]).collect()}
    assert got == {
        (1, "bgColor", "#010203"): 2.0, (1, "bgArea", "#010203"): 0.5, (1, "borderColor", "#ff0000"): 2.0, (1, "borderColor", "#00ff00"): 1.0, (1, "structuralBorderColor", "#ff0000"): 1.0, (1, "structuralBorderColor", "#00ff00"): 1.0,
        (1, "border", "1px solid #ff0000"): 1.0, (1, "border", "2px solid #ff0000"): 1.0, (1, "border", "1px solid #00ff00"): 1.0, (1, "border", "1.5px solid #ff0000"): 1.0, (1, "fontFamily", "Arial"): 2.0, (1, "fontTextFamily", "Arial"): 7.0, (1, "spacing", "4px"): 2.0,
    }


def test_color_groups(spark):
    tokens = [(1, 0, "background", "#ffffff"), (1, 1, "palette-1", "rgb(255, 255, 255)"), (1, 2, "accent", "#ff0000"), (1, 3, "palette-2", "#00ff00"), (1, 4, "palette-3", "#0000ff"), (1, 5, "palette-4", "#123456"), (1, 6, "brand", "#654321"), (1, 7, "x-badge", "#777777"), (2, 0, "accent", "#ff0000"), (2, 1, "primary", "#00ff00"), (2, 2, "odd", "no colour")]
    usage = [(1, "linkColor", "#00ff00", 3.0), (1, "textColor", "rgb(0, 255, 0)", 3.0), (1, "declaredColor", "#654321", 2.0), (1, "brandTokenColor", "#654321", 1.0), (1, "bgColor", "#0000ff", 4.0), (1, "bgArea", "#0000ff", 0.5)]
    sources = [(1, "palette-2", "usage:textColor"), (1, "palette-2", "css:x")]
    f = spark.createDataFrame
    got = cg.color_groups(f(tokens, "site int, ord int, name string, value string"), f(usage, "site int, category string, value string, n double"), f(sources, "site int, name string, source string"), f([(1, "palette-4", 3)], "site int, name string, observations int"), ["site"])
    assert {(r.site, r.label, r.place, r.name, r.score) for r in got.collect()} == {
        (1, "surface", 1, "palette-3", 4.5), (1, "surface", 2, "background", 1.0), (1, "decorative", 1, "accent", 1.0), (1, "text", 1, "palette-2", 4.0), (1, "fallback", 1, "palette-4", 1.0),
        (1, "declared", 1, "brand", 3.0), (1, "status", 1, "x-badge", 1.0), (2, "action", 1, "accent", 1.0), (2, "action", 2, "primary", 1.0),
    }


def walk(seeds, links, most=None):
    """Breadth first, by rank and name within a round."""
    seen, edge, depth = {u: (0, None) for u in seeds}, list(seeds), 0
    while edge:
        depth += 1
        new = {}
        for u in edge:
            for target, rank in links.get(u, []):
                if target is not None and target not in seen:
                    old = new.get(target, (rank, u))
                    new[target] = (min(rank, old[0]), min(u, old[1]))
        order = sorted(new, key=lambda t: (new[t][0], t))
        if most is not None:
            order = order[: max(0, most - sum(d > 0 for d, _ in seen.values()))]
        seen |= {t: (depth, new[t][1]) for t in order}
        edge = order
    return seen


def test_frontier_equals_a_queue(spark):
    rng, links, rows = random.Random(8), {}, []
    for site in ("a", "b", "c"):
        for _ in range({"a": 90, "b": 6, "c": 0}[site]):
            u, t, r = f"{site}{rng.randrange(40)}", rng.choice([f"{site}{rng.randrange(40)}", None]), rng.randrange(5)
            links.setdefault(u, []).append((t, r))
            rows.append((site, u, t, float(r)))
    seeds = [("a", "a0"), ("a", "a1"), ("b", "b3"), ("c", "c0"), ("c", "c0")]
    f = spark.createDataFrame
    table, start = f(rows, "site string, url string, target string, rank double"), f(seeds, "site string, url string")
    for most in (None, 7):
        want = set()
        for site in "abc":
            want |= {(site, u, d, p) for u, (d, p) in walk(sorted({u for s, u in seeds if s == site}), links, most).items()}
        assert {tuple(r) for r in discovery.frontier(start, table, most).collect()} == want
    assert discovery.frontier(start, table, rounds=1).agg({"depth": "max"}).first()[0] == 1


def test_sitemaps(spark):
    loc = lambda *us: "".join(f"<url><loc>{u}</loc></url>" for u in us)
    docs = {
        "https://e.com/robots.txt": "User-agent: *\nSitemap: https://e.com/s1.xml\nsitemap:https://e.com/index.xml\nSitemap: /sitemap.xml", "https://e.com/s1.xml": loc("https://e.com/a", "https://e.com/b#x", "https://other.com/z", "/rel?utm_source=q"),
        "https://e.com/index.xml": "<sitemapindex >" + loc("https://e.com/c1.xml", "https://e.com/gone.xml", "https://e.com/c2.xml"), "https://e.com/c1.xml": loc("https://e.com/a", "https://e.com/c"), "https://e.com/c2.xml": "<sitemapindex>" + loc("https://e.com/deep.xml"),
        "https://e.com/sitemap.xml": loc("https://e.com/d"), "https://e.com/deep.xml": loc("https://e.com/never"), "https://f.com/sitemap_index.xml": loc("https://f.com/x"), "https://e.com/sitemap/sitemap-index.xml": "x" * 2_000_001,
    }
    got = discovery.sitemap_candidates(spark.createDataFrame([("e", "https://e.com/start"), ("f", "https://f.com"), ("g", "https://g.com")], "site string, base string"), spark.createDataFrame(list(docs.items()), "url string, body string"))
    assert [(r.site, r.url) for r in got.orderBy("site", "ord").collect()] == [
        ("e", "https://e.com/a"), ("e", "https://e.com/b"), ("e", "https://e.com/rel"), ("e", "https://e.com/d"), ("e", "https://e.com/c"), ("e", "https://e.com/deep.xml"), ("f", "https://f.com/x"),
    ]


def test_lookups(spark):
    f = spark.createDataFrame
    pages = f([(1, "p1", 0, "https://e.com/a?q", "desktop"), (1, "p2", 1, "https://e.com/a", "mobile"), (1, "p3", 2, "https://e.com/b/", "desktop"), (1, "p4", 3, "https://e.com/c", "desktop")], "site int, page string, ord int, url string, viewport string")
    item = "site int, id string, page string, section string"
    index = lookup.id_index({
        "sections": f([(1, "s1", "p1", None), (1, "dup", "p1", None)], item), "components": f([(1, "c1", "p2", "s1"), (1, "dup", "p3", None)], item), "responsive": f([(1, "r1", None, "s1"), (1, "r2", None, "nowhere")], item), "images": f([(1, "i1", "p9", None)], item),
    }, pages, ["site"])
    got = {r.id: (r.collection, r.page, r.url and r.url[-1], r.viewport) for r in index.collect()}
    assert got == {"s1": ("sections", "p1", "q", "desktop"), "dup": ("sections", "p1", "q", "desktop"), "c1": ("components", "p2", "a", "mobile"), "r1": ("responsive", "p1", "q", "desktop"), "r2": ("responsive", None, None, None), "i1": ("images", "p9", None, None)} | {p: ("pages", p, u, v) for p, u, v in (("p1", "q", "desktop"), ("p2", "a", "mobile"), ("p3", "/", "desktop"), ("p4", "c", "desktop"))}
    cites = f([(1, "k1", i) for i in ("s1", "c1", "p3", "p4", "r1")] + [(1, "k2", "r2"), (1, "k3", "c1")], "site int, claim string, id string")
    assert {(r.claim, tuple(r.scopes), r.more) for r in lookup.claim_scopes(cites, index, ["site"]).collect()} == {("k1", ("https://e.com/a · desktop/mobile", "https://e.com/b/ · desktop"), 1), ("k3", ("https://e.com/a · mobile",), 0)}
    refs = f([(1, "o", i) for i in ("s1", "r2", "i1", "zz", None)], "site int, owner string, id string")
    assert sorted(r.id for r in lookup.dangling_ids(refs, index, ["site"]).collect()) == ["i1", "r2", "zz"]
    owners = f([(1, k, f"e{k}", ["t1"] if k < 11 else ["t1", "t2", "t2"]) for k in range(12)] + [(1, 50, "e3", ["t1"])], "site int, rank int, id string, token_refs array<string>")
    tokens = f([(1, "t1", ["https://e.com/b"]), (1, "t2", []), (1, "t3", ["https://e.com/b", "https://e.com/a#x"]), (1, "t4", ["https://e.com/none"])], "site int, token string, urls array<string>")
    out = {}
    for r in lookup.evidence_of_tokens(tokens, owners, pages, ["site"]).orderBy("token", "place").collect():
        out.setdefault((r.token, r.more), []).append(r.id)
    assert out == {("t1", 4): [f"e{k}" for k in range(8)], ("t2", 0): ["e11"], ("t3", 0): ["p1", "p2", "p3"]}
    assert Counter(r.collection for r in index.collect())["pages"] == 4
