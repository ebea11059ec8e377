"""Stylesheet rows against the tree that a sheet was written from, and the rules over them."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import stylesheets as st

NOISE = ["", " ", "\n", "/* } { ; */", "/**/\t"]
VALUES = ["red", "1px solid rgb(1, 2, 3)", '"};{"', "'a\\'b;'", "url(data:image/png;base64,{x};y)", "url( \"a;b}\" )", "calc((1px + 2px) * 3)", "a\\;b", "[full-start] 1fr"]


def written(rng, depth=0, stack=(), parents=(), out=None, counter=None):
    """A sheet and the rows that it stands for: (kind, stack, parents, selector, property, value, important)."""
    n = lambda: rng.choice(NOISE)
    text = ""
    for _ in range(rng.randint(1, 4)):
        if rng.random() < 0.35 and depth < 4:
            prelude = rng.choice(["@media (min-width: 40em)", "@container card (width > 300px)", "@supports (display: grid)", "@layer base", "@keyframes k", "@font-face"])
            out.append(("at", stack, parents, None, None, prelude, False))
            inner = written(rng, depth + 1, (*stack, prelude), parents, out)
            text += n() + prelude.replace(" ", "  ") + n() + "{" + inner + "}" + n()
        else:
            selector = rng.choice([".a", "a:hover > b", 'x[y="}"]', ".b::before, .c:focus", ":root", "&:active"])
            text += n() + selector + n() + "{" + n()
            for _ in range(rng.randint(0, 3)):
                name = rng.choice(["color", "--x-Y", "background-image", "Width", "-webkit-box"])
                value = "{a: b; {c}}" if name == "--x-Y" and rng.random() < 0.3 else rng.choice(VALUES)
                bang = rng.random() < 0.2
                out.append(("declaration", stack, parents, selector, name if name.startswith("--") else name.lower(), value, bang))
                text += name + n() + ":" + n().replace("\n", " ") + value + (" ! important" if bang else "") + n() + ";" + n()
            if rng.random() < 0.15 and depth < 4:
                text += written(rng, depth + 1, stack, (*parents, selector), out)
            text += "}"
    return text


def test_rows_of_fuzzed_sheets():
    for seed in range(400):
        rng, want = random.Random(seed), []
        sheet = written(rng, out=want)
        got = [(kind, tuple(stack), tuple(parents), selector, prop, value, bang) for kind, _, _, stack, parents, selector, prop, value, bang in st.parse(sheet)]
        assert got == want, sheet


@pytest.mark.parametrize(("text", "rows"), [
    ("", []), ("}}} a{b:c", [("a", "b", "c")]), ("a{b:c;;d}", [("a", "b", "c")]), ("a{b:'x", [("a", "b", "'x")]), ("a{/* b:c", []), ("@import url(x.css);a{b:c}", [("a", "b", "c")]),
    ("a{b:(;)}c{d:e}", [("a", "b", "(;)"), ("c", "d", "e")]), ("a{1x:y;b:c!IMPORTANT}", [("a", "b", "c")]), ("a{u:unset;url:url(unclosed", [("a", "u", "unset"), ("a", "url", "url(unclosed")]), ("a{b:c\\}d}", [("a", "b", "c\\}d")]),
])
def test_broken_sheets(text, rows):
    assert [r[5:8] for r in st.parse(text) if r[0] == "declaration"] == rows


def parsed(spark, *sheets):
    return st.rules(spark.createDataFrame([(i, s, "x") for i, s in enumerate(sheets)], "page int, css string, kind string"), ["page"])


def test_rows_keep_their_pages(spark, monkeypatch):
    monkeypatch.setattr(st, "BATCH_ROWS", 3)
    some = parsed(spark, "a{b:c}" * 10, None, "", "@media x{" + "d{e:f}" * 5 + "}")
    assert sorted(some.groupBy("page", "kind").count().collect()) == [(0, "declaration", 10), (3, "at", 1), (3, "declaration", 5)]
    assert [r.ord for r in some.where("page = 3").orderBy("ord").collect()] == [0, 1, 2, 3, 4, 5]
    assert parsed(spark, "a{b:c}").where("false").count() == 0


def test_state_rules(spark):
    css = "a:hover,a:focus{COLOR:red;color:blue;margin:0;background-color:url(x)} b{color:red} @media p{c:active{width:1px}} d{&:hover{color:red}} @keyframes e{f:hover{color:red}} g:hover{filter:url (#x)}"
    got = sorted((r.state, r.selector, tuple(sorted(r.styles.items()))) for r in st.state_rules(parsed(spark, css), ["page"]).collect())
    assert got == [("active", "c:active", (("width", "1px"),)), ("focus", "a:hover,a:focus", (("color", "blue"),)), ("hover", "a:hover,a:focus", (("color", "blue"),))]


def test_breakpoint_counts(spark):
    css = "@media (min-width:640px) and (MAX-WIDTH: 80em){} @media (640px <= width < 1024px){@container c (width>30rem){}} @media (min-width:639.6px){} @supports (width:1px){} @media print{} @media (min-width:0px){}"
    assert sorted((r.width, r.n) for r in st.breakpoint_counts(parsed(spark, css), ["page"]).collect()) == [(480, 1), (640, 3), (1024, 1), (1280, 1)]
    assert sorted(r.width for r in st.breakpoint_counts(parsed(spark, "@media (width<10em){}"), ["page"], F.lit(20.0)).collect()) == [200]


def test_motion(spark):
    css = (
        "a{transition:opacity 200ms cubic-bezier(.4, 0, .2, 1), transform .5s 1s} b{transition:all .2s} c{transition:all 200ms ease} d{transition:none 1s} e{transition:color}"
        "f{animation:spin 1s linear infinite;animation-duration:250ms} g{animation-name:x, y;animation-duration:1s} h{transition-duration:.1s;transition:width 2s}"
    )
    rows = st.motion_rules(parsed(spark, css), ["page"])
    got = {(r.property, r.duration, r.easing, r.n) for r in st.top_motion(rows, ["page"], ["rule"]).collect()}
    assert got == {
        ("opacity, transform", "0.2s, 0.5s", "cubic-bezier(.4, 0, .2, 1), ease", 1), ("all", "0.2s", "ease", 2), ("animation:spin", "0.25s", "linear", 1),
        ("animation:x, y", "1s", "ease", 1), ("width", "2s", "ease", 1),
    }
    assert [r.property for r in st.top_motion(rows, ["page"], ["rule"]).orderBy("ord").collect()][:2] == ["all", "opacity, transform"]


def test_variable_colors(spark):
    css = (
        ":root, .x{--brand: #102030;--primary-hover:#111111;--brand-error:rgb(1,2,3);--size:1px;--Card-bg: rgba(1, 2, 3, 0.5);--ring:transparent}"
        "html{--brand:#445566} @layer t{:root{--accent:var(--a1);--a1:var(--brand, red);--border:var(--none, #0a0b0c);--loop-link:var(--loop-link)}} .y{--cta:#fff} :root{a{--muted:#000}}"
    )
    variables = st.resolved(st.root_variables(parsed(spark, css), ["page"], ["page"]), ["page"])
    got = {(r.category, r.value, r.weight) for r in st.variable_colors(variables, ["page"]).collect()}
    assert got == {
        ("declaredColor", "#445566", 2), ("brandTokenColor", "#445566", 2), ("declaredColor", "#111111", 1), ("declaredColor", "#010203", 1),
        ("declaredColor", "rgba(1, 2, 3, 0.5)", 1), ("declaredColor", "#0a0b0c", 1),
    }


def test_sheets_of_a_page(spark):
    html = "<!-- <style>no{a:b}</style> --><STYLE media=x>a{b:c}</style><script>'<style>no{}</style>'</script><style>d{e:f}</style>"
    got = st.sheets(spark.createDataFrame([(1, html), (2, None), (3, "")], "page int, html string"), ["page"]).collect()
    assert [(r.page, r.sheet, r.css) for r in got] == [(1, 0, "a{b:c}"), (1, 1, "d{e:f}")]
