import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import color, css, ids, numbers, text, url


@pytest.fixture
def one(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    return value


@pytest.mark.parametrize(
    ("given", "route", "page"),
    [
        ("https://user:pw@Example.com:443/a/b/?q=1#x", "https://example.com/a/b", "https://example.com/a/b/"),
        ("http://example.com:80", "http://example.com/", "http://example.com/"),
        ("http://example.com:8080///", "http://example.com:8080/", "http://example.com:8080///"),
        ("not a url?x#y", "not a url", "not a url"),
    ],
)
def test_identity(one, given, route, page):
    assert one(url.route_identity(F.lit(given))) == route
    assert one(url.page_identity_url(F.lit(given))) == page


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("https://e.com/a//b/?utm_source=x&b=2&a=1&ref=q#f", "https://e.com/a/b?a=1&b=2"),
        ("https://e.com/", "https://e.com/"),
        ("https://e.com/a%0Ab", None),
        ("https://e.com/a'b", None),
        ("ftp://e.com/a", None),
    ],
)
def test_crawl_url(one, given, expected):
    assert one(url.crawl_url(F.lit(given))) == expected


@pytest.mark.parametrize(
    ("path", "query", "location", "base", "kind", "score"),
    [
        ("/pricing", "", 24, "/", "pricing", 160),
        ("/login", "", 24, "/", "generic", None),
        ("/docs/a/b", "", 0, "/", "docs", 102),
        ("/x/123", "p=1", 0, "/", "generic", 65),
        ("/posts/123", "", 0, "/", "content", 110),
        ("/app/pricing/x", "", 0, "/app", "pricing", 124),
        ("/app", "", 0, "/app", "generic", None),
        ("/2024/05/x", "", 0, "/", "generic", None),
    ],
)
def test_page_score(one, path, query, location, base, kind, score):
    assert one(url.page_kind(F.lit(path))) == kind
    assert one(url.page_score(F.lit(path), F.lit(query), F.lit(location), F.lit(base))) == score


def test_redact_urls(one):
    given = "see https://u:p@e.com/a?token=1#x, and http://f.org/b."
    assert one(url.redact_urls(F.lit(given))) == "see https://e.com/a and http://f.org/b."
    assert one(url.sanitised(F.lit("me@host/path?x"))) == "host/path"


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("rgb(255, 0, 10)", "#ff000a"),
        ("rgba(255,0,10,0.5)", "rgba(255, 0, 10, 0.5)"),
        ("rgba(1 2 3 / 0.9995)", "#010203"),
        ("#AbC", "#aabbcc"),
        ("#aabbcc", "#aabbcc"),
        ("red", None),
        (None, None),
    ],
)
def test_normal_color(one, given, expected):
    assert one(color.normal(F.lit(given).cast("string"))) == expected


def test_color_grammars_differ(one):
    assert one(color.token_channels(F.lit("#abc"))) is None
    assert one(color.token_channels(F.lit("rgb(1.5, 2, 3)")))["r"] == 1.5
    assert one(color.recipe_channels(F.lit("rgb(1,2,3)"))) is None
    assert one(color.tag_channels(F.lit("rgba(1,2,3,.2)")))["a"] == 1.0


def test_color_measures(one):
    black, white, half = (color.channels(F.lit(c)) for c in ("#000000", "#ffffff", "rgba(0,0,0,0.5)"))
    assert one(color.contrast(black, white)) == pytest.approx(21)
    assert one(color.contrast(half, white)) < 6
    assert one(color.distance(black, white)) == pytest.approx(math.sqrt(3) * 255)
    assert [one(color.hue_family(color.channels(F.lit(c)))) for c in ("#ff0000", "#00ff00", "#0000ff", "#888888")] == [0, 4, 8, 0]
    assert one(color.neutral(color.channels(F.lit("#808085"))))
    assert not one(color.neutral(color.channels(F.lit("#ff0000"))))
    assert one(color.equal(F.lit("RGB(255,255,255)"), F.lit("#fff")))
    assert one(color.transparent(F.lit("rgba(0, 0, 0, 0)")))
    assert one(color.slug(F.lit("rgba(255,0,0,0.5)"))) == "ff0000-80"


@pytest.mark.parametrize(("given", "px"), [("12px", 12.0), ("1.5rem", 24.0), ("-2em", -32.0), ("7", 7.0), ("10%", None), ("", None)])
def test_length(one, given, px):
    assert one(css.length_px(F.lit(given))) == px


@pytest.mark.parametrize(("px", "expected"), [(11.9062, 12.0), (12.31, 12.31), (12.45, 12.5), (0.1234, 0.123), (-0.04, 0.0)])
def test_subpixel(one, px, expected):
    assert one(css.subpixel(F.lit(px))) == pytest.approx(expected)


def test_css_values(one):
    assert one(css.duration_ms(F.lit("0.3s"))) == pytest.approx(300)
    assert one(css.duration_ms(F.lit("fast"))) == float("inf")
    assert one(css.px_to_rem(F.lit(20.0))) == "1.25rem"
    assert one(css.grid_columns(F.lit("repeat(3, 1fr)"))) == 3
    assert one(css.grid_columns(F.lit("1fr minmax(0, 1fr) 200px"))) == 3
    assert one(css.bounded_px(F.lit("241px"))) is None
    assert one(css.transform_matrix(F.lit("translateY(-2px)"))) == one(css.transform_matrix(F.lit("matrix(1, 0, 0, 1, 0, -2)")))
    assert one(css.font_normal(F.lit('"Open  Sans"'))) == "open sans"
    assert one(css.shadow_elevation(F.lit("rgba(0,0,0,.5) 4px 2px 8px 2px"))) == pytest.approx(12)
    assert not one(css.visible_shadow(F.lit("none")))
    assert one(css.visible_shadow(F.lit("0px 1px 2px #00000080")))
    g = one(css.gradient(F.lit("linear-gradient(to right, rgba(0,0,0,.1), #fff)")))
    assert (g["kind"], g["direction"], len(g["stops"])) == ("linear", "to right", 2)
    assert one(css.gradient(F.lit("linear-gradient(url(x), #fff)"))) is None
    assert one(css.uniform_radius(F.array(*[F.lit("4px")] * 4))) == "4px"


def test_numbers(one):
    assert one(numbers.half_up(F.lit(-2.5))) == -2
    assert one(numbers.plain(F.lit(1.500), 3)) == "1.5"
    assert one(numbers.plain(F.lit(100.0), 3)) == "100"
    assert one(numbers.clamp(F.lit(float("nan")), 0, 1)) is None


def test_text(one):
    assert one(text.identity(F.lit("(3)  Inbox\n x"))) == "Inbox x"
    assert one(text.identity(F.lit("  "))) is None
    assert not one(text.meaningful(F.lit("Just a moment...")))
    assert one(text.meaningful(F.lit("Acme")))
    assert not one(text.meaningful(F.lit(None).cast("string")))
    none = F.lit(None).cast("string")
    assert one(text.site_name(none, none, F.lit("Home | Acme"), F.lit("healthy"), F.array())) == "Acme"
    assert one(text.site_name(F.lit("Acme"), none, none, F.lit("unusable"), F.array())) is None
    assert sorted(one(text.terms(F.lit("Big-data, a 设计系统!")))) == sorted(["big-data", "设计", "计系", "系统"])
    assert one(text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1
    assert one(text.relevance(F.lit("Primary Button"), F.array(F.lit("button"), F.lit("b")))) == 1


def test_ids(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, o int")
    got = {(r.k, r.o): r.id for r in ids.with_instance_ids(rows, "section", ["k"], ["o"]).collect()}
    assert len(set(got.values())) == 3
    assert got["b", 1] == spark.range(1).select(ids.stable_id("section", F.lit("b")).alias("i")).first()["i"]
    assert all(v.startswith("section-") and len(v) == 20 for v in got.values())
