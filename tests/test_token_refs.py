"""Token references of styles: namespaces, spellings, ratios."""

from tessera.operators import token_refs as tr

G = ["site"]


def test_references_follow_the_property(spark):
    tokens = [
        ("spacing.1", "16px"), ("radius.1", "16px"), ("typography.font-size.1", "1rem"), ("color.ink", "rgb(17, 17, 17)"), ("border.1", "1px solid #cccccc"), ("shadow.1", "0px 1px 2px rgba(0, 0, 0, 0.5)"), ("typography.font-family.1", "Inter"),
        ("typography.font-stack.1", '"Inter", sans-serif'), ("typography.line-height.1", "1.5"), ("typography.font-weight.1", "700"), ("z-index.1", "10"), ("transition.1", "200ms"), ("typography.letter-spacing.1", "0.5px"),
    ]
    styles = [
        (1, "a", {"paddingTop": "16px", "color": "#111111", "backgroundColor": "RGB(17,17,17)", "fontSize": "16px", "lineHeight": "24px", "width": "16px"}), (1, "b", {"borderRadius": "16px 0px", "border": "1px solid #cccccc", "boxShadow": "0px 1px 2px rgba(0, 0, 0, 0.5)"}),
        (1, "c", {"fontFamily": "inter,  sans-serif", "fontWeight": "700", "zIndex": "10", "transitionDuration": "color 200ms", "letterSpacing": "0.5px"}), (1, "d", {"fontFamily": '"Inter"', "marginLeft": "1rem 4px", "outline": "16px"}), (2, "a", {"paddingTop": "16px"}), (1, "f", {"boxShadow": "0px 9px 9px rgba(0, 0, 0, 0.5)", "color": "rgba(17, 17, 17, 0.5)"}), (1, "e", {"fontSize": "16px", "lineHeight": "normal", "gap": None}),
    ]
    f = spark.createDataFrame
    got = tr.style_token_refs(f(styles, "site int, id string, styles map<string,string>"), f([(1, *t) for t in tokens], "site int, ref string, value string"), G)
    assert {(r.site, r.id): r.refs for r in got.collect()} == {
        (1, "a"): ["color.ink", "spacing.1", "typography.font-size.1", "typography.line-height.1"], (1, "b"): ["border.1", "radius.1", "shadow.1"],
        (1, "c"): ["transition.1", "typography.font-weight.1", "typography.letter-spacing.1", "z-index.1"], (1, "d"): ["spacing.1", "typography.font-family.1"], (2, "a"): [], (1, "f"): [], (1, "e"): ["typography.font-size.1"],
    } | {(1, "c"): ["transition.1", "typography.font-stack.1", "typography.font-weight.1", "typography.letter-spacing.1", "z-index.1"]}


def test_sources_are_united(spark):
    rows = [(1, 0, "k", "a"), (1, 1, "k", "b"), (1, 2, "k", "a"), (1, 3, "m", "a"), (2, 4, "k", "a")]
    got = tr.merged_sources(spark.createDataFrame(rows, "site int, ord int, key string, source string"), G)
    assert {tuple(r) for r in got.collect()} == {(1, "k", "a", 0), (1, "k", "b", 1), (1, "m", "a", 3), (2, "k", "a", 4)}
