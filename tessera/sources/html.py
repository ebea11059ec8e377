"""Links and identity from stored HTML, by expressions. Static HTML gives declared values, never what a browser renders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, url
from ..functions.binding import let

#: What a link's place adds to its page's score.
PLACE_SCORES = {"nav": 24, "header": 24, "main": 24, "article": 24, "footer": -20}


def _blocks(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))


def _hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*\bhref=[\"']([^\"']*)[\"']"), F.lit(1))


def links(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """keep, href, location: each link with the score of the part of the page that it stands in, 0 for none. Comments, scripts and styles are left out."""
    bare = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    parts = pages.select(*keep, bare.alias("_h"))

    def placed(hrefs: Column, score: int) -> Column:
        return F.transform(hrefs, lambda h: F.struct(h.alias("href"), F.lit(score).alias("location")))

    found = [placed(F.flatten(F.transform(_blocks(F.col("_h"), tag), _hrefs)), score) for tag, score in PLACE_SCORES.items()]
    rest = F.regexp_replace(F.col("_h"), "(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in PLACE_SCORES), "")
    found.append(placed(_hrefs(rest), 0))
    return parts.select(*keep, F.explode(F.concat(*found)).alias("_l")).select(*keep, "_l.href", "_l.location")


def resolve(href: Column, base: Column) -> Column:
    """An absolute URL from an absolute or root-relative link; null for other links."""
    return F.when(href.rlike("^(?i:https?)://"), href).when(href.rlike("^/(?!/)"), F.concat(url.origin(base), href))


def candidates(pages: DataFrame, site: Column, page_url: str = "url", html: str = "html") -> DataFrame:
    """site, url, kind, family, score, source, contextual: every page that links lead to within their own origin, scored."""
    rows = links(pages.select(site.alias("site"), F.col(page_url).alias("_base"), html), ["site", "_base"], html)

    def scored(base: Column, u: Column, p: Column) -> Column:
        root = F.regexp_replace(url.path(base), "/$", "")
        root = F.when(root == "", F.lit("/")).otherwise(root)
        contextual = (root != "/") & F.startswith(p, F.concat(root, F.lit("/")))
        family = F.coalesce(F.get(url.segments(p), F.lit(0)), F.lit(""))
        made = F.struct(u.alias("url"), url.page_kind(p).alias("kind"), family.alias("family"), url.page_score(p, url.query(u), F.col("location"), root).alias("score"), F.lit("dom").alias("source"), contextual.alias("contextual"))
        return F.when(u.isNotNull() & url.same_origin(u, base), made)

    # One bound expression for each link: a filter on its fields copies it once, not once for each use.
    row = let(F.col("_base"), lambda base: let(resolve(F.col("href"), base), lambda full: let(url.crawl_url(full), lambda u: let(url.path(u), lambda p: scored(base, u, p)))))
    return rows.select("site", row.alias("_r")).where("_r.score is not null").select("site", "_r.*")


def title(html: Column) -> Column:
    """The page's title with the five basic entities decoded."""
    raw = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return text.identity(raw)


def sitemap_urls(xml: Column) -> Column:
    """The locations of a sitemap, entities decoded."""
    def decode(x: Column) -> Column:
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            x = F.replace(x, F.lit(entity), F.lit(char))
        return F.trim(x)

    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), decode)


def breakpoints(css: Column) -> Column:
    """Widths in px of min-width, max-width and range conditions in CSS text."""
    old = F.regexp_extract_all(css, F.lit(r"(?i)(?:min|max)-width\s*:\s*(\d*\.?\d+(?:px|em|rem))"), F.lit(1))
    new = F.regexp_extract_all(css, F.lit(r"(?i)width\s*[<>]=?\s*(\d*\.?\d+(?:px|em|rem))"), F.lit(1))
    from ..functions.css import length_px

    return F.transform(F.concat(old, new), lambda v: F.floor(length_px(v) + 0.5).cast("int"))


def interaction_rules(css: Column) -> Column:
    """struct(selector, state, body) of the rules for :hover, :focus and :active whose values hold no url() or data."""
    rules = F.regexp_extract_all(css, F.lit(r"(?is)([^{}]+?:(?:hover|focus|active)[^{}]*\{[^{}]*\})"), F.lit(1))
    made = F.transform(rules, lambda r: F.struct(F.trim(F.regexp_extract(r, r"(?s)^([^{]*)\{", 1)).alias("selector"), F.lower(F.regexp_extract(r, r"(?i):(hover|focus|active)", 1)).alias("state"), F.trim(F.regexp_extract(r, r"(?s)\{(.*)\}", 1)).alias("body")))
    return F.filter(made, lambda r: ~r["body"].rlike(r"(?i)url\(|data:"))
