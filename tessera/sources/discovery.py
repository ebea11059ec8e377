"""Discovery over stored pages and sitemaps: rounds from the entry pages outward, and the candidates that sitemaps name.

Nothing is fetched: documents are rows of (url, body). A round is one join of the frontier with the links and one anti-join with what was seen; each is
checkpointed, so the plan does not grow with the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url
from ..operators.ranking import top
from ..staging import cut
from .html import sitemap_urls

# Where sitemaps are by convention, and how many roots, children and characters are read.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap-index.xml")
MOST_ROOTS, MOST_CHILDREN, MOST_CHARS = 8, 12, 2_000_000
INDEX = r"(?i)<sitemapindex(?:\s|>)"


def declared_sitemaps(robots: Column) -> Column:
    """The addresses of a robots.txt's Sitemap lines, in order."""
    return F.regexp_extract_all(robots, F.lit(r"(?im)^sitemap:[^\S\n]*(\S+)\s*$"), F.lit(1))


def _bodies(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("url").alias("at"), "body").where(F.col("body").isNotNull() & (F.length("body") <= MOST_CHARS))


def _resolved(href: Column, origin: Column) -> Column:
    return url.crawl_url(F.when(href.rlike("^/(?!/)"), F.concat(origin, href)).otherwise(href))


def sitemap_candidates(sites: DataFrame, documents: DataFrame) -> DataFrame:
    """site, url, ord: pages that the sitemaps of each site name, each once, in the order of the documents.

    sites: site, base (the site's URL); documents: url, body, robots.txt and sitemaps among them, each URL once. Roots are what robots.txt declares, then the usual places; indexes lead to
    their children, one level deep, as deeper ones are not followed. A body beyond MOST_CHARS counts as missing.
    """
    held = _bodies(documents)
    based = sites.select("site", url.origin(F.col("base")).alias("origin"))
    robots = based.join(held, F.col("at") == F.concat("origin", F.lit("/robots.txt")), "left")
    usual = F.array(*(F.concat("origin", F.lit(p)) for p in SITEMAP_PATHS))
    named = F.concat(F.coalesce(declared_sitemaps(F.col("body")), F.array().cast("array<string>")), usual)
    roots = robots.select("site", "origin", F.posexplode(named).alias("pos", "href")).select("site", "origin", "pos", _resolved(F.col("href"), F.col("origin")).alias("at")).where("at is not null")
    roots = roots.groupBy("site", "origin", "at").agg(F.min("pos").alias("pos"))
    roots = top(roots, ["site"], [F.col("pos")], MOST_ROOTS, "place").join(held, "at")
    roots = cut(roots.select("site", "origin", F.col("place").alias("root"), "body", F.col("body").rlike(INDEX).alias("index")))
    children = roots.where("index").select("site", "origin", "root", F.posexplode(sitemap_urls(F.col("body"))).alias("pos", "href"))
    children = children.select("site", "origin", "root", "pos", _resolved(F.col("href"), F.col("origin")).alias("at")).where("at is not null")
    children = top(children, ["site"], [F.col("root"), F.col("pos")], MOST_CHILDREN, "place").join(held, "at")
    pages = roots.where("not index").select("site", "origin", "root", "body").unionByName(children.select("site", "origin", (F.col("place") + MOST_ROOTS).alias("root"), "body"))
    found = pages.select("site", "origin", "root", F.posexplode(sitemap_urls(F.col("body"))).alias("pos", "href"))
    found = found.select("site", "origin", F.struct("root", "pos").alias("at"), _resolved(F.col("href"), F.col("origin")).alias("url")).where(F.col("url").isNotNull() & (url.origin(F.col("url")) == F.col("origin")))
    first = found.groupBy("site", "url").agg(F.min("at").alias("at"))
    return first.select("site", "url", F.row_number().over(Window.partitionBy("site").orderBy("at")).alias("ord"))


def frontier(seeds: DataFrame, links: DataFrame, most: int | None = None, rounds: int | None = None) -> DataFrame:
    """site, url, depth, parent: what is reached from the seeds of each site over links, each URL once, at its least depth.

    seeds: site, url; links: site, url (of the page), target, rank (what comes first is taken first). A page reached by several pages of one round belongs to the smallest URL. most bounds the pages of a site beyond its
    seeds, in order of depth, rank and URL; None bounds nothing, and the rounds end when nothing new is reached, at the longest shortest path. Cycles and repeated links cost nothing.
    """
    start = seeds.select("site", "url").distinct().select("site", "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("double").alias("rank"))
    seen = cut(start)
    edge, depth = seen, 0
    while rounds is None or depth < rounds:
        depth += 1
        led = edge.select("site", F.col("url").alias("parent")).join(links.select("site", F.col("url").alias("parent"), F.col("target").alias("url"), F.col("rank").cast("double").alias("rank")), ["site", "parent"])
        new = led.where("url is not null").groupBy("site", "url").agg(F.min("parent").alias("parent"), F.min("rank").alias("rank")).join(seen.select("site", "url"), ["site", "url"], "left_anti")
        if most is not None:
            had = seen.where("depth > 0").groupBy("site").agg(F.count(F.lit(1)).alias("_had"))
            new = top(new, ["site"], [F.col("rank"), F.col("url")], most, "_r").join(had, "site", "left").where(F.col("_r") + F.coalesce("_had", F.lit(0)) <= most).drop("_r", "_had")
        edge = cut(new.select("site", "url", F.lit(depth).alias("depth"), "parent", "rank"))
        if edge.isEmpty():
            break
        seen = cut(seen.unionByName(edge))
    return seen.select("site", "url", "depth", "parent")
