"""Ranking, top-k and selection."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most values of each token scale.
SCALE_SIZES = {"fontSizes": 8, "fontWeights": 5, "lineHeights": 5, "spacing": 12, "radii": 5, "shadows": 4, "borders": 4, "fontStacks": 5, "fontFamilies": 5, "letterSpacings": 6, "zIndices": 8, "transitions": 6}
VIEWPORT_RANK = {"desktop": 0, "tablet": 1, "mobile": 2}
#: Selection prefers variety among the first so many pages, by these deductions.
DIVERSE_PREFIX, KIND_COST, FAMILY_COST = 32, 12, 4


def top(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "ord") -> DataFrame:
    """The first n rows of each group, with their place from 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def first_row(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    return top(df, group, order, 1, "_first").drop("_first")


def scale(frequency: DataFrame, group: list[str], n: int, number: str) -> DataFrame:
    """The n most frequent values (ties by value), then numbered by size. frequency: group, value, n and a numeric column."""
    some = top(frequency, group, [F.col("n").desc(), F.col("value")], n, "_rank")
    w = Window.partitionBy(*group).orderBy(number, "value")
    return some.withColumn("ord", F.row_number().over(w)).drop("_rank")


def canonical_capture(captures: DataFrame, url: str, viewport: str, width: str, ident: str) -> DataFrame:
    """One capture for each URL: desktop, tablet, mobile, others; then the wider; then by id."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in VIEWPORT_RANK.items() for x in kv)), F.col(viewport)), F.lit(3))
    return first_row(captures, [url], [rank, F.col(width).desc(), F.col(ident)])


def breakpoint_category(width: Column) -> Column:
    return F.when(width <= 480, "mobile").when(width <= 768, "tablet-sm").when(width <= 1024, "tablet").when(width <= 1280, "desktop").otherwise("wide")


def canonicality(width: Column) -> Column:
    return F.when(width % 16 == 0, 3).when(width % 8 == 0, 2).when(width % 4 == 0, 1).otherwise(0)


def islands(df: DataFrame, group: list[str], value: str, gap: int) -> DataFrame:
    """Adds island: neighbours in order of value at most gap apart share one."""
    w = Window.partitionBy(*group).orderBy(value)
    new = (F.col(value) - F.lag(value).over(w) > gap) | F.lag(value).over(w).isNull()
    return df.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new")


def representative_breakpoints(breakpoints: DataFrame, group: list[str], most: int = 10) -> DataFrame:
    """group, width, n, category: one width for each cluster of gaps up to 2, then two at most for each category.

    A cluster is named by its most frequent width, then the roundest, then the smallest. In a category the second is chosen for being the category's
    boundary, round, frequent, far from the first, small, in this order. breakpoints: group, width, n, a row for each width.
    """
    clusters = islands(breakpoints, group, "width", 2)
    one = [F.col("n").desc(), canonicality(F.col("width")).desc(), F.col("width")]
    total = F.sum("n").over(Window.partitionBy(*group, "island"))
    reps = first_row(clusters.withColumn("total", total), [*group, "island"], one)
    reps = reps.select(*group, "width", F.col("total").alias("n"), breakpoint_category(F.col("width")).alias("category"))
    cat = Window.partitionBy(*group, "category")
    ranked = reps.withColumn("r", F.row_number().over(cat.orderBy(*one)))
    primary = F.max(F.when(F.col("r") == 1, F.col("width"))).over(cat)
    boundary = ((F.col("category") == "mobile") & (F.col("width") == 480)) | ((F.col("category") == "tablet-sm") & (F.col("width") == 768)) | ((F.col("category") == "tablet") & (F.col("width") == 1024)) | ((F.col("category") == "desktop") & (F.col("width") == 1280))
    second = [F.col("first").desc(), boundary.desc(), canonicality(F.col("width")).desc(), F.col("n").desc(), F.abs(F.col("width") - F.col("primary")).desc(), F.col("width")]
    chosen = ranked.withColumn("primary", primary).withColumn("first", (F.col("r") == 1).cast("int")).withColumn("place", F.row_number().over(cat.orderBy(*second))).where("place <= 2")
    return top(chosen.select(*group, "width", "n", "category"), group, [F.col("width")], most).drop("ord")


def page_pool(candidates: DataFrame, site: str) -> DataFrame:
    """Distinct URLs of score 90 or more (the best row of each, DOM first on ties), only those under the site's own path if there are any."""
    best = first_row(candidates, [site, "url"], [F.col("score").desc(), (F.col("source") == "dom").desc()]).where("score >= 90")
    some = best.where("contextual").select(site).distinct().withColumn("_any", F.lit(True))
    return best.join(some, site, "left").where("_any is null or contextual").select(*best.columns)


def ranked_pages(candidates: DataFrame, site: str, n: int) -> DataFrame:
    """The n best pages of each site by score, then URL."""
    return top(page_pool(candidates, site), [site], [F.col("score").desc(), F.col("url")], n)


def _diverse(most: int):
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (-r["score"], r["url"]))
        kinds: dict[str, int] = {}
        families: dict[str, int] = {}
        chosen, rest = [], rows
        while rest and len(chosen) < min(DIVERSE_PREFIX, most):
            # Rows are in rank order, so max() keeps the better of equals.
            best = max(rest, key=lambda r: r["score"] - KIND_COST * kinds.get(r["kind"], 0) - FAMILY_COST * families.get(r["family"], 0))
            chosen.append(best)
            rest = [r for r in rest if r is not best]
            kinds[best["kind"]] = kinds.get(best["kind"], 0) + 1
            if best["family"]:
                families[best["family"]] = families.get(best["family"], 0) + 1
        chosen += rest[: most - len(chosen)]
        return pa.Table.from_pylist([r | {"ord": i + 1} for i, r in enumerate(chosen)], pa.schema([*t.schema, pa.field("ord", pa.int32())]))

    return run


def diverse_pages(candidates: DataFrame, site: str, most: int) -> DataFrame:
    """Pages of each site for variety: each pick lowers the score of pages of its kind and family; after 32 the rest follow by rank.

    Only the best most + 32 * 32 rows of a site can be picked, as a deduction never lifts a page; so a task's group is bounded. candidates: site, url, score, kind, family,
    source, contextual.
    """
    pool = page_pool(candidates, site)
    by_kind = Window.partitionBy(site, "kind", "family").orderBy(F.col("score").desc(), "url")
    # Within a kind and family picks follow rank, so its later rows are out of reach of the prefix.
    bounded = pool.withColumn("_k", F.row_number().over(by_kind)).withColumn("_r", F.row_number().over(Window.partitionBy(site).orderBy(F.col("score").desc(), "url"))).where((F.col("_k") <= DIVERSE_PREFIX) | (F.col("_r") <= most + DIVERSE_PREFIX)).drop("_k", "_r")
    return bounded.groupBy(site).applyInArrow(_diverse(most), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bounded.schema) + ", ord int")


def median_sample(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The middle row of each group."""
    w = Window.partitionBy(*group)
    return df.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w)).where("_r = floor(_n / 2) + 1").drop("_r", "_n")
