"""Evidence tables: provenance, lookups, patterns, sequences, responsive observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, css
from .clusters import run_lengths
from .diffs import adjacent, map_changes
from .matching import near
from .ranking import top

PAGES_SHOWN, SOURCES_SHOWN = 8, 12
#: How token values are compared with observed ones, by group: a tolerance for numbers, or a normal form.
TOLERANCES = {"fontSizes": 0.01, "spacing": 0.1, "radii": 0.1, "lineHeights": 0.001}


def match_key(group: str, value: Column) -> Column:
    if group == "colors":
        return F.coalesce(color.normal(value), F.lower(F.trim(value)))
    if group in ("fontFamilies", "fontStacks"):
        return css.first_family(value)
    return F.lower(F.trim(value))


def provenance(tokens: DataFrame, usage: DataFrame, group: str) -> DataFrame:
    """token, observations, pages, captures, page_list, source_list for the tokens of one group.

    tokens: token, value, category; usage: category, value, weight, url, capture, source. Lengths match within the group's tolerance (a bucketed equi-join), other values by normal form.
    Usage is added up by value first, and joined with the distinct values of tokens; only then tokens get what their value has.
    """
    key = (lambda v: css.length_px(v)) if group in TOLERANCES else (lambda v: match_key(group, v))
    t = tokens.select("token", "category", key(F.col("value")).alias("y"))
    seen = usage.select("category", key(F.col("value")).alias("x"), "weight", "url", "capture", "source").where("x is not null")
    seen = seen.groupBy("category", "x", "url", "capture", "source").agg(F.sum("weight").alias("weight"))
    wanted = t.select("category", "y").where("y is not null").distinct()
    values = seen.select("category", "x").distinct()
    pairs = near(values, wanted, ["category"], "x", "y", TOLERANCES[group]) if group in TOLERANCES else wanted.withColumn("x", F.col("y"))
    rows = seen.join(pairs.select("category", "x", "y"), ["category", "x"])

    def first(col: str, most: int, name: str) -> DataFrame:
        """The smallest distinct texts of each value; a task sends on no more than most of its own, so a value that every page has stays small."""
        each = top(rows.where(F.col(col).isNotNull()).select("category", "y", col).distinct(), ["category", "y"], [F.col(col)], most, "_p")
        return each.groupBy("category", "y").agg(F.array_sort(F.collect_list(col)).alias(name))

    number = lambda col, name: rows.where(F.col(col).isNotNull()).select("category", "y", col).distinct().groupBy("category", "y").agg(F.count(F.lit(1)).alias(name))
    found = rows.groupBy("category", "y").agg(F.sum("weight").alias("observations"))
    for part in (number("url", "pages"), first("url", PAGES_SHOWN, "page_list"), number("capture", "captures"), first("source", SOURCES_SHOWN, "source_list")):
        found = found.join(part, ["category", "y"], "left")
    out = t.join(found, ["category", "y"], "left").select("token", "observations", "pages", "captures", "page_list", "source_list")
    return out.fillna(0, ["observations", "pages", "captures"])


def token_index(tokens: DataFrame) -> DataFrame:
    """variant, ref: every spelling under which a token's value may occur. tokens: ref, value."""
    v = F.col("value")
    px = css.length_px(v)
    variants = F.array_distinct(F.array_compact(F.array(F.lower(F.trim(v)), color.normal(v), F.when(css.scalar_length(v), css.px_to_rem(px)), css.font_normal(v))))
    return tokens.select("ref", F.explode(variants).alias("variant")).distinct()


def style_refs(styles: DataFrame, tokens: DataFrame) -> DataFrame:
    """id, refs: the tokens that the values of each element's styles, or the colours and lengths inside them, name. styles: id, styles (map)."""
    parts = styles.select("id", F.explode("styles").alias("property", "text"))
    inner = F.regexp_extract_all("text", F.lit(r"(#[0-9a-fA-F]{3,8}|rgba?\([^)]*\)|-?\d*\.?\d+(?:px|rem|em))"), F.lit(1))
    tried = F.explode(F.array_distinct(F.transform(F.array_append(inner, F.col("text")), lambda x: F.coalesce(color.normal(x), F.lower(F.trim(x))))))
    found = parts.select("id", tried.alias("variant")).distinct().join(token_index(tokens), "variant")
    return styles.select("id").join(found.groupBy("id").agg(F.array_sort(F.collect_set("ref")).alias("refs")), "id", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))


def cross_page(items: DataFrame, site: list[str], role: str, url: str, least: int = 2) -> DataFrame:
    """site, role, pages: roles seen on least URLs or more."""
    return items.groupBy(*site, role).agg(F.count_distinct(url).alias("pages")).where(F.col("pages") >= least)


def sequences(items: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """group, sequence: the values in order, equal neighbours once, unknown ones left out."""
    runs = run_lengths(items.where(F.col(value).isNotNull() & (F.col(value) != "unknown")), group, order, value)
    listed = F.array_sort(F.collect_list(F.struct("run", value)))
    return runs.groupBy(*group).agg(F.array_join(F.transform(listed, lambda x: x[value]), " > ").alias("sequence"))


def modal(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value, n: the most frequent value, the smallest of equals."""
    n = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group).orderBy(F.col("n").desc(), F.col(value))
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def responsive_changes(sections: DataFrame, url: list[str], order: list[str]) -> DataFrame:
    """Changes of each section between neighbouring viewports of a URL: url, key, viewport, next_viewport, changes. sections: url, key, viewport, order columns, styles (map)."""
    pairs = adjacent(sections, [*url, "key"], order, ["viewport", "styles"])
    return pairs.withColumn("changes", map_changes(F.col("styles"), F.col("next_styles"))).where(F.size("changes") > 0).select(*url, "key", "viewport", "next_viewport", "changes")


def coverage(captures: DataFrame, expected: DataFrame, site: list[str]) -> DataFrame:
    """site, pages, expected, captured, share of the (url, viewport) pairs that were to be captured."""
    done = captures.select(*site, "url", "viewport").distinct().withColumn("_done", F.lit(1))
    all_of = expected.select(*site, "url", "viewport").distinct().join(done, [*site, "url", "viewport"], "left")
    return all_of.groupBy(*site).agg(F.count_distinct("url").alias("pages"), F.count(F.lit(1)).alias("expected"), F.coalesce(F.sum("_done"), F.lit(0)).alias("captured")).withColumn("share", F.col("captured") / F.col("expected"))
