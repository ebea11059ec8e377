"""What lies inside what: aggregates over the descendants and ancestors of page elements, suppression of layered sections, sources of overflow, crops.

An element has its number in document order, pre, and the largest number inside it, last; so it contains whatever lies in (pre, last].
An interval is cut into aligned blocks of 1, 8, 64 and so on numbers, at most fourteen of each, a number lies in one block of each, and blocks meet by an equi-join after
what is looked for has been summed up by block. A page of n elements costs n log n rows, never the pairs of its elements, and a page of any size spreads over
its blocks. Exploded rows outgrow what Spark reckons with, so these joins deal out both sides (see staging) and send none of them whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..staging import dealt

#: Shares of a section's area from which a nested one tells the same, fixed values.
SAME_REGION, LANDMARK_REGION = 0.85, 0.5
#: Pixels beyond the viewport that count, and how many sources are named.
LEAST_OVERFLOW, MOST_SOURCES = 4, 3
CELLS, NEAR = 8, 1e-6
#: Binary digits between two levels of blocks.
BITS = 3


def _heights(points: DataFrame) -> tuple[int, int]:
    """The largest number among points, and how many times it can be cut by BITS: one row for the driver."""
    most = max(0, int(points.agg(F.max("pre")).first()[0] or 0))
    return most, -(-max(1, most.bit_length()) // BITS)


def _shifted(way: str, at: Column, levels: Column) -> Column:
    return F.call_function(f"shift{way}", at, levels * BITS)


def _by_level(rows: DataFrame, height: int) -> DataFrame:
    """rows once for each level of blocks, _k. A plan names a level by this column, so it is as long for any height."""
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(height))))


def _block(at: Column, height: int) -> Column:
    """The name of the block of level _k with this number; blocks of different levels differ."""
    return at + _shifted("left", F.lit(1).cast("long"), F.lit(height) - F.col("_k"))


def _point_blocks(rows: DataFrame, height: int) -> DataFrame:
    """rows, without the number _at, once for each block that it lies in, _block."""
    return _by_level(rows, height).withColumn("_block", _block(_shifted("right", F.col("_at"), F.col("_k")), height)).drop("_at", "_k")


def _interval_blocks(rows: DataFrame, most: int, height: int) -> DataFrame:
    """rows, without the bounds _low and _high, once for each of the blocks, _block, that make up what of [_low, _high] points can lie in; none where it is empty."""
    top = F.when(F.col("_high").isNotNull(), F.least("_high", F.lit(most).cast("long")))
    begin = lambda k: _shifted("right", F.col("_low") + _shifted("left", F.lit(1).cast("long"), k) - 1, k)
    end = lambda k: _shifted("right", F.col("_high") + 1, k)
    above = F.least(F.col("_k") + 1, F.lit(height))
    each = _by_level(rows.withColumn("_high", top).where("_low <= _high"), height)
    # blocks of level _k in [_from, _end), less those in [_up, _to), which higher levels hold
    each = each.withColumns({"_from": begin(F.col("_k")), "_up": begin(above), "_to": end(above), "_end": end(F.col("_k"))})
    inner = (F.col("_k") < height) & (F.col("_up") < F.col("_to"))
    each = each.withColumns({c: F.when(inner, _shifted("left", F.col(c), F.lit(1))).otherwise(F.col("_end")) for c in ("_up", "_to")})
    left = F.col("_up") - F.col("_from")
    each = each.withColumn("_n", F.greatest(left, F.lit(0)) + F.col("_end") - F.col("_to")).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    at = F.when(F.col("_i") < left, F.col("_from")).otherwise(F.col("_to") - left) + F.col("_i")
    return each.withColumn("_block", _block(at, height)).drop("_low", "_high", "_k", "_from", "_up", "_to", "_end", "_n", "_i")


def _met(looked: DataFrame, blocks: DataFrame, page: list[str], ident: str, measures: dict[str, tuple[str, Column]]) -> DataFrame:
    fold = {"max": F.max, "min": F.min}
    blocks = blocks.groupBy(*page, "_block").agg(*(fold[how](n).alias(n) for n, (how, _) in measures.items()))
    met = looked.join(dealt(blocks), [*page, "_block"]).groupBy(*page, ident).agg(*(fold[how](n).alias(n) for n, (how, _) in measures.items()))
    return dealt(met)


def _measured(measures: dict[str, tuple[str, Column]]) -> list[Column]:
    return [c.alias(n) for n, (_, c) in measures.items()]


def over_descendants(wanted: DataFrame, given: DataFrame, page: list[str], ident: str, measures: dict[str, tuple[str, Column]], among: DataFrame | None = None) -> DataFrame:
    """page, ident and the measures, (max or min, column of given), over all rows of given inside each row of wanted, itself not counted; rows with nothing inside are left out.

    among: a table at hand that holds the rows of given, if those take work to find.
    """
    most, height = _heights(given if among is None else among)
    pre, last = F.col("pre").cast("long"), F.col("last").cast("long")
    looked = _interval_blocks(wanted.select(*page, ident, (pre + 1).alias("_low"), last.alias("_high")), most, height)
    return _met(looked, _point_blocks(given.select(*page, *_measured(measures), pre.alias("_at")), height), page, ident, measures)


def over_ancestors(wanted: DataFrame, given: DataFrame, page: list[str], ident: str, measures: dict[str, tuple[str, Column]], itself: bool = False, among: DataFrame | None = None) -> DataFrame:
    """The same over all rows of given that contain each row of wanted, with itself if so asked. among: a table at hand that holds the rows of wanted."""
    most, height = _heights(wanted if among is None else among)
    pre, last = F.col("pre").cast("long"), F.col("last").cast("long")
    looked = _point_blocks(wanted.select(*page, ident, pre.alias("_at")), height)
    return _met(looked, _interval_blocks(given.select(*page, *_measured(measures), (pre if itself else pre + 1).alias("_low"), last.alias("_high")), most, height), page, ident, measures)


def suppressed_sections(candidates: DataFrame, page: list[str], ident: str = "id") -> DataFrame:
    """candidates with suppressed: nested candidates that tell the same region, of which one stays.

    Of two nested ones whose areas are alike the outer goes, but an anonymous one inside a landmark goes itself; an anonymous one around a landmark
    of half its area goes, too. candidates: page, ident, pre, last, area, landmark; null areas are neither alike nor half of anything.
    """
    area, mark = F.col("area").cast("double"), F.coalesce(F.col("landmark"), F.lit(False))
    inside = over_descendants(candidates, candidates, page, ident, {"_any": ("max", area), "_mark": ("max", F.when(mark, area))})
    around = over_ancestors(candidates.where(~mark), candidates.where(mark), page, ident, {"_outer": ("min", area)}, among=candidates)
    told = candidates.join(inside, [*page, ident], "left").join(around, [*page, ident], "left")
    outer = F.when(mark, F.col("_mark") >= area * SAME_REGION).otherwise((F.col("_any") >= area * SAME_REGION) | (F.coalesce(F.col("_mark") >= area * LANDMARK_REGION, F.lit(False))))
    inner = ~mark & (area >= F.col("_outer") * SAME_REGION)
    return told.select(*candidates.columns, (F.coalesce(outer, F.lit(False)) | F.coalesce(inner, F.lit(False))).alias("suppressed"))


def overflowing(elements: DataFrame, page: list[str], ident: str = "id") -> DataFrame:
    """The visible elements that reach beyond the viewport's sides, outside scrolling or clipping containers and fixed layers, with overflow_px.

    elements: page, ident, pre, last, left, right, width, viewport, visible, position, overflow_x, scroll_width, client_width, body (whether it is the body) and root
    (whether it is the document's root). Body and root are no containers.
    """
    way = F.col("overflow_x")
    clips = way.isin("hidden", "clip") | (way.isin("auto", "scroll") & (F.col("scroll_width") > F.col("client_width") + 4))
    clips = F.coalesce(clips, F.lit(False)) & ~F.col("body") & ~F.col("root")
    layered = F.coalesce(F.col("position") == "fixed", F.lit(False))
    special = elements.withColumns({"_clips": clips, "_fixed": layered}).where("_clips or _fixed")
    free = elements.where(F.col("visible") & ~layered)
    around = over_ancestors(free, special, page, ident, {"_in_clip": ("max", F.col("_clips")), "_in_fixed": ("max", F.col("_fixed"))}, among=elements)
    free = free.join(around, [*page, ident], "left").where(~F.coalesce("_in_clip", F.lit(False)) & ~F.coalesce("_in_fixed", F.lit(False)))
    beyond = F.greatest(F.lit(0.0), -F.col("left").cast("double")) + F.greatest(F.lit(0.0), (F.col("right") - F.col("viewport")).cast("double"))
    return free.select(*elements.columns, beyond.alias("overflow_px")).where(F.col("overflow_px") > LEAST_OVERFLOW)


def overflow_sources(over: DataFrame, page: list[str], ident: str = "id") -> DataFrame:
    """page, ord, ident, pre, last, overflow_px, width, position: up to MOST_SOURCES elements of overflowing that do not nest, the widest first.

    The body comes last; of equal ones the first in the document counts. Each round takes the best of what is left on every page and removes what
    nests with it, so no page is ordered in one place.
    """
    rank = F.struct(F.col("body"), (-F.col("overflow_px")).alias("px"), "pre")
    left, found = over.select(*page, ident, "pre", "last", "overflow_px", "width", "position", "body"), []
    for i in range(1, MOST_SOURCES + 1):
        best = left.groupBy(*page).agg(F.min_by(F.struct(ident, "pre", "last", "overflow_px", "width", "position"), rank).alias("_best"))
        found.append(best.select(*page, F.lit(i).alias("ord"), "_best.*"))
        if i < MOST_SOURCES:
            apart = (F.col("last") < F.col("_best.pre")) | (F.col("_best.last") < F.col("pre"))
            left = left.join(best, page).where(apart).drop("_best")
    return reduce(DataFrame.unionByName, found)


def overflow_report(over: DataFrame, sources: DataFrame, sections: DataFrame, page: list[str], ident: str = "id") -> DataFrame:
    """sources with whole pixels, and section and role of the smallest section that holds each, of equal ones the first in order. sections: page, section, role, pre, last, area, ord."""
    smallest = F.struct(F.col("area").cast("double").alias("area"), "ord", "section", "role")
    held = over_ancestors(sources, sections, page, ident, {"_in": ("min", smallest)}, itself=True)
    whole = lambda c: half_up(F.col(c)).cast("int").alias(c)
    return sources.join(held, [*page, ident], "left").select(*page, "ord", ident, whole("overflow_px"), whole("width"), "position", "_in.section", "_in.role")


def content_width(over: DataFrame, page: list[str]) -> DataFrame:
    """page, content_width, overflows: how wide the content of each page with overflowing elements is, and whether that is overflow."""
    wide = F.ceil(F.max(F.greatest(F.col("viewport").cast("double"), F.col("right").cast("double"), (F.col("viewport") - F.col("left")).cast("double")))).cast("int")
    out = over.groupBy(*page).agg(wide.alias("content_width"), F.max("viewport").alias("_viewport"))
    return out.select(*page, "content_width", (F.col("content_width") > F.col("_viewport") + LEAST_OVERFLOW).alias("overflows"))


def crop_of(targets: DataFrame, crops: DataFrame, page: list[str], ident: str = "id") -> DataFrame:
    """page, ident, crop: the first crop in order that is of the target's section or holds its rectangle; targets without one are left out.

    targets: page, ident, section, x, y, w, h; crops: page, crop, ord, section, x, y, w, h, in shares of the page. A crop lies in the cells of a grid that it covers, a target in that
    of its corner, so rectangles meet by an equi-join. Of a page's equal crops only the first can be the answer, and equal targets have the same, so neither meets others more than once.
    """
    cell = lambda v: F.least(F.greatest(F.floor(v * CELLS), F.lit(0)), F.lit(CELLS)).cast("int")
    span = lambda a, n: F.sequence(cell(F.col(a) - NEAR), cell(F.col(a) + F.col(n) + NEAR))
    first = F.min(F.struct("ord", "crop"))
    named = crops.withColumnsRenamed({"section": "crop_section", "x": "cx", "y": "cy", "w": "cw", "h": "ch"}).where("cw >= 0 and ch >= 0")
    covered = named.groupBy(*page, "cx", "cy", "cw", "ch").agg(first.alias("_c")).withColumn("gx", F.explode(span("cx", "cw"))).withColumn("gy", F.explode(span("cy", "ch")))
    placed = targets.select(*page, "x", "y", "w", "h").distinct().withColumns({"gx": cell(F.col("x")), "gy": cell(F.col("y"))})
    within = lambda a, n, b, m: (F.col(a) >= F.col(b) - NEAR) & (F.col(a) + F.col(n) <= F.col(b) + F.col(m) + NEAR)
    met = placed.join(dealt(covered), [*page, "gx", "gy"]).where(within("x", "w", "cx", "cw") & within("y", "h", "cy", "ch"))
    held = met.groupBy(*page, "x", "y", "w", "h").agg(F.min("_c").alias("_held"))
    own = named.groupBy(*page, F.col("crop_section").alias("section")).agg(first.alias("_own"))
    out = targets.join(dealt(held), [*page, "x", "y", "w", "h"], "left").join(dealt(own), [*page, "section"], "left").withColumn("_c", F.least("_held", "_own"))
    return out.where("_c is not null").groupBy(*page, ident).agg(F.min("_c").alias("_c")).select(*page, ident, "_c.crop")
