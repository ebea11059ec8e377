"""Usage that elements add to a capture: backgrounds by visible area, painted borders, fonts by text, spacing.

elements: page columns, id, left, top, right, bottom, viewport_width, viewport_height, background, border_width (texts of the four sides, from the top clockwise), border_style, border_color,
interactive, font_family, text_chars (of its own text), spacing (a map of computed properties). An element becomes a few rows, which are summed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..functions.numbers import number

# The properties that tell spacing, and the values that tell none.
SPACING = ("marginTop", "marginBottom", "marginLeft", "marginRight", "paddingTop", "paddingBottom", "paddingLeft", "paddingRight", "gap", "rowGap", "columnGap")
NO_SPACING = ("", "0px", "auto", "normal")
UNPAINTED_STYLES = ("none", "hidden")


def observed_color(text: Column) -> Column:
    """The normal form of a colour that is not wholly transparent, else null."""
    return F.when(~color.transparent(text), color.normal(text))


def visible_share(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """The share of the viewport that a rectangle covers."""
    across = F.greatest(F.lit(0.0), F.least(right, width) - F.greatest(left, F.lit(0.0)))
    down = F.greatest(F.lit(0.0), F.least(bottom, height) - F.greatest(top, F.lit(0.0)))
    return across * down / F.greatest(F.lit(1.0), width * height)


def painted_sides(widths: Column, styles: Column, colors: Column, across: Column, down: Column) -> Column:
    """array of struct(color, border) of the sides that are drawn along an edge of some length, each colour and each border once."""
    sides = F.arrays_zip(widths.alias("width"), styles.alias("style"), colors.alias("paint"))

    def drawn(side: Column, i: Column) -> Column:
        paint, edge = observed_color(side["paint"]), F.when(i % 2 == 0, across).otherwise(down)
        seen = (number(F.regexp_extract(side["width"], r"^\s*(\d*\.?\d+)", 1)) > 0) & (edge > 0) & ~side["style"].isin(*UNPAINTED_STYLES) & paint.isNotNull()
        return F.when(seen, F.struct(paint.alias("color"), F.concat_ws(" ", side["width"], side["style"], paint).alias("border")))

    return F.array_compact(F.transform(sides, drawn))


def _rows(category: str, values: Column, weight: Column | None = None) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(category).alias("category"), v.alias("value"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight")))


def element_usage(elements: DataFrame, page: list[str]) -> DataFrame:
    """page, category, value, weight: bgColor and bgArea (shares of the viewport), borderColor, structuralBorderColor (outside controls), border, fontFamily, fontTextFamily (by characters) and spacing.

    A border colour counts once for an element, however many sides have it. Null values add nothing; an empty table gives an empty result.
    """
    one = lambda c, test: F.when(test & c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    c = F.col
    share = visible_share(*(c(x).cast("double") for x in ("left", "top", "right", "bottom", "viewport_width", "viewport_height")))
    seen = elements.select(
        *page, "interactive", "text_chars", c("font_family").alias("_font"), observed_color(c("background")).alias("_paint"), share.alias("_share"),
        painted_sides(c("border_width"), c("border_style"), c("border_color"), c("right") - c("left"), c("bottom") - c("top")).alias("_sides"),
        F.filter(F.transform(F.array(*map(F.lit, SPACING)), lambda p: F.element_at("spacing", p)), lambda v: v.isNotNull() & ~v.isin(*NO_SPACING)).alias("_spacing"),
    )
    shades, edges = (F.array_distinct(_field("_sides", k)) for k in ("color", "border"))
    free = F.when(~F.coalesce("interactive", F.lit(False)), shades).otherwise(F.array().cast("array<string>"))
    font = F.nullif("_font", F.lit(""))
    parts = [
        _rows("bgColor", one(c("_paint"), F.lit(True))), _rows("bgArea", one(c("_paint"), c("_share") > 0), c("_share")), _rows("borderColor", shades), _rows("structuralBorderColor", free), _rows("border", edges),
        _rows("fontFamily", one(font, F.lit(True))), _rows("fontTextFamily", one(font, F.coalesce(c("text_chars"), F.lit(0)) > 0), c("text_chars")), _rows("spacing", c("_spacing")),
    ]
    told = seen.select(*page, F.inline(F.concat(*(F.coalesce(p, F.array().cast("array<struct<category:string,value:string,weight:double>>")) for p in parts))))
    return told.groupBy(*page, "category", "value").agg(F.sum("weight").alias("weight"))


def _field(array: str, name: str) -> Column:
    return F.transform(array, lambda s: s[name])
