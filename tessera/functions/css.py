"""CSS values: lengths, durations, shadows, grids, transforms, fonts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_up, number, plain

ROOT_PX = 16
_LENGTH = r"(?i)^\s*(-?\d*\.?\d+)(px|rem|em)?\s*$"
#: Names of font weights by hundreds.
WEIGHT_NAMES = {100: "thin", 200: "extra-light", 300: "light", 400: "regular", 500: "medium", 600: "semibold", 700: "bold", 800: "extra-bold", 900: "black"}


def length_px(text: Column) -> Column:
    """px, or plain numbers, as they are; rem and em by a root of 16 px; null otherwise."""
    amount, unit = number(F.regexp_extract(text, _LENGTH, 1)), F.lower(F.regexp_extract(text, _LENGTH, 2))
    return F.when(unit.isin("rem", "em"), amount * ROOT_PX).otherwise(amount)


def scalar_length(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*-?\d*\.?\d+(px|rem|em)\s*$")


def subpixel(px: Column) -> Column:
    """The nearest half pixel where it is within 0.1, else three places."""
    half = F.floor(px * 2 + 0.5) / 2
    return F.when(F.abs(px - half) <= 0.1, half).otherwise(half_up(px, 3)) + F.lit(0.0)


def px_to_rem(px: Column) -> Column:
    return F.concat(plain(px / ROOT_PX, 3), F.lit("rem"))


def duration_ms(text: Column) -> Column:
    """Milliseconds of a text in ms or s; infinite for anything else, which sorts last."""
    rx = r"(?i)^\s*([\d.]+)(ms|s)\s*$"
    amount, unit = number(F.regexp_extract(text, rx, 1)), F.lower(F.regexp_extract(text, rx, 2))
    return F.when(unit == "ms", amount).when(unit == "s", amount * 1000).otherwise(F.lit(float("inf")))


def numbers_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d*\.?\d+)"), F.lit(1)), lambda x: x.cast("double"))


def shadow_sort_score(text: Column) -> Column:
    """Over each four lengths a quarter of the first, the second, twice the third, and the fourth."""
    lengths = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d*\.?\d+)px"), F.lit(1)), lambda x: F.abs(x.cast("double")))
    weighted = F.transform(lengths, lambda x, i: x * F.element_at(F.array(F.lit(0.25), F.lit(1.0), F.lit(2.0), F.lit(1.0)), i % 4 + 1))
    return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)


def shadow_elevation(text: Column) -> Column:
    """Of the first layer, without colours: a quarter of the offset across, the offset down, blur and half the spread; null below two lengths."""
    bare = F.regexp_replace(text, r"(?i)(?:rgba?|hsla?|oklch|oklab|lab|lch|color)\([^)]*\)", "")
    found = F.regexp_extract_all(F.element_at(F.split(bare, ","), 1), F.lit(r"(?i)(-?\d*\.?\d+(?:px|rem|em)|\b0\b)"), F.lit(1))
    at = lambda i: F.coalesce(length_px(F.get(found, F.lit(i))), F.lit(0.0))
    return F.when(F.size(found) >= 2, F.abs(at(0)) * 0.25 + F.abs(at(1)) + F.greatest(F.lit(0.0), at(2)) + F.abs(at(3)) * 0.5)


def visible_shadow(text: Column) -> Column:
    """Whether a layer, cut at commas outside parentheses, has a length other than 0 and no transparent colour."""
    from .color import transparent

    layers = F.split(text, r",(?![^(]*\))")
    seen = lambda v: F.exists(F.regexp_extract_all(v, F.lit(r"(-?\d*\.?\d+)px"), F.lit(1)), lambda n: n.cast("double") != 0) & ~transparent(F.regexp_extract(v, r"(?i)((?:rgba?|hsla?)\([^)]*\)|#[0-9a-f]{3,8}|transparent)", 1))
    return F.coalesce((F.lower(F.trim(text)) != "none") & F.exists(layers, seen), F.lit(False))


def visible_border(text: Column) -> Column:
    """Whether a border's text names neither none nor hidden, its first number is above 0, and the colour that ends it, if any, is not transparent; false for null."""
    from .color import transparent

    width = F.get(numbers_in(text), F.lit(0))
    paint = F.regexp_extract(text, r"(?i)(transparent|(?:rgba?|hsla?|oklch|oklab|hsl|lab|lch)\([^)]+\)|#[\da-f]{3,8})\s*$", 1)
    return F.coalesce(~text.rlike(r"(?i)\b(?:none|hidden)\b") & (width > 0) & ((paint == "") | ~transparent(paint)), F.lit(False))


def grid_columns(text: Column) -> Column:
    """repeat()'s count, else the number of tracks; null for none."""
    bare = text
    for _ in range(4):  # innermost parentheses first
        bare = F.regexp_replace(bare, r"\([^()]*\)", "")
    repeated = F.regexp_extract(text, r"^\s*repeat\(\s*(\d+)\s*,", 1)
    tracks = F.size(F.filter(F.split(F.trim(bare), r"\s+"), lambda t: t != ""))
    return F.when(repeated != "", repeated.try_cast("int")).when(F.lower(F.trim(text)).isin("none", ""), F.lit(None)).otherwise(tracks)


def bounded_px(text: Column, most: float = 240) -> Column:
    px = length_px(text)
    return F.when((px > 0) & (px <= most), F.concat(plain(px, 3), F.lit("px")))


def transform_matrix(text: Column) -> Column:
    """none, translate() and matrix() as one matrix() text with six places, other text with blanks collapsed."""
    nums = numbers_in(F.regexp_replace(text, r"(?i)matrix|translate[xy]?", ""))
    get = lambda i: F.coalesce(F.get(nums, F.lit(i)), F.lit(0.0))
    matrix = lambda *v: F.concat(F.lit("matrix("), F.concat_ws(", ", *(plain(F.when(F.abs(x) < 1e-6, 0.0).otherwise(x), 6) for x in v)), F.lit(")"))
    one, zero = F.lit(1.0), F.lit(0.0)
    low = F.lower(F.trim(text))
    out = F.when(low == "none", matrix(one, zero, zero, one, zero, zero))
    out = out.when(low.rlike(r"^translatex\([^)]*\)$"), matrix(one, zero, zero, one, get(0), zero)).when(low.rlike(r"^translatey\([^)]*\)$"), matrix(one, zero, zero, one, zero, get(0)))
    out = out.when(low.rlike(r"^translate\([^)]*\)$"), matrix(one, zero, zero, one, get(0), get(1)))
    return out.when(low.rlike(r"^matrix\([^)]*\)$"), matrix(*(get(i) for i in range(6)))).otherwise(F.regexp_replace(low, r"\s+", " "))


def font_normal(text: Column) -> Column:
    """Without quotes, blanks collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "[\"']", ""), r"\s+", " ")))


def first_family(text: Column) -> Column:
    return font_normal(F.element_at(F.split(text, ","), 1))


def weight_name(text: Column) -> Column:
    names = F.create_map(*(F.lit(x) for k, v in WEIGHT_NAMES.items() for x in (str(k), v)))
    return F.coalesce(F.element_at(names, F.trim(text)), text)


def uniform_radius(corners: Column) -> Column:
    """The corners' common value if they are equal and a plain length."""
    one = F.element_at(corners, 1)
    return F.when((F.size(F.array_distinct(corners)) == 1) & scalar_length(one), one)


def compound_radius(text: Column) -> Column:
    parts = F.split(F.trim(text), r"\s+")
    return text.rlike("[%/]") | (F.size(parts) != 4) | (F.size(F.array_distinct(parts)) > 1)


def gradient(text: Column) -> Column:
    """struct(kind, direction, stops) of a gradient with two stops or more and at most 1,000 characters; null for others, and with url()."""
    rx = r"(?is)^\s*(?:repeating-)?(linear|radial|conic)-gradient\((.*)\)\s*$"
    parts = F.transform(F.split(F.regexp_extract(text, rx, 2), r",(?![^(]*\))"), F.trim)
    leads = F.element_at(parts, 1).rlike(r"(?i)^(to |from |at |circle|ellipse|-?[\d.]+(deg|turn|rad))")
    stops = F.when(leads, F.slice(parts, 2, 1000)).otherwise(parts)
    good = text.rlike(rx) & ~text.rlike(r"(?i)url\(") & (F.length(text) <= 1000) & (F.size(stops) >= 2)
    return F.when(good, F.struct(F.lower(F.regexp_extract(text, rx, 1)).alias("kind"), F.when(leads, F.element_at(parts, 1)).alias("direction"), stops.alias("stops")))


def compact_borders(sides: Column) -> Column:
    """From a map of the four sides: border for four equal visible ones, else each visible side."""
    seen = F.map_filter(sides, lambda _, v: ~v.rlike(r"(?i)^\s*(0(px)?\b|none)"))
    names = F.transform(F.map_entries(seen), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    same = (F.size(seen) == 4) & (F.size(F.array_distinct(F.map_values(seen))) == 1)
    return F.when(same, F.array(F.concat(F.lit("border: "), F.element_at(F.map_values(seen), 1)))).otherwise(F.array_sort(names))
