"""Colours: several grammars, normal forms, distances, luminance and contrast, as expressions over text or channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .numbers import number, plain

RELATED, MATCH, CLUSTER, BACKGROUND_CLUSTER = 96, 20, 30, 12
TRANSPARENT, OPAQUE = 0.001, 0.999


def _channel(hexes: Column, at: int) -> Column:
    return F.conv(F.substring(hexes, at, 2), 16, 10).cast("int")


def _hex6(text: Column, short: bool = True) -> Column:
    six = F.regexp_extract(text, r"(?i)^\s*#([0-9a-f]{6})\s*$", 1)
    if not short:
        return six
    three = F.regexp_extract(text, r"(?i)^\s*#([0-9a-f]{3})\s*$", 1)
    return F.when(six != "", six).otherwise(F.regexp_replace(three, "(.)", "$1$1"))


def channels(text: Column) -> Column:
    """struct(r, g, b, a) of rgb(), rgba(), #rgb and #rrggbb with whole-number channels; null for anything else."""
    return let(text, _channels)


def _channels(text: Column) -> Column:
    rx = r"(?i)rgba?\(\s*(\d+)[,\s]+(\d+)[,\s]+(\d+)(?:\s*[,/]\s*([\d.]+))?"
    part = lambda i: F.regexp_extract(text, rx, i)
    hexes = _hex6(text)
    rgb = F.struct(*(part(i).cast("int").alias(n) for i, n in ((1, "r"), (2, "g"), (3, "b"))), F.coalesce(number(part(4)), F.lit(1.0)).alias("a"))
    hexed = F.struct(*(_channel(hexes, i).alias(n) for i, n in ((1, "r"), (3, "g"), (5, "b"))), F.lit(1.0).alias("a"))
    return F.when(text.rlike(rx), rgb).when(hexes != "", hexed)


def tag_channels(text: Column) -> Column:
    """The same with alpha ignored."""
    return let(channels(text), lambda c: F.when(c.isNotNull(), F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), F.lit(1.0).alias("a"))))


def token_channels(text: Column) -> Column:
    """Anchored, with decimal channels and slash or percent-free alpha; of hex colours only #rrggbb."""
    rx = r"(?i)^\s*rgba?\(\s*([\d.]+)\s*[,\s]\s*([\d.]+)\s*[,\s]\s*([\d.]+)\s*(?:[,/]\s*([\d.]+)\s*)?\)\s*$"
    part = lambda i: number(F.regexp_extract(text, rx, i))
    hexes = _hex6(text, short=False)
    rgb = F.struct(part(1).alias("r"), part(2).alias("g"), part(3).alias("b"), F.coalesce(part(4), F.lit(1.0)).alias("a"))
    hexed = F.struct(*(_channel(hexes, i).cast("double").alias(n) for i, n in ((1, "r"), (3, "g"), (5, "b"))), F.lit(1.0).alias("a"))
    return F.when(text.rlike(rx), rgb).when(hexes != "", hexed)


def recipe_channels(text: Column) -> Column:
    """#rrggbb alone."""
    hexes = _hex6(text, short=False)
    return F.when(hexes != "", F.struct(*(_channel(hexes, i).alias(n) for i, n in ((1, "r"), (3, "g"), (5, "b"))), F.lit(1.0).alias("a")))


def normal(text: Column) -> Column:
    """#rrggbb, or rgba() with three places of alpha below 0.999; null for what is no colour."""

    def shown(c: Column) -> Column:
        opaque = F.format_string("#%02x%02x%02x", c["r"], c["g"], c["b"])
        clear = F.concat(F.lit("rgba("), F.concat_ws(", ", c["r"], c["g"], c["b"], plain(c["a"], 3)), F.lit(")"))
        return F.when(c.isNotNull(), F.when(c["a"] < OPAQUE, clear).otherwise(opaque))

    return let(channels(text), shown)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of channels."""
    return F.sqrt(sum(((a[k] - b[k]) * (a[k] - b[k])).cast("double") for k in "rgb"))


def related(a: Column, b: Column) -> Column:
    return distance(a, b) <= RELATED


def _linear(v: Column) -> Column:
    s = v / 255.0
    return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def luminance(c: Column) -> Column:
    return 0.2126 * _linear(c["r"]) + 0.7152 * _linear(c["g"]) + 0.0722 * _linear(c["b"])


def over(front: Column, back: Column) -> Column:
    """front composited on an opaque back."""
    mixed = lambda k: front[k] * front["a"] + back[k] * (1 - front["a"])
    return F.struct(*(mixed(k).alias(k) for k in "rgb"), F.lit(1.0).alias("a"))


def contrast(front: Column, back: Column) -> Column:
    one, two = luminance(over(front, back)), luminance(back)
    return (F.greatest(one, two) + 0.05) / (F.least(one, two) + 0.05)


def chroma(c: Column) -> Column:
    return F.greatest(c["r"], c["g"], c["b"]) - F.least(c["r"], c["g"], c["b"])


def relative_chroma(c: Column) -> Column:
    top = F.greatest(c["r"], c["g"], c["b"])
    return F.when(top > 0, chroma(c) / top).otherwise(0.0)


def hue(c: Column) -> Column:
    """0 to 360; 0 for greys."""
    top, d = F.greatest(c["r"], c["g"], c["b"]), chroma(c)
    turn = F.when(top == c["r"], (c["g"] - c["b"]) / d).when(top == c["g"], (c["b"] - c["r"]) / d + 2).otherwise((c["r"] - c["g"]) / d + 4)
    return F.when(d == 0, 0.0).otherwise(F.pmod(60.0 * turn, F.lit(360.0)))


def hue_family(c: Column) -> Column:
    """The hue's twelfth of the circle."""
    return F.floor(hue(c) / 30).cast("int")


def neutral(c: Column) -> Column:
    return (chroma(c) <= 24) | (relative_chroma(c) <= 0.12)


def alpha(text: Column) -> Column:
    """Alpha of rgb(a), hsl(a), other functions with a slash, and #rrggbbaa; 1 for other text, 0 for transparent."""
    last = number(F.regexp_extract(text, r"(?i)^(?:rgba|hsla)\([^)]*,\s*([\d.]+)\s*\)$", 1))
    slash = F.regexp_extract(text, r"/\s*([\d.]+%?)\s*\)$", 1)
    share = F.when(F.endswith(slash, F.lit("%")), number(F.regexp_replace(slash, "%", "")) / 100).otherwise(number(slash))
    hexed = F.regexp_extract(text, r"(?i)^#[0-9a-f]{6}([0-9a-f]{2})$", 1)
    byte = F.when(hexed != "", F.conv(hexed, 16, 10).cast("int") / 255.0)
    return F.when(F.lower(F.trim(text)) == "transparent", 0.0).otherwise(F.coalesce(last, share, byte, F.lit(1.0)))


def transparent(text: Column) -> Column:
    return alpha(text) <= TRANSPARENT


def equal(a: Column, b: Column) -> Column:
    """The same colour, or where either is none, the same text but for case and blanks."""
    x, y = normal(a), normal(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.lower(F.trim(a)).eqNullSafe(F.lower(F.trim(b))))


def slug(text: Column) -> Column:
    """A stable name: hex digits, those with alpha in hex, or the text's letters and digits."""
    c = channels(text)
    six = F.format_string("%02x%02x%02x", c["r"], c["g"], c["b"])
    clear = F.concat(six, F.lit("-"), F.format_string("%02x", F.floor(c["a"] * 255 + 0.5).cast("int")))
    words = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(c.isNull(), words).when(c["a"] < OPAQUE, clear).otherwise(six)
