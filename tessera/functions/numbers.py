"""Number rules shared by the other functions: rounding halves up, fixed places, plain decimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, places: int = 0) -> Column:
    """Rounds halves toward plus infinity: -2.5 gives -2."""
    scale = 10**places
    return F.floor(c.cast("double") * scale + 0.5) / scale


def plain(c: Column, places: int = 3) -> Column:
    """A number as text with at most so many places and no trailing zeros."""
    text = F.format_string(f"%.{places}f", c.cast("double"))
    return F.when(c.isNotNull(), F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def number(text: Column) -> Column:
    """The text as a double, null where it is none."""
    return text.try_cast("double")


def clamp(c: Column, low: float, high: float, places: int = 1) -> Column:
    """Bounded and rounded, null where not finite."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite, half_up(F.least(F.greatest(c, F.lit(low)), F.lit(high)), places))
