"""Which tokens the styles of elements use: spellings of values, the namespace that a property takes, and line heights as ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, css
from ..functions.numbers import plain

# The token namespaces by property, in order, and the parts of a value that are looked up besides the whole.
NAMESPACES = (
    (r"^(?:color|backgroundColor|border(?:Top|Right|Bottom|Left)?Color|outlineColor|textDecorationColor|fill|stroke)$", r"^color\."),
    (r"^border(?:Top|Right|Bottom|Left)?$", r"^border\."),
    (r"^border(?:Radius|(?:TopLeft|TopRight|BottomRight|BottomLeft)Radius)$", r"^radius\."),
    (r"^boxShadow$", r"^shadow\."),
    (r"^fontFamily$", r"^typography\.font-(?:family|stack)\."),
    (r"^fontSize$", r"^typography\.font-size\."),
    (r"^fontWeight$", r"^typography\.font-weight\."),
    (r"^lineHeight$", r"^typography\.line-height\."),
    (r"^letterSpacing$", r"^typography\.letter-spacing\."),
    (r"^(?:gap|rowGap|columnGap|padding(?:Top|Right|Bottom|Left)?|margin(?:Top|Right|Bottom|Left)?)$", r"^spacing\."),
    (r"^zIndex$", r"^z-index\."),
    (r"^transition", r"^transition\."),
)
PARTS = r"(?i)(rgba?\([^)]+\)|#[\da-f]{3,8}|-?\d+(?:\.\d+)?(?:px|rem|em|s|ms)\b)"
LINE_HEIGHT = "typography.line-height."


def compatible(name: Column, ref: Column) -> Column:
    """Whether a property may use a token: 16px is a font size, a spacing or a radius, by where it stands. Other properties use none."""
    out = F.lit(False)
    for prop, space in reversed(NAMESPACES):
        out = F.when(name.rlike(prop), ref.rlike(space)).otherwise(out)
    return out


def spellings(text: Column) -> Column:
    """The forms under which a value is looked up: as it is, as a colour, lengths in rem, fonts without quotes; all in lower case."""
    low = F.lower(F.trim(text))
    whole = text.rlike(r"(?i)^rgba?\(\s*\d+[,\s]+\d+[,\s]+\d+(?:\s*[,/]\s*1(?:\.0*)?)?\s*\)$")
    shade = F.when(whole, color.normal(text)).otherwise(low)
    plain_text = F.regexp_replace(F.trim(shade), r"\s+", " ")
    token = F.when(plain_text.rlike(r"^-?\d+(?:\.\d+)?px$"), css.px_to_rem(F.regexp_extract(plain_text, r"^(-?[\d.]+)", 1).cast("double"))).otherwise(plain_text)
    return F.array_distinct(F.array(low, shade, token, css.font_normal(text)))


def style_token_refs(styles: DataFrame, tokens: DataFrame, on: list[str]) -> DataFrame:
    """on, id, refs: the tokens that each element's styles use, sorted. styles: on, id, styles (map of computed properties); tokens: on, ref (namespace first), value.

    A value is looked up whole and by the colours, lengths and times inside it; only references of the property's namespace count. A line height in a length also counts as its ratio to the font
    size. Elements that use none have an empty list. One equi-join by spelling; an element's references are as many as a site has tokens at most.
    """
    index = tokens.select(*on, "ref", F.explode(spellings(F.col("value"))).alias("variant")).distinct()
    each = styles.select(*on, "id", F.explode("styles").alias("property", "text")).where("text is not null")
    inner = F.transform(F.regexp_extract_all("text", F.lit(PARTS), F.lit(1)), spellings)
    tried = each.select(*on, "id", "property", F.explode(F.array_distinct(F.array_union(spellings(F.col("text")), F.flatten(inner)))).alias("variant"))
    found = tried.join(index, [*on, "variant"]).where(compatible(F.col("property"), F.col("ref"))).select(*on, "id", "ref")
    size, height = (css.length_px(F.when(css.scalar_length(F.element_at("styles", k)), F.element_at("styles", k))) for k in ("fontSize", "lineHeight"))
    ratio = styles.select(*on, "id", F.when((size != 0) & (height != 0), plain(height / size, 3)).alias("variant")).where("variant is not null")
    found = found.unionByName(ratio.join(index.where(F.col("ref").startswith(LINE_HEIGHT)), [*on, "variant"]).select(*on, "id", "ref"))
    listed = found.distinct().groupBy(*on, "id").agg(F.array_sort(F.collect_list("ref")).alias("refs"))
    return styles.select(*on, "id").join(listed, [*on, "id"], "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))


def merged_sources(sources: DataFrame, group: list[str]) -> DataFrame:
    """group, key, source, ord: the sources of every value over all captures, each once, where it first occurs. sources: group, ord, key, source."""
    return sources.groupBy(*group, "key", "source").agg(F.min("ord").alias("ord"))
