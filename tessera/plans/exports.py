"""Exports of tokens as text: a row for each site, lines in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of custom properties by token group; {i} is the place from 1.
PROPERTY = {"colors": "color", "fontSizes": "font-size", "fontWeights": "font-weight", "lineHeights": "line-height", "fontFamilies": "font-family", "letterSpacings": "letter-spacing", "spacing": "spacing", "radii": "radius", "shadows": "shadow", "borders": "border", "zIndices": "z-index", "transitions": "transition"}
DTCG_TYPES = {"colors": "color", "fontSizes": "dimension", "spacing": "dimension", "radii": "dimension", "fontFamilies": "fontFamily", "fontWeights": "fontWeight", "transitions": "duration", "shadows": "shadow"}


def property_name(group: Column, label: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in PROPERTY.items() for x in kv))
    return F.concat(F.coalesce(F.element_at(names, group), group), F.lit("-"), label.cast("string"))


def _label(tokens: DataFrame) -> Column:
    """A token's name where it has one, as colours do, else its place."""
    place = F.col("ord").cast("string")
    return F.coalesce("name", place) if "name" in tokens.columns else place


def _joined(tokens: DataFrame, on: list[str], line: Column, before: str, after: str) -> DataFrame:
    rows = tokens.select(*on, F.struct("group", "ord", line.alias("line")).alias("l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n")
    return rows.groupBy(*on).agg(F.concat(F.lit(before), text, F.lit(after)).alias("text"))


def css_variables(tokens: DataFrame, on: list[str]) -> DataFrame:
    """on, text: a :root rule. tokens: on, group, ord, value, and name for what is named."""
    return _joined(tokens, on, F.concat(F.lit("  --"), property_name(F.col("group"), _label(tokens)), F.lit(": "), F.col("value"), F.lit(";")), ":root {\n", "\n}\n")


def scss(tokens: DataFrame, on: list[str]) -> DataFrame:
    return _joined(tokens, on, F.concat(F.lit("$"), property_name(F.col("group"), _label(tokens)), F.lit(": "), F.col("value"), F.lit(";")), "", "\n")


def tailwind(tokens: DataFrame, on: list[str]) -> DataFrame:
    return _joined(tokens, on, F.concat(F.lit("  --"), property_name(F.col("group"), _label(tokens)), F.lit(": "), F.col("value"), F.lit(";")), '@import "tailwindcss";\n\n@theme {\n', "\n}\n")


def dtcg(tokens: DataFrame, on: list[str]) -> DataFrame:
    """on, text: JSON of groups of {name: {$type, $value}}."""
    types = F.create_map(*(F.lit(x) for kv in DTCG_TYPES.items() for x in kv))
    leaf = F.struct(F.coalesce(F.element_at(types, F.col("group")), F.lit("string")).alias("$type"), F.col("value").alias("$value"))
    groups = tokens.groupBy(*on, "group").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(_label(tokens).alias("k"), leaf.alias("v")).alias("e")))), lambda x: x["e"])).alias("leaves"))
    return groups.groupBy(*on).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("group", "leaves")), lambda a, b: F.when(a["group"] < b["group"], -1).when(a["group"] > b["group"], 1).otherwise(0)))).alias("text"))


def markdown(tokens: DataFrame, on: list[str]) -> DataFrame:
    """on, text: one list for each group."""
    line = F.concat(F.lit("- "), property_name(F.col("group"), _label(tokens)), F.lit(": `"), F.col("value"), F.lit("`"))
    return _joined(tokens, on, F.concat(F.when(F.col("ord") == 1, F.concat(F.lit("\n## "), F.col("group"), F.lit("\n\n"))).otherwise(""), line), "# Design tokens\n", "\n")


FORMATS = {"css": css_variables, "scss": scss, "tailwind": tailwind, "json": dtcg, "markdown": markdown}


def export(tokens: DataFrame, on: list[str], names: str) -> dict[str, DataFrame]:
    """The named formats, separated by commas; all means every one."""
    wanted = list(FORMATS) if names == "all" else [n.strip() for n in names.split(",")]
    if unknown := [n for n in wanted if n not in FORMATS]:
        raise ValueError(f"unknown formats: {', '.join(unknown)}")
    return {n: FORMATS[n](tokens, on) for n in wanted}
