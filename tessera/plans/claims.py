"""From capture snapshots to claims: the tables of claim_rules, filled from what a snapshot holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import css, ids
from ..operators import claim_rules, gates, roles, token_refs
from ..sources import snapshots
from ..staging import cut

#: Token namespaces by group of the analysis's tokens.
NAMESPACE = {
    "fontSizes": "typography.font-size", "fontWeights": "typography.font-weight", "lineHeights": "typography.line-height", "spacing": "spacing", "radii": "radius", "shadows": "shadow", "borders": "border",
    "fontFamilies": "typography.font-family", "letterSpacings": "typography.letter-spacing", "zIndices": "z-index", "transitions": "transition",
}
ON = ["analysisId"]


def references(tokens: DataFrame, colors: DataFrame) -> DataFrame:
    """analysisId, ref, value of an analysis's tokens and named colours."""
    names = F.create_map(*(F.lit(x) for kv in NAMESPACE.items() for x in kv))
    scale = tokens.select(*ON, F.concat_ws(".", F.element_at(names, F.col("group")), F.col("ord").cast("string")).alias("ref"), "value").where("ref is not null")
    return scale.unionByName(colors.select(*ON, F.concat(F.lit("color."), F.col("name")).alias("ref"), "value"))


def _style(name: str) -> Column:
    return F.element_at("styles", name)


def _surface() -> dict[str, Column]:
    sides = [_style(k) for k in ("border", "borderTop", "borderRight", "borderBottom", "borderLeft")]
    drawn = F.lit(False)
    for side in sides:
        drawn = drawn | css.visible_border(side)
    paint = _style("backgroundColor")
    return {"bordered": drawn, "shadowed": F.coalesce(css.visible_shadow(_style("boxShadow")), F.lit(False)), "filled": paint.isNotNull() & (paint != "")}


def tables(captures: DataFrame, tokens: DataFrame, colors: DataFrame) -> dict[str, DataFrame]:
    """The tables that draft_claims takes, by name, from snapshots. Snapshots hold neither interactions, text nodes nor media, so those tables are empty."""
    some = captures.where("analysisId is not null")
    codes = F.transform(F.coalesce("health.issues", F.array().cast(captures.schema["health"].dataType["issues"].dataType)), lambda i: i["code"])
    fit = F.col("health").isNull() | gates.evidence_eligible(F.col("health.status"), codes)
    page = ids.stable_id("page", F.col("analysisId"), F.col("url"), F.col("viewport"))
    wide = F.col("viewportWidth").cast("int")
    pages = some.select(*ON, page.alias("page"), "url", "viewport", wide.alias("viewport_width"), wide.alias("content_width"), F.lit(False).alias("severe"), fit.alias("eligible")).dropDuplicates([*ON, "page"])
    refs = references(tokens, colors)

    def entities(field: str, kind: str) -> DataFrame:
        held = snapshots.entity_table(some, field).withColumn("page", page)
        named = cut(ids.with_instance_ids(held, kind, [*ON, "url", "viewport", "key"], ["ord"]).withColumns(_surface()))
        found = token_refs.style_token_refs(named.select(*ON, "id", F.coalesce("styles", F.create_map().cast("map<string,string>")).alias("styles")), refs, ON)
        return named.join(found.withColumnRenamed("refs", "token_refs"), [*ON, "id"])

    sections, parts = entities("sections", "section"), entities("components", "component")
    surfaces = ["token_refs", "bordered", "shadowed", "filled"]
    rows = sections.select(*ON, "id", "page", F.coalesce("order", "ord").alias("place"), F.coalesce("role", F.lit("unknown")).alias("role"), F.col("layoutMode").alias("layout_mode"), F.coalesce("rect.x", F.lit(0.0)).alias("x"), F.coalesce("rect.width", F.lit(1.0)).alias("width"), *surfaces)
    owner = sections.select(*ON, "page", F.col("key").alias("sectionKey"), F.col("id").alias("section"))
    shape = roles.component_shape(F.coalesce(_style("borderRadius"), F.lit("0")), F.lit(None).cast("double"))
    kept = parts.join(owner, [*ON, "page", "sectionKey"]).select(*ON, "id", "page", "section", F.col("ord").alias("place"), "type", "role", shape.alias("shape"), F.lit(None).cast("string").alias("variant"), *surfaces)
    spark = captures.sparkSession
    none = lambda ddl: spark.createDataFrame([], f"analysisId string, {ddl}")
    return {
        "pages": pages, "sections": rows, "components": kept, "nodes": none("id string, page string, section string, place int, role string, typed boolean, token_refs array<string>"),
        "interactions": none("id string, page string, place int, driver string, safety string, properties array<string>, transition boolean"), "media": none("id string, page string, place int, kind string, role string, importance string"),
        "overflow": none("page string, section string"),
    }


def claims_of(captures: DataFrame, tokens: DataFrame, colors: DataFrame) -> dict[str, DataFrame]:
    """claims and assertions of every analysis in the snapshots; see claim_rules.assemble."""
    drafted, assertions = claim_rules.draft_claims(**tables(captures, tokens, colors), on=ON)
    return {"claims": drafted, "assertions": assertions}
