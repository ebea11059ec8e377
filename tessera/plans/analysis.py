"""From capture snapshots to tokens with provenance, evidence and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, css, ids
from ..operators import clusters, evidence, gates, ranking, usage
from ..sources import snapshots
from . import colors as color_plan

#: Token groups with the usage category that feeds them.
GROUPS = {"fontSizes": "fontSize", "fontWeights": "fontWeight", "lineHeights": "lineHeight", "spacing": "spacing", "radii": "radius", "shadows": "shadow", "borders": "border", "fontFamilies": "fontFamily", "letterSpacings": "letterSpacing", "zIndices": "zIndex", "transitions": "transition"}
COLOR_CATEGORIES = ("textColor", "bgColor", "borderColor", "declaredColor")


def numeric_key(group, value):
    """What a scale is ordered by."""
    out = css.length_px(value)
    out = F.when(group == "transitions", css.duration_ms(F.get(F.regexp_extract_all(value, F.lit(r"([\d.]+m?s)"), F.lit(1)), F.lit(0)))).when(group == "shadows", css.shadow_sort_score(value)).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def eligible(captures: DataFrame) -> DataFrame:
    codes = F.transform(F.coalesce("health.issues", F.expr("array()").cast(captures.schema["health"].dataType["issues"].dataType)), lambda i: i["code"])
    return captures.where(F.col("health").isNull() | gates.evidence_eligible(F.col("health.status"), codes))


def analyse(captures: DataFrame) -> dict[str, DataFrame]:
    """Named tables: usage, votes, tokens, palette, colors, color_pairs, token_evidence, components, coverage, sections. colors holds the named colour tokens (analysisId, name, value)."""
    good = eligible(captures.where("analysisId is not null"))
    table = snapshots.usage_table(good)
    votes = usage.vote_shares(table, ["analysisId"], "viewport", "url")
    names = F.create_map(*(F.lit(x) for k, v in GROUPS.items() for x in (v, k)))
    sizes = F.create_map(*(F.lit(x) for k in GROUPS for x in (k, ranking.SCALE_SIZES[k])))
    grouped = votes.withColumn("group", F.element_at(names, F.col("category"))).where("group is not null").select("analysisId", "group", "category", "value", F.col("weight").alias("n"))
    grouped = grouped.withColumn("number", numeric_key(F.col("group"), F.col("value"))).where((F.col("group") != "spacing") | ((F.col("number") > 0) & (F.col("number") <= 96)))
    most = max(ranking.SCALE_SIZES.values())
    scaled = ranking.top(grouped, ["analysisId", "group"], [F.col("n").desc(), F.col("value")], most, "_rank").where(F.col("_rank") <= F.element_at(sizes, F.col("group")))
    tokens = ranking.scale(scaled.drop("_rank"), ["analysisId", "group"], most, "number").withColumn("token", F.concat_ws(".", "group", (F.col("ord") - 1).cast("string")))
    colors = votes.where(F.col("category").isin(*COLOR_CATEGORIES)).groupBy("analysisId", "value").agg(F.sum("weight").alias("n"))
    colors = colors.withColumn("ord", F.row_number().over(Window.partitionBy("analysisId").orderBy(F.col("n").desc(), "value")))
    palette = clusters.leader_clusters(colors, ["analysisId"])
    palette = palette.withColumn("value", color.normal(F.col("value")))
    weighed = votes.select("analysisId", "category", "value", F.col("weight").alias("n"), F.row_number().over(Window.partitionBy("analysisId", "category").orderBy(F.col("weight").desc(), "value")).alias("ord"))
    acts = snapshots.observation_table(good)
    named = color_plan.color_tokens(weighed, acts, ["analysisId"])
    observed = table.withColumn("capture", F.concat_ws("::", "url", "viewport")).withColumn("source", F.concat(F.lit("usage:"), F.col("category")))
    parts = [evidence.provenance(tokens.where(F.col("group") == g).select(F.concat_ws("/", "analysisId", "token").alias("token"), F.concat_ws("/", "analysisId", "category").alias("category"), "value"), observed.withColumn("category", F.concat_ws("/", "analysisId", "category")), g) for g in GROUPS]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    score = gates.token_score(F.col("pages"), F.col("captures"), F.col("observations"), F.lit(False), F.lit(False), F.lit(False))
    sections = snapshots.entity_table(good, "sections")
    sections = ids.with_instance_ids(sections, "section", ["analysisId", "url", "viewport", "key"], ["ord"])
    components = snapshots.entity_table(good, "components")
    summary = components.groupBy("analysisId", "type").agg(F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("confidence"))
    wanted = captures.select("analysisId", "url").distinct().join(captures.select("analysisId", "viewport").distinct(), "analysisId")
    return {"usage": usage.frequency(table, ["analysisId", "category", "value"]), "votes": votes, "tokens": tokens, "palette": palette, "colors": named, "color_pairs": color_plan.color_pairs(named, acts, ["analysisId"]), "token_evidence": found.withColumn("confidence", gates.confidence(score)), "sections": sections, "components": summary, "coverage": evidence.coverage(good, wanted, ["analysisId"])}
