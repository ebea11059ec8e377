"""Colour tokens by what they are used for: one canonical name for each colour, and its dominant role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from .ranking import top

# Roles with their usage categories, in order of preference; names that tell a role; labels in the order of the list.
ROLES = {
    "action": ("primaryActionBackgroundColor", "primaryActionColor", "actionBackgroundColor", "actionColor", "selectedColor"),
    "editorial": ("actionForegroundColor", "linkColor"),
    "status": ("statusBackgroundColor", "statusForegroundColor", "statusColor"),
    "decorative": ("accentColor", "bgColor"),
    "text": ("textColor",),
    "surface": ("bgColor", "bgArea"),
    "border": ("borderColor", "structuralBorderColor"),
    "fallback": (),
}
RENDERED = (
    "primaryActionBackgroundColor", "primaryActionForegroundColor", "primaryActionColor", "actionBackgroundColor", "actionForegroundColor", "actionColor", "selectedColor", "accentColor", "linkColor",
    "statusBackgroundColor", "statusForegroundColor", "statusColor", "bgColor", "bgArea", "textColor", "borderColor", "structuralBorderColor",
)
DECLARED = ("declaredColor", "brandTokenColor")
LABELS = ("action", "editorial", "status", "decorative", "text", "surface", "border", "declared", "fallback")
ROLE_NAMES = (
    (r"(?i)danger|warning|success|status|delta|badge", "status"), (r"(?i)^editorial-accent$", "editorial"), (r"(?i)^decorative-accent$", "decorative"), (r"(?i)^accent$", None),
    (r"(?i)^(?:background|surface|secondary)(?:-|$)", "surface"), (r"(?i)^(?:foreground|muted-foreground|text)(?:-|$)", "text"), (r"(?i)^border(?:-|$)", "border"), (r"(?i)^(?:primary|action)(?:-|$)", "action"),
)
SEMANTIC_NAME = r"^(?:background|surface|secondary|foreground|muted-foreground|primary|accent|border(?:-.+)?|danger|warning|success|status|.*badge.*)$"
PALETTE_NAME = r"^(?:dark-)?palette-\d+$"
MOST_NAMES = 6


def name_priority(name: Column) -> Column:
    return F.when(name.rlike(SEMANTIC_NAME), 3).when(name.rlike(PALETTE_NAME), 0).otherwise(1)


def named_role(name: Column, has_primary: Column) -> Column:
    """The role that a name tells, null for none; accent is an action's where there is a primary colour."""
    out = F.lit(None).cast("string")
    for pattern, role in reversed(ROLE_NAMES):
        out = F.when(name.rlike(pattern), F.when(has_primary, "action").otherwise("decorative") if role is None else F.lit(role)).otherwise(out)
    return out


def color_groups(tokens: DataFrame, usage: DataFrame, sources: DataFrame, observed: DataFrame, group: list[str]) -> DataFrame:
    """group, label, label_order, place, name, score: the colours of each label, the most used first, MOST_NAMES at most.

    Names of one colour are aliases: the canonical one has the clearest name, then the most observations, then comes first by name. A colour that is declared and never rendered is
    declared; else its name tells its role, else its usage (a source counts like one use), the roles in order on ties; without any it is a fallback. Equal scores keep the tokens' order.
    tokens: group, ord, name, value; usage: group, category, value, n; sources: group, name, source (usage:<category>); observed: group, name, observations.
    """
    c = F.col
    known = tokens.withColumn("shade", color.normal(c("value"))).where("shade is not null")
    first = known.groupBy(*group, "shade").agg(F.min("ord").alias("first"))
    best = known.join(observed.select(*group, "name", "observations"), [*group, "name"], "left")
    best = top(best, [*group, "shade"], [name_priority(c("name")).desc(), F.coalesce("observations", F.lit(0)).desc(), c("name")], 1, "_r").select(*group, "shade", "name")
    used = usage.select(*group, "category", color.normal(c("value")).alias("shade"), c("n").cast("double").alias("n")).where("shade is not null")
    told = sources.where(c("source").startswith("usage:")).select(*group, "name", F.substring("source", 7, 200).alias("category")).join(known.select(*group, "name", "shade"), [*group, "name"])
    once = told.select(*group, "category", "shade").distinct()
    parts = used.select(*group, "shade", "category", "n", c("n").alias("used")).unionByName(once.select(*group, "shade", "category", F.lit(1.0).alias("n"), F.lit(0.0).alias("used")))
    of = lambda names, what: F.coalesce(F.sum(F.when(c("category").isin(*names), c(what))), F.lit(0.0)) if names else F.lit(0.0)
    scores = parts.groupBy(*group, "shade").agg(*(of(names, "n").alias(f"s_{r}") for r, names in ROLES.items() if names), of(RENDERED, "used").alias("rendered"), of(DECLARED, "used").alias("declared"))
    primary = known.where("name = 'primary'").select(*group).distinct().withColumn("has_primary", F.lit(True))
    whole = best.join(first, [*group, "shade"]).join(scores, [*group, "shade"], "left").join(primary, group, "left").fillna(0.0)
    whole = whole.withColumn("s_fallback", F.lit(0.0))
    ranked = F.array_max(F.array(*(F.struct(c(f"s_{r}").alias("score"), F.lit(-i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(ROLES))))
    whole = whole.withColumn("_d", ranked)
    by_use = F.when(c("_d.score") > 0, c("_d.role")).otherwise("fallback")
    label = F.when((c("rendered") == 0) & (c("declared") > 0), "declared").otherwise(F.coalesce(named_role(c("name"), F.coalesce("has_primary", F.lit(False))), by_use))
    whole = whole.withColumn("label", label)
    own = F.element_at(F.create_map(*(x for r in ROLES for x in (F.lit(r), c(f"s_{r}")))), c("label"))
    scored = whole.withColumn("score", F.greatest(F.lit(1.0), F.when(c("label") == "declared", c("declared")).otherwise(own)))
    out = top(scored, [*group, "label"], [c("score").desc(), c("first")], MOST_NAMES, "place")
    return out.select(*group, "label", F.array_position(F.array(*map(F.lit, LABELS)), c("label")).cast("int").alias("label_order"), "place", "name", "score")
