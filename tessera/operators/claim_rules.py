"""Claims drafted from evidence: what the sections, components, interactions and media of an analysis say together.

Every rule gives three tables: drafts (on, key, ord, placements, subject and, where it is fixed, confidence), cites (on, key, id, and where agreement counts the value said,
and whether the evidence is passive) and assertions (on, key, pos, kind, target, predicate, property, value, evidence). `assemble` then looks at what each claim cites in one grouped
pass: its evidence, its scope by the number of URLs, its confidence by scope, agreement and passivity, its token references and its id.

The tables of all rules are written once before they meet (see staging), since the plan of each has many parts. Samples are the first few of an order, as the rules say; groups are counted before that, so a large analysis costs its rows once. Texts are not written here: subject holds what a
sentence would name. on are the columns of an analysis. Tables, with on: pages (page, url, viewport, viewport_width, content_width, severe, eligible), sections (id, page, place, role,
layout_mode, x, width, token_refs, bordered, shadowed, filled), components (id, page, section, place, type, role, shape, variant, token_refs, bordered, shadowed, filled), nodes (id, page, section, place,
role, typed, token_refs), interactions (id, page, place, driver, safety, properties, transition), media (id, page, place, kind, role, importance), overflow (page, section).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..staging import cut
from . import claims, gates, ranking, roles

# How many of what a rule looks at, and the share from which values agree.
SECTION_SAMPLE, ROLE_GROUPS, ROLE_SAMPLE, TRANSITIONS, PAIRS = 8, 8, 6, 4, 4
COMPONENT_GROUPS, COMPONENT_SAMPLE, INTERACTION_GROUPS, INTERACTION_SAMPLE, VISUAL_SAMPLE = 10, 6, 10, 12, 16
COLOR_REFS, TOKEN_REFS, MOST_REFS, MEDIA_SAMPLE, OVERFLOW_PAGES = 6, 8, 12, 8, 4
AGREEMENT = 0.75
STATE_PROPERTIES = r"(?i)^(?:aria-|data-|checked$|disabled$|selected$|expanded$)"
VIEWPORTS = {"desktop": 0, "tablet": 1, "mobile": 2}
#: Rules in the order in which their claims come, by their keys' first part.
ORDER = ("sequence", "entry", "container", "alignment", "density", "color", "typography", "shape", "surfaces", "section", "component", "interaction", "feedback", "amplitude", "motion", "overflow", "imagery")

_C = F.col


@dataclass
class Drafts:
    """The three tables of a rule."""

    drafts: DataFrame
    cites: DataFrame
    assertions: DataFrame


def _place(rule: str, rank: Column | int = 0) -> Column:
    return F.lit(ORDER.index(rule) * 1000) + (F.lit(rank) if isinstance(rank, int) else rank)


def _draft(df: DataFrame, on: list[str], key: Column, ord_: Column, placements: list[Column], subject: dict[str, Column], confidence: Column | None = None) -> DataFrame:
    said = F.map_from_arrays(F.array(*map(F.lit, subject)), F.array(*(c.cast("string") for c in subject.values()))) if subject else F.create_map().cast("map<string,string>")
    fixed = F.lit(None).cast("string") if confidence is None else confidence
    return df.select(*on, key.alias("key"), ord_.cast("int").alias("ord"), F.array_compact(F.array(*placements)).alias("placements"), said.alias("subject"), fixed.alias("fixed"))


def _cite(df: DataFrame, on: list[str], key: Column, ident: Column, said: Column | None = None, passive: Column | None = None) -> DataFrame:
    return df.select(*on, key.alias("key"), ident.alias("id"), (F.lit(None).cast("string") if said is None else said).alias("said"), (F.lit(False) if passive is None else passive).alias("passive"))


def _assert(df: DataFrame, on: list[str], key: Column, pos: Column, kind: str, target: Column, predicate: str, evidence: Column, value: Column | None = None, name: Column | str | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    prop = none if name is None else F.lit(name) if isinstance(name, str) else name
    held = F.lit(None).cast("array<string>") if value is None else F.array(value.cast("string"))
    return df.select(*on, key.alias("key"), pos.cast("long").alias("pos"), F.lit(kind).alias("kind"), target.alias("target"), F.lit(predicate).alias("predicate"), prop.alias("property"), held.alias("value"), evidence.alias("evidence"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _first(df: DataFrame, group: list[str], order: list[str | Column], n: int, name: str = "pos") -> DataFrame:
    return ranking.top(df, group, [_C(c) if isinstance(c, str) else c for c in order], n, name)


def canonical_pages(pages: DataFrame, on: list[str]) -> DataFrame:
    """One page for each URL: healthy, without severe overflow; desktop, tablet, mobile, others; then the wider, then by id."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in VIEWPORTS.items() for x in kv)), _C("viewport")), F.lit(3))
    fit = pages.where(~F.coalesce("severe", F.lit(False)) & F.coalesce("eligible", F.lit(True)))
    return ranking.first_row(fit, [*on, "url"], [rank, F.coalesce("viewport_width", F.lit(0)).desc(), _C("page")])


def sequence_claims(sections: DataFrame, on: list[str]) -> Drafts:
    """The most frequent order of roles of a page, where repeats count once, and the most frequent first role."""
    w = Window.partitionBy(*on, "page").orderBy("place", "id")
    known = sections.where("role <> 'unknown'").withColumn("_before", F.lag("role").over(w)).where("_before is null or _before <> role")
    known = known.select(*on, "page", "id", "role", F.row_number().over(w).alias("step"), F.lead("role").over(w).alias("next_role"), F.lead("id").over(w).alias("next_id"))
    chain = known.groupBy(*on, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "role"))), lambda s: s["role"]), ">").alias("way"), F.min_by("role", "step").alias("entry"))  # one page's sections
    best = lambda c: ranking.first_row(chain.groupBy(*on, c).agg(F.count(F.lit(1)).alias("captures")), on, [_C("captures").desc(), _C(c)])
    ways, entries = best("way"), best("entry")
    steps = known.join(chain.join(ways, [*on, "way"]).select(*on, "page"), [*on, "page"])
    opened = known.join(chain.join(entries, [*on, "entry"]).select(*on, "page"), [*on, "page"]).where("step <= 2")
    s, e = F.lit("observed-section-sequence"), F.lit("observed-entry-section")
    pair, alone = (_C("next_id").isNotNull()), (_C("next_id").isNull() & (_C("step") == 1))
    place = F.xxhash64("page").bitwiseAND(F.lit((1 << 40) - 1)) * 64 + _C("step")  # any order of pages, steps in order
    return Drafts(
        _draft(ways, on, s, _place("sequence"), [F.lit(x) for x in ("singleton:thesis", "singleton:composition.rhythm", "attention-sequence")] + [F.lit("signature?")], {"roles": F.replace("way", F.lit(">"), F.lit(" -> ")), "captures": _C("captures")})
        .unionByName(_draft(entries, on, e, _place("entry"), [F.lit("singleton:attention.entry")], {"role": _C("entry"), "captures": _C("captures")})),
        _cite(steps, on, s, _C("id")).unionByName(_cite(opened, on, e, _C("id"))),
        _all([
            _assert(steps.where(pair & (_C("step") <= PAIRS)), on, s, place, "section", _C("role"), "ordered-before", F.array("id", "next_id"), _C("next_role")),
            _assert(steps.where(alone), on, s, place, "section", _C("role"), "present", F.array("id")),
            _assert(opened.where("step = 1"), on, e, place * 2, "section", _C("role"), "present", F.array("id")),
            _assert(opened.where(pair & (_C("step") == 1)), on, e, place * 2 + 1, "section", _C("role"), "ordered-before", F.array("id", "next_id"), _C("next_role")),
        ]),
    )


def composition_claims(sections: DataFrame, on: list[str]) -> Drafts:
    """The median width and the most frequent anchor of the first sections, and how many sections pages have."""
    some = _first(sections, on, ["page", "place", "id"], SECTION_SAMPLE).withColumn("anchor", roles.section_anchor(_C("x"), _C("width")))
    percent = F.floor(F.percentile("width", F.lit(0.5)) * 100 + 0.5).cast("int")
    wide = some.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), percent.alias("percent"))
    modes = some.groupBy(*on, "anchor").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    mode = ranking.first_row(modes, on, [_C("n").desc(), _C("first")])
    counts = sections.groupBy(*on, "page").agg(F.count(F.lit(1)).alias("n")).groupBy(*on).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("captures"))
    keys = {k: F.lit(f"composition-{k}") for k in ("container", "alignment", "density")}
    slot = lambda k: [F.lit(f"singleton:composition.{k}")]
    texts = lambda *c: F.array(*(x.cast("string") for x in c))
    return Drafts(
        _all([
            _draft(wide, on, keys["container"], _place("container"), slot("container"), {"count": _C("n"), "width": _C("percent")}),
            _draft(mode, on, keys["alignment"], _place("alignment"), slot("alignment"), {"anchor": _C("anchor"), "count": _C("n")}),
            _draft(counts, on, keys["density"], _place("density"), slot("density"), {"minimum": _C("low"), "maximum": _C("high"), "captures": _C("captures")}),
        ]),
        _all([_cite(some, on, keys["container"], _C("id")), _cite(some, on, keys["alignment"], _C("id"), _C("anchor")), _cite(sections, on, keys["density"], _C("id"))]),
        _all([
            _values(wide, on, keys["container"], "rect.width.median-percent", texts(_C("percent"))),
            _values(mode, on, keys["alignment"], "rect.anchor", texts(_C("anchor"))), _values(counts, on, keys["density"], "detected-section-count-range", texts(_C("low"), _C("high"))),
        ]),
    )


def _values(df: DataFrame, on: list[str], key: Column, name: str, value: Column, target: str = "composition", pos: int = 0) -> DataFrame:
    """An assertion that all the claim's evidence supports; its evidence is filled in by assemble."""
    told = df.withColumn("_value", value)
    return _assert(told, on, key, F.lit(pos), "evidence", F.lit(target), "supports", F.lit(None).cast("array<string>"), None, name).drop("value").join(told.select(*on, key.alias("key"), _C("_value").alias("value")), [*on, "key"])


def visual_claims(sections: DataFrame, components: DataFrame, nodes: DataFrame, on: list[str]) -> Drafts:
    """The first colour references and who owns them, typography of text nodes, corner shapes of components, and drawn surfaces."""
    columns = [*on, "id", "page", "place", "token_refs", "bordered", "shadowed", "filled"]
    owners = sections.select(*columns, F.lit(0).alias("side")).unionByName(components.select(*columns, F.lit(1).alias("side")))
    order = ["side", "page", "place", "id"]
    keys = {k: F.lit(f"visual-{k}") for k in ("color", "typography", "shape", "surfaces")}
    slot = lambda k: [F.lit(f"singleton:visual.{k}")]
    refs = roles.owner_refs(owners.withColumnRenamed("token_refs", "refs"), on, order[:-1], "color.", COLOR_REFS)
    typed = nodes.join(sections.select(*on, _C("id").alias("section")), [*on, "section"], "left_semi").where(_C("typed") | F.exists("token_refs", lambda r: r.startswith("typography.")))
    texts, shapes = _first(typed, on, ["page", "place", "id"], TOKEN_REFS), _first(components, on, ["page", "place", "id"], TOKEN_REFS)
    drawn = _first(owners.where(_C("filled") | _C("bordered") | _C("shadowed")), on, order, TOKEN_REFS)
    of = lambda c: F.count(F.when(_C(c), 1))
    surfaces = drawn.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), of("bordered").alias("b"), of("shadowed").alias("s"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")  # noqa: E731  of a sample
    return Drafts(
        _all([
            _draft(refs.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), on, keys["color"], _place("color"), slot("color"), {"count": _C("n")}),
            _draft(texts.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), names("role").alias("r")), on, keys["typography"], _place("typography"), slot("typography"), {"count": _C("n"), "roles": _C("r")}),
            _draft(shapes.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), names("shape").alias("r")), on, keys["shape"], _place("shape"), slot("shape"), {"count": _C("n"), "shapes": _C("r")}),
            _draft(surfaces, on, keys["surfaces"], _place("surfaces"), slot("surfaces"), {"count": _C("n"), "bordered": _C("b"), "shadowed": _C("s")}),
        ]),
        _all([_cite(refs, on, keys["color"], _C("owner"))] + [_cite(df, on, keys[k], _C("id")) for k, df in (("typography", texts), ("shape", shapes), ("surfaces", drawn))]),
        _all([
            _assert(refs, on, keys["color"], _C("place"), "token", _C("ref"), "observed", F.array("owner")),
            _assert(texts, on, keys["typography"], _C("pos"), "evidence", F.lit("typography"), "supports", F.array("id"), _C("role"), "text-role"),
            _assert(shapes, on, keys["shape"], _C("pos"), "component", _C("type"), "corner-shape", F.array("id"), _C("shape")),
            _values(surfaces, on, keys["surfaces"], "observed-surface-counts", F.array(*(F.concat(F.lit(f"{n}:"), _C(c).cast("string")) for n, c in (("owners", "n"), ("bordered", "b"), ("shadowed", "s")))), "surfaces"),
        ]),
    )


def _groups(df: DataFrame, group: list[str], most: int, on: list[str]) -> DataFrame:
    """The most frequent groups with their rank from 1, ties by name."""
    return _first(df.groupBy(*on, *group).agg(F.count(F.lit(1)).alias("n")), on, [_C("n").desc(), *group], most, "rank")


def section_claims(sections: DataFrame, urls: DataFrame, on: list[str]) -> Drafts:
    """For each frequent role: its layouts, its place where that is always the same, and the role that follows where that is always the same."""
    named = sections.where("role <> 'unknown'")
    ranked = named.join(_groups(named, ["role"], ROLE_GROUPS, on).drop("n"), [*on, "role"])
    some = _first(ranked, [*on, "role"], ["page", "place", "id"], ROLE_SAMPLE)
    key = lambda what: F.concat(F.lit("section-"), _C("role"), F.lit(f"-{what}"))
    spread = some.join(urls, [*on, "page"], "left").groupBy(*on, "role", "rank").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("u"), F.array_join(F.array_sort(F.collect_set("layout_mode")), ", ").alias("layouts"), F.count_distinct("place").alias("p"), (F.min("place") + 1).alias("position"))
    steady = spread.where("p = 1")
    after = sections.select(*on, "page", (_C("place") - 1).alias("place"), _C("id").alias("next_id"), _C("role").alias("next_role"))
    after = ranking.first_row(after, [*on, "page", "place"], [_C("next_id")]).where("next_role <> 'unknown'")
    moves = _first(ranked.join(after, [*on, "page", "place"]), [*on, "role"], ["page", "place", "id"], TRANSITIONS)
    one = moves.groupBy(*on, "role", "rank").agg(F.count_distinct("next_role").alias("k"), F.min("next_role").alias("next_role")).where("k = 1")
    moves = moves.join(one.select(*on, "role"), [*on, "role"])
    bucket = lambda b: F.concat(F.lit("section:"), _C("role"), F.lit(f":{b}"))
    at = lambda i: _place("section", _C("rank") * 3 + i)
    same = some.join(steady.select(*on, "role"), [*on, "role"])
    return Drafts(
        _all([
            _draft(spread, on, key("composition"), at(0), [bucket("composition"), F.when(_C("u") >= 2, "signature")], {"role": _C("role"), "count": _C("n"), "layouts": _C("layouts")}),
            _draft(steady, on, key("rhythm"), at(1), [bucket("contentRhythm")], {"role": _C("role"), "position": _C("position")}),
            _draft(one, on, key("transition"), at(2), [bucket("transitionToNext")], {"role": _C("role"), "next": _C("next_role")}),
        ]),
        _all([_cite(some, on, key("composition"), _C("id")), _cite(same, on, key("rhythm"), _C("id")), _cite(moves, on, key("transition"), _C("id")), _cite(moves, on, key("transition"), _C("next_id"))]),
        _all([
            _assert(some, on, key("composition"), _C("pos"), "section", _C("role"), "layout-mode", F.array("id"), _C("layout_mode")),
            _values(steady, on, key("rhythm"), "sequence-index", F.array(_C("position").cast("string"))),
            _assert(moves, on, key("transition"), _C("pos"), "section", _C("role"), "ordered-before", F.array("id", "next_id"), _C("next_role")),
        ]),
    )


def component_claims(components: DataFrame, urls: DataFrame, on: list[str]) -> Drafts:
    """For each frequent type and role of components: their shapes and variants; primary ones draw attention."""
    named = components.withColumn("role", F.coalesce(F.nullif("role", F.lit("")), "type"))
    ranked = named.join(_groups(named, ["type", "role"], COMPONENT_GROUPS, on).drop("n"), [*on, "type", "role"])
    some = _first(ranked, [*on, "type", "role"], ["place", "id"], COMPONENT_SAMPLE)
    key = F.concat(F.lit("component-"), _C("type"), F.lit("-"), _C("role"))
    set_of = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")  # noqa: E731  of a sample
    spread = some.join(urls, [*on, "page"], "left").groupBy(*on, "type", "role", "rank").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("u"), set_of("shape").alias("shapes"), set_of("variant").alias("variants"), F.max(_C("variant") == "primary").alias("primary"))
    places = [F.concat_ws(":", F.lit("component"), "type", "role"), F.when(_C("u") >= 2, "signature"), F.when(_C("primary"), "singleton:attention.action")]
    return Drafts(
        _draft(spread, on, key, _place("component", _C("rank")), places, {c: _C("n") if c == "count" else _C(c) for c in ("count", "type", "role", "shapes", "variants")}),
        _cite(some, on, key, _C("id")),
        _all([
            _assert(some, on, key, _C("pos") * 3, "component", _C("type"), "present", F.array("id")),
            _assert(some, on, key, _C("pos") * 3 + 1, "component", _C("type"), "corner-shape", F.array("id"), _C("shape")),
            _assert(some.where("variant is not null"), on, key, _C("pos") * 3 + 2, "component", _C("type"), "variant", F.array("id"), _C("variant")),
        ]),
    )


def interaction_claims(interactions: DataFrame, on: list[str]) -> Drafts:
    """For each frequent driver, safety and set of properties what was observed; then what feedback looks like, how many properties change, and whether transitions were seen."""
    seen = interactions.where(F.size("properties") > 0).withColumns({"passive": _C("safety") == "passive", "names": F.array_join(F.array_sort(F.array_distinct("properties")), ", ")})
    group = ["driver", "safety", "names"]
    ranked = seen.join(_groups(seen, group, INTERACTION_GROUPS, on).drop("n"), [*on, *group])
    some = _first(ranked, [*on, *group], ["place", "id"], INTERACTION_SAMPLE)
    key = F.concat(F.lit("interaction-"), F.concat_ws("|", *group))
    spread = some.groupBy(*on, *group, "rank").agg(F.count(F.lit(1)).alias("n"))
    shown = _first(seen.where(F.exists("properties", lambda p: ~p.rlike(STATE_PROPERTIES))), on, ["place", "id"], VISUAL_SAMPLE)
    properties = F.array_join(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("properties")))), 1, 12), ", ")  # of a sample
    size = F.size("properties")
    told = shown.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(_C("passive"), 1)).alias("p"), properties.alias("properties"), F.min(size).alias("low"), F.max(size).alias("high"))
    moving = seen.where("transition")
    moved = moving.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    feedback, amplitude, motion = F.lit("interaction-feedback"), F.lit("interaction-amplitude"), F.lit("visual-motion")
    changes = lambda df, k, base: _assert(df.select("*", F.posexplode("properties").alias("i", "name")), on, k, _C("pos") * 1000 + base + _C("i"), "interaction", _C("driver"), "property-change", F.array("id"), None, _C("name"))
    number = lambda c: F.array(_C(c).cast("string"))
    return Drafts(
        _all([
            _draft(spread, on, key, _place("interaction", _C("rank")), [F.lit("interaction:driver"), F.when(_C("driver") == "scroll", "interaction:scrollNarrative")], {"count": _C("n"), "driver": _C("driver"), "safety": _C("safety"), "properties": _C("names")}),
            _draft(told, on, feedback, _place("feedback"), [F.lit("singleton:interaction.feedback")], {"count": _C("n"), "properties": _C("properties"), "passive": _C("p")}),
            _draft(told, on, amplitude, _place("amplitude"), [F.lit("singleton:interaction.amplitude")], {"minimum": _C("low"), "maximum": _C("high")}),
            _draft(moved, on, motion, _place("motion"), [F.lit("visual:motion")], {"count": _C("n")}),
        ]),
        _all([_cite(df, on, k, _C("id"), None, _C("passive")) for df, k in ((some, key), (shown, feedback), (shown, amplitude), (moving, motion))]),
        _all([
            _assert(some, on, key, _C("pos") * 1000, "interaction", _C("driver"), "observed", F.array("id")), changes(some, key, 1),
            _assert(some.where("safety = 'safe-active'"), on, key, _C("pos") * 1000 + 999, "interaction", _C("driver"), "executed", F.array("id")),
            changes(shown, feedback, 0), _values(told, on, feedback, "observation-count", number("n"), "interaction", 1 << 30), _values(told, on, feedback, "passive-observation-count", number("p"), "interaction", (1 << 30) + 1),
            _values(told, on, amplitude, "changed-property-count-range", F.array(_C("low").cast("string"), _C("high").cast("string")), "interaction"),
            _values(moved, on, motion, "transition-metadata-observed", F.array(F.lit("true")), "motion"),
        ]),
    )


def overflow_claims(pages: DataFrame, overflow: DataFrame, on: list[str]) -> Drafts:
    """The first pages that are fit as evidence and overflow severely, with the sections that cause it."""
    wide = _first(pages.where(F.coalesce("eligible", F.lit(True)) & F.coalesce("severe", F.lit(False))), on, ["page"], OVERFLOW_PAGES)
    key = F.concat(F.lit("overflow-"), _C("page"))
    causes = _first(overflow.where("section is not null").select(*on, "page", "section").distinct().join(wide.select(*on, "page"), [*on, "page"], "left_semi"), [*on, "page"], ["section"], OVERFLOW_PAGES)
    size = F.array(*(F.coalesce(_C(c), F.lit(0)).cast("string") for c in ("viewport_width", "content_width")))
    told = _assert(wide.withColumn("_v", size), on, key, F.lit(0), "responsive", F.lit("viewport"), "horizontal-overflow", F.lit(None).cast("array<string>")).drop("value").join(wide.select(*on, key.alias("key"), size.alias("value")), [*on, "key"])
    return Drafts(
        _draft(wide, on, key, _place("overflow", _C("pos")), [F.lit("transfer:avoid")], {"viewport": _C("viewport_width"), "content": _C("content_width"), "name": _C("viewport")}, F.lit("high")),
        _cite(wide, on, key, _C("page")).unionByName(_cite(causes, on, key, _C("section"))), told,
    )


def media_claims(media: DataFrame, on: list[str]) -> Drafts:
    """Kinds and roles of the first major media."""
    some = _first(media.where("importance = 'major'"), on, ["place", "id"], MEDIA_SAMPLE)
    key = F.lit("visual-imagery")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")  # noqa: E731  of a sample
    told = some.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), names("kind").alias("kinds"), names("role").alias("roles"))
    facts = _assert(some, on, key, _C("pos"), "evidence", F.lit("imagery"), "supports", F.array("id"), None, "media-kind-role").drop("value").join(some.select(*on, _C("pos").cast("long").alias("pos"), F.array("kind", "role").alias("value")), [*on, "pos"])
    return Drafts(_draft(told, on, key, _place("imagery"), [F.lit("visual:imagery")], {"count": _C("n"), "kinds": _C("kinds"), "roles": _C("roles")}), _cite(some, on, key, _C("id")), facts)


def _priority(placements: Column) -> Column:
    """Which placements come first, a fixed order."""
    first = ("singleton:", "transfer:avoid", "transfer:adapt", "signature", "visual:", "section:", "component:")
    out = F.lit(len(first))
    for i in range(len(first) - 1, -1, -1):
        out = F.when(F.exists(placements, _starts(first[i])), F.lit(i)).otherwise(out)
    return out


def _starts(prefix: str):
    return lambda p: p.startswith(prefix)


def assemble(parts: list[Drafts], index: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(claims, assertions) of all rules. index: on, id, url, token_refs for every evidence id.

    claims: on, key, claim_id, place, placements, subject, confidence, scope, evidence_ids, token_refs, MOST_CLAIMS at most. Cites of ids that the index does not know are
    dropped. A claim whose evidence spans two URLs is of high confidence, unless its values agree less than AGREEMENT or all of it is passive.
    assertions: on, key, pos, kind, target, predicate, property, value, scope, evidence. What a claim cites is one group.
    """
    drafts, cites, facts = (cut(_all([getattr(p, t) for p in parts])) for t in ("drafts", "cites", "assertions"))
    known = cut(cites.join(index.select(*on, "id", "url", "token_refs"), [*on, "id"]))
    modes = known.groupBy(*on, "key", "said").agg(F.count(F.lit(1)).alias("n")).groupBy(*on, "key").agg((F.max(F.when(_C("said").isNotNull(), _C("n"))) / F.sum(F.when(_C("said").isNotNull(), _C("n")))).alias("share"))
    refs = known.select(*on, "key", F.explode("token_refs").alias("ref")).distinct()
    refs = _first(refs, [*on, "key"], ["ref"], MOST_REFS).groupBy(*on, "key").agg(F.array_sort(F.collect_list("ref")).alias("token_refs"))
    held = cut(known.groupBy(*on, "key").agg(F.array_sort(F.collect_set("id")).alias("evidence_ids"), F.count_distinct("url").alias("urls"), F.bool_and("passive").alias("all_passive")))
    full = drafts.join(held, [*on, "key"]).join(modes, [*on, "key"], "left").join(refs, [*on, "key"], "left")
    sure = (_C("urls") >= 2) & (F.coalesce("share", F.lit(1.0)) >= AGREEMENT) & ~_C("all_passive")
    recurring = F.transform(F.filter("placements", lambda p: (p != "signature?") | (_C("urls") >= 2)), lambda p: F.replace(p, F.lit("?"), F.lit("")))
    told = full.select(
        *on, "key", "ord", recurring.alias("placements"), "subject", F.coalesce("fixed", F.when(sure, "high").otherwise("medium")).alias("confidence"), gates.assertion_scope(_C("urls")).alias("scope"),
        "evidence_ids", F.coalesce("token_refs", F.array().cast("array<string>")).alias("token_refs"),
    ).withColumn("claim_id", ids.content_id("claim", F.struct("key", "placements", "evidence_ids", "subject")))
    out = cut(ranking.top(told, on, [_priority(_C("placements")), _C("ord"), _C("key")], claims.MOST_CLAIMS, "place").drop("ord"))
    owned = facts.join(held.select(*on, "key", "evidence_ids"), [*on, "key"]).withColumn("evidence", F.coalesce(F.array_intersect("evidence", "evidence_ids"), _C("evidence_ids"))).drop("evidence_ids")
    urls = owned.select(*on, "key", "pos", F.explode_outer("evidence").alias("id")).join(index.select(*on, "id", "url"), [*on, "id"], "left").groupBy(*on, "key", "pos").agg(F.count_distinct("url").alias("_urls"))
    owned = owned.join(urls, [*on, "key", "pos"]).withColumn("scope", gates.assertion_scope(_C("_urls"))).drop("_urls").join(out.select(*on, "key"), [*on, "key"], "left_semi")
    return out, cut(owned)


def evidence_index(pages: DataFrame, sections: DataFrame, components: DataFrame, nodes: DataFrame, interactions: DataFrame, media: DataFrame, on: list[str]) -> DataFrame:
    """on, id, url, token_refs for everything that claims may cite."""
    none = F.array().cast("array<string>")
    placed = [(sections, _C("token_refs")), (components, _C("token_refs")), (nodes, _C("token_refs")), (interactions, none), (media, none)]
    held = _all([df.select(*on, "id", "page", refs.alias("token_refs")) for df, refs in placed]).join(pages.select(*on, "page", "url"), [*on, "page"])
    return cut(pages.select(*on, _C("page").alias("id"), "url", none.alias("token_refs")).unionByName(held.select(*on, "id", "url", "token_refs")))


def draft_claims(pages: DataFrame, sections: DataFrame, components: DataFrame, nodes: DataFrame, interactions: DataFrame, media: DataFrame, overflow: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """All rules over the canonical pages of each analysis; see assemble for the result, and the module for the tables."""
    valid = canonical_pages(pages, on).select(*on, "page", "url")
    fit = lambda df: df.join(valid.select(*on, "page"), [*on, "page"], "left_semi")
    valid = cut(valid)
    some = cut(fit(sections))
    held = cut(fit(components).join(some.select(*on, _C("id").alias("section")), [*on, "section"], "left_semi"))
    parts = [
        sequence_claims(some, on), composition_claims(some, on), visual_claims(some, held, nodes, on), section_claims(some, valid, on), component_claims(held, valid, on),
        interaction_claims(fit(interactions), on), overflow_claims(pages, overflow, on), media_claims(fit(media), on),
    ]
    return assemble(parts, evidence_index(pages, sections, components, nodes, interactions, media, on), on)


def uncertainties(analyses: DataFrame, pages: DataFrame, sections: DataFrame, interactions: DataFrame, on: list[str]) -> DataFrame:
    """on, place, topic: what an analysis cannot be sure of, in a fixed order, eight at most.

    analyses: on, page_coverage, capture_coverage, asset_coverage, absent (a responsive observation tells of absence), mismatch (sections changed their identity).
    """
    of = lambda c: F.count(F.when(c, 1))
    sick = pages.groupBy(*on).agg(of(~F.coalesce("eligible", F.lit(True))).alias("_sick"), of(F.coalesce("severe", F.lit(False))).alias("_severe"))
    urls = canonical_pages(pages, on).groupBy(*on).agg(F.count(F.lit(1)).alias("_urls"))
    active = interactions.groupBy(*on).agg(of(_C("safety") != "passive").alias("_active"))
    held = sections.groupBy(*on).agg(F.count(F.lit(1)).alias("_sections"))
    out = analyses.join(sick, on, "left").join(urls, on, "left").join(active, on, "left").join(held, on, "left").fillna(0, ["_sick", "_severe", "_urls", "_active", "_sections"])
    rules = [
        ("page-coverage", _C("page_coverage") == "partial"), ("capture-coverage", _C("capture_coverage") == "partial"), ("capture-health", _C("_sick") > 0), ("asset-coverage", _C("asset_coverage") == "partial"),
        ("cross-page", _C("_urls") < 2), ("interaction", _C("_active") == 0), ("responsive-presence", _C("absent")), ("responsive-identity", _C("mismatch")), ("overflow", _C("_severe") > 0), ("sections", _C("_sections") == 0),
    ]
    topics = F.slice(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), t) for t, c in rules))), 1, 8)
    return out.select(*on, F.posexplode(topics).alias("place", "topic"))
