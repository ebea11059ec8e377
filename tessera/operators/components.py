"""Components of pages from recorded elements: many detectors in one pass, and one component for each element by priority.

Elements are rows: page columns, id, parent_id, pre and last (see nesting), tag in lower case, role, input_type, has_href, classes, onclick, tabindex, aria_modal,
visible, width, height, viewport_width, viewport_height, text_chars, child_tags, main_child (whether it is a section or article right under the main part), background, shadow,
position, z_index, and border_width, border_style, radius and padding, each an array of the four sides or corners. All detectors are conditions of one row; what they
find is exploded, moved to the element that it is seen on, and merged by element in one aggregation. Elements are wide and stay where they are read: joins move only what is found,
inputs, and a few columns of those that may be cards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import cut, dealt
from . import nesting

# Kinds, confidences, reasons and bounds of the detectors.
EDITABLE_ROLES = ("textbox", "searchbox", "combobox", "spinbutton")
MEDIA_OR_ACTION = ("img", "picture", "svg", "button", "input", "textarea", "select")
NO_CARDS = ("html", "body", "main", "nav", "header", "footer", "form", "ul", "ol", "table", "dialog", "button", "input", "textarea", "select")
NO_DEEP_CARDS = NO_CARDS[3:]
LEAST_CARD, MOST_CARD = 0.62, 0.94
STYLES = {
    "button": ("backgroundColor", "color", "borderRadius", "padding", "fontSize", "fontWeight"),
    "card": ("backgroundColor", "borderRadius", "boxShadow", "border", "padding"),
    "navigation": ("backgroundColor", "display", "gap"),
    "input": ("backgroundColor", "border", "borderRadius", "padding", "fontSize"),
}
#: Ancestors that may be the visible box of an input.
INPUT_BOX_LEVELS = 3

_C = F.col


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def clear_paint(color: Column) -> Column:
    """Whether a colour's text says that nothing is painted: transparent, or a last channel of 0."""
    return _yes((F.lower(F.trim(color)) == "transparent") | F.trim(color).rlike(r"(?i)^rgba?\([^)]*(?:,|/)\s*0(?:\.0+)?\s*\)$"))


def _clear_surface(color: Column) -> Column:
    return _yes((color == "transparent") | color.endswith(", 0)"))


def _any_drawn(widths: Column, styles: Column) -> Column:
    return F.exists(F.arrays_zip(widths.alias("w"), styles.alias("s")), lambda b: (b["w"] > 0) & ~b["s"].isin("none", "hidden"))


def _native(types: tuple[str, ...]) -> Column:
    return _yes((_C("tag") == "input") & F.lower("input_type").isin(*types))


def _editable(*excluded: str) -> Column:
    kind = F.lower(F.coalesce("input_type", F.lit("")))
    return ((_C("tag") == "input") & ~kind.isin(*excluded)) | _C("tag").isin("textarea", "select")


def _detectors() -> list[tuple[str, float, tuple[str, ...], Column]]:
    """(type, confidence, reasons, condition), in order; cards come after them."""
    role, tag, classes = _C("role"), _C("tag"), F.array_join("classes", " ")
    acts = ((tag == "a") & _C("has_href")) | tag.isin("button", "input") | _C("onclick") | (_C("tabindex") == "0")
    over = (_C("aria_modal") == "true") | (_C("position").isin("fixed", "absolute") & (_C("z_index") != "auto"))
    return [
        ("button", 0.98, ("native-element",), (tag == "button") | _native(("button", "submit", "reset"))),
        ("button", 0.9, ("aria-role",), role == "button"),
        ("button", 0.65, ("class-name", "interactive-behavior"), F.arrays_overlap("classes", F.array(F.lit("btn"), F.lit("button"))) & _yes(acts)),
        ("navigation", 0.98, ("native-element",), tag == "nav"),
        ("navigation", 0.9, ("aria-role",), role == "navigation"),
        ("input", 0.98, ("native-element",), _editable("hidden", "button", "submit", "reset")),
        ("input", 0.88, ("aria-role",), role.isin(*EDITABLE_ROLES)),
        ("table", 0.98, ("native-element",), tag == "table"),
        ("table", 0.9, ("aria-role",), role == "table"),
        ("table", 0.82, ("aria-grid-role",), role.isin("grid", "treegrid")),
        ("modal", 0.98, ("native-element",), tag == "dialog"),
        ("modal", 0.9, ("aria-role",), role.isin("dialog", "alertdialog")),
        ("modal", 0.65, ("class-name", "overlay-position"), classes.rlike("modal|Modal") & _yes(over)),
        ("list", 0.98, ("native-element",), tag.isin("ul", "ol")),
        ("list", 0.9, ("aria-role",), role == "list"),
    ]


def _largest(array: str) -> Column:
    return F.coalesce(F.array_max(_C(array)), F.lit(0.0))


def _wide_section() -> Column:
    return (_C("width") >= _C("viewport_width") * 0.9) & _yes(_C("main_child") | (_C("role") == "region"))


def structural_signature() -> Column:
    """Tag, the first three short class names in order, and the first five children's tags."""
    names = F.slice(F.array_sort(F.filter("classes", lambda c: F.length(c) <= 48)), 1, 3)
    return F.concat_ws("|", "tag", F.array_join(names, "."), F.array_join(F.slice("child_tags", 1, 5), ","))


def _repeated(some: DataFrame, counted: DataFrame, page: list[str]) -> DataFrame:
    """some with _repeated: whether two rows or more of counted share the parent and _signature. One aggregation by parent and signature."""
    key = [*page, "parent_id", "_signature"]
    twice = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").withColumn("_repeated", F.lit(True)).drop("_n")
    return some.join(dealt(twice), key, "left").withColumn("_repeated", F.coalesce("_repeated", F.lit(False)))


def _card_rows(elements: DataFrame, page: list[str], bounds: tuple[Column, Column, Column], painted: Column, signature: Column) -> DataFrame:
    """What counts of elements that may be cards, so that joins move a few narrow columns of these alone. bounds: rounded, shadowed, bordered."""
    large = (_C("width") >= _C("viewport_width") * 0.9) & (_C("height") >= _C("viewport_height") * 0.5)
    told = {**dict(zip(("_rounded", "_shadowed", "_bordered"), bounds, strict=True)), "_content": _C("text_chars") >= 12, "_built": F.size("child_tags") >= 2, "_large": large}
    return elements.select(*page, "id", "parent_id", "pre", "last", F.when(painted, _C("background")).alias("_paint"), signature.alias("_signature"), *(_yes(c).alias(n) for n, c in told.items()))


def _with_surroundings(some: DataFrame, elements: DataFrame, page: list[str]) -> DataFrame:
    """some, rows of _card_rows, with _distinct, whether they are painted unlike the parent, and _acts, whether they hold media or something to act on."""
    parents = elements.select(*page, _C("id").alias("parent_id"), _C("background").alias("_behind"))
    acts = _C("tag").isin(*MEDIA_OR_ACTION) | ((_C("tag") == "a") & _yes(_C("has_href"))) | _yes(_C("role") == "button")
    inside = nesting.over_descendants(some, elements.where(acts), page, "id", {"_acts": ("max", F.lit(True))}, among=elements)
    out = some.join(inside, [*page, "id"], "left").join(dealt(parents), [*page, "parent_id"], "left")
    return out.withColumns({"_acts": F.coalesce("_acts", F.lit(False)), "_distinct": _yes(_C("_paint") != F.coalesce("_behind", F.lit("")))}).drop("_paint", "_behind")


def _card_parts(padded: Column, repeated: Column) -> list[tuple[float, Column, Column]]:
    """(score, condition, reasons) of rows with surroundings, in the order in which they add up."""
    one = lambda reason: F.array(F.lit(reason))
    bounds = F.array_compact(F.array(F.when(_C("_shadowed"), "shadow-boundary"), F.when(_C("_bordered"), "border-boundary")))
    return [
        (0.16, _C("_rounded"), one("rounded-container")), (0.22, _C("_shadowed") | _C("_bordered"), bounds), (0.16, padded, one("contained-spacing")), (0.1, _C("_distinct"), one("distinct-surface")),
        (0.12, _C("_content"), one("content-region")), (0.08, _C("_built"), one("structured-children")), (0.12, repeated, one("repeated-sibling-structure")),
        (0.08, _C("_acts"), one("media-or-action")), (-0.2, _C("_large"), one("large-layout-penalty")),
    ]


def _score(parts: list[tuple[float, Column, Column]]) -> Column:
    return reduce(lambda total, p: total + F.when(p[1], F.lit(p[0])).otherwise(F.lit(0.0)), parts, F.lit(0.0))


def _cards(elements: DataFrame, page: list[str]) -> DataFrame:
    """page, id, confidence, reasons of the visible elements that look like cards. Only these meet parents, insides and siblings."""
    rounded, shadowed, padded = _largest("radius") > 4, _C("shadow") != "none", _largest("padding") >= 12
    bordered = (_largest("border_width") > 0) & F.exists("border_style", lambda s: s != "none")
    fits = _C("visible") & ~_C("tag").isin(*NO_CARDS) & (_C("width") >= 120) & (_C("height") >= 72) & ~_wide_section() & padded & (rounded | shadowed | bordered)
    some = _card_rows(elements.where(_yes(fits)), page, (rounded, shadowed, bordered), ~_clear_surface(_C("background")), structural_signature())
    counted = elements.where("visible and parent_id is not null").select(*page, "parent_id", structural_signature().alias("_signature"))
    parts = _card_parts(F.lit(True), _C("_repeated"))
    reasons = F.flatten(F.array(*(F.when(c, r).otherwise(F.array().cast("array<string>")) for _, c, r in parts)))
    known = _repeated(_with_surroundings(some, elements, page), counted, page).withColumn("_score", _score(parts)).where(_C("_score") >= LEAST_CARD)
    return known.select(*page, "id", F.least(F.lit(MOST_CARD), "_score").alias("confidence"), reasons.alias("reasons"))


def input_boxes(inputs: DataFrame, elements: DataFrame, page: list[str]) -> DataFrame:
    """page, id, box: the nearest of the next ancestors that frames the input visibly and closely, else the input itself. One join for each level of INPUT_BOX_LEVELS, over inputs alone."""
    lined = (F.get("border_width", F.lit(0)) > 0) & ~F.get("border_style", F.lit(0)).isin("none", "hidden")
    framed = _yes(lined | (F.get("radius", F.lit(0)) > 0) | (_C("shadow") != "none"))
    up = dealt(elements.select(
        *page, _C("id").alias("_at"), _C("parent_id").alias("_next"), F.when(_C("visible"), _C("width")).alias("_w"), _C("height").alias("_h"), framed.alias("_framed"),
        F.when(~framed & ~clear_paint(_C("background")), _C("background")).alias("_paint"),
    ))
    out = inputs.select(*page, "id", "width", "height", "background", _C("parent_id").alias("_up"), F.lit(None).cast(elements.schema["id"].dataType).alias("box"))
    kept = ["id", "width", "height", "background"]
    for _ in range(INPUT_BOX_LEVELS):
        met = out.join(up.withColumnRenamed("_at", "_up"), [*page, "_up"], "left")
        close = (_C("_w") >= _C("width")) & (_C("_h") >= _C("height")) & (_C("_w") <= F.greatest(_C("width") * 1.8, _C("width") + 160)) & (_C("_h") <= F.greatest(_C("height") * 3, F.lit(72)))
        larger = (_C("_w") > _C("width") + 2) | (_C("_h") > _C("height") + 2)
        box = F.coalesce("box", F.when(_yes(close & larger & (_C("_framed") | (_C("_paint") != _C("background")))), _C("_up")))
        out = met.select(*page, *kept, _C("_next").alias("_up"), box.alias("box"))
    return out.select(*page, "id", F.coalesce("box", "id").alias("box"))


def detect_components(elements: DataFrame, page: list[str]) -> DataFrame:
    """page, id, type, confidence, reasons: what each visible element is, once for each type: the highest confidence, and all reasons in the order of the detectors.

    Inputs are told of the box that frames them. Elements without a parent have no siblings that repeat them. An empty table gives an empty result.
    """
    made = lambda place, t, p, r: F.struct(F.lit(t).alias("type"), p.alias("confidence"), F.lit(place).alias("_place"), r.alias("reasons"))
    told = [(t, F.when(_yes(c), made(i, t, F.lit(p), F.array(*map(F.lit, r))))) for i, (t, p, r, c) in enumerate(_detectors())]
    found_by = lambda inputs: F.explode(F.array_compact(F.array(*(f for t, f in told if (t == "input") == inputs)))).alias("_found")
    plain = elements.where("visible").select(*page, "id", found_by(False))
    cards = _cards(elements, page).select(*page, "id", made(len(told), "card", _C("confidence"), _C("reasons")).alias("_found"))
    inputs = elements.where(_yes(_editable("hidden", "button", "submit", "reset") | _C("role").isin(*EDITABLE_ROLES)))
    boxed = inputs.select(*page, "id", "visible", found_by(True)).join(dealt(input_boxes(inputs, elements, page)), [*page, "id"], "left")
    boxed = boxed.where(_C("visible") | (_C("box") != _C("id"))).select(*page, F.coalesce("box", "id").alias("id"), "_found")
    merged = plain.unionByName(boxed).unionByName(cards).groupBy(*page, "id", "_found.type").agg(
        F.max("_found.confidence").alias("confidence"), F.array_sort(F.collect_set(F.struct("_found._place", "_found.reasons"))).alias("_all")  # one for each detector
    )
    return merged.select(*page, "id", "type", "confidence", F.array_distinct(F.flatten(F.transform("_all", lambda r: r["reasons"]))).alias("reasons"))


def component_styles(kind: Column, styles: Column) -> Column:
    """Of a map of computed styles those that are recorded for a type of component; none for types without a list."""
    wanted = F.create_map(*(F.lit(x) for t, names in STYLES.items() for x in (t, ",".join(names))))
    names = F.split(F.coalesce(F.element_at(wanted, kind), F.lit("")), ",")
    return F.map_filter(styles, lambda k, _: F.array_contains(names, k))


def status_roots(candidates: DataFrame, page: list[str]) -> DataFrame:
    """candidates with root: the outermost elements that tell one status each.

    candidates: page, id, pre, last, native, strong (a painted fill or border of its own) and drawn (at least 4 by 4 pixels and not clipped away). A native status counts as it is;
    another one gives way to native ones inside it, and, unless it is strong itself, to two or more independent strong ones inside it.
    """
    measures = {
        "_native": ("max", _C("native")), "_first": ("min", F.when(_C("strong"), F.struct("pre", "last"))), "_farthest": ("max", F.when(_C("strong"), _C("pre"))),
    }
    inside = nesting.over_descendants(candidates, candidates, page, "id", measures)
    several = _yes(_C("_farthest") > _C("_first.last"))  # the first one in order is the outermost of its kind
    preferred = _C("drawn") & (_C("native") | (~_yes(_C("_native")) & (_C("strong") | ~several)))
    judged = cut(candidates.join(inside, [*page, "id"], "left").select(*candidates.columns, _yes(preferred).alias("_preferred")))
    some = judged.where("_preferred")
    covered = nesting.over_ancestors(some, some, page, "id", {"_covered": ("max", F.lit(True))})
    return judged.join(covered, [*page, "id"], "left").select(*candidates.columns, (_C("_preferred") & _C("_covered").isNull()).alias("root"))


def deep_cards(elements: DataFrame, taken: DataFrame, page: list[str]) -> DataFrame:
    """page, id, confidence of the elements inside the main part that look like cards and are no other component. taken: page, id; elements: with in_main besides, and radius_text.

    A card whose parent holds another one with the same tag, background, corners and line above is more likely.
    """
    line, rounded, shadowed = F.get("border_width", F.lit(0)), F.get("radius", F.lit(0)) > 4, _C("shadow") != "none"
    bordered = (line > 0) & ~F.get("border_style", F.lit(0)).isin("none", "hidden")
    fits = ~_C("tag").isin(*NO_DEEP_CARDS) & _C("visible") & _C("in_main") & _C("parent_id").isNotNull() & ~_wide_section() & (shadowed | bordered | rounded) & (_largest("padding") >= 8) & (_C("width") >= 120) & (_C("height") >= 64)
    rows = _card_rows(elements.where(_yes(fits)), page, (rounded, shadowed, bordered), ~clear_paint(_C("background")), F.concat_ws("|", "tag", "background", "radius_text", line.cast("string")))
    some = cut(rows.join(dealt(taken.select(*page, "id").distinct()), [*page, "id"], "left_anti"))
    score = _score(_card_parts(F.lit(True), F.lit(False))) + F.when(_C("_repeated"), F.lit(0.12)).otherwise(F.lit(0.0))
    known = _repeated(_with_surroundings(some, elements, page), some, page)
    return known.where(score >= LEAST_CARD).select(*page, "id", F.least(F.lit(MOST_CARD), score).alias("confidence"))


def collect_components(elements: DataFrame, page: list[str]) -> DataFrame:
    """page, id, type, role, element_kind, confidence: one component for each visible element, the first that fits of: status, tab, native button, styled link, navigation, input, table, dialog, list; then cards.

    elements: as above with status_root, status_candidate, status_role, action_role, native_action and styled_link besides (see status_roots and roles). A box that frames an
    input is an input besides what else it is.
    """
    tag, role = _C("tag"), _C("role")
    kind = F.when(tag == "input", "input").when((role == "button") & (tag != "button"), "role-button").otherwise("button")
    none = F.lit(None).cast("string")
    free = ~_yes(_C("status_candidate"))
    ways = [
        (_C("status_root"), "status", _C("status_role"), F.lit("status"), 0.94), (role == "tab", "tab", role, F.lit("button"), 0.98),
        (_C("native_action") & free, "button", _C("action_role"), kind, 0.98), (_C("styled_link") & free, "button", _C("action_role"), F.lit("anchor"), 0.9),
        ((tag == "nav") | (role == "navigation"), "navigation", role, none, 0.98), ((tag == "table") | role.isin("table", "grid"), "table", role, none, 0.96),
        ((tag == "dialog") | role.isin("dialog", "alertdialog"), "modal", role, none, 0.96), (tag.isin("ul", "ol") | (role == "list"), "list", role, none, 0.9),
    ]
    made = lambda t, r, k, c: F.struct(F.lit(t).alias("type"), r.alias("role"), k.alias("element_kind"), F.lit(c).alias("confidence"))
    first = F.coalesce(*(F.when(_yes(c), made(t, r, k, p)) for c, t, r, k, p in ways))
    own = elements.where("visible").select(*page, "id", first.alias("_c")).where("_c is not null").select(*page, "id", "_c.*")
    typed = elements.where(_C("visible") & _yes(_editable("hidden", "button", "submit") | role.isin("textbox", "combobox")))
    boxed = input_boxes(typed, elements, page).join(typed.select(*page, "id", "role", "pre"), [*page, "id"])
    inputs = boxed.groupBy(*page, _C("box").alias("id")).agg(F.min_by("role", "pre").alias("role")).select(*page, "id", F.lit("input").alias("type"), "role", F.lit("input").alias("element_kind"), F.lit(0.96).alias("confidence"))
    framed = inputs.select(*page, "id").withColumn("_input", F.lit(True))
    after = own.join(framed, [*page, "id"], "left").where(_C("_input").isNull() | ~_C("type").isin("table", "modal", "list")).drop("_input")
    whole = after.unionByName(inputs)
    cards = deep_cards(elements, whole, page).select(*page, "id", F.lit("card").alias("type"), none.alias("role"), none.alias("element_kind"), "confidence")
    return whole.unionByName(cards)
