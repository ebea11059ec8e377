"""Roles of elements, sections and pages, decided by rules over recorded facts; columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, css
from ..functions.numbers import number

# The words that name a role or an intent in an element's classes and attributes.
WORDS = {
    "action-hint": "btn|button|cta|pill|action|primary|secondary",
    "primary-action": "primary|cta|submit|confirm|purchase|checkout|continue",
    "destructive-action": "error|danger|destructive|delete|remove|invalid",
    "status": "status|success|successful|warning|warn|error|danger|destructive|delete|remove|healthy|health|ok|invalid",
    "subject": "delta|trend|change",
    "direction": "up|down|positive|negative|increase|decrease|gain|loss",
    "positive": "success|successful|healthy|health|ok|up|positive|increase|gain",
    "warning": "warning|warn",
    "negative": "error|danger|destructive|delete|remove|invalid|down|negative|decrease|loss",
}
# What a page's path says about its role, in order.
PAGE_PATHS = (
    ("pricing", "pricing|plans|billing"), ("workspace", "workspace|editor|studio|console|creator"), ("profile", "profile"),
    ("account", "account|settings|dashboard"), ("product", "product|products|features"), ("content", "article|blog|docs|guide|about|explore|discover"),
)
# A fixed value: colours that paint nothing.
UNPAINTED = r"(?i)^(?:transparent|rgba?\([^)]*(?:,|/)\s*0(?:\.0+)?\s*\))$"


def word_rx(name: str) -> str:
    """A word stands between blanks, hyphens, underscores or the ends."""
    return rf"(?:^|[\s_-])(?:{WORDS[name]})(?:$|[\s_-])"


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def status_intent(context: Column) -> Column:
    low = F.lower(context)
    return F.when(low.rlike(word_rx("positive")), "positive").when(low.rlike(word_rx("warning")), "warning").when(low.rlike(word_rx("negative")), "negative").otherwise("neutral")


def painted(background: Column) -> Column:
    return _no((background != "") & ~F.trim(background).rlike(UNPAINTED))


def candidate_role(context: Column, tag: Column, role: Column, input_type: Column, href: Column, aria_live: Column, background: Column, border: Column, width: Column, height: Column, pad_inline: Column, pad_block: Column) -> Column:
    """struct(element_kind, role, status_kind, status_intent) of an element, null for one that is neither an action nor a status.

    context: its classes and attributes, see tags.context_text. An interactive element is an action whatever it announces; a link is one only where a word says so
    and paint or the size of a control agrees. Nulls say nothing.
    """
    low, tag = F.lower(context), F.lower(tag)
    said = lambda name: _no(low.rlike(word_rx(name)))
    button, as_input, as_button = _no(tag == "button"), _no((tag == "input") & input_type.isin("button", "submit")), _no(role == "button")
    anchor = _no((tag == "a") & (href != ""))
    acts = button | as_input | as_button | anchor
    trend = said("subject") & said("direction")
    announces = _no(role.isin("status", "alert")) | _no((aria_live != "") & (aria_live != "off"))
    control = _no(width >= 44) & _no(height >= 28) & (_no(pad_inline >= 8) | _no(pad_block >= 6))
    linked = said("action-hint") & (painted(background) | _no(border > 0) | control)
    none = F.lit(None).cast("string")
    status = F.struct(F.lit("status").alias("element_kind"), F.lit("status").alias("role"), F.when(trend, "delta").otherwise("status").alias("status_kind"), status_intent(context).alias("status_intent"))
    kind = F.when(anchor, "anchor").when(as_input, "input").when(as_button & ~button, "role-button").otherwise("button")
    does = F.when(said("primary-action"), "primary-action").when(said("destructive-action"), "destructive-action").otherwise("action")
    action = F.struct(kind.alias("element_kind"), does.alias("role"), none.alias("status_kind"), none.alias("status_intent"))
    return F.when(~acts & (announces | said("status") | trend), status).when(acts & (~anchor | linked), action)


def section_role(tag: Column, aria: Column, has_h1: Column, top: Column, viewport_height: Column, media_area: Column, area: Column, children: Column, alike: Column, text_length: Column, link_length: Column, actions: Column, viewport_area: Column) -> Column:
    """A section's role: landmark, hero, media, feature group, navigation by its links, action, content, or unknown.

    top: distance from the page's top; children: visible ones; alike: the most of them with one signature; text_length, link_length: characters of all text and of links.
    """
    tag = F.upper(tag)
    landmark = F.when((tag == "HEADER") | (aria == "banner"), "header").when((tag == "NAV") | (aria == "navigation"), "navigation")
    landmark = landmark.when((tag == "FOOTER") | (aria == "contentinfo"), "footer").when((tag == "ASIDE") | (aria == "complementary"), "aside")
    small = (actions > 0) & (text_length > 0) & (text_length <= 480) & (area / viewport_area <= 0.35)
    role = F.when(has_h1 & (top < viewport_height * 1.5), "hero").when(media_area >= area * 0.45, "media").when((children >= 3) & (alike >= 2), "feature-group")
    role = role.when((text_length > 0) & (link_length >= text_length * 0.6), "navigation").when(small, "action").when(tag.isin("MAIN", "ARTICLE", "SECTION"), "content").otherwise("unknown")
    return F.coalesce(landmark, role)


def page_role(path: Column, person: Column, article_length: Column, main_length: Column, main_h1: Column, controls: Column, grid: Column, chrome: Column, has_h1: Column, sections: Column) -> Column:
    """A page's role by its path, else by facts of the document: a person's data, long texts, application controls beside a grid and page chrome, a heading over sections."""
    low = F.lower(path)
    role = None
    for name, words in PAGE_PATHS:
        here = low.rlike(rf"/({words})(/|$)")
        role = F.when(here, name) if role is None else role.when(here, name)
    role = role.when(person, "profile").when(article_length >= 500, "content").when(~main_h1 & (main_length >= 500), "content")
    return role.when(controls & grid & chrome, "workspace").when(has_h1 & (sections >= 2), "landing").otherwise("unknown")


def layout_mode(position: Column, z_index: Column) -> Column:
    return F.when(position == "sticky", "sticky").when(position == "fixed", "fixed").when((position == "absolute") & (z_index != "auto"), "overlay").otherwise("flow")


def normalised_rect(left: Column, top: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """struct(x, y, width, height) in shares of the page, clamped to it."""
    x, y = F.greatest(F.lit(0.0), F.least(page_width, left)), F.greatest(F.lit(0.0), F.least(page_height, top))
    within = lambda size, whole, at: F.greatest(F.lit(0.0), F.least(whole - at, size)) / whole
    return F.struct((x / page_width).alias("x"), (y / page_height).alias("y"), within(width, page_width, x).alias("width"), within(height, page_height, y).alias("height"))


def media_kind(tag: Column) -> Column:
    t = F.upper(tag)
    return F.when(t == "VIDEO", "video").when(t == "SVG", "svg").when(t == "CANVAS", "canvas").when(t.isin("IMG", "PICTURE"), "image").otherwise("css-background")


def media_importance(kind: Column, width: Column, height: Column, viewport_area: Column, in_chrome: Column) -> Column:
    """icon, major or supporting, by size, share of the viewport, and whether it stands in a control or page chrome."""
    share = width * height / viewport_area
    icon = ((width <= 64) & (height <= 64)) | ((kind == "svg") & in_chrome)
    major = (share >= 0.06) | (~kind.isin("svg", "canvas") & ~in_chrome & (share >= 0.015))
    return F.when(icon, "icon").when(major, "major").when(share >= 0.004, "supporting").otherwise("icon")


def section_anchor(x: Column, width: Column) -> Column:
    free = F.greatest(F.lit(0.0), 1 - width)
    return F.when(width >= 0.96, "full").when(F.abs(x - free / 2) <= 0.04, "center").when(x <= F.greatest(F.lit(0.06), free * 0.3), "left").otherwise("right")


def pill_radius(radius: Column, height_px: Column) -> Column:
    """A share, a radius of 64 px or more, or one that rounds off the whole height."""
    most = F.coalesce(F.array_max(css.numbers_in(radius)), F.lit(0.0))
    return _no(radius.rlike("%")) | (most >= 64) | _no((height_px > 0) & (most >= F.greatest(F.lit(12.0), height_px / 2 - 1)))


def component_shape(radius: Column, height_px: Column) -> Column:
    return F.when(pill_radius(radius, height_px), "pill").when(radius.rlike("[1-9]"), "rounded").otherwise("sharp")


def structural_radius(corners: Column) -> Column:
    """The corners joined by blanks; null if all are zero, or one is empty, long or unsafe."""
    zero = F.forall(corners, lambda v: v.rlike(r"(?i)^(?:0|0px|0rem|0em)$"))
    unsafe = F.exists(corners, lambda v: v.isNull() | (v == "") | (F.length(v) > 80) | v.rlike(r"(?i)[\r\n]|url\s*\("))
    return F.when(~_no(zero) & ~unsafe, F.array_join(corners, " "))


def browser_product(agent: Column, path: Column) -> Column:
    """By the executable's path, then by the user agent; the patterns and their order are fixed values."""
    role = F.when(path.rlike(r"(?i)(?:^|[\\/])(?:msedge|microsoft edge)(?:[\\/.]|$)"), "edge").when(path.rlike(r"(?i)(?:^|[\\/])(?:chrome-headless-shell|chromium)(?:[\\/.]|$)"), "chromium")
    role = role.when(path.rlike(r"(?i)(?:^|[\\/])(?:chrome|google chrome)(?:[\\/.]|$)"), "chrome").when(agent.rlike(r"(?i)Edg/"), "edge")
    return role.when(agent.rlike(r"(?i)Chromium/") | path.rlike("(?i)chromium"), "chromium").when(agent.rlike(r"(?i)(?:Headless)?Chrome/"), "chrome").otherwise("unknown")


def browser_version(agent: Column) -> Column:
    return F.nullif(F.regexp_extract(agent, r"(?i)(?:Edg|Chrome|Chromium)/([\d.]+)", 1), F.lit(""))


def positive_length(text: Column) -> Column:
    """True or false for a plain length, null for anything else."""
    amount = F.regexp_extract(F.trim(text), r"(?i)^(-?\d+(?:\.\d+)?)(?:px|rem|em|pt)?$", 1)
    return F.when(amount != "", number(amount) > 0)


def outline_visible(style: Column, width: Column, paint: Column) -> Column:
    """Whether an outline shows; null where the record does not tell. The words of the patterns are fixed values."""
    unset = r"(?i)^(?:none|hidden|initial|unset)$"
    vague = style.isNull() | F.trim(style).rlike(r"(?i)^(?:inherit|revert(?:-layer)?)$") | positive_length(width).isNull() | paint.isNull() | F.trim(paint).rlike(r"(?i)^(?:initial|inherit|unset|revert(?:-layer)?)$")
    nothing = style.isNull() & width.isNull() & paint.isNull()
    hidden = _no((style != "") & F.trim(style).rlike(unset)) | _no(~positive_length(width)) | _no((paint != "") & color.transparent(paint))
    return F.when(nothing, F.lit(None)).when(hidden, False).when(_no(vague), F.lit(None)).otherwise(True)


def focus_visible(driver: Column, shadow: Column, style: Column, width: Column, paint: Column) -> Column:
    """Whether a focus state shows by shadow or outline; null where the record does not tell, or for another driver."""
    shade = F.when(shadow.isNotNull(), css.visible_shadow(shadow))
    line = outline_visible(style, width, paint)
    return F.when((driver == "focus") & (_no(shade) | _no(line)), True).when((driver == "focus") & _no(~shade) & _no(~line), False)


def useful_change(name: Column, before: Column, after: Column, role: Column) -> Column:
    """Whether a property's change between viewports says something about the design."""
    grid = name.isin("gridTemplateColumns", "childGridTemplateColumns")
    x, y = css.grid_columns(before), css.grid_columns(after)
    columns = _no((F.trim(before) != "") & (F.trim(after) != "")) & F.coalesce(x != y, F.lit(True))
    heights = role.isin("header", "navigation", "action") & css.bounded_px(before).isNotNull() & css.bounded_px(after).isNotNull()
    never = name.startswith("rect.") | (name == "visibility") | before.eqNullSafe(after)
    use = F.when(never, False).when(grid, columns).when(name.isin("node.heading.fontSize", "layoutMode", "position", "order", "sequenceIndex"), True)
    use = use.when((name == "height") | name.endswith(".height"), _no(heights)).when(name.rlike("^border(?:Top|Right|Bottom|Left)$"), css.visible_border(before) | css.visible_border(after))
    return use.otherwise(name == "boxShadow")


# Properties whose change moves a section, and those that only resize it.
STRUCTURAL = ("sequenceIndex", "layoutMode", "display", "gridTemplateColumns", "rect.x", "rect.y")
SIZES = ("height", "rect.width", "rect.height", "maxWidth", "paddingTop", "paddingRight", "paddingBottom", "paddingLeft", "gap")


def change_type(changed: Column) -> Column:
    """What a set of changed properties amounts to: interaction, reorder, mixed, reflow or scale; null for none. interactionModel stands for changed interactions."""
    acts = F.array_contains(changed, "interactionModel")
    all_of = lambda names: F.forall(changed, lambda k: k.isin(*names))
    reorder = F.array_contains(changed, "sequenceIndex") & all_of(("sequenceIndex", "rect.x", "rect.y"))
    kind = F.when(acts & (F.size(changed) == 1), "interaction").when(reorder, "reorder").when(acts, "mixed")
    kind = kind.when(F.exists(changed, lambda k: k.isin(*STRUCTURAL)), "reflow").when(all_of(SIZES), "scale").otherwise("mixed")
    return F.when(F.size(changed) > 0, kind)


def consistent_identity(observations: DataFrame, sections: DataFrame) -> DataFrame:
    """id, consistent: whether the sections an observation refers to have one role at most. observations: id, refs; sections: section, role."""
    named = observations.select("id", F.explode(F.array_distinct("refs")).alias("section")).join(sections.select("section", "role"), "section")
    roles = named.groupBy("id").agg(F.count_distinct("role").alias("n"))
    return observations.select("id").join(roles, "id", "left").select("id", (F.coalesce("n", F.lit(0)) <= 1).alias("consistent"))


def ordered_pairs(sections: DataFrame, group: list[str], order: list[str], most: int = 4) -> DataFrame:
    """group, place, role, next_role, ids: each of the first sections with the one after it."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = sections.select(*group, "id", "role", F.lead("id").over(w).alias("next_id"), F.lead("role").over(w).alias("next_role"), F.row_number().over(w).alias("place"))
    return out.where((F.col("place") <= most) & F.col("next_id").isNotNull())


def owner_refs(owners: DataFrame, group: list[str], order: list[str], prefix: str, most: int = 6) -> DataFrame:
    """group, ref, owner, place: the first owner of each token reference with the prefix, the first most of them. owners: group, order, id, refs."""
    rows = owners.select(*group, *order, "id", F.posexplode("refs").alias("pos", "ref")).where(F.col("ref").startswith(prefix))
    first = rows.groupBy(*group, "ref").agg(F.min(F.struct(*order, "pos", "id")).alias("at"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("at"))
    return first.select(*group, "ref", F.col("at.id").alias("owner"), place.alias("place")).where(F.col("place") <= most)
