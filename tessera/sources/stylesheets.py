"""Stylesheet text as rows: at-rules, style rules and declarations, and what follows from them.

The text goes through a state machine over Arrow batches, a row of output for each at-rule block and each declaration, so comments,
strings, addresses, brackets and nested blocks end where CSS says they do. Everything after that is DataFrame work over the rows.
A sheet is parsed by the task that reads its page; nothing is shuffled until rows are counted. Values are declared ones: shorthands stay as written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import color, css
from ..functions.numbers import plain
from ..operators import ranking

#: Rows of output in a batch, about.
BATCH_ROWS = 8192
#: At-rules whose blocks hold style rules under a condition or a name; the others (key frames, fonts, pages) hold none.
GROUPING = ("media", "supports", "container", "layer", "scope", "starting-style", "document")
#: Properties whose change in a state is recorded, as fixed values.
STATE_PROPERTIES = (
    "background-color", "border-color", "border-bottom-color", "border-left-color", "border-right-color", "border-top-color", "box-shadow",
    "color", "display", "filter", "fill", "height", "max-height", "max-width", "opacity", "outline", "outline-color", "outline-offset",
    "outline-style", "outline-width", "rotate", "scale", "stroke", "text-decoration", "text-decoration-color", "text-decoration-line",
    "text-decoration-thickness", "text-shadow", "text-underline-offset", "transform", "translate", "visibility", "width",
)
#: Values with addresses are not recorded; a fixed value, as are the patterns of variable names below.
UNSAFE_VALUE = r"(?i)(?:url\s*\(|data:|https?:|javascript:)"
STATES = ("hover", "focus", "active")
SEMANTIC_NAME = r"(?i)(?:^|[-_])(brand|primary|secondary|accent|action|cta|theme|background|surface|foreground|border|ring|link|card|muted)(?:$|[-_])"
BRAND_NAME = r"(?i)(?:^|[-_])(brand|primary|accent|action|cta|theme)(?:$|[-_])"
VARIANT_NAME = r"(?i)(?:^|[-_])(?:hover|active|pressed|focus|disabled|subtle|muted|light|dark|foreground|background|border|ring|\d{1,3})(?:$|[-_])"
FUNCTIONAL_NAME = r"(?i)(?:^|[-_])(?:danger|destructive|error|invalid|warning|success|alert|notice)(?:$|[-_])"
#: Selectors that the root element matches.
ROOT_SELECTORS = (":root", "html", "*", "html:root", ":root:root")
#: References between variables are followed so many times.
ALIAS_HOPS = 5
EASING = r"^(?:ease|linear|ease-in|ease-out|ease-in-out|step-start|step-end|(?:cubic-bezier|steps|linear)\(.*\))$"
TIME = r"^[+-]?(?:\d+\.?\d*|\.\d+)m?s$"
ANIMATION_WORD = r"^(?:infinite|normal|reverse|alternate|alternate-reverse|none|forwards|backwards|both|running|paused|[\d.]+)$"
MOST_MOTIONS = 10

_TOKEN = re.compile(
    r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)|url\(\s*(?!["'\s])(?:[^)\\]|\\.)*(?:\)|\Z)|\\.|[{}()\[\];]|[^{}()\[\];"'/\\u]+|.""",
    re.S | re.I,
)
_CUSTOM = re.compile(r"\s*--[^:{};]*:")
_IMPORTANT = re.compile(r"\s*!\s*important\s*$", re.I)


class _Block:
    """An open block: an at-rule (prelude starts with @) or a style rule."""

    def __init__(self, prelude: str, rule: int):
        self.prelude, self.rule = prelude, rule
        self.style = not prelude.startswith("@")


def _declaration(text: str) -> tuple[str, str, bool] | None:
    name, colon, value = text.partition(":")
    name, value = name.strip(), value.strip()
    if not colon or not re.fullmatch(r"-?-?[A-Za-z_\\\u0080-\U0010ffff][^\s]*|--[^\s]*", name):
        return None
    bare = _IMPORTANT.sub("", value)
    return (name if name.startswith("--") else name.lower()), bare, bare != value


def parse(text: str) -> Iterator[tuple]:
    """(kind, rule, ord, stack, parents, selector, property, value, important) for each at-rule block and declaration, in order.

    stack: preludes of the enclosing at-rules; parents: selectors of enclosing style rules. An at-rule row has its own prelude as value. Blocks that
    the text leaves open end with it; a closing brace without a block is skipped, and what is no declaration is dropped.
    """
    blocks: list[_Block] = []
    buffer: list[str] = []
    rules = ord_ = depth = braces = 0

    def emit(kind: str, rule: int, prop: str | None, value: str, important: bool) -> tuple:
        nonlocal ord_
        ord_ += 1
        styles = [b.prelude for b in blocks if b.style]
        stack = [b.prelude for b in blocks if not b.style]
        own = styles[-1] if styles and kind == "declaration" and blocks[-1].style else None
        return kind, rule, ord_ - 1, stack, styles[:-1] if own is not None else styles, own, prop, value, important

    def flush() -> Iterator[tuple]:
        found = _declaration("".join(buffer)) if blocks else None
        buffer.clear()
        if found:
            yield emit("declaration", blocks[-1].rule, *found)

    for token in _TOKEN.findall(text):
        if token.startswith("/*"):
            buffer.append(" ")
        elif braces:  # inside the value of a custom property
            braces += (token == "{") - (token == "}")
            buffer.append(token)
        elif token == "{" and depth == 0:
            prelude = "".join(buffer)
            if blocks and _CUSTOM.match(prelude):
                braces = 1
                buffer.append(token)
                continue
            prelude = " ".join(prelude.split())
            buffer.clear()
            if prelude.startswith("@"):
                yield emit("at", rules, None, prelude, False)
            blocks.append(_Block(prelude, rules))
            rules += 1
        elif token == "}":
            depth = 0
            yield from flush()
            if blocks:
                blocks.pop()
        elif token == ";" and depth == 0:
            yield from flush()
        else:
            depth = max(0, depth + (token in ("(", "[")) - (token in (")", "]")))
            buffer.append(token)
    yield from flush()


_TEXTS, _ARRAYS = T.StringType(), T.ArrayType(T.StringType())
_ROWS = (
    ("kind", _TEXTS), ("rule", T.IntegerType()), ("ord", T.IntegerType()), ("stack", _ARRAYS), ("parents", _ARRAYS),
    ("selector", _TEXTS), ("property", _TEXTS), ("value", _TEXTS), ("important", T.BooleanType()),
)


def _batch(batch: pa.RecordBatch, keep: list[str], at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in keep]
    made = [pa.array(c, to_arrow_type(t)) for c, (_, t) in zip(zip(*rows, strict=True), _ROWS, strict=True)]
    return pa.RecordBatch.from_arrays(kept + made, names=[*keep, *(n for n, _ in _ROWS)])


def rules(sheets: DataFrame, keep: list[str], text: str = "css") -> DataFrame:
    """keep and the rows of parse for each sheet. A null or empty sheet has none, repeated rows are parsed each, other columns are left out; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, sheet in enumerate(batch.column("_text")):
                for row in parse(sheet.as_py() or ""):
                    at.append(i)
                    rows.append(row)
                    if len(rows) >= BATCH_ROWS:
                        yield _batch(batch, keep, at, rows)
                        at, rows = [], []
            if rows:
                yield _batch(batch, keep, at, rows)

    read = sheets.select(*keep, F.col(text).cast("string").alias("_text"))
    return read.mapInArrow(run, T.StructType([*(read.schema[c] for c in keep), *(T.StructField(n, t) for n, t in _ROWS)]))


def sheets(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """keep, sheet, css: the style elements of each page in order, without those in comments or scripts."""
    bare = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<script\b.*?</script>", "")
    found = F.regexp_extract_all(bare, F.lit(r"(?is)<style\b[^>]*>(.*?)</style>"), F.lit(1))
    return pages.select(*keep, F.posexplode(found).alias("sheet", "css"))


def _at_name(prelude: Column) -> Column:
    return F.lower(F.regexp_extract(prelude, r"^@(?:-[a-z]+-)?([A-Za-z-]+)", 1))


def styled(parsed: DataFrame) -> DataFrame:
    """The declarations of style rules: all enclosing at-rules are groups of rules, so neither key frames nor fonts."""
    grouped = F.forall("stack", lambda s: _at_name(s).isin(*GROUPING))
    return parsed.where((F.col("kind") == "declaration") & F.col("selector").isNotNull() & grouped)


def state_rules(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """keep, rule, state, selector, styles for each rule whose selector names a state, once for each state; of a property the last declaration counts.

    Rules inside other style rules are left out, and rules without a recorded property. The declarations of one rule are one group.
    """
    named = F.filter(F.array(*map(F.lit, STATES)), lambda s: F.contains(F.col("selector"), F.concat(F.lit(":"), s)))
    safe = F.col("property").isin(*STATE_PROPERTIES) & ~F.col("value").rlike(UNSAFE_VALUE) & (F.col("value") != "")
    found = styled(parsed).where(safe & (F.size("parents") == 0)).select(*keep, "rule", "selector", "property", "ord", "value", F.explode(named).alias("state"))
    last = found.groupBy(*keep, "rule", "state", "selector", "property").agg(F.max_by("value", "ord").alias("value"))
    entries = F.array_sort(F.collect_list(F.struct("property", "value")))  # STATE_PROPERTIES at most
    return last.groupBy(*keep, "rule", "state", "selector").agg(F.map_from_entries(entries).alias("styles"))


def condition_widths(condition: Column, root_px: Column) -> Column:
    """The distinct widths in whole px that a media or container condition names; em and rem by the root's size."""
    patterns = (  # fixed values
        r"(?i)(?:min|max)-width\s*:\s*(\d*\.?\d+(?:px|r?em))",
        r"(?i)\bwidth\s*[<>]=?\s*(\d*\.?\d+(?:px|r?em))",
        r"(?i)(\d*\.?\d+(?:px|r?em))\s*[<>]=?\s*width\b",
    )
    found = F.concat(*(F.regexp_extract_all(condition, F.lit(p), F.lit(1)) for p in patterns))

    def px(v: Column) -> Column:
        amount = F.regexp_extract(v, r"^[\d.]+", 0).cast("double")
        return F.floor(F.when(F.lower(v).endswith("px"), amount).otherwise(amount * root_px) + 0.5).cast("int")

    return F.array_distinct(F.filter(F.transform(found, px), lambda w: w > 0))


def breakpoint_counts(parsed: DataFrame, keep: list[str], root_px: Column | None = None) -> DataFrame:
    """keep, width, n: how many media and container rules name each width, however often one rule does."""
    at = parsed.where((F.col("kind") == "at") & _at_name(F.col("value")).isin("media", "container"))
    widths = condition_widths(F.col("value"), F.lit(float(css.ROOT_PX)) if root_px is None else root_px)
    return at.select(*keep, F.explode(widths).alias("width")).groupBy(*keep, "width").agg(F.count(F.lit(1)).alias("n"))


def root_variables(parsed: DataFrame, keep: list[str], order: list[str]) -> DataFrame:
    """keep, name, value: custom properties that rules for the root element declare, the last in order counts; empty values are left out."""
    roots = F.exists(F.split("selector", ","), lambda s: F.trim(s).isin(*ROOT_SELECTORS))
    found = styled(parsed).where(F.startswith("property", F.lit("--")) & roots & (F.size("parents") == 0) & (F.col("value") != ""))
    return found.groupBy(*keep, F.col("property").alias("name")).agg(F.max_by("value", F.struct(*order, "ord")).alias("value"))


def resolved(variables: DataFrame, keep: list[str]) -> DataFrame:
    """variables with references to other variables of the same keep put in, through ALIAS_HOPS of them; a reference to none takes its fallback, or stays."""
    reference = r"(?s)^var\(\s*(--[^\s,)]+)\s*(?:,\s*(.*?)\s*)?\)$"
    out = variables
    for _ in range(ALIAS_HOPS):
        target = variables.select(*(F.col(k).alias(f"_{k}") for k in keep), F.col("name").alias("_name"), F.col("value").alias("_value"))
        wanted = F.regexp_extract("value", reference, 1)
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keep]
        fallback = F.nullif(F.regexp_extract("value", reference, 2), F.lit(""))
        put = F.when(wanted == "", F.col("value")).otherwise(F.coalesce("_value", fallback, F.col("value")))
        out = out.join(target, [*same, wanted == F.col("_name")], "left").select(*keep, "name", put.alias("value"))
    return out


def variable_colors(variables: DataFrame, keep: list[str]) -> DataFrame:
    """keep, category, value, weight: declared colours of variables with a name for a role, and those of the brand itself among them.

    A brand variable names the brand and neither a variant nor a message; values that are no colour, or wholly transparent, do not count.
    """
    name, shade = F.col("name"), color.normal(F.col("value"))
    clear = color.transparent(F.col("value"))
    brand = name.rlike(BRAND_NAME) & ~name.rlike(VARIANT_NAME) & ~name.rlike(FUNCTIONAL_NAME)
    kinds = F.array_compact(F.array(F.lit("declaredColor"), F.when(brand, F.lit("brandTokenColor"))))
    found = variables.where(name.rlike(SEMANTIC_NAME)).select(*keep, F.explode(F.when(~clear, kinds)).alias("category"), shade.alias("value")).where("value is not null")
    return found.groupBy(*keep, "category", "value").agg(F.count(F.lit(1)).alias("weight"))


def _outside_brackets(separator: str) -> str:
    return rf"{separator}(?![^()]*\))"


def _motion_part(part: Column, animation: bool) -> Column:
    """struct(property, duration, easing) of one comma part of a shorthand, with the initial values for what it leaves out."""
    words = F.filter(F.split(F.trim(part), _outside_brackets(r"\s+")), lambda w: w != "")
    low = lambda w: F.lower(w)
    time, ease = F.get(F.filter(words, lambda w: low(w).rlike(TIME)), F.lit(0)), F.get(F.filter(words, lambda w: low(w).rlike(EASING)), F.lit(0))
    rest = F.filter(words, lambda w: ~low(w).rlike(TIME) & ~low(w).rlike(EASING) & (~low(w).rlike(ANIMATION_WORD) if animation else F.lit(True)))
    named = F.coalesce(F.get(rest, F.lit(0)), F.lit("none" if animation else "all"))
    return F.struct(named.alias("property"), F.coalesce(_seconds(time), F.lit("0s")).alias("duration"), F.coalesce(ease, F.lit("ease")).alias("easing"))


def _seconds(time: Column) -> Column:
    return F.when(time.isNotNull(), F.concat(plain(css.duration_ms(F.regexp_replace(time, r"^\+", "")) / 1000, 6), F.lit("s")))


def _listed(text: Column, part) -> Column:
    return F.array_join(F.transform(F.split(text, _outside_brackets(",")), lambda p: part(F.trim(p))), ", ")


def _parts(text: Column, animation: bool) -> Column:
    return F.transform(F.split(text, _outside_brackets(",")), lambda p: _motion_part(p, animation))


def motion_rules(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """keep, rule, animated, property, duration, easing: the transition and the animation that each style rule declares, as its shorthand and later longhands say.

    Parts of a list are joined by commas; animations are named animation:<name>. Rules that move nothing or take no time are left out.
    """
    return _motions(parsed, keep, False).unionByName(_motions(parsed, keep, True))


def _motions(parsed: DataFrame, keep: list[str], animated: bool) -> DataFrame:
    short, initial = ("animation", "none") if animated else ("transition", "all")
    longhands = {"property": f"{short}-name" if animated else f"{short}-property", "duration": f"{short}-duration", "easing": f"{short}-timing-function"}
    mine = styled(parsed).where(F.col("property").isin(short, *longhands.values()))
    of = lambda p, c: F.when(F.col("property") == p, F.col(c))
    last = {n: (F.max_by(of(p, "value"), of(p, "ord")).alias(f"{n}_value"), F.max(of(p, "ord")).alias(f"{n}_ord")) for n, p in {"short": short, **longhands}.items()}
    one = mine.groupBy(*keep, "rule").agg(*(c for pair in last.values() for c in pair)).withColumn("parts", _parts(F.col("short_value"), animated))
    shape = {"property": lambda p: p, "duration": _seconds, "easing": lambda p: p}
    start = {"property": initial, "duration": "0s", "easing": "ease"}

    def chosen(n: str) -> Column:
        later = F.col(f"{n}_ord") > F.coalesce("short_ord", F.lit(-1))
        of_short = F.array_join(F.transform("parts", lambda x: x[n]), ", ")
        return F.when(later, _listed(F.col(f"{n}_value"), shape[n])).when(F.col("short_value").isNotNull(), of_short).otherwise(F.lit(start[n])).alias(n)

    found = one.select(*keep, "rule", F.lit(animated).alias("animated"), *map(chosen, longhands)).where((F.col("property") != "none") & (F.col("duration") != "0s"))
    return found.withColumn("property", F.concat(F.lit("animation:"), F.col("property"))) if animated else found


def top_motion(motions: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """group, property, duration, easing, n, ord: the MOST_MOTIONS most frequent; of equal counts the one that comes first by the columns order, transitions of a rule before its animation."""
    counted = motions.groupBy(*group, "property", "duration", "easing").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order, "animated")).alias("at"))
    return ranking.top(counted, group, [F.col("n").desc(), F.col("at")], MOST_MOTIONS).drop("at")
