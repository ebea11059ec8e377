"""Personal data in texts, with built-in column functions only.

A regular expression for each kind proposes spans, a checksum or range check confirms them (Luhn for cards, mod 97 for
account numbers, 255 for address parts, digit counts for phones), and context words in the 48 characters of the text on
either side of a span raise its score (for secrets: right before it). The base kinds (email, ip, card, phone) count once confirmed; the added kinds (iban, ssn, secret) need a score of
THRESHOLD. The patterns cannot backtrack over a long run: repeated groups are possessive, and a run is entered only at its start
or where the last match ended, which finds what the plain patterns find.

Positions: a text split at the matches has pieces whose lengths, with those of the matches, add up to the offsets in code points.
Prefix sums run over blocks of about the square root of the number of spans, so a text of many spans costs its power 1.5.
Everything is one projection of each row: no shuffle, no state between rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
THRESHOLD, CONTEXT_CHARS = 0.6, 48
#: Characters of an account number with its country code, by the registry; codes that are not listed take any length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Groups of four with or without spaces; a known country fixes the length, so a word after the number is not taken with it."""

    def rest(n: int) -> str:
        whole, tail = divmod(n - 4, 4)
        return rf"[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{whole}}}" + (rf"\x20?[A-Z0-9]{{{tail}}}" if tail else "")

    known = "|".join(f"(?:{'|'.join(codes.split())}){rest(n)}" for n, codes in IBAN_LENGTHS.items())
    codes = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    other = rf"(?!{codes})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}+(?:\x20?[A-Z0-9]{{1,3}})?+"
    return rf"(?<![A-Za-z0-9])(?:{known}|{other})(?![A-Za-z0-9])"


PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+(?:[._~+/-]++[A-Za-z0-9]++)*+=*+",
}
#: Score of a confirmed match, and what context words add to it.
SCORES = {"iban": 0.8, "ssn": 0.4, "secret": 0.3}
CONTEXT = {
    "email": r"(?i)mail|contact|write to",
    "ip": r"(?i)\bip\b|address|host|server",
    "card": r"(?i)card|visa|credit|debit|payment",
    "phone": r"(?i)phone|tel\b|call|mobile|fax",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
    "ssn": r"(?i)ssn|social|security|tax id",
    "secret": r"(?i)(?:password|passwd|secret|token|api[ _-]?key)[\x20\"'=:]*$",
}
CONTEXT_BONUS = 0.4
#: No match of the kind is shorter, so so many neighbours hold all of a span's context.
LEAST_CHARS = {"email": 5, "ip": 7, "card": 2, "phone": 4, "iban": 15, "ssn": 11, "secret": 16}
#: A text that lacks this cannot hold the kind.
NEEDS = {"email": lambda t: F.contains(t, F.lit("@")), "phone": lambda t: F.contains(t, F.lit("+"))}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _at(array: Column, i: Column) -> Column:
    return F.element_at(array, i + 1)


def prefixes(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each long in values the fold with op, from 0, of those before it; the fold runs over blocks."""
    fold = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), op)

    def by_block(v: Column, width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: F.slice(v, b * width + 1, width))

        def join(bs: Column) -> Column:
            def inner(before: Column) -> Column:
                return F.flatten(F.transform(bs, lambda block, b: F.transform(block, lambda _, i: op(fold(F.slice(before, F.lit(1), b)), fold(F.slice(block, F.lit(1), i))))))

            return let(F.transform(bs, fold), inner)

        return let(blocks, join)

    return F.when(F.size(values) == 0, F.array().cast("array<long>")).otherwise(let(values, lambda v: let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda w: by_block(v, w))))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    def total(d: Column) -> Column:
        def digit(i: Column) -> Column:
            v = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * (1 + i % 2)
            return v - F.when(v > 9, 9).otherwise(0)

        return F.length(d).between(12, 19) & (F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0)

    return let(_digits(s), total)


def _mod97(s: Column) -> Column:
    def rest(c: Column) -> Column:
        chars = F.filter(F.split(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4)), ""), lambda x: x != "")
        value = lambda x: F.when(x <= "9", F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
        step = lambda a, x: F.when(x <= "9", a * 10 + value(x)).otherwise(a * 100 + value(x)) % 97
        return F.length(c).between(15, 34) & (F.aggregate(chars, F.lit(0), step) == 1)

    return let(F.replace(s, F.lit(" "), F.lit("")), rest)


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda d: (F.length(d) <= 3) & (F.coalesce(d.try_cast("int"), F.lit(0)) <= 255))),
    "card": _luhn,
    "phone": lambda s: F.length(_digits(s)).between(9, 15),
    "iban": _mod97,
    "ssn": lambda s: ~s.rlike("^(000|666|9)|-00-|-0000$"),
    "secret": lambda s: s.rlike("[0-9]") & s.rlike("[A-Za-z]"),
}

_SPAN = "struct<start:long,rank:int,end:long,kind:string,score:double>"


def _in_context(found: Column, pieces: Column, i: Column, kind: str) -> Column:
    """Whether context words of the kind lie in the CONTEXT_CHARS before match i, or (secret: only before) in those after it."""
    k, most = -(-CONTEXT_CHARS // LEAST_CHARS[kind]), F.lit(CONTEXT_CHARS)
    first = F.greatest(i - k, F.lit(0))
    joined = lambda parts, matches, both: F.array_join(F.zip_with(parts, matches, both), "")
    ended = joined(F.slice(pieces, first + 1, i - first), F.slice(found, first + 1, i - first), lambda p, m: F.concat(F.right(p, most), F.right(m, most)))
    near = F.right(F.concat(ended, F.right(_at(pieces, i), most)), most).rlike(CONTEXT[kind])
    if kind == "secret":
        return near
    after = joined(F.slice(pieces, i + 2, F.lit(k)), F.slice(found, i + 2, F.lit(k)), lambda p, m: F.concat(F.left(p, most), F.coalesce(F.left(m, most), F.lit(""))))
    return near | F.left(after, most).rlike(CONTEXT[kind])


def _of_kind(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind, in order."""

    def spans(found: Column) -> Column:
        def placed(pieces: Column) -> Column:
            steps = F.transform(found, lambda m, i: (F.length(_at(pieces, i)) + F.length(m)).cast("long"))

            def rows(before: Column) -> Column:
                def row(m: Column, i: Column) -> Column:
                    start = _at(before, i) + F.length(_at(pieces, i))
                    score = F.lit(SCORES.get(kind, 1.0)) + F.when(_in_context(found, pieces, i, kind), CONTEXT_BONUS).otherwise(0.0)
                    good = CHECKS[kind](m) if kind in BASE_KINDS else CHECKS[kind](m) & (score >= THRESHOLD)
                    return F.when(good, F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"), score.alias("score")))

                return F.filter(F.transform(found, row), lambda x: x.isNotNull())

            return let(prefixes(steps, lambda a, b: a + b), rows)

        return F.when(F.size(found) == 0, F.array().cast(f"array<{_SPAN}>")).otherwise(let(F.split(text, PATTERNS[kind], -1), placed))

    may = NEEDS.get(kind, lambda t: t.rlike("[0-9]"))(text)
    return F.when(may, let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), spans)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def pii_spans(text: Column) -> Column:
    """All spans of a text (null: none) by start, then kind: structs of start, rank, end, kind, score; code points, end exclusive."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.array_sort(F.concat(*(_of_kind(t, k) for k in KINDS))))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each group of overlapping spans replaced by the name of its first kind, such as <EMAIL>."""

    def build(ss: Column) -> Column:
        def parts(before: Column) -> Column:
            def part(s: Column, i: Column) -> Column:
                end = _at(before, i)
                return F.when(s["start"] >= end, F.concat(F.substring(text, (end + 1).cast("int"), (s["start"] - end).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")

            rest = F.substring(text, (F.array_max(F.transform(ss, lambda s: s["end"])) + 1).cast("int"), F.length(text))
            return F.concat(F.array_join(F.transform(ss, part), ""), rest)

        return let(prefixes(F.transform(ss, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), parts)

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, build))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of structs) and text for each row of docs; a null text is empty, repeated rows stay, other columns are ignored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("spans", pii_spans(F.col("text")))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The counts of the base kinds, the hash of the base spans and all spans as text, for each row of docs."""
    found = find_pii(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = spans_text(F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS)))
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(base, 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by the names of its kinds, and n_chars set anew where the table has it.

    A null text stays null and an empty one empty; overlapping spans are masked together; every row stays, repeated ones too; an empty
    table stays empty; other columns are not touched, whatever their names.
    """
    spans = fresh(docs, "spans")
    marked = docs.withColumn(spans, pii_spans(F.col("text")))
    out = marked.withColumn("text", masked(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
