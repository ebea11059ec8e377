"""Texts: normal forms, page identity, comparable terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY_CHARS = 120
# Titles that do not name a site, and those of pages in the way of one.
GENERIC_TITLES = (r"^(?:home|homepage)$", r"^(?:首页|主页)$", r"^(?:log\s*in|sign\s*in)$", r"^403(?:\s+forbidden)?$", r"^access denied$", r"^error(?:\s+\d{3})?$")
INTERSTITIAL_TITLES = (r"\bjust a moment\b", r"\bchecking your browser\b", r"\bcloudflare\b", r"\bcaptcha\b", r"\bhuman verification\b")
BLOCKED_HEALTH = ("auth-wall", "captcha", "error-page", "rate-limited", "unexpected-navigation")
# Notices of new messages before a title, and what parts a title.
NOTICE = r"^(?:(?:\(|（|\[|【)\s*(?:\d+\s*(?:条)?(?:新)?消息|(?:\d+\s+)?new\s+messages?|未读|unread)\s*(?:\)|）|\]|】)\s*|\(\s*\d+\s*\)\s+(?=\S))+"
SEPARATOR = r"\s+(?:[-–—|·•])\s+"


def normal(text: Column) -> Column:
    """Blanks collapsed and trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def identity(text: Column) -> Column:
    """A title on one line, without notices in front, of 120 code points at most."""
    line = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{Cc}\p{Cf}]", " "), r"\s+", " "))
    return F.nullif(F.trim(F.left(F.trim(F.regexp_replace(line, "(?i)" + NOTICE, "")), F.lit(IDENTITY_CHARS))), F.lit(""))


def meaningful(text: Column) -> Column:
    clean = identity(text)
    return F.coalesce(~clean.rlike("(?i)" + "|".join((*GENERIC_TITLES, *INTERSTITIAL_TITLES))), F.lit(False))


def site_name(application: Column, open_graph: Column, title: Column, status: Column, codes: Column) -> Column:
    """The application's name, else the graph's, else the one meaningful part of a title with generic parts; null for pages in poor health."""
    parts = F.filter(F.transform(F.split(identity(title), SEPARATOR), identity), lambda p: p.isNotNull())
    named = F.filter(parts, meaningful)
    from_title = F.when((F.size(parts) >= 2) & (F.size(named) == 1), F.element_at(named, 1))
    healthy = ~F.coalesce(status == "unusable", F.lit(False)) & ~F.coalesce(F.arrays_overlap(codes, F.array(*map(F.lit, BLOCKED_HEALTH))), F.lit(False))
    return F.when(healthy, F.when(meaningful(application), identity(application)).when(meaningful(open_graph), identity(open_graph)).otherwise(from_title))


def system_name(site: Column, title: Column, host: Column) -> Column:
    """Site, else the title's first meaningful part, else the host, else a fallback."""
    first = F.get(F.filter(F.split(identity(title), SEPARATOR), meaningful), F.lit(0))
    return F.coalesce(F.when(meaningful(site), identity(site)), identity(first), F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit("")), F.lit("Observed design system"))


def terms(text: Column) -> Column:
    """Distinct words of three characters or more, and pairs of neighbours in runs of Han characters."""
    low = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s-]", " ")
    words = F.filter(F.split(low, r"\s+"), lambda w: (F.length(w) >= 3) & ~w.rlike(r"^[㐀-鿿]+$"))
    runs = F.filter(F.regexp_extract_all(low, F.lit(r"([㐀-鿿]+)"), F.lit(1)), lambda r: F.length(r) >= 2)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, pairs))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Shared share of two arrays taken as sets; empty: what two empty ones give."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def relevance(text: Column, words: Column) -> Column:
    """How many of the words of two characters or more the text holds."""
    return F.size(F.filter(words, lambda w: (F.length(w) >= 2) & F.contains(F.lower(text), F.lower(w))))


def issue_reason(text: Column) -> Column:
    """Without terminal codes, control characters and URL queries, 180 characters at most, percent-encoded."""
    from .url import redact_urls

    bare = F.regexp_replace(F.regexp_replace(text, r"\u001b\[[0-9;]*[A-Za-z]", ""), r"[\u0000-\u001f\u007f]+", " ")
    return F.replace(F.url_encode(F.left(F.trim(redact_urls(bare)), F.lit(180))), F.lit("+"), F.lit("%20"))
