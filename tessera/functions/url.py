"""URL expressions: identity, sanitising, crawl normalisation, page kinds and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Page kinds with the path words that name them, first match wins, and what each adds to a page's score.
PAGE_KINDS = (
    ("pricing", r"/(?:pricing|plans?|cost)(?:/|$)", 36),
    ("product", r"/(?:product|products|features?|solutions?|platform|enterprise|business)(?:/|$)", 30),
    ("docs", r"/(?:docs?|documentation|developers?|api-reference|guides?)(?:/|$)", 26),
    ("content", r"/(?:questions?|answers?|topics?|posts?|stories?|videos?|watch|explore|feed)(?:/|$)", 24),
    ("about", r"/(?:about|company|team|story|careers?)(?:/|$)", 10),
    ("contact", r"/(?:contact|demo|trial|get-started|start)(?:/|$)", -14),
    ("blog", r"/(?:blog|resources|insights|news|articles?)(?:/|$)", 16),
    ("support", r"/(?:help|support|faq|community)(?:/|$)", -12),
)
GENERIC_BOOST = 12
# Paths that are never representative.
EXCLUDED_PATHS = (
    r"/(?:login|log-in|signin|sign-in|signup|sign-up|register|auth)(?:/|$)",
    r"/(?:logout|signout|sign-out)(?:/|$)",
    r"/(?:terms|privacy|legal|cookie|gdpr|tos)(?:/|$)",
    r"/(?:account|profile|settings|checkout|cart|search)(?:/|$)",
    r"/(?:cdn-cgi|wp-admin|wp-content|wp-json|api)(?:/|$)",
    r"/(?:tag|author|page)/[^/]+",
    r"/(?:19|20)\d{2}/(?:0?[1-9]|1[0-2])(?:/|$)",
    r"\.(?:avif|css|csv|docx?|gif|ico|jpe?g|js|json|mov|mp3|mp4|pdf|png|svg|tar|webm|webp|xml|zip|gz)$",
)
TRACKING = r"^(?i:fbclid|gclid|mc_cid|mc_eid|ref|source|utm_.+)$"
MIN_REPRESENTATIVE_SCORE = 90


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    """Host and port without credentials, lower-cased, without the scheme's usual port."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)", 1))
    return F.when(scheme(url) == "http", F.regexp_replace(host, ":80$", "")).when(scheme(url) == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def _absolute(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")


def page_identity_url(url: Column) -> Column:
    """Without credentials, query and fragment; an empty path is /. What is no absolute URL is cut at its first ? or #."""
    p = path(url)
    whole = F.concat(origin(url), F.when(p == "", F.lit("/")).otherwise(p))
    return F.when(_absolute(url), whole).otherwise(F.regexp_extract(url, r"^([^?#]*)", 1))


def route_identity(url: Column) -> Column:
    """page_identity_url() without slashes at the end, except for the root."""
    trimmed = F.regexp_replace(path(url), "/+$", "")
    whole = F.concat(origin(url), F.when(trimmed == "", F.lit("/")).otherwise(trimmed))
    return F.when(_absolute(url), whole).otherwise(F.regexp_extract(url, r"^([^?#]*)", 1))


def sanitised(url: Column) -> Column:
    """For storage: no credentials, query or fragment, also where the text is no absolute URL."""
    return F.when(_absolute(url), page_identity_url(url)).otherwise(F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), r"^[^/@\s]*@", ""))


def redact_urls(text: Column) -> Column:
    """Every http(s) URL in a text without credentials, query and fragment."""
    bare = F.regexp_replace(text, r"(?i)(https?://)[^\s/@?#\"'<>]*@", "$1")
    return F.regexp_replace(bare, r"(?i)(https?://[^\s?#\"'<>)\]]+)[?#][^\s\"'<>)\]]*", "$1")


def kept_parameters(url: Column) -> Column:
    """The query without tracking parameters, sorted by name, then as text."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(TRACKING))
    return F.array_join(F.array_sort(pairs), "&")


def crawl_url(url: Column) -> Column:
    """For following: no fragment or tracking parameters, one slash in a row, none at the end. Null for control, quote and blank characters, plain or encoded."""
    bad = url.rlike(r"[\u0000-\u001f\u007f\s\"'`<>]") | url.rlike(r"(?i)%(?:25)*(?:0[0-9a-f]|1[0-9a-f]|20|22|27|3c|3e|60|7f)")
    p = F.regexp_replace(F.regexp_replace(path(url), "/{2,}", "/"), "/$", "")
    q = kept_parameters(url)
    whole = F.concat(origin(url), F.when(p == "", F.lit("/")).otherwise(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(scheme(url).isin("http", "https") & _absolute(url) & ~bad, whole)


def same_origin(a: Column, b: Column) -> Column:
    return F.when(_absolute(a) & _absolute(b), origin(a) == origin(b)).otherwise(a == b)


def excluded(p: Column) -> Column:
    return p.rlike("(?i)" + "|".join(f"(?:{x})" for x in EXCLUDED_PATHS))


def page_kind(p: Column) -> Column:
    out = F.lit("generic")
    for kind, pattern, _ in reversed(PAGE_KINDS):
        out = F.when(F.lower(p).rlike(pattern), kind).otherwise(out)
    return out


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


def page_score(p: Column, q: Column, location: Column, base: Column) -> Column:
    """100, the kind's boost and the link's place, less 12 for each further step down, 15 for a query and 20 (content 2) for a number
    or a very long word in the path. Null for excluded paths and the base itself. base: the site's own path, / for its root."""
    return let(page_kind(p), lambda kind: _page_score(p, q, location, base, kind))


def _page_score(p: Column, q: Column, location: Column, base: Column, kind: Column) -> Column:
    parts = segments(p)
    boosts = F.create_map(*(F.lit(x) for name, _, value in (*PAGE_KINDS, ("generic", "", GENERIC_BOOST)) for x in (name, value)))
    boost = F.element_at(boosts, kind)
    under = (base != "/") & F.startswith(p, F.concat(base, F.lit("/")))
    depth = F.size(parts) - F.when(under, F.size(segments(base))).otherwise(0)
    odd = F.exists(parts, lambda s: s.rlike(r"^\d+$") | (F.length(s) > 64))
    score = 100 + boost + location - F.greatest(depth - 1, F.lit(0)) * 12 - F.when(q != "", 15).otherwise(0)
    score = score - F.when(odd, F.when(kind == "content", 2).otherwise(20)).otherwise(0)
    return F.when(~excluded(p) & (p != base), score.cast("long"))
