"""What recorded facts of a capture say about it: whether a login stands in front of the page, and how healthy it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import url
from . import gates

# Reasons, codes and bounds of the rules.
AUTH_PATH = r"(?i)(?:^|/)(?:auth|login|log-in|signin|sign-in|passport|sso|account/login)(?:/|$)"
SURE_REASONS = ("unauthorized-response", "password-form", "blocking-login-dialog")
OVERLAY, LARGE_OVERLAY, SKELETON, MUTATIONS, OVERFLOW = 0.08, 0.45, 0.12, 30, 4
MAIN_CHARS, BODY_CHARS, SURFACE_CHARS, SURFACE_INPUTS = 30, 80, 5000, 30
UNUSABLE = ("large-overlay", "main-content-empty", "auth-wall", "captcha", "error-page", "rate-limited", "unexpected-navigation")
ISSUE = "struct<code:string,severity:string,recoverable:boolean,detail:string>"


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def login_only(body_chars: Column, inputs: Column, auth_forms: Column, strong: Column, credentials: Column, submits: Column, actions: Column) -> Column:
    """Whether a page is little else than a login: a short text with few inputs, and a form for logging in or fields for credentials with a way to send them.

    inputs, auth_forms, strong (passwords, user names, codes), credentials (those and mail or phone fields), submits and actions are numbers of visible elements.
    """
    flow = (strong > 0) & (((credentials > 0) & (submits > 0)) | ((credentials >= 2) & (actions > 0)))
    return _no((body_chars > 0) & (body_chars < SURFACE_CHARS) & (inputs <= SURFACE_INPUTS) & ((auth_forms > 0) | flow))


def auth_wall(final_url: Column, status: Column, passwords: Column, blocking_dialog: Column, login_page: Column) -> Column:
    """struct(detected, confidence, reasons): a login path alone is a hint of low confidence, not a detection. passwords: number of visible password fields."""
    path = F.concat(url.path(final_url), F.coalesce(F.regexp_extract(final_url, r"(#.*)$", 1), F.lit("")))
    absolute = final_url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    rules = (
        ("login-redirect", absolute & path.rlike(AUTH_PATH)), ("unauthorized-response", status.isin(401, 403)), ("password-form", passwords > 0),
        ("blocking-login-dialog", blocking_dialog), ("login-only-page", login_page),
    )
    reasons = F.array_compact(F.array(*(F.when(_no(c), F.lit(n)) for n, c in rules)))
    sure = F.exists(reasons, lambda r: r.isin(*SURE_REASONS))
    seen = sure | F.array_contains(reasons, "login-only-page")
    return F.struct(seen.alias("detected"), F.when(sure, "high").when(seen, "medium").otherwise("low").alias("confidence"), reasons.alias("reasons"))


def main_empty(main_chars: Column, body_chars: Column, media: Column) -> Column:
    return _no((main_chars < MAIN_CHARS) & (body_chars < BODY_CHARS) & (media == 0))


def health_issues(facts: Column, status: Column, expected_url: Column, current_url: Column) -> Column:
    """array of struct(code, severity, recoverable, detail), in a fixed order.

    facts: struct(overlay_ratio, main_empty, skeleton_ratio, fonts_ready, mutations, viewport_width, content_width, auth_wall, captcha). Null facts tell nothing.
    """
    f = lambda name: facts[name]
    text = lambda c: c.cast("string")
    sizes = F.concat_ws("/", text(f("viewport_width")), text(f("content_width")))
    rules = (
        ("large-overlay", f("overlay_ratio") >= OVERLAY, F.when(f("overlay_ratio") >= LARGE_OVERLAY, "error").otherwise("warning"), True, None),
        ("main-content-empty", f("main_empty"), F.lit("error"), True, None), ("skeleton-heavy", f("skeleton_ratio") >= SKELETON, F.lit("warning"), True, None),
        ("fonts-not-ready", ~f("fonts_ready"), F.lit("warning"), True, None), ("dom-still-mutating", f("mutations") >= MUTATIONS, F.lit("warning"), True, text(f("mutations"))),
        ("horizontal-overflow", f("content_width") > f("viewport_width") + OVERFLOW, F.lit("warning"), False, sizes), ("auth-wall", f("auth_wall"), F.lit("error"), False, None),
        ("captcha", f("captcha"), F.lit("error"), False, None), ("rate-limited", status == 429, F.lit("error"), False, None), ("error-page", status >= 400, F.lit("error"), False, text(status)),
        ("unexpected-navigation", ~url.same_origin(expected_url, current_url), F.lit("error"), False, current_url),
    )
    made = [F.when(_no(c), F.struct(F.lit(n).alias("code"), severity.alias("severity"), F.lit(again).alias("recoverable"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))) for n, c, severity, again, detail in rules]
    return F.array_compact(F.array(*made)).cast(f"array<{ISSUE}>")


def health(issues: Column) -> Column:
    """struct(status, eligible): unusable for an error that hides the page, degraded for any other issue; eligible as evidence is what gates.evidence_eligible says."""
    hidden = F.exists(issues, lambda i: (i["severity"] == "error") & i["code"].isin(*UNUSABLE))
    status = F.when(hidden, "unusable").when(F.size(issues) > 0, "degraded").otherwise("healthy")
    return F.struct(status.alias("status"), gates.evidence_eligible(status, F.transform(issues, lambda i: i["code"])).alias("eligible"))
