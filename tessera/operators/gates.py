"""Gates: comparability, fail-closed results, integrity, confidence, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Health issues that make a page's evidence unsafe.
UNSAFE_HEALTH = ("large-overlay", "main-content-empty", "skeleton-heavy", "fonts-not-ready", "dom-still-mutating", "auth-wall", "captcha", "error-page", "rate-limited", "unexpected-navigation", "health-recovery-failed", "health-recovery-timeout")


def evidence_eligible(status: Column, codes: Column) -> Column:
    return (status != "unusable") & ~F.coalesce(F.arrays_overlap(codes, F.array(*map(F.lit, UNSAFE_HEALTH))), F.lit(False))


def field_reasons(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Names of the fields that differ, by their JSON; what is missing on both sides is equal."""
    differs = lambda x, y: ~F.to_json(F.struct(x.alias("v"))).eqNullSafe(F.to_json(F.struct(y.alias("v"))))
    return F.array_compact(F.array(*(F.when(differs(a[k], b[k]), F.lit(k)) for k in a)))


def comparability(reasons: Column, limitations: Column) -> Column:
    """inconclusive for any reason, else limited: nothing is ever fully comparable."""
    return F.when(F.size(reasons) > 0, "inconclusive").otherwise("limited")


def fail_closed(results: DataFrame, gate: DataFrame, on: list[str]) -> DataFrame:
    """results (on, category, status, changes) with every category inconclusive and without changes where gate (on, comparability) is."""
    blocked = F.coalesce(F.col("comparability"), F.lit("inconclusive")) == "inconclusive"
    joined = results.join(gate.select(*on, "comparability"), on, "left")
    return joined.withColumn("status", F.when(blocked, "inconclusive").otherwise(F.col("status"))).withColumn("changes", F.when(blocked, 0).otherwise(F.col("changes"))).drop("comparability")


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str, label: str) -> DataFrame:
    """code, n: references of child, other than null, that parent lacks."""
    missing = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("code"), "n")


def token_score(pages: Column, captures: Column, observations: Column, variable: Column, action: Column, rendered: Column) -> Column:
    """Points for a token: pages 4, 3 or 1, a declared variable 2, use in actions 2, rendered text 1, observations 2 or 1, captures 1."""
    p = F.when(pages >= 3, 4).when(pages >= 2, 3).when(pages >= 1, 1).otherwise(0)
    o = F.when(observations >= 10, 2).when(observations >= 2, 1).otherwise(0)
    flag = lambda c, n: F.when(c, n).otherwise(0)
    return p + o + flag(variable, 2) + flag(action, 2) + flag(rendered, 1) + flag(captures >= 2, 1)


def confidence(score: Column) -> Column:
    return F.when(score >= 6, "high").when(score >= 3, "medium").otherwise("low")


def assertion_scope(urls: Column) -> Column:
    return F.when(urls >= 2, "cross-page").when(urls == 1, "page").otherwise("instance")


def confusion(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """expected, actual, n."""
    return df.groupBy(F.col(expected).alias("expected"), F.col(actual).alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def checks(rows: dict[str, Column]) -> Column:
    """array(struct(id, passed)) of named conditions; null counts as failed."""
    return F.array(*(F.struct(F.lit(k).alias("id"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in rows.items()))


def stabilised(status: Column, attempts: Column) -> Column:
    return F.when(status == "unusable", "unusable").when(attempts > 1, "recovered").otherwise(status)
