"""Capture manifests: whether two captures were taken under the same request, environment and stabilization."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The compared fields by effect, the reasons and the limitations.
INCONCLUSIVE = (
    "request.schemaVersion", "request.viewports", "request.pageMode", "request.maxPages", "request.pageDiscovery", "request.depth", "request.accessMode",
    "environment.locale", "environment.languages", "environment.timezone", "environment.colorScheme", "environment.reducedMotion", "environment.deviceScaleFactor",
    "environment.viewports", "stabilization.strategyVersion", "stabilization.animationFreeze",
)
LIMITING = ("tool.version", "environment.platform", "environment.architecture", "environment.browser.product", "environment.browser.version", "environment.browser.headless")
FAMILIES = (("request.", "capture-settings-mismatch"), ("environment.", "capture-environment-mismatch"), ("stabilization.", "stabilization-mismatch"))
MISSING, SCHEMA = "missing-capture-manifest", "capture-manifest-schema-mismatch"
BROWSER_DIFFERS, TOOL_DIFFERS = "browser-environment-differs", "tool-version-differs"
#: What of a viewport's record does not count.
IGNORED_OF_VIEWPORT = "userAgent"


def fields(manifest: Column) -> Column:
    """A manifest struct as a map from each compared field to its JSON, in which viewports have no user agent; null fields are left out.

    manifest: struct(schemaVersion, tool, request, environment, stabilization) with the fields of INCONCLUSIVE and LIMITING.
    """

    def value(path: str) -> Column:
        got = reduce(lambda c, name: c[name], path.split("."), manifest)
        got = F.transform(got, lambda v: v.dropFields(IGNORED_OF_VIEWPORT)) if path == "environment.viewports" else got
        return F.when(got.isNotNull(), F.to_json(F.struct(got.alias("v"))))

    entries = F.array(*(F.struct(F.lit(p).alias("key"), value(p).alias("value")) for p in (*INCONCLUSIVE, *LIMITING)))
    return F.when(manifest.isNotNull(), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))


def differences(a: Column, b: Column) -> Column:
    """array of struct(field, before, after, effect) of the fields that differ between two maps of fields; what neither has is equal."""
    told = lambda names, effect: [F.struct(F.lit(p).alias("field"), a[p].alias("before"), b[p].alias("after"), F.lit(effect).alias("effect")) for p in names]
    every = F.array(*told(INCONCLUSIVE, "inconclusive"), *told(LIMITING, "limitation"))
    return F.filter(every, lambda d: ~d["before"].eqNullSafe(d["after"]))


def _family(found: Column, prefix: str) -> Column:
    return F.exists(found, lambda d: d["field"].startswith(prefix))


def with_comparability(pairs: DataFrame, a: str = "manifest_a", b: str = "manifest_b") -> DataFrame:
    """pairs with differences, manifest_reasons and manifest_limitations of the manifest columns a and b: struct(schema, fields) with fields as of `fields`.

    A missing manifest is the only reason then. Any field that makes a comparison inconclusive names the families of all that differ, limiting ones included.
    """
    there = F.col(a).isNotNull() & F.col(b).isNotNull()
    none = F.array().cast("array<string>")
    out = pairs.withColumn("differences", F.when(there, differences(F.col(f"{a}.fields"), F.col(f"{b}.fields"))))
    found = F.col("differences")
    hard = F.exists(found, lambda d: d["effect"] == "inconclusive")
    soft = F.exists(found, lambda d: (d["effect"] == "limitation") & d["field"].startswith("environment."))
    reasons = [F.when(~F.col(f"{a}.schema").eqNullSafe(F.col(f"{b}.schema")), SCHEMA), *(F.when(hard & _family(found, prefix), name) for prefix, name in FAMILIES)]
    limits = [F.when(soft, BROWSER_DIFFERS), F.when(F.exists(found, lambda d: d["field"] == "tool.version"), TOOL_DIFFERS)]
    return out.withColumns({
        "manifest_reasons": F.when(there, F.array_compact(F.array(*reasons))).otherwise(F.array(F.lit(MISSING))),
        "manifest_limitations": F.when(there, F.array_compact(F.array(*limits))).otherwise(none),
    })
