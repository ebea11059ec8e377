"""Manifests, the capture gate and the categories that evidence decides."""

import itertools

from pyspark.sql import functions as F

from tessera.operators import manifests as mf
from tessera.plans import compare



def manifest(**changed):
    out = {
        "schemaVersion": 1, "tool": {"version": "1"}, "request": {"schemaVersion": 1, "viewports": ["desktop"], "pageMode": "auto", "maxPages": 3, "pageDiscovery": "links", "depth": "standard", "accessMode": "public"},
        "environment": {"platform": "linux", "architecture": "x64", "locale": "en", "languages": ["en"], "timezone": "UTC", "colorScheme": "light", "reducedMotion": "no", "deviceScaleFactor": 1.0,
                        "browser": {"product": "b", "version": "1", "headless": True}, "viewports": [{"name": "desktop", "width": 1440, "userAgent": "x"}]},
        "stabilization": {"strategyVersion": 1, "animationFreeze": True},
    }
    for path, value in changed.items():
        *way, last = path.split("__")
        at = out
        for w in way:
            at = at[w]
        at[last] = value
    return out


def reasons(spark, *pairs):
    env = ",".join(f"{n}:{t}" for n, t in (("platform", "string"), ("architecture", "string"), ("locale", "string"), ("languages", "array<string>"), ("timezone", "string"), ("colorScheme", "string"), ("reducedMotion", "string"), ("deviceScaleFactor", "double"), ("browser", "struct<product:string,version:string,headless:boolean>"), ("viewports", "array<struct<name:string,width:int,userAgent:string>>")))
    kind = f"struct<schemaVersion:int,tool:struct<version:string>,request:struct<schemaVersion:int,viewports:array<string>,pageMode:string,maxPages:int,pageDiscovery:string,depth:string,accessMode:string>,environment:struct<{env}>,stabilization:struct<strategyVersion:int,animationFreeze:boolean>>"
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"n int, a {kind}, b {kind}")
    held = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.schemaVersion").alias("schema"), mf.fields(F.col(c)).alias("fields")))
    out = mf.with_comparability(df.select("n", held("a").alias("manifest_a"), held("b").alias("manifest_b")))
    return [(r.manifest_reasons, r.manifest_limitations, [d.field for d in r.differences or []]) for r in out.orderBy("n").collect()]


def test_manifest_families(spark):
    got = reasons(
        spark, (manifest(), manifest()), (manifest(), None), (manifest(), manifest(schemaVersion=2)), (manifest(), manifest(request__depth="deep", environment__platform="mac")),
        (manifest(), manifest(environment__browser__version="2", tool__version="2")), (manifest(), manifest(stabilization__animationFreeze=False, environment__languages=["en", "de"])),
        (manifest(), manifest(environment__viewports=[{"name": "desktop", "width": 1440, "userAgent": "y"}])), (manifest(), manifest(environment__viewports=[{"name": "desktop", "width": 1441, "userAgent": "x"}])), (manifest(environment__locale=None), manifest(environment__locale=None)),
    )
    assert got == [
        ([], [], []), (["missing-capture-manifest"], [], []), (["capture-manifest-schema-mismatch"], [], []),
        (["capture-settings-mismatch", "capture-environment-mismatch"], ["browser-environment-differs"], ["request.depth", "environment.platform"]),
        ([], ["browser-environment-differs", "tool-version-differs"], ["tool.version", "environment.browser.version"]),
        (["capture-environment-mismatch", "stabilization-mismatch"], [], ["environment.languages", "stabilization.animationFreeze"]),
        ([], [], []), (["capture-environment-mismatch"], [], ["environment.viewports"]), ([], [], []),
    ]


def side(spark, color="red", columns="1fr 1fr", moved="mobile", sites=(1, 2, 3)):
    section = "site int, page string, id string, role string, parent_id string, layout_mode string, order int, layoutMode string, display string, position string, maxWidth string, gridTemplateColumns string, childGridTemplateColumns string"
    return {
        "sections": spark.createDataFrame([(s, "p", f"s{s}", "header", None, "flow", 0, "flow", "grid", "static", None, columns, None) for s in sites], section),
        "components": spark.createDataFrame([], "site int, page string, id string, section_id string, type string, element_kind string, role string"),
        "interactions": spark.createDataFrame([(s, "p", f"o{s}", "hover", "mouse", "color", "blue", color) for s in sites], "site int, page string, id string, driver string, trigger string, property string, before string, after string"),
        "changes": spark.createDataFrame([(s, f"r{s}", 0, "position", "static", moved) for s in sites], "site int, id string, ord int, property string, before string, after string"),
        "observations": spark.createDataFrame([(s, f"r{s}", f"s{s}", "desktop", "mobile", "reflow") for s in sites], "site int, id string, section string, from_viewport string, to_viewport string, change_type string"),
    }


def test_evidence_decides_all_categories(spark):
    captures = spark.createDataFrame([(s, 2, False, False) for s in (1, 2, 3)], "site int, viewports int, mismatch boolean, coverage_differs boolean")
    open_ = spark.createDataFrame([(1, "limited"), (2, "limited"), (3, "inconclusive")], "site int, comparability string")
    cases = {
        ("red", "1fr 1fr", "mobile"): ("unchanged", "unchanged", "unchanged"), ("green", "1fr 1fr", "mobile"): ("changed", "unchanged", "unchanged"),
        ("red", "1fr", "mobile"): ("unchanged", "changed", "unchanged"), ("red", "100px 200px", "tablet"): ("unchanged", "unchanged", "changed"),
    }
    for (color, columns, moved), want in cases.items():
        out = compare.compare_evidence(side(spark), side(spark, color, columns, moved), captures, open_, ["site"]).collect()
        got = {(r.site, r.category): (r.status, r.changes) for r in out}
        for site, (category, status) in itertools.product((1, 2), zip(("interaction-states", "layout", "responsive"), want, strict=True)):
            assert got[site, category] == (status, int(status == "changed"))
        assert {v for (site, _), v in got.items() if site == 3} == {("inconclusive", 0)}
    token = spark.createDataFrame([(s, "spacing", "4px", 0) for s in (1, 2, 3)], "site int, group string, value string, ord int")
    section = spark.createDataFrame([(1, "p", "x", "sig", "hero", "flow")], "site int, page string, id string, signature string, role string, layoutMode string")
    observed = compare.compare_evidence(side(spark), side(spark, "green"), captures, open_, ["site"])
    whole = compare.compare(token, token, section, section, open_, ["site"], observed)
    got = {r.category: r.status for r in whole.where("site = 1").collect()}
    assert got == {"colors": "unchanged", "typography": "unchanged", "spacing": "unchanged", "radii": "unchanged", "layout": "unchanged", "interaction-states": "changed", "responsive": "unchanged"}


def test_capture_gate(spark):
    capture = "struct<schema:int,route:string,access:string,language:string,page_coverage:string,capture_coverage:string>"
    pages = "array<struct<key:string,health:string,eligible:boolean>>"
    held = "struct<schema:int,fields:map<string,string>>"
    whole, page = (1, "/", "public", "en", "complete", "complete"), [("k", "ok", True)]
    rows = [(1, whole, whole, page, page, (1, {"tool.version": "1"}), (1, {"tool.version": "2"})), (2, whole, (1, "/x", "public", "en", "complete", "complete"), page, page, None, (1, {})), (3, whole, whole, page, page, (1, {}), (1, {}))]
    df = spark.createDataFrame(rows, f"site int, a {capture}, b {capture}, pages_a {pages}, pages_b {pages}, manifest_a {held}, manifest_b {held}")
    got = {r.site: (r.reasons, r.limitations, r.comparability) for r in compare.capture_gate(df, ["site"]).collect()}
    assert got == {1: ([], ["tool-version-differs"], "limited"), 2: (["missing-capture-manifest", "route-mismatch"], [], "inconclusive"), 3: ([], [], "limited")}
