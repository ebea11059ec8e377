"""Claims that cite evidence: catalog, integrity, profile, comparison of profiles, benchmark evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from .ranking import first_row, top

MOST_CLAIMS, MOST_SIGNATURES, MOST_DRIVERS = 64, 2, 4
CONFIDENCES = ("low", "medium", "high")


def confidence_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CONFIDENCES)), c)


def catalog(claims: DataFrame, evidence: DataFrame, group: list[str]) -> DataFrame:
    """Claims with an id, one for each key (the first by ord), evidence ids sorted and unique, those unknown left out; in order of priority, 64 at most.

    claims: group, key, ord, priority, statement, confidence, evidence_ids, ...; evidence: group, id.
    """
    unique = first_row(claims, [*group, "key"], [F.col("ord")])
    cited = unique.select(*group, "key", F.explode("evidence_ids").alias("id")).distinct().join(evidence.select(*group, "id").distinct(), [*group, "id"], "left_semi")
    known = cited.groupBy(*group, "key").agg(F.array_sort(F.collect_list("id")).alias("known"))
    out = unique.join(known, [*group, "key"], "left").withColumn("evidence_ids", F.coalesce("known", F.array().cast("array<string>"))).drop("known")
    out = out.withColumn("claim_id", ids.content_id("claim", F.struct("key", "statement", "evidence_ids")))
    return top(out, group, [F.col("priority"), F.col("ord")], MOST_CLAIMS, "place")


def integrity(claims: DataFrame, evidence: DataFrame, group: list[str]) -> DataFrame:
    """group, code, claim_id, detail: duplicate ids, missing or unsafe evidence, claims without any, passive evidence at high confidence, token refs that no cited evidence owns.

    claims: group, claim_id, confidence, evidence_ids, token_refs, placement; evidence: group, id, safe, passive, severe, token_refs.
    """
    error = lambda df, code, detail: df.select(*group, F.lit(code).alias("code"), "claim_id", detail.cast("string").alias("detail"))
    cites = claims.select(*group, "claim_id", "confidence", "placement", F.explode("evidence_ids").alias("id"))
    found = cites.join(evidence.select(*group, "id", "safe", "passive", "severe", F.col("token_refs").alias("owned"), F.lit(True).alias("there")), [*group, "id"], "left")
    twice = claims.groupBy(*group, "claim_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    passive = found.groupBy(*group, "claim_id", "confidence").agg(F.bool_and(F.coalesce("passive", F.lit(False))).alias("all_passive")).where("all_passive and confidence = 'high'")
    owned = found.select(*group, "claim_id", F.explode("owned").alias("ref")).distinct()
    refs = claims.select(*group, "claim_id", F.explode("token_refs").alias("ref")).join(owned, [*group, "claim_id", "ref"], "left_anti")
    parts = [
        error(twice, "duplicate-id", F.col("n")),
        error(claims.where(F.size("evidence_ids") <= 0), "no-evidence", F.lit(None)),
        error(found.where("there is null"), "missing-evidence", F.col("id")),
        error(found.where("there and not safe"), "unsafe-evidence", F.col("id")),
        error(found.where("severe and placement <> 'avoid'"), "severe-page", F.col("id")),
        error(passive, "passive-high", F.col("confidence")),
        error(refs, "unowned-token", F.col("ref")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile(claims: DataFrame, group: list[str]) -> DataFrame:
    """group, slot, place, claim_id: the best claim of a slot, two of signature, four of driver; by confidence, scope, evidence, id."""
    most = F.when(F.col("slot") == "signature", MOST_SIGNATURES).when(F.col("slot") == "driver", MOST_DRIVERS).otherwise(1)
    order = [confidence_rank(F.col("confidence")).desc(), (F.col("scope") == "cross-page").desc(), F.size("evidence_ids").desc(), F.col("claim_id")]
    w = Window.partitionBy(*group, "slot").orderBy(*order)
    ranked = claims.where("slot is not null").withColumn("place", F.row_number().over(w))
    return ranked.where(F.col("place") <= most).select(*group, "slot", "place", "claim_id")


def merged(claims: DataFrame, key: list[str]) -> DataFrame:
    """Claims of one key as one: the lowest confidence, all evidence."""
    return claims.groupBy(*key).agg(F.min_by("confidence", confidence_rank(F.col("confidence"))).alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"))


def profile_similarity(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """on, slot, similarity, only_a, only_b: Jaccard similarity of the terms of each slot's statements; 24 distinctive terms of either side."""
    words = lambda df, name: df.groupBy(*on, "slot").agg(F.array_distinct(F.flatten(F.collect_list(text.terms(F.col("statement"))))).alias(name))
    none = F.array().cast("array<string>")
    both = words(a, "x").join(words(b, "y"), [*on, "slot"], "full_outer").withColumn("x", F.coalesce("x", none)).withColumn("y", F.coalesce("y", none))
    only = lambda p, q: F.slice(F.array_sort(F.array_except(p, q)), 1, 24)
    return both.select(*on, "slot", text.jaccard(F.col("x"), F.col("y")).alias("similarity"), only("x", "y").alias("only_a"), only("y", "x").alias("only_b"))


def scope(claims: DataFrame, evidence: DataFrame, group: list[str]) -> DataFrame:
    """group, claim_id, scope: cross-page for evidence of two URLs or more, page for one, else instance."""
    from .gates import assertion_scope

    urls = claims.select(*group, "claim_id", F.explode_outer("evidence_ids").alias("id")).join(evidence.select(*group, "id", "url"), [*group, "id"], "left")
    return urls.groupBy(*group, "claim_id").agg(assertion_scope(F.count_distinct("url")).alias("scope"))


def evaluate(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """scenario, category, expected, actual, outcome for benchmark scenarios; a scenario without a result has failed.

    expected and actual: scenario, category, status.
    """
    both = expected.select("scenario", "category", F.col("status").alias("expected")).join(actual.select("scenario", "category", F.col("status").alias("actual")), ["scenario", "category"], "full_outer")
    outcome = F.when(F.col("actual").isNull(), "failed").when(F.col("expected").isNull(), "unexpected").when(F.col("expected") == F.col("actual"), "correct")
    outcome = outcome.when((F.col("expected") == "changed") & (F.col("actual") == "unchanged"), "missed").when((F.col("expected") == "inconclusive") & (F.col("actual") != "inconclusive"), "fail-closed").when(F.col("actual") == "inconclusive", "inconclusive")
    return both.withColumn("outcome", outcome.otherwise("unexpected"))


def policy(outcomes: DataFrame, maxima: dict[str, int]) -> DataFrame:
    """outcome, n, most, passed: the counts of outcomes against their limits."""
    limits = outcomes.sparkSession.createDataFrame(list(maxima.items()), "outcome string, most long")
    counts = outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return limits.join(counts, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"), "most", (F.coalesce("n", F.lit(0)) <= F.col("most")).alias("passed"))
