"""Looking up evidence: an index of ids over all collections, tokens to what shows them, scopes of claims, and ids that lead nowhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url
from .ranking import top

#: Collections in the order in which an id is looked for, a fixed order.
COLLECTIONS = ("sections", "components", "nodes", "media", "interactions", "responsive", "layers", "pages", "images")
#: How much evidence a token shows, and how many scopes a claim.
MOST_EVIDENCE, MOST_SCOPES = 8, 2


def id_index(collections: dict[str, DataFrame], pages: DataFrame, on: list[str]) -> DataFrame:
    """on, id, collection, page, section, url, viewport: each id once, as the first collection that has it tells.

    collections: by names of COLLECTIONS, with on, id, page and section (null for none); what has no page of its own takes its section's. pages: on, page, url, viewport, which are
    the collection pages. Two joins, by section and by page.
    """
    order = [c for c in COLLECTIONS if c in collections or c == "pages"]
    own = pages.select(*on, F.col("page").alias("id"), "page", F.lit(None).cast("string").alias("section"))
    rows = reduce(DataFrame.unionByName, ((own if c == "pages" else collections[c].select(*on, "id", "page", "section")).withColumn("_c", F.lit(i)) for i, c in enumerate(order)))
    first = rows.groupBy(*on, "id").agg(F.min_by(F.struct("_c", "page", "section"), "_c").alias("_x")).select(*on, "id", "_x.*")
    held = collections["sections"].groupBy(*on, F.col("id").alias("section")).agg(F.min("page").alias("_page")) if "sections" in collections else None
    known = first if held is None else first.join(held, [*on, "section"], "left").withColumn("page", F.coalesce("page", "_page")).drop("_page")
    named = F.element_at(F.array(*map(F.lit, order)), F.col("_c") + 1)
    return known.join(pages.select(*on, "page", "url", "viewport"), [*on, "page"], "left").select(*on, "id", named.alias("collection"), "page", "section", "url", "viewport")


def evidence_of_tokens(tokens: DataFrame, owners: DataFrame, pages: DataFrame, on: list[str]) -> DataFrame:
    """on, token, place, id, more: the first MOST_EVIDENCE owners of each token, or, for tokens that nothing owns, pages on its routes; more counts the rest.

    tokens: on, token, urls (where it was observed); owners: on, rank (collection's and own order), id, token_refs; pages: on, page, ord, url. Tokens without either are left out.
    """
    wanted = tokens.select(*on, "token").distinct()
    owned = owners.select(*on, "rank", "id", F.explode(F.array_distinct("token_refs")).alias("token")).join(wanted, [*on, "token"], "left_semi")
    owned = owned.groupBy(*on, "token", "id").agg(F.min("rank").alias("rank"))
    bare = tokens.join(owned.select(*on, "token").distinct(), [*on, "token"], "left_anti")
    routes = bare.select(*on, "token", F.explode("urls").alias("_u")).select(*on, "token", url.route_identity(F.col("_u")).alias("_route")).distinct()
    there = routes.join(pages.select(*on, url.route_identity(F.col("url")).alias("_route"), F.col("page").alias("id"), F.col("ord").cast("long").alias("rank")), [*on, "_route"])
    every = owned.select(*on, "token", "id", F.col("rank").cast("long").alias("rank")).unionByName(there.groupBy(*on, "token", "id").agg(F.min("rank").alias("rank")))
    total = every.groupBy(*on, "token").agg(F.count(F.lit(1)).alias("_n"))
    shown = top(every, [*on, "token"], [F.col("rank"), F.col("id")], MOST_EVIDENCE, "place").join(total, [*on, "token"])
    return shown.select(*on, "token", "place", "id", F.greatest(F.col("_n") - MOST_EVIDENCE, F.lit(0)).alias("more"))


def claim_scopes(cites: DataFrame, index: DataFrame, on: list[str], most: int = MOST_SCOPES) -> DataFrame:
    """on, claim, scopes, more: the first most URLs of each claim's evidence with their viewports, and how many URLs follow. Claims whose evidence has no page are left out. cites: on, claim, id."""
    seen = cites.join(index.where("url is not null").select(*on, "id", url.sanitised(F.col("url")).alias("url"), "viewport"), [*on, "id"])
    urls = seen.groupBy(*on, "claim", "url").agg(F.array_join(F.array_sort(F.collect_set("viewport")), "/").alias("_v"))
    total = urls.groupBy(*on, "claim").agg(F.count(F.lit(1)).alias("_n"))
    line = F.concat(F.col("url"), F.lit(" · "), F.col("_v"))
    shown = top(urls, [*on, "claim"], [F.col("url")], most, "_p").groupBy(*on, "claim").agg(F.array_sort(F.collect_list(line)).alias("scopes"))
    return shown.join(total, [*on, "claim"]).select(*on, "claim", "scopes", F.greatest(F.col("_n") - most, F.lit(0)).alias("more"))


def dangling_ids(references: DataFrame, index: DataFrame, on: list[str]) -> DataFrame:
    """The references (on, owner, id) whose id no collection has, or whose page is not there."""
    known = index.where(F.col("url").isNotNull()).select(*on, "id")
    return references.where("id is not null").join(known, [*on, "id"], "left_anti")
