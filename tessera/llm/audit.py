"""What each filter of a chain removes, whatever the order of the filters: a direct relational replay of all orders.

Each document's flags (a bit for each filter that it fails) meet every order of the filters, which is a broadcast table of k! rows; the
steps are exploded, the first failure of the order's filters says at which step the document goes, and conditional sums count what
each step keeps, removes and would have removed.

Scale: documents are read once and only their flags are replayed. The k! * k rows of a document exist one after another inside a task, which sums them up before
the shuffle, so what travels is at most parts * k! * k rows from each task, whatever the size of a part. k is at most MAX_FILTERS.
Equal texts are found by their digests: the first id of each is one aggregation, and documents meet it by id and digest, so no
group of copies meets in a task.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages

MAX_FILTERS = 6
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Thresholds of the filters: words, percent of distinct words, percent of capitals, signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 50, 65, 5, "[#$%&*|]"
#: Spaces that part words, as a fixed value: space and code points 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"


def text_fails(text: Column) -> dict[str, Column]:
    """The filters that look at one text: name -> whether it fails. text must not be null."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * LEAST_DISTINCT,
        "C": capitals * 100 > F.length(text) * MOST_CAPITALS,
        "D": text.rlike(SIGNS),
    }


def failing(documents: DataFrame, labels: DataFrame, stages: Stages) -> DataFrame:
    """part, fails (bit i: fails filter i of FILTERS), good, toxic for each document: the input of replay.

    E fails where the text is identical to that of any smaller doc_id. A null text is empty, a null source is the empty part. A document
    without an id neither fails E nor makes others fail, and has no labels; rows that repeat an id and its text are not
    copies of each other. A label that occurs in any of an id's rows counts; null labels count as 0. Empty tables give an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(f, F.lit(1 << FILTERS.index(k))).otherwise(F.lit(0)) for k, f in text_fails(text).items()))
    read = documents.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), bits.alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest"))
    read = stages.keep(read, "flags")
    named = read.where(F.col("id").isNotNull())
    firsts = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where(F.col("id").isNotNull())
    marked = marked.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    copy = F.when(F.col("first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    known = named.join(firsts, ["id", "digest"], "left").join(marked, "id", "left")
    known = known.select("part", F.col("bits").bitwiseOR(copy).alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    nameless = read.where(F.col("id").isNull()).select("part", F.col("bits").alias("fails"), F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return stages.keep(known.unionByName(nameless), "failing")


def replay(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of COUNTS, a row for each part, order of the filters and step.

    flags has the columns part, fails (int, bit i for filters[i]), good and toxic. Null good and toxic count as false; repeated
    rows count each; other columns are ignored. An empty table has no parts.
    """
    if not 0 < len(filters) <= MAX_FILTERS:
        raise ValueError(f"{MAX_FILTERS} filters at most, as each document meets every order of them")
    spark, k = flags.sparkSession, len(filters)
    orders = [("".join(o), *(1 << filters.index(f) for f in o)) for o in permutations(filters)]
    orders = spark.createDataFrame(orders, ", ".join(["filter_order string", *(f"bit{s} int" for s in range(1, k + 1))]))
    crossed = flags.select("part", F.col("fails").cast("int").alias("fails"), "good", "toxic").crossJoin(F.broadcast(orders))
    hits = lambda bit: F.col("fails").bitwiseAND(bit) != 0
    first = reduce(lambda later, s: F.when(hits(F.col(f"bit{s}")), F.lit(s)).otherwise(later), range(k, 0, -1), F.lit(k + 1))
    steps = F.explode(F.array(*(F.struct(F.lit(s).alias("step"), F.col(f"bit{s}").alias("bit")) for s in range(1, k + 1))))
    steps = crossed.select("part", "filter_order", "fails", "good", "toxic", first.alias("first"), steps.alias("at")).select("*", "at.step", "at.bit")
    here, step = F.col("first") == F.col("step"), F.col("step")
    counted = {
        "kept": F.col("first") > step, "removed": here, "redundant": hits(F.col("bit")) & (F.col("first") < step),
        "unique_fails": F.col("fails") == F.col("bit"), "good_lost": here & F.col("good"), "toxic_lost": here & F.col("toxic"),
    }
    out = steps.groupBy("part", "filter_order", "step").agg(*(F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in counted.items()))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))  # k! rows a window


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley over whole documents; see failing and replay for nulls, repeated rows and empty tables."""
    return replay(failing(documents, labels, Stages(documents.sparkSession)))
