"""Consecutive numbers for the rows of a table, part by part, without a window over a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages, fresh

#: (part, table partition) pairs that are broadcast at most; a longer list is joined by a shuffle.
BROADCAST_MARKS = 1_000_000


def numbered(rows: DataFrame, stages: Stages, part: str, order: list[str], named: tuple[str, str, str]) -> DataFrame:
    """rows with three more columns, named: the place of the row's part among the parts, its own place in the part by order, the part's size.

    A range partitioning is staged with each row's partition and place in it; offsets then come from one row for each part and partition.
    """
    group, index, size = named
    at, place = fresh(rows, "at_partition"), fresh(rows, "at_place")
    keys = [F.col(part).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The low 33 bits of the generated id count the rows of a partition.
    dealt = dealt.withColumns({at: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    dealt = stages.keep(dealt, "numbered")
    marks = dealt.groupBy(part, at).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    before = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(part)
    marks = stages.keep(marks.select(part, at, "first", F.sum("n").over(whole).alias(size), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "marks")
    parts = marks.groupBy(part).agg(F.min(at).alias("opens"))
    # Parts follow one another in the partitions, so those that open in a partition are ranked there, after all that open before.
    opening = parts.groupBy("opens").agg(F.count("*").alias("n"))
    earlier = opening.select("opens", (F.sum("n").over(Window.orderBy("opens")) - F.col("n")).alias("earlier"))  # a row for each partition
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("opens").orderBy(F.col(part).asc_nulls_first())))
    ranked = ranked.join(earlier, "opens").select(F.col(part).alias("its_part"), (F.col("earlier") + F.col("rank") - 1).alias(group))
    marks = stages.keep(marks.join(ranked, F.col(part).eqNullSafe(F.col("its_part"))).drop("its_part"), "parts")
    marks = marks.withColumnsRenamed({part: "mark_part", at: "mark_at"})
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_MARKS else marks
    joined = dealt.join(marks, (F.col(at) == F.col("mark_at")) & F.col(part).eqNullSafe(F.col("mark_part")))
    return joined.select(*rows.columns, group, (F.col(place) - F.col("first") + F.col("offset")).alias(index), size)
