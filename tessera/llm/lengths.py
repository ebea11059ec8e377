"""Exact token counts of a corpus from a histogram of encoded lengths.

Every text is encoded where it lies; a partition returns one row for each length it saw, and these add up to the histogram. Suffix sums over it then
answer any question about totals, quantiles or truncation without looking at texts again. The sums run in two levels, over blocks of lengths
and within them, so no task holds the whole histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Stages, chunks, small_batches, utf8
from .encode import encoder

LENGTHS_PER_BLOCK = 4096


def _count(path: str, extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path), Counter()
        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in chunks(off, CHUNK_BYTES):
                _, at = enc.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                n, c = np.unique(np.diff(at) + extra, return_counts=True)
                seen.update(dict(zip(n.tolist(), c.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n_docs"])

    return run


def length_histogram(docs: DataFrame, path: str, end_tokens: int = 0, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many rows of docs have each encoded length. A null text is empty; other columns are ignored; no rows, no result."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_count(path, end_tokens), "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length in the histogram: docs and tokens in documents at least so long, the total if all are cut to it, and the share of shorter or equal ones.

    A limit between two lengths truncates as limit * docs_at_least of the next length, plus the tokens of the shorter documents.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / LENGTHS_PER_BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("later_d"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("later_t"), F.sum("bd").over(every).alias("all_d"), F.sum("bt").over(every).alias("all_t"))
    inner = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = F.sum("n_docs").over(inner) + F.col("later_d")
    t = F.sum("tokens").over(inner) + F.col("later_t")
    out = h.join(blocks, "block").select("n_tokens", "n_docs", d.alias("docs_at_least"), t.alias("tokens_at_least"), "all_d", "all_t")
    cut = F.col("all_t") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    share = (F.col("all_d") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_d")
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", cut.alias("truncated_tokens"), share.alias("share_at_most"))


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, tokens, truncated_docs for each context limit: the corpus's tokens if every document is cut to the limit, and how many are."""
    sums = [F.sum(F.least("n_tokens", F.lit(x)) * F.col("n_docs")) for x in limits]
    over = [F.sum(F.when(F.col("n_tokens") > x, F.col("n_docs")).otherwise(0)) for x in limits]
    row = F.array(*(F.struct(F.lit(x).cast("long").alias("limit"), F.coalesce(a, F.lit(0)).alias("tokens"), F.coalesce(b, F.lit(0)).alias("truncated_docs")) for x, a, b in zip(limits, sums, over, strict=True)))
    return histogram.agg(row.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that so great a share of the documents does not exceed, from suffix_sums()."""
    least = [F.min(F.when(F.col("share_at_most") >= q, F.col("n_tokens"))) for q in shares]
    row = F.array(*(F.struct(F.lit(q).alias("share"), v.alias("n_tokens")) for q, v in zip(shares, least, strict=True)))
    return sums.agg(row.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """suffix_sums() of the rows of docs."""
    return suffix_sums(Stages(docs.sparkSession).keep(length_histogram(docs, path), "lengths"))
