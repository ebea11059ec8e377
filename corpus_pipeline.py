"""The corpus pipeline: quality rules, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of documents; the last returns packed pieces.
A document stays with its stage's decision: rejected by the quality rules it goes, of near duplicates that of the smallest doc_id
stays, personal data is replaced in the text itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import Stages
from tessera.llm.hyperminhash import drop_near_duplicates
from tessera.llm.packing import pack
from tessera.llm.perplexity import keep_quality
from tessera.llm.pii import redact
from tessera.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep. Null and empty texts go, repeated rows share a verdict, null ids and languages are judged like others; an empty table stays empty."""
    return keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of near duplicates. Rows without an id stay, rows that repeat the kept id too; an empty table stays empty."""
    return drop_near_duplicates(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data masked. Null and empty texts stay as they are; an empty table stays empty."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces with their token ids; tessera.llm.packing.write_sequences writes them as padded sequences. An empty table has no pieces."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), end_id=1)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_dedup), ("personal data", personal_data), ("packing", packing)]
#: SQL has neither the perplexity model nor the tokenizer, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written and read again by the next."""
    stages = Stages(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stages.keep(stage(spark, docs, sf_dir), stage.__name__)
        stages.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
