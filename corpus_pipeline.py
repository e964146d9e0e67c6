"""The corpus pipeline: quality rules, near duplicates, decontamination, pseudonyms, and BPE codes, in this order.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and read again before the next. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, decontaminate, jaccard, pii, quality
from factloom.llm.shared import spent, table, written


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Under the session's key; the test tables, where it has none, under the published one."""
    return pii.stage(spark, docs, sf_dir, spark.conf.get("spark.factloom.pii.key", pii.TEST_KEY))


STAGES = [
    ("quality_rules", quality.stage),
    ("jaccard_join", jaccard.stage),
    ("decontaminate", decontaminate.stage),
    ("pii", pseudonyms),
    ("bpe", bpe.stage),
]
#: Verdicts of a trained model and tokens of a vocabulary file: SQL can't express them; tests/llm holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written before the next, which reads all of it; a stage's table goes once the next one's is there. An
    empty table passes as one; null and repeated ids and texts are rows as the stages' docstrings say."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            spent(before)
        before = docs
    return docs
