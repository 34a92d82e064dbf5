"""A cleaning pipeline for a training corpus: five stages, each written as Parquet and read by the next.

Edge cases: rows without an id pass all stages as rows of their own; null and empty texts are judged as texts without
words (quality by the bias alone, no near copies, no benchmark item, no secret, no ids); repeated rows are
treated alike; extra columns pass through, but ``ids`` and ``decoded`` are the last stage's own; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, decontaminate, minhash, quality, secrets, sentencepiece_op


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: every kept document with its SentencePiece ids and the text that they decode to."""
    return sentencepiece_op.encode_decode(docs.drop("ids", "decoded"))


STAGES = [
    ("quality", quality.quality_filter),
    ("near_dedup", minhash.dedup_stage),
    ("decontamination", decontaminate.clean_stage),
    ("secrets", secrets.secret_stage),
    ("sentencepiece", tokenized),
]

#: No SQL can express learned stages; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` that all stages keep, with ids and decoded text."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        common.tidy(spark)
    return docs
