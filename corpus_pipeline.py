"""A training corpus from `documents`: five stages, each one of the operators of arpent.llm."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from arpent.llm import byte_bpe, decontaminate, line_templates, near_jaccard, quality_rules
from arpent.llm.common import materialise, settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring(docs, keep_whole=True, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

#: Neither learned rules nor BPE can be written in SQL; tests compare near-dedup with a brute-force version.
ORACLE_SQL = None


@settled("corpus")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages wrote on the way is dropped.

    Null and empty texts have no lines, words or leaks: all their counts are zero, by which quality rules
    judge them alike; the next stages leave them as they are but for near-dedup, where all texts without
    a word are one group and repeated rows one document. Rows are told apart by id and text, an empty
    table gives an empty table, and other columns stay up to the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
