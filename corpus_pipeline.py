"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, byte-level BPE.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again before the next. All stages but the last return the columns of documents.

Cases: nulls, empty and very long texts, repeated rows and further columns are as the operators say. Quality rules drop rows without words;
line dedup may leave an empty text, which near-dedup then joins with all other empty ones; an empty table stays empty.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import bpe, decontaminate, lines, quality, simhash, similar
from trailmark.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # long lines that few sites share are for the next stage: a near copy without them would no longer be one
    found = lines.without_boilerplate(docs, least_sites_long=lines.LEAST_SITES)
    return found.withColumn("n_chars", F.when(F.col("_line_gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # SimHash's components first, by byte positions; then what two bits can't reach, by exact Jaccard similarity
    return simhash.keep_one(docs, grouped=partial(similar.classes, start=simhash.classes))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]
#: Learned rules, similarity and merges aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
