"""The corpus pipeline: quality classifier, exact dedup, near dedup, mixing, packing.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of `documents`. Documents that the
classifier rejects go; of exact copies the row with the largest id stays; of
near copies the one with the smallest; mixing repeats a row as often as the mix
takes it and drops those it doesn't take; packing returns the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from paperloom.llm.common import materialize, table
from paperloom.llm.queries import PACKING_VOCABULARY, vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary(PACKING_VOCABULARY))


STAGES = [("quality classifier", classify), ("exact dedup", dedup), ("minhash near-dedup", dedup_near), ("mixing to target weights", mix), ("best-fit packing", pack)]

#: The classifier's scores and the packing's token ids aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
