"""The queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_extraction, lm_scoring, matroska, mixing, near_dedup, packing, pii, quality, transcripts
from .common import table

#: For the test tables; a job sets paperloom.pii.key to a secret of its own.
TEST_KEY = "paperloom-demo-key"
PACKING_VOCABULARY, SCORING_VOCABULARY = "word_bpe_49k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Where the installed vocabulary file is; only its path travels to the workers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(PACKING_VOCABULARY))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(matroska.encode(table(spark, sf_dir, "documents")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op5_lattice_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), vocabulary(SCORING_VOCABULARY))


def op6_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), spark.conf.get("paperloom.pii.key", TEST_KEY))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op9_transcript_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.recover(table(spark, sf_dir, "conversations"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def _all() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


QUERIES = dict(sorted(_all().items(), key=lambda x: int(x[0][2:].split("_")[0])))
ORACLES = {"op2_exact_dedup": exact_dedup.SQL, "op4_source_mixing": mixing.SQL}
