"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import jaccard, langid, linededup, mixing, packing, periodic, pii, quality, secrets, sentencepieces, spelling, topk, toxicity
from palimpsest.llm.common import read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), weights=mixing.WEIGHTS)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_dual_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_sentencepiece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.collapse_runs(read(spark, sf_dir, "documents"), prepare=periodic.tandem_copies))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"), slip_one_in=199)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_best_fit_packing, op3_language_id, op4_source_mixing, op5_line_dedup, op6_quality_outliers, op7_ngram_jaccard, op8_pii_surrogates, op9_dual_tree_topk, op10_toxicity, op11_sentencepiece_encoding, op12_periodic_runs, op13_spelling_variants)}
ORACLE: dict[str, str] = {"op4_source_mixing": mixing.ORACLE, "op5_line_dedup": linededup.ORACLE, "op9_dual_tree_topk": topk.ORACLE}
