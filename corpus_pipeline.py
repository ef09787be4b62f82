"""A corpus pipeline of five stages over `documents`: toxicity, line dedup, near duplicates, mixing, packing.

Each stage reads what the one before it kept and returns the columns of documents, but for the last,
which returns the packed pieces. Stages are written to the shared folder and read again, so that a
lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import jaccard, linededup, mixing, packing, toxicity
from palimpsest.llm.common import materialize, read, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return toxicity.reject_toxic(docs, read(spark, sf_dir, "labels"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; n_chars follows the text; a document of
    which nothing is left goes."""
    cut = linededup.dedup_lines(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text").rlike(linededup.HAS_WORD), F.lit(False))
    return cut.where(~emptied).withColumn("n_chars", n_chars).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect, the row with the smallest id stays. Rows are told apart
    by id and text, so that of rows that share an id each different text is judged by itself, and of equal
    rows one stays; a null id comes last. Rows without words stay."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all tokens, dealt down the domain - language - source tree by mixing.WEIGHTS, each document
    once at most; rows that share an id enter together or not at all."""
    return mixing.mixed_documents(docs, share=0.9, epochs=1, weights=mixing.WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens in as few sequences as possible."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("ngram_jaccard", keep_one_of_each_group),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the learned grammar nor the packing: the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    written = []
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            break
        docs = materialize(docs)
        release(*written)
        written = [docs]
    return docs
