"""A corpus pipeline of five stages over `documents`, each with one operator of leafmill.llm.

Every stage works on all rows that the one before kept, and all but the last return the columns of documents.
run() writes each stage's rows to the shared folder and reads them again for the next; what a stage made on its way, and the
rows before it, are deleted then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, language_id, line_dedup, near_dedup, sentencepiece_sampling
from leafmill.llm.tables import column, cut, release, scratch, unused

#: Documents without a language, or with none that reaches this share of the probability, are rejected.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the model is fitted to a bounded sample of the labelled ones."""
    model = language_id.train(language_id.training_rows(docs))
    [into] = unused(docs.columns, "language")
    told = language_id.identify(docs, model, into=into)
    return told.where((F.col(f"{into}.lang") != language_id.UNKNOWN) & (F.col(f"{into}.score") >= LEAST_SCORE)).drop(into)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten or more of them have; n_chars follows the text."""
    [into] = unused(docs.columns, "lines")
    found = line_dedup.dedup_lines(docs, min_docs=10, into=into)
    new = {"text": F.col(f"{into}.text"), "n_chars": F.length(f"{into}.text").cast(docs.schema["n_chars"].dataType)}
    return found.select(*(new.get(c, column(c)).alias(c) for c in docs.columns))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies."""
    return near_dedup.drop_near_duplicates(docs, percent=75)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    [into] = unused(docs.columns, "found")
    found = decontaminate.decontaminate(docs, benchmark, into=into)
    return found.where(F.col(f"{into}.n_hit") == 0).drop(into)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and one sampled segmentation of each text."""
    coded = sentencepiece_sampling.encode(docs.select("doc_id", "lang", "source", "text"), seed=20, into="pieces")
    return coded.select("doc_id", "lang", "source", F.size("pieces.ids").cast("long").alias("n_pieces"), F.col("pieces.ids").alias("ids"), F.col("pieces.lossless").alias("lossless"))


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_common_lines),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding and decoding", encoded),
]

#: SQL can express neither the language model nor sampled segmentations; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for number, (_, stage) in enumerate(STAGES[:-1]):
        with scratch() as keep:
            docs = keep(cut(stage(spark, docs, sf_dir), f"stage{number}"))
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
