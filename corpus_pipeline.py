"""From raw documents to training pieces: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Every stage but the last keeps the columns of
``docs``; each result is written as Parquet to the shared folder and read back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicklens.functions.plan import evaluated_once
from clicklens.llm.near_dups import near_duplicates
from clicklens.llm.quality import quality_score, train
from clicklens.llm.queries import VOCABULARIES, read
from clicklens.llm.secret_scan import redact_secrets
from clicklens.llm.sentencepieces import encode_pieces
from clicklens.llm.templates import drop_contaminated
from clicklens.sources.tables import staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.5 or more).

    The classifier is trained on the labelled documents of ``docs`` outside its held-out fold. Null and empty
    texts are scored as empty ones; without labels nothing is rejected.
    """
    model = train(docs, read(spark, sf_dir, "labels"))
    scored = evaluated_once(docs.withColumn("_quality", quality_score(model, F.col("text"))))
    return scored.filter("_quality >= 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each group of near-duplicates.

    Five-word shingles, similarity of 0.8 or more. Texts without words and rows without a doc_id stay. The
    decision is about ids: rows that repeat a doc_id stay or go together.
    """
    groups = near_duplicates(docs, words=5, percent=80)
    dropped = groups.filter("NOT kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col("_dropped"), "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark, also not with other numbers and names."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars counted anew where one was."""
    return redact_secrets(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, piece_ids, n_pieces, round_trip) of every document."""
    pieces = encode_pieces(docs, f"{VOCABULARIES}/piece_bpe_32k.model")
    return pieces.select("doc_id", "lang", "source", "piece_ids", "n_pieces", "round_trip")


STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scan", hide_secrets),
    ("sentencepiece", to_pieces),
]

ORACLE_SQL = None  # learned scores and Viterbi segmentation have no counterpart in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
