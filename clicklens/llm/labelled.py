"""Bounded training samples of labelled documents, and the hash folds that keep rows out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, without: tuple[int, int]) -> DataFrame:
    """At most ``rows`` labelled documents of each class as (doc_id, text, label), outside fold ``without``.

    ``without`` is (folds, fold). Rows are chosen by a hash of the doc_id, so the choice is stable and follows
    nothing else. The chosen ids are bounded by ``2 * rows``, which is why they may be broadcast; texts do not
    move. Null labels and ids are left out; a document labelled twice gives two rows.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & (fold(F.col("doc_id"), without[0]) != without[1])
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [usable.filter(F.col("label") == c).orderBy(*order).limit(rows) for c in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
