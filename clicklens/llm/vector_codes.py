"""Vector codes: consecutive parts of vectors, each replaced by the nearest entry of its codebook.

The nearest entry is found by slices and masks. Each coordinate of a codebook is sorted, and every prefix of that
order carries a mask of its entries (64 entries at most, so one unsigned long). The distance to an entry near in one
coordinate is an initial radius: per coordinate, two searches cut the entries within it, as the difference of two
prefix masks, and the masks ANDed are all entries that can be as near. Only those are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicklens.llm.vectors import MEANS, group_sums, is_finite, matrix, whole, with_means
from clicklens.sources.tables import staged

PARTS, ENTRIES, ROUNDS = 16, 64, 2

#: Pieces that each label's rows are dealt to when they meet the label's sum.
SALTS = 32


class Slices:
    """Sorted coordinates of one part's entries (entries x places, 64 entries at most), with prefix masks."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = [np.ascontiguousarray(entries[o, j]) for j, o in enumerate(self.order.T)]
        self.masks = []
        for o in self.order.T:
            bits = np.uint64(1) << o.astype(np.uint64)
            self.masks.append(np.concatenate([np.zeros(1, np.uint64), np.bitwise_or.accumulate(bits)]))

    def _distance(self, parts: np.ndarray, entry: np.ndarray) -> np.ndarray:
        apart = parts - self.entries[entry]
        return np.einsum("ij,ij->i", apart, apart)

    def radius(self, parts: np.ndarray) -> np.ndarray:
        """Squared distance to an entry that is near in one coordinate, the least over the coordinates."""
        best = None
        for j, values in enumerate(self.sorted):
            place = np.minimum(np.searchsorted(values, parts[:, j]), len(values) - 1)
            found = self._distance(parts, self.order[place, j])
            best = found if best is None else np.minimum(best, found)
        return best

    def candidates(self, parts: np.ndarray, squared: np.ndarray) -> np.ndarray:
        """Masks of the entries that are within the radius in every coordinate."""
        radius = np.sqrt(squared.astype(float)).astype(np.int64) + 1
        result = np.full(len(parts), np.uint64(2**64 - 1))
        for j, (values, masks) in enumerate(zip(self.sorted, self.masks)):
            low = np.searchsorted(values, parts[:, j] - radius, "left")
            high = np.searchsorted(values, parts[:, j] + radius, "right")
            result &= masks[high] ^ masks[low]
        return result

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest entry of each part; ties go to the smaller number."""
        best = self.radius(parts)
        left = self.candidates(parts, best)
        entry = np.full(len(parts), -1)
        rows = np.arange(len(parts))
        while len(rows):  # entry by entry, in ascending order
            bit = left & (~left + np.uint64(1))
            number = np.bitwise_count(bit - np.uint64(1)).astype(np.int64)
            found = self._distance(parts[rows], number)
            better = (found < best[rows]) | ((found == best[rows]) & (entry[rows] < 0))
            best[rows[better]], entry[rows[better]] = found[better], number[better]
            left ^= bit
            more = left != 0
            rows, left = rows[more], left[more]
        return entry, best


def _encode(vectors: np.ndarray, books: list[Slices]) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers (vectors x parts) and the squared distances summed over the parts."""
    width = vectors.shape[1] // len(books)
    codes, errors = np.empty((len(vectors), len(books)), np.int64), np.zeros(len(vectors), np.int64)
    for p, book in enumerate(books):
        codes[:, p], distance = book.nearest(np.ascontiguousarray(vectors[:, p * width : (p + 1) * width]))
        errors += distance
    return codes, errors


def _retrained(kept: DataFrame, entries: np.ndarray, column: str) -> np.ndarray:
    """Codebooks (parts x entries x places) after one round of assigning all parts and taking means."""
    parts, count, width = entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Slices(e) for e in entries]
        totals, members = np.zeros((parts * count, width), np.int64), np.zeros(parts * count, np.int64)
        for batch in batches:
            vectors = matrix(batch.column(0), parts * width)
            codes, _ = _encode(vectors, books)
            groups = (codes + np.arange(parts) * count).ravel()
            np.add.at(totals, groups, vectors.reshape(-1, width))
            members += np.bincount(groups, minlength=parts * count)
        yield group_sums(totals, members)

    found = kept.select(column).mapInArrow(sums, MEANS)
    return with_means(entries.reshape(parts * count, width), found).reshape(entries.shape)


def _coded(kept: DataFrame, entries: np.ndarray, column: str) -> DataFrame:
    """``kept`` without the vectors, with code and error."""
    parts, _, width = entries.shape
    others = [c for c in kept.columns if c != column]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Slices(e) for e in entries]
        for batch in batches:
            codes, errors = _encode(matrix(batch.column(column), parts * width), books)
            text, size = codes.astype(np.uint8).tobytes().hex(), 2 * parts
            out = {c: batch.column(c) for c in others}
            out["code"] = pa.array([text[i : i + size] for i in range(0, len(text), size)], pa.string())
            out["error"] = pa.array(errors)
            yield pa.record_batch(out)

    fields = [kept.schema[c] for c in others]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", code string, error long"
    return kept.mapInArrow(encode, schema)


def train_codebooks(
    kept: DataFrame, column: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> np.ndarray | None:
    """Codebooks (parts x entries x places) of the whole vectors in ``column``; None without any.

    They start as the parts of the rows of the smallest vec_id (ties: by vector; null ids last), of which there may
    be fewer than ``entries``. All vectors must have one length that the number of parts divides.
    """
    if not 1 <= entries <= 64:
        raise ValueError("a mask holds 1 to 64 entries")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), column).limit(entries).select(column).collect()
    if not first:
        return None
    start = np.array([r[0] for r in first], np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _retrained(kept, books, column)
    return books


def code_report(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept row of (vec_id, embedding, label, ...).

    Rows whose vector is null, or holds null or non-finite components, go. All kept vectors should have the length
    of the one with the smallest vec_id; rows of another length go too, and all rows if the parts do not divide it.
    Components beyond 2**27 / 256 count as that. label_error sums the errors of equal labels, nulls together (null
    if it passes the range of a long). Repeated rows give equal rows; other columns are not read; an empty table
    gives no rows.
    """
    rows = embeddings.filter(is_finite(F.col("embedding"))).select("vec_id", "label", "embedding")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding")).first()
    length = first[0] if first and first[0] % PARTS == 0 else 0
    kept = rows.filter((F.size("embedding") == length) & (F.size("embedding") > 0))
    kept = kept.withColumn("embedding", whole(F.col("embedding")))
    books = train_codebooks(kept, "embedding")
    if books is None:
        books = np.zeros((PARTS, 1, 1), np.int64)
    coded = staged(_coded(kept, books, "embedding"), "codes")
    # Sums of labels meet their rows by label and a salt, so that one frequent label is many groups.
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    dealt = sums.select(
        F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    )
    salted = coded.withColumn("_of", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    met = salted.join(dealt, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_of") == F.col("_salt")), "left")
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
