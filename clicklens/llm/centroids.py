"""Clusters by nearest centroid, with most centroids turned away by bounds from distances to a few pivots.

A simplex is built once from the distances between the pivots. The distances of a vector to them make it the apex of
that simplex: as many coordinates as pivots, the last one its height. For two vectors the Euclidean distance of
their apexes is a lower bound of their own distance, and that with one height turned down an upper bound. Distances
to pivots and the apexes follow from the vector alone, so they are computed once, kept beside it, and serve all
rounds. A centroid whose lower bound is above the least upper bound cannot be the nearest; the others are compared
in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicklens.functions.plan import local_rows
from clicklens.llm.vectors import MEANS, group_sums, is_finite, matrix, whole, with_means
from clicklens.sources.tables import staged

#: Pivots at most, vectors they are chosen from, and the part of its distance to the first pivot that a pivot must stand
#: above the simplex of those before it.
PIVOTS, DRAWN, LEAST_HEIGHT = 60, 80, 0.02

#: Room for rounding (apexes are kept in single precision), as a part of the squared lengths of both apexes.
ROUNDING = 2e-6

_BLOCK = 2048


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, exact in longs."""
    return np.stack([np.einsum("ij,ij->i", a - row, a - row) for row in b], axis=1)


class Simplex:
    """The base simplex of some pivots; pivots that add no dimension are left out."""

    def __init__(self, pivots: np.ndarray, most: int = PIVOTS) -> None:
        chosen, corners = [0], np.zeros((1, 0))
        for i in range(1, len(pivots)):
            if len(chosen) >= most:
                break
            distance = squared(pivots[i : i + 1], pivots[chosen])
            apex = self._apex(distance, corners)[0]
            if apex[-1] > LEAST_HEIGHT * np.sqrt(distance[0, 0]):
                corners = np.vstack([np.pad(corners, ((0, 0), (0, 1))), apex])
                chosen.append(i)
        self.pivots, self.corners = pivots[chosen], corners

    @staticmethod
    def _apex(distance: np.ndarray, corners: np.ndarray) -> np.ndarray:
        """Coordinates in the space of the corners, the first of which is the origin, and the height above it."""
        inner, own = corners[1:], distance[:, :1].astype(float)
        side = (own - distance[:, 1:] + (inner**2).sum(axis=1)) / 2
        base = np.linalg.solve(inner, side.T).T if len(inner) else side
        height = np.sqrt(np.maximum(own - (base**2).sum(axis=1, keepdims=True), 0))
        return np.hstack([base, height])

    def apexes(self, distance: np.ndarray) -> np.ndarray:
        """Apex of each row of squared distances to the pivots."""
        return self._apex(distance, self.corners)


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds of the distances between the vectors of all apexes of ``a`` and ``b``."""
    low = np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T), 0)
    return low, low + 4 * np.outer(a[:, -1], b[:, -1])


def nearest(
    vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centroid_apexes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid (ties: the smaller number), and the number of exact comparisons."""
    number, distance, compared = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64), 0
    for first in range(0, len(vectors), _BLOCK):
        part = slice(first, first + _BLOCK)
        own = apexes[part]
        low, high = bounds(own, centroid_apexes)
        room = ROUNDING * ((own**2).sum(axis=1)[:, None] + (centroid_apexes**2).sum(axis=1)) + 1e-3
        rows, candidates = np.nonzero(low - room <= (high + room).min(axis=1)[:, None])
        apart = vectors[part][rows] - centroids[candidates]
        exact = np.einsum("ij,ij->i", apart, apart)
        starts = np.flatnonzero(np.diff(rows, prepend=-1))  # every row has a candidate
        least = np.minimum.reduceat(exact, starts)
        hit = np.flatnonzero(exact == least[rows])
        at = hit[np.diff(rows[hit], prepend=-1) > 0]
        number[part], distance[part] = candidates[at], least
        compared += len(rows)
    return number, distance, compared


def with_apexes(kept: DataFrame, simplex: Simplex, column: str) -> DataFrame:
    """``kept`` with ``apex``, in single precision."""
    width = simplex.pivots.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = simplex.apexes(squared(matrix(batch.column(column), width), simplex.pivots)).astype(np.float32)
            offsets = np.arange(len(apexes) + 1, dtype=np.int32) * apexes.shape[1]
            yield batch.append_column("apex", pa.ListArray.from_arrays(offsets, pa.array(apexes.ravel())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(project, schema + ", apex array<float>")


def _assigned(batch: pa.RecordBatch, column: str, simplex: Simplex, centroids: np.ndarray) -> tuple:
    vectors = matrix(batch.column(column), centroids.shape[1])
    apexes = batch.column("apex").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    own = simplex.apexes(squared(centroids, simplex.pivots))
    return vectors, *nearest(vectors, apexes, centroids, own)


def moved(projected: DataFrame, column: str, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor means of their vectors; those without vectors stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, members = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            vectors, number, _, _ = _assigned(batch, column, simplex, centroids)
            np.add.at(totals, number, vectors)
            members += np.bincount(number, minlength=len(centroids))
        yield group_sums(totals, members)

    return with_means(centroids, projected.select(column, "apex").mapInArrow(sums, MEANS))


def assigned(projected: DataFrame, column: str, simplex: Simplex, centroids: np.ndarray, others: list[str]) -> DataFrame:
    """``others`` of each row with cluster and distance (squared)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, number, distance, _ = _assigned(batch, column, simplex, centroids)
            out = {c: batch.column(c) for c in others}
            out |= {"cluster": pa.array(number.astype(np.int32)), "distance": pa.array(distance)}
            yield pa.record_batch(out)

    fields = [projected.schema[c] for c in others]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", cluster int, distance long"
    return projected.select(*others, column, "apex").mapInArrow(assign, schema)


def first_vectors(kept: DataFrame, column: str, count: int, seed: str = "2") -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:vec_id`` (ties: by vector; null ids last), in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(order.asc_nulls_last(), column).limit(count).select(column).collect()
    return np.array([r[0] for r in rows], np.int64)


def cluster_report(embeddings: DataFrame, count: int = 40, rounds: int = 5, dims: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept row of (vec_id, embedding).

    Vectors that have not exactly ``dims`` components, all of them finite, go. There may be fewer than ``count``
    centroids when there are fewer vectors; an empty table gives no rows. Components beyond 2**27 / 256 count as that;
    a sum that passes the range of a long is null. Repeated rows give equal rows; other columns are not read.
    """
    usable = (F.size("embedding") == dims) & is_finite(F.col("embedding"))
    kept = embeddings.select("vec_id", "embedding").filter(usable)
    kept = kept.withColumn("embedding", whole(F.col("embedding")))
    drawn = first_vectors(kept, "embedding", max(count, DRAWN))
    if not len(drawn):
        drawn = np.zeros((1, dims), np.int64)
    centroids, simplex = drawn[:count], Simplex(drawn)
    projected = staged(with_apexes(kept, simplex, "embedding"), "apexes")
    for _ in range(rounds):
        centroids = moved(projected, "embedding", simplex, centroids)
    rows = staged(assigned(projected, "embedding", simplex, centroids, ["vec_id"]), "clusters")
    digests = [(i, sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = local_rows(
        kept.sparkSession, digests, kept.sparkSession.createDataFrame([], "cluster int, centroid_sha256 string").schema
    )
    sums = rows.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    # One row for each centroid.
    facts = staged(named.join(sums, "cluster"), "centroids")
    inertia = facts.agg(F.try_sum("cluster_inertia")).first()[0]
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id",
        "cluster",
        "distance",
        "cluster_inertia",
        F.lit(inertia).cast("long").alias("inertia"),
        "centroid_sha256",
    )
