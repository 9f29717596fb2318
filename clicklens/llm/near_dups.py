"""MinHash near-duplicates by tensored banding: small hash collections combine into many table keys.

With two collections of ``m`` keys of ``WIDTH`` minhashes each, every pair (A_i, B_j) is the key of one of
``m * m`` tables, so ``2 * m * WIDTH`` minhashes do the work of ``m * m * 2 * WIDTH``. Two sets of similarity
``t`` miss every table with a chance of at most ``2 * (1 - t ** WIDTH) ** m``; ``m`` follows from ``MISS``.

How it stays linear when one text or one group of near copies holds a third of all rows:

* equal sets collapse to one representative by aggregation before anything is compared;
* a collection key held by one representative cannot complete a table key, so it is dropped before the
  tensor product (exact, and the bulk of a corpus ends there);
* in a table bucket every member is compared with one hub only, the member whose keys are the most common,
  which in a group of edited copies is the text they were made from;
* after the components of those links, the members that a hub met but did not link are held against the rest of
  the hub's component and each other, so no link between different texts is lost and nobody compares within a
  joined group. Pairs of too different size, and pairs whose signatures agree on fewer of SIGNATURE minhashes
  than a linked pair does by more than SURE standard deviations, are turned away inside the join.

Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicklens.llm.components import connected_components
from clicklens.llm.textbytes import Words, mix, pieces, stream
from clicklens.sources.tables import staged

WIDTH = 4
MISS = 5e-5
SIGNATURE = 1024
SURE = 4.75
_BITS = 2
_LOW = 0x5555555555555555
_LONGS = [f"s{i}" for i in range(SIGNATURE * _BITS // 64)]


def collection_size(percent: int) -> int:
    """Keys of one collection, so that a pair at the threshold is missed with a chance of ``MISS``."""
    return math.ceil(math.log(MISS / 2) / math.log(1 - (percent / 100) ** WIDTH))


def _agreeing(percent: int) -> int:
    """Signature places on which a pair at the threshold agrees, less SURE standard deviations."""
    agree = percent / 100 + (1 - percent / 100) / 2**_BITS
    return math.floor(SIGNATURE * agree - SURE * math.sqrt(SIGNATURE * agree * (1 - agree)))


def _sketcher(words: int, m: int):
    places = max(SIGNATURE, 2 * m * WIDTH)
    factors, shifts = stream(21, places) | np.uint64(1), stream(22, places)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in pieces(batch.column("text")):
                found, ranges = Words(texts).shingles(words)
                sets = [np.unique(found[a:b]) for a, b in zip(ranges[:-1], ranges[1:])]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                keys = np.zeros((len(sets), 2 * m), dtype=np.uint64)
                bits = np.zeros((len(_LONGS), len(sets)), dtype=np.uint64)
                if len(full):
                    flat, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
                    keys[full] = np.arange(1, 2 * m + 1, dtype=np.uint64)
                    for i in range(places):
                        with np.errstate(over="ignore"):
                            least = mix(np.minimum.reduceat(flat * factors[i] + shifts[i], starts))
                        if i < 2 * m * WIDTH:
                            keys[full, i // WIDTH] = mix(keys[full, i // WIDTH] ^ least)
                        if i < SIGNATURE:
                            place = np.uint64(i * _BITS % 64)
                            bits[i * _BITS // 64, full] |= (least & np.uint64(2**_BITS - 1)) << place
                hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), 2 * m)
                columns = [batch.column("doc_id").slice(row, len(texts)), pa.array(sizes), pa.array(hashes, pa.binary())]
                columns += [lists.cast(pa.list_(pa.int64())), *[pa.array(b.view(np.int64)) for b in bits]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_hash", "keys", *_LONGS])

    return sketch


def sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, keys, signature) for each row of (doc_id, text)."""
    schema = "doc_id long, n_shingles long, set_hash binary, keys array<long>, " + ", ".join(f"{c} long" for c in _LONGS)
    return docs.select("doc_id", "text").mapInArrow(_sketcher(words, collection_size(percent)), schema)


def _confirmer(words: int, percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for row, left in pieces(batch.column("text_a")):
                right = batch.column("text_b").slice(row, len(left))
                x, xr = Words(left).shingles(words)
                y, yr = Words(right).shingles(words)
                for i in range(len(left)):
                    a, b = np.unique(x[xr[i] : xr[i + 1]]), np.unique(y[yr[i] : yr[i + 1]])
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    good[row + i] = both > 0 and 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return confirm


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full texts reach the similarity; texts meet them in two plain joins."""
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    both = (
        pairs.join(texts, F.col("a") == F.col("_id"))
        .select("a", "b", F.col("text").alias("text_a"))
        .join(texts, F.col("b") == F.col("_id"))
        .select("a", "b", "text_a", F.col("text").alias("text_b"))
    )
    return both.mapInArrow(_confirmer(words, percent), "a long, b long")


def _similar_size(n: Column, other: Column, percent: int) -> Column:
    return 100 * F.least(n, other) >= percent * F.greatest(n, other)


def _buckets(reps: DataFrame, m: int) -> DataFrame:
    """(key, id, n, rank) of every table a representative is in, without those that nobody shares."""
    keys = staged(reps.select("id", "n", F.posexplode("keys").alias("c", "k")), "near-keys")
    shared = keys.groupBy("c", "k").agg(F.count("*").alias("holders")).filter("holders > 1")
    own = (
        keys.join(shared, ["c", "k"])
        .groupBy("id", "n")
        .agg(F.collect_list(F.struct("c", "k")).alias("keys"), F.sum("holders").alias("common"))
    )
    left, right = F.filter("keys", lambda x: x.c < m), F.filter("keys", lambda x: x.c >= m)
    tensor = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.xxhash64(x.c, x.k, y.c, y.k))))
    rank = F.shiftleft("common", 20) + F.xxhash64("id").bitwiseAND(0xFFFFF)
    return own.select("id", "n", rank.alias("rank"), F.explode(tensor).alias("key"))


def links(docs: DataFrame, sketched: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Components (id, component) of the confirmed links between representatives, and (set_hash, id) of those."""
    some = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = staged(some.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "near-sets")
    reps = some.join(first.select("set_hash", "id"), "set_hash").filter("doc_id = id")
    reps = reps.select("id", F.col("n_shingles").alias("n"), "keys", *_LONGS)
    rows = staged(_buckets(reps, collection_size(percent)), "near-buckets")
    hubs = (
        rows.groupBy("key")
        .agg(
            F.count("*").alias("size"),
            F.max_by("id", "rank").alias("hub"),
            F.max_by("n", "rank").alias("hub_n"),
        )
        .filter("size > 1")
        .select("key", "hub", "hub_n")
    )
    met = rows.join(hubs, "key").filter(F.col("id") != F.col("hub"))
    star = (
        met.filter(_similar_size(F.col("n"), F.col("hub_n"), percent))
        .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        .distinct()
    )
    star = staged(star, "near-pairs")
    found = staged(confirmed(star, docs, words, percent), "near-links")
    groups = connected_components(found)

    # What the hubs left open: what one met outside its component, against that component and each other.
    def grouped(frame: DataFrame, column: str, name: str) -> DataFrame:
        of = groups.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
        return frame.join(of, F.col(column) == F.col("_id"), "left").select(
            *frame.columns, F.coalesce("_component", column).alias(name)
        )

    meetings = met.select("hub", "id").distinct()
    placed = staged(grouped(grouped(meetings, "hub", "main"), "id", "component"), "near-placed")
    open_rows = placed.filter("component <> main").select("main", "id", "component").distinct()
    others = (
        placed.select("main", F.explode(F.array(F.struct("id", "component"), F.struct(F.col("hub").alias("id"), F.col("main").alias("component")))).alias("m"))
        .select("main", "m.*")
        .distinct()
        .join(open_rows.select("main").distinct(), "main", "left_semi")
    )
    marks = reps.select("id", "n", *_LONGS)
    left = open_rows.join(marks, "id")
    right = others.join(marks, "id").select("main", *[F.col(c).alias(f"{c}_2") for c in ("id", "component", *marks.columns[1:])])
    agree = SIGNATURE - sum(
        (F.bit_count((x := F.col(c).bitwiseXOR(F.col(f"{c}_2"))).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(_LOW)) for c in _LONGS),
        F.lit(0),
    )
    rest = (
        left.join(right, "main")
        .filter("component <> component_2 AND (component_2 = main OR id < id_2)")
        .filter(_similar_size(F.col("n"), F.col("n_2"), percent))
        .filter(agree >= _agreeing(percent))
        .select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b"))
        .distinct()
        .join(star, ["a", "b"], "left_anti")
    )
    rest = staged(rest, "near-pairs")
    if not rest.isEmpty():
        more = staged(confirmed(rest, docs, words, percent), "near-links")
        if not more.isEmpty():
            groups = connected_components(found.unionByName(more))
    return groups, first


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Two texts are linked when ``100 * |A & B| >= percent * |A | B|`` for their sets of ``words``-word shingles
    (a shorter text: its whole sequence). component_id is the smallest doc_id reachable and kept says that it
    is the row's own. Null, empty and blank texts have no shingles and stand alone, as do rows without a
    doc_id (component_id null, kept). Rows that repeat a doc_id count as one document with all their texts
    and each get a row. Other columns are not read. An empty table gives no rows.
    """
    sketched = staged(sketches(docs, words, percent), "near-sketches")
    groups, first = links(docs, sketched, words, percent)
    copies = first.filter("copies > 1").select("set_hash", F.col("id").alias("_first"))
    of = groups.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    return (
        sketched.select("doc_id", "n_shingles", "set_hash")
        .withColumn("set_hash", F.when(F.col("n_shingles") > 0, F.col("set_hash")))
        .join(copies, "set_hash", "left")
        .withColumn("_rep", F.coalesce("_first", "doc_id"))
        .join(of, F.col("_rep") == F.col("_id"), "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("_component", "_rep").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("_component", "_rep"), F.lit(True)).alias("kept"),
        )
    )
