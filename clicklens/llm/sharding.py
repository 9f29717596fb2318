"""Shards of near equal size by sampled splitters, in SQL functions.

The rows are ordered by their keys, with the place a row was read from behind them, so that one key with a third of
all rows can be cut anywhere. A size-weighted sample gives quantile boundaries that cut this order into many more
ranges than shards; a range that came out overfull is sampled again, by rows, more densely each time, and cut at its
own quantiles. Exact totals of the ranges, summed in order, and a running sum inside each range then give the place of
every row among all bytes, which decides its shard: the sample shapes the work of tasks, never the result.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicklens.sources.tables import staged

#: Ranges for each shard at least, rows of a range on average at most, and sampled keys for each range.
RANGES, RANGE_ROWS, DRAWS = 32, 4_000_000, 16

#: A range with the rows or bytes of more fair ranges than this is cut again.
OVERFULL = 2.5


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 8 for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; that of no bytes for null."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _chance(draw: int) -> Column:
    """A fixed number from 0 to 1 for each row and draw."""
    return F.shiftrightunsigned(F.xxhash64("_key", F.lit(draw)), 1).cast("double") / F.lit(2.0**63)


def _cuts(sample: DataFrame, pieces: Column) -> DataFrame:
    """The keys at the quantiles of each range's sample (_range, _key, _weight): its boundaries but the lowest."""
    ordered = W.partitionBy("_range").orderBy("_key")
    so_far = F.sum("_weight").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    whole = F.sum("_weight").over(W.partitionBy("_range"))
    placed = sample.withColumn("_piece", F.floor(F.coalesce(so_far, F.lit(0.0)) * pieces / whole))
    return placed.filter("_piece > 0").groupBy("_range", "_piece").agg(F.min("_key").alias("_key")).select("_key")


def _splitters(cuts: DataFrame) -> tuple[Column, int]:
    """All boundaries as one sorted array constant, and their number: a few for each range."""
    keys = F.array_sort(F.collect_set("_key"))
    text, count = cuts.agg(F.to_json(keys), F.size(keys)).first()
    return F.from_json(F.lit(text), T.ArrayType(cuts.schema["_key"].dataType)), count


def _range_of(splitters: Column, count: int) -> Column:
    """How many splitters are at most the row's key, by halving."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        below = F.get(splitters, middle) <= F.col("_key")
        open_ = s["low"] < s["high"]
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(s["low"]).alias("low"),
            F.when(open_ & ~below, middle).otherwise(s["high"]).alias("high"),
        )

    steps = F.array(*[F.lit(i) for i in range(ceil(log2(count + 1)))])
    if count == 0:
        return F.lit(0)
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(count).alias("high")), halve, lambda s: s["low"])


def _ranges(rows: DataFrame, n_rows: int, n_bytes: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (_key, _size, ...) with _range, numbered in the order of the keys, and the totals of the ranges."""
    drawn = rows.filter(_chance(0) * n_bytes < F.lit(DRAWS * ranges) * F.col("_size"))
    weight = F.greatest(F.col("_size").cast("double"), F.lit(n_bytes / (DRAWS * ranges)))
    first = drawn.select(F.lit(0).alias("_range"), "_key", weight.alias("_weight"))
    cuts, draw = staged(_cuts(first, F.lit(ranges)), "cuts"), 0
    while True:
        placed = rows.withColumn("_range", _range_of(*_splitters(cuts)))
        sums = [F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"), F.max("_size").alias("_most")]
        totals = staged(placed.groupBy("_range").agg(*sums), "ranges")
        # How many fair ranges a range holds, by rows or by bytes; one row alone cannot be divided.
        fair = F.greatest((F.col("_bytes") - F.col("_most")) * ranges / n_bytes, F.col("_rows") * ranges / n_rows)
        overfull = totals.filter((fair > OVERFULL) & (F.col("_rows") > 1)).select(
            "_range", "_rows", F.ceil(fair).alias("_pieces")
        )
        if overfull.isEmpty():
            return placed, totals
        # Twice as many draws each time: at last all rows of a range, whose quantiles divide it for certain.
        draw += 1
        wanted = F.lit(DRAWS << draw) * F.col("_pieces")
        again = placed.join(overfull, "_range").filter(_chance(draw) * F.col("_rows") < wanted)
        again = again.select("_range", "_key", "_pieces", F.lit(1.0).alias("_weight"))
        cuts = staged(cuts.unionByName(_cuts(again, F.col("_pieces"))), "cuts")


def sharded(rows: DataFrame, shards: int, keys: list[str], size: Column | None = None) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (the gapless place in the shard, a long).

    Shards follow the order of ``keys`` (columns of whole numbers, text or dates, nulls first). With ``size`` (a positive long)
    the sizes of shards are near equal: a shard's ends are off by half a row at most. Without it their counts are at
    most one apart. Rows of equal keys stand in the order they were read in; they are what a hot group may be cut
    at. Rows are staged once, with that place. An empty table gives no rows; columns named shard or slot are
    replaced, those that begin with an underscore must not be there, all others are kept.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    columns = [F.col(f"`{c}`") for c in kept]
    at = F.monotonically_increasing_id().alias("_at")
    fixed = staged(rows.select(*columns, (F.lit(1) if size is None else size).cast("long").alias("_size"), at), "rows")
    n_rows, n_bytes = fixed.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    keyed = fixed.withColumn("_key", F.struct(*[F.col(f"`{k}`") for k in keys], "_at"))
    ranges = max(RANGES * shards, ceil(n_rows / RANGE_ROWS))
    placed, totals = _ranges(keyed, max(n_rows, 1), max(n_bytes, 1), ranges)
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
    )
    inside = W.partitionBy("_range").orderBy("_key")
    here = F.coalesce(F.sum("_size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ordered = placed.withColumns({"_here": here, "_number": F.row_number().over(inside) - 1}).join(starts, "_range")
    # Twice the middle of the row among all bytes; decimals, as the product with the shards may pass a long.
    middle = (2 * (F.col("_bytes_before") + F.col("_here")) + F.col("_size")).cast("decimal(38,0)")
    shard = F.floor(middle * shards / F.lit(2 * max(n_bytes, 1)).cast("decimal(38,0)")).cast("int")
    numbered = ordered.select(
        *columns,
        F.least(shard, F.lit(shards - 1)).alias("shard"),
        (F.col("_rows_before") + F.col("_number")).alias("_number"),
    )
    firsts = numbered.groupBy(F.col("shard").alias("_shard")).agg(F.min("_number").alias("_first"))
    # One row for each shard.
    with_first = numbered.join(F.broadcast(firsts), F.col("shard") == F.col("_shard"))
    return with_first.select(*columns, "shard", (F.col("_number") - F.col("_first")).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int, keys: list[str], size: Column | None = None) -> None:
    """The rows as Parquet below ``path``, one folder for each shard, with their slots."""
    placed = sharded(rows, shards, keys, size)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of ``docs`` (doc_id, text, ...).

    Law ``bytes``: sizes near equal, in the order of doc_id (null first), then of the text's checksum and size;
    grown_shard is null. Null and empty texts have size 8; repeated rows each get a slot; other columns are not read.
    """
    rows = docs.select("doc_id", text_bytes(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"))
    placed = sharded(rows, shards, ["doc_id", "text_crc32", "size"], F.col("size"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
