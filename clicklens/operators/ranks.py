"""Positions of values in a total order without a single-task window.

``positions`` gives each distinct value its number of rows and the number of rows before it. Equal
values combine first and are stored once; the distinct values are dealt out by range, so no task ever sorts a
whole column, and only the piece totals are scanned in order. Ranks, exact quantiles and medians all follow from the positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklens.sources.tables import staged


def positions(values: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, value, rows, before)`` per distinct value of any number of groups.

    The distinct values are dealt out by range of (group, value) and stored with their piece. Pieces
    follow the session's partitions and so the cluster; only their totals, a row for each group and
    piece, are scanned in order.
    """
    distinct = (
        values.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
        .groupBy(group, value)
        .agg(F.count("*").alias("rows"))
    )
    placed = staged(
        distinct.repartitionByRange(group, value).withColumn("_piece", F.spark_partition_id()),
        "distinct-values",
    )
    pieces = W.partitionBy(group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy(group, "_piece").agg(F.sum("rows").alias("_rows"))
    starts = totals.select(
        group, "_piece", F.coalesce(F.sum("_rows").over(pieces), F.lit(0).cast("bigint")).alias("_start")
    )
    inside = W.partitionBy(group, "_piece").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return placed.join(starts, [group, "_piece"]).select(
        group,
        value,
        "rows",
        (F.col("_start") + F.coalesce(F.sum("rows").over(inside), F.lit(0).cast("bigint"))).alias(
            "before"
        ),
    )


def average_ranks(values: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, value, rank)`` where ties share the mean of their positions (from 1)."""
    placed = positions(values, group, value)
    return placed.select(
        group, value, (F.col("before") + (F.col("rows") + 1) / F.lit(2.0)).alias("rank")
    )


def quantiles(values: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per group with an array."""
    placed = positions(values, group, value)
    # The size of a group is where its last position ends.
    sizes = placed.groupBy(group).agg(F.max(F.col("before") + F.col("rows")).alias("_size"))
    placed, size = placed.join(sizes, group), F.col("_size")
    picks, edges = [], []
    for i, share in enumerate(shares):
        at = (size - 1) * F.lit(float(share))
        for side, position in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("before") <= position) & (position < F.col("before") + F.col("rows"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}{i}"))
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        edges.append(low + (high - low) * (at - F.floor(at)))
    return placed.groupBy(group, "_size").agg(*picks).select(group, F.array(*edges).alias("edges"))


def rank_correlation(pairs: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """Spearman correlation per group: Pearson over average ranks of both columns."""
    # Stored, so that their true size decides whether they are broadcast.
    left_rank = staged(average_ranks(pairs, group, left).withColumnRenamed("rank", "_l"), "ranks")
    right_rank = staged(average_ranks(pairs, group, right).withColumnRenamed("rank", "_r"), "ranks")
    # Equal pairs combine first, so a hot pair joins as one weighted row. A value that is hot in
    # one column only meets a single rank row, which adaptive execution may split freely.
    weighted = pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(
        group, left, right
    ).agg(F.count("*").alias("_w"))
    ranked = weighted.join(left_rank, [group, left]).join(right_rank, [group, right])
    w, x, y = F.col("_w"), F.col("_l"), F.col("_r")
    sums = ranked.groupBy(group).agg(
        F.sum(w).cast("double").alias("n"),
        F.sum(w * x).alias("sx"),
        F.sum(w * y).alias("sy"),
        F.sum(w * x * y).alias("sxy"),
        F.sum(w * x * x).alias("sxx"),
        F.sum(w * y * y).alias("syy"),
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return sums.select(
        group, F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("spearman_rank")
    )
