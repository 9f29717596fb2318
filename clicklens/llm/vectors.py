"""Vectors as whole numbers: which rows are kept, and their components in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are rounded down to this fraction; beyond the limit they count as the limit, so squares fit a long.
SCALE, LIMIT = 256, 1 << 27


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and no component is null, NaN or infinite."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))

    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def whole(vector: Column) -> Column:
    """floor(256 * x) of each component as int."""

    def component(x: Column) -> Column:
        scaled = F.least(F.greatest(x.cast("double") * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))
        return F.floor(scaled).cast("int")

    return F.transform(vector, component)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def floor_means(sums: DataFrame) -> DataFrame:
    """Partial (group, place, total, members) combined to (group, place, mean), rounded down."""
    combined = sums.groupBy("group", "place").agg(F.sum("total").alias("total"), F.sum("members").alias("members"))
    mean = F.expr("CAST((total - pmod(total, members)) div members AS bigint)")
    return combined.select("group", "place", mean.alias("mean"))


MEANS = "group int, place int, total long, members long"


def group_sums(totals: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
    """Sums of a task (groups x places) and member counts as rows for ``floor_means``; empty groups give none."""
    groups = np.flatnonzero(members)
    width = totals.shape[1]
    return pa.record_batch(
        {
            "group": pa.array(np.repeat(groups, width).astype(np.int32)),
            "place": pa.array(np.tile(np.arange(width, dtype=np.int32), len(groups))),
            "total": pa.array(totals[groups].ravel()),
            "members": pa.array(np.repeat(members[groups], width)),
        }
    )


def with_means(entries: np.ndarray, sums: DataFrame) -> np.ndarray:
    """``entries`` (groups x places) with the means of their members; groups without members stay."""
    found = floor_means(sums).toArrow()
    result = entries.copy()
    places = [found[c].to_numpy() for c in ("group", "place")]
    result[places[0], places[1]] = found["mean"].to_numpy()
    return result
