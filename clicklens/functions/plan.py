"""Plan shaping helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def evaluated_once(rows: DataFrame) -> DataFrame:
    """The same rows, with every column computed exactly once per row.

    A filter on a computed column is normally pushed below the projection by repeating the
    column's expression, which for parsed text means parsing it again for every use. A generator
    over a single struct stops that; it adds no shuffle and stays inside code generation.
    """
    return rows.select(F.inline(F.array(F.struct("*"))))


def local_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few driver-side rows as a local relation.

    Goes through Arrow, so no Python worker starts, and its exact size is known to the optimizer.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    names = schema.fieldNames()
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def count_at_most(values: Column, key: Column) -> Column:
    """How many values of a sorted array are at most ``key``, by halving."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        open_, below = state["low"] < state["high"], F.get(values, middle) <= key
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(open_ & ~below, middle).otherwise(state["high"]).alias("high"),
        )

    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(31)]), lambda d: d <= F.size(values))
    first = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))
    return F.aggregate(steps, first, halve, lambda state: state["low"])
