"""Connected components of an edge table, with nothing but small counts on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicklens.sources.tables import staged


def _mapped(rows: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by where it is hooked to."""
    to = hooks.select(F.col("node").alias("_node"), F.col("to").alias("_to"))
    return (
        rows.join(to, F.col(column) == F.col("_node"), "left")
        .withColumn(column, F.coalesce("_to", column))
        .drop("_node", "_to")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b); component is the smallest id reachable.

    Each round hooks every node to its smallest smaller neighbour, follows the hooks two steps further and
    contracts the edges, so their number falls by a factor and a star of any size is one aggregation. Every
    round is written to the shared folder: the plan stays short and a lost executor costs one round. Loops
    and repeated edges are allowed; no edges give no rows.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    live = staged(ends.distinct(), "component-edges")
    labels = live.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("component", F.col("id"))
    labels = staged(labels, "component-labels")
    while not live.isEmpty():
        hooks = live.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to"))
        for _ in range(2):
            hooks = staged(_mapped(hooks, "to", hooks), "component-hooks")
        labels = staged(_mapped(labels, "component", hooks), "component-labels")
        ends = _mapped(_mapped(live, "u", hooks), "v", hooks)
        live = staged(
            ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(),
            "component-edges",
        )
    return labels
