"""Where a stream begins when its checkpoint is fresh."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clicklens.session import exists
from clicklens.sources.keyed import Commits

EARLIEST, LATEST = "earliest", "latest"


def begin_at(text: DataFrame, checkpoint: str, starting: str) -> None:
    """Prepare a checkpoint so that a stream on ``text`` begins with what is there (``earliest``) or after it.

    ``latest`` lets the source note the backlog in the checkpoint, in batches whose rows nobody reads: no line of the
    backlog is parsed or even scanned. The choice counts only for a fresh checkpoint and is kept in it, so a restart goes
    on where it stopped, whatever it asks for. A skip that was cut short is made again before the first batch.
    """
    if starting not in (EARLIEST, LATEST):
        raise ValueError("starting must be earliest or latest")
    spark = text.sparkSession
    choice = Commits(spark, f"{checkpoint}/begin")
    known = dict(choice.all())
    if not known:
        if starting == EARLIEST or exists(spark, f"{checkpoint}/offsets"):
            return
        choice.put(0, {"starting": starting})
    if 1 not in known:
        noted = text.select("value").writeStream.option("checkpointLocation", checkpoint)
        noted.foreachBatch(lambda rows, number: None).trigger(availableNow=True).start().awaitTermination()
        choice.put(1, {"starting": starting})
