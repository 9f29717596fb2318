"""The given tables as click-through evidence and as an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clicklens import constants as K
from clicklens.functions.payload import event_json
from clicklens.session import shared_folder
from clicklens.sources.events import text_event_stream
from clicklens.sources.tables import staged


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def star_opportunities(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item: the three keys, whether it was clicked, and the ship date.

    The two big tables meet once on the order key. Each first takes its own attribute, so the
    rows shuffled for that join hold only the keys in use. No side is forced to broadcast.
    """
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate")
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    ordered = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_mktsegment", "o_orderpriority"
    )
    shown = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "p_type", "l_returnflag", "l_shipdate"
    )
    return shown.join(ordered, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("p_type").alias("ad_category"),
        F.col("c_mktsegment").alias("publisher_domain"),
        F.col("o_orderpriority").alias("conversation_category"),
        (F.col("l_returnflag") == "R").alias("clicked"),
        F.col("l_shipdate").alias("shown_at"),
    )


def star_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Impressions and clicks per triplet of the star tables."""
    return (
        star_opportunities(spark, folder)
        .groupBy(*K.BUCKET_KEYS)
        .agg(F.count("*").alias("impressions"), F.count_if("clicked").alias("clicks"))
    )


def _pick(family: str, index: Column) -> Column:
    """Seed value of a family by position."""
    values = F.array(*[F.lit(v) for v, _ in K.SEED_WEIGHTS[family]])
    return F.element_at(values, (index + 1).cast("int"))


def as_event_log(events: DataFrame) -> DataFrame:
    """Rows of the ``events`` table in event form; unknown types stay as they are."""
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_type") == "view", K.IMPRESSION)
        .otherwise(F.col("event_type"))
        .alias("event_type"),
        _pick("ad", F.col("user_id") % 5).alias("ad_category"),
        _pick("domain", F.floor(F.col("user_id") / 5) % 4).alias("publisher_domain"),
        _pick("context", F.get_json_object("props", "$.k").cast("bigint") % 5).alias(
            "conversation_category"
        ),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.lit(None).cast("string").alias("impression_event_id"),
    )


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every event, valid or not, as typed columns."""
    return as_event_log(table(spark, folder, "events"))


def valid_event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Impressions and clicks only; the type filter reaches the scan."""
    events = table(spark, folder, "events").filter(F.col("event_type").isin("view", "click"))
    return as_event_log(events)


def event_text(log: DataFrame) -> DataFrame:
    """Events as the JSON text a topic carries."""
    return log.select(event_json().alias("value"))


def write_topic(spark: SparkSession, log: DataFrame, out: str, batches: int = 4) -> int:
    """Events as text files below ``out``, a batch after the other by time; returns the files of a batch.

    A reader that takes as many files per trigger as a batch has gets the events in order of time.
    """
    rows = staged(log, "event-log")
    at = F.unix_micros("occurred_at")
    shares = [i / batches for i in range(1, batches)]
    cuts = rows.agg(F.percentile_approx(at, shares)).first()[0] or []
    place = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= at)), F.lit(0))
    files = spark.sparkContext.defaultParallelism
    # Dealt by the hash of the whole event: without a key Spark would first sort the rows to deal them repeatably.
    deal = F.xxhash64(*rows.columns)
    for i in range(len(set(cuts)) + 1):
        event_text(rows.filter(place == i).repartition(files, deal)).write.mode("append").text(out)
    return files


def event_text_stream(spark: SparkSession, log: DataFrame, batches: int = 4) -> DataFrame:
    """Events as a file stream of text that arrives in ``batches`` micro-batches."""
    out = shared_folder(spark, "topic")
    files = write_topic(spark, log, out, batches)
    return text_event_stream(spark, out, files)


def star_event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as events: an impression each, and a click for returned ones.

    The attributes come from the other tables. A click follows its impression by a second.
    """
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    ordered = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    number = F.concat_ws("-", "l_orderkey", "l_linenumber")
    shown_at = F.col("l_shipdate").cast("timestamp")

    def event(prefix: str, kind: str, at: Column, cause: Column) -> Column:
        return F.struct(
            F.concat(F.lit(prefix), number).alias("event_id"),
            F.lit(kind).alias("event_type"),
            at.alias("occurred_at"),
            cause.alias("impression_event_id"),
        )

    shown = event("i-", K.IMPRESSION, shown_at, F.lit(None).cast("string"))
    clicked = event("c-", K.CLICK, shown_at + F.expr("INTERVAL 1 SECOND"), F.concat(F.lit("i-"), number))
    both = F.when(F.col("l_returnflag") == "R", F.array(shown, clicked)).otherwise(F.array(shown))
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        ordered, F.col("l_orderkey") == F.col("o_orderkey")
    )
    events = joined.select(
        F.col("p_type").alias("ad_category"),
        F.col("c_mktsegment").alias("publisher_domain"),
        F.col("o_orderpriority").alias("conversation_category"),
        F.explode(both).alias("_e"),
    )
    return events.select(*K.BUCKET_KEYS, "_e.*")
