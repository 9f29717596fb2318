"""Counts over events. All are partial aggregations, so a hot key is combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicklens import constants as K

def is_impression() -> Column:
    return F.col("event_type") == K.IMPRESSION


def is_click() -> Column:
    return F.col("event_type") == K.CLICK


def event_counts(events: DataFrame) -> DataFrame:
    """Totals of a batch of events."""
    return events.agg(
        F.count_if(is_impression()).alias("impressions"),
        F.count_if(is_click()).alias("clicks"),
        F.count("*").alias("total_events"),
    )


def triplet_counts(events: DataFrame) -> DataFrame:
    """Cumulative impressions and clicks per triplet; nothing is rejected here."""
    return events.groupBy(*K.BUCKET_KEYS).agg(
        F.count_if(is_impression()).alias("impressions"),
        F.count_if(is_click()).alias("clicks"),
    )


def route_events(events: DataFrame, also_unified: bool = False) -> DataFrame:
    """Topic, key and JSON value per message; optionally every event also to the unified topic."""
    from clicklens.functions.payload import bucket_key, event_json

    own = F.when(is_impression(), K.IMPRESSION_TOPIC).otherwise(K.CLICK_TOPIC)
    keyed = events.select(own.alias("topic"), bucket_key().alias("key"), event_json().alias("value"))
    if not also_unified:
        return keyed
    return keyed.select(
        F.explode(F.array("topic", F.lit(K.EVENT_TOPIC))).alias("topic"), "key", "value"
    )


def union_topics(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Both topics as one unkeyed set of events."""
    return impressions.unionByName(clicks)
