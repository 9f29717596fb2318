import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from clicklens.operators import admission as A
from clicklens.operators.model import seed_model
from clicklens.schemas import EVENT

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def make_events(seed, keys=6, n=1500, copies=True):
    """Random events; the first key holds a third of them, and some events repeat."""
    rng = random.Random(seed)
    events = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(keys)}"
        kind = "click" if rng.random() < 0.55 else "impression"
        at = T0 + timedelta(seconds=rng.randrange(3600))
        event = (f"e{i:05d}", kind, key, "d", "c", at, None)
        events.append(event)
        if copies and rng.random() < 0.03:
            events += [event] * rng.randrange(1, 4)
    # A flood of copies of one event.
    events += [("flood", "click", "hot", "d", "c", T0 + timedelta(seconds=1800), None)] * (n // 3)
    return events


def sequential(events, start):
    """One event at a time, as a keyed process would."""
    counts = dict(start)
    rejected = {}
    order = sorted(events, key=lambda e: (e[5], e[0], e[1] != "impression"))
    for e in order:
        impressions, clicks = counts.get(e[2], (0, 0))
        if e[1] == "impression":
            counts[e[2]] = (impressions + 1, clicks)
        elif clicks + 1 > impressions:
            rejected[e[0]] = rejected.get(e[0], 0) + 1
        else:
            counts[e[2]] = (impressions, clicks + 1)
    return counts, rejected


@pytest.mark.parametrize("slot_seconds", [7, 600, 100_000])
def test_equals_sequential_processing(spark, slot_seconds):
    events = make_events(slot_seconds)
    start = {"hot": (40, 10), "k1": (3, 3)}
    stored = spark.createDataFrame(
        [(k, "d", "c", i, c) for k, (i, c) in start.items()],
        "ad_category string, publisher_domain string, conversation_category string, impressions bigint, clicks bigint",
    )
    frame = spark.createDataFrame(events, EVENT)
    done = A.admit_clicks(frame, stored, slot_seconds)
    counts, rejected = sequential(events, start)

    runs = done.runs.persist()
    got = {r["event_id"]: r["rejected"] for r in runs.collect() if r["rejected"]}
    assert got == rejected
    totals = {r["ad_category"]: (r["impressions"], r["clicks"]) for r in done.totals.collect()}
    assert totals == {k: v for k, v in counts.items()}
    again = {r["ad_category"]: (r["impressions"], r["clicks"]) for r in A.totals_of(runs, stored).collect()}
    assert again == totals
    last = {}
    for r in runs.orderBy("occurred_at", "event_id").collect():
        last[r["ad_category"]] = (r["impressions_after"], r["clicks_after"])
    assert last == totals
    runs.unpersist()


def test_hot_bucket_is_split(spark):
    frame = spark.createDataFrame(make_events(1), EVENT)
    plan = A.admit_clicks(frame).runs._jdf.queryExecution().executedPlan().toString()
    rows = [line for line in plan.splitlines() if "Window [" in line and "occurred_at" in line]
    assert rows and all("slot" in line for line in rows)


def test_only_rejected_clicks_create_nothing(spark):
    frame = spark.createDataFrame([("e", "click", "a", "d", "c", T0, None)], EVENT)
    done = A.admit_clicks(frame)
    assert done.totals.count() == 0
    letters = A.rejected_clicks(done).collect()
    assert [(r["reason"], r["copies"]) for r in letters] == [("clicks_would_exceed_impressions", 1)]


def test_impression_then_click(spark):
    rows = [("a", "impression", "x", "d", "c", T0, None), ("b", "click", "x", "d", "c", T0, "a")]
    done = A.admit_clicks(spark.createDataFrame(rows, EVENT))
    bucket = A.new_buckets(done, None, seed_model(spark)).collect()[0]
    assert (bucket["impressions"], bucket["clicks"]) == (1, 1)
    assert bucket["alpha_prior"] + bucket["beta_prior"] == pytest.approx(100.0)


def test_priors_of_stored_buckets_are_kept(spark):
    model = seed_model(spark)
    first = A.admit_clicks(spark.createDataFrame([("a", "impression", "finance", "d", "c", T0, None)], EVENT))
    stored = A.new_buckets(first, None, model).withColumn("alpha_prior", A.F.lit(7.0))
    second = A.admit_clicks(spark.createDataFrame([("b", "impression", "finance", "d", "c", T0, None)], EVENT), stored)
    row = A.new_buckets(second, stored, model).collect()[0]
    assert (row["impressions"], row["alpha_prior"]) == (2, 7.0)


def test_copies_expand_in_bounded_steps(spark):
    letters = spark.createDataFrame([("r", "{}", 25), ("s", "{}", 1)], "reason string, event string, copies bigint")
    rows = A.expand_copies(letters, block=10).groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in rows} == {"r": 25, "s": 1}


def test_flush_accounting(spark):
    rows = [(f"e{i}", "impression", "x", "d", "c", T0 + timedelta(milliseconds=10 * i), None) for i in range(120)]
    done = A.admit_clicks(spark.createDataFrame(rows, EVENT))
    # Windows of 500 ms hold 50, 50 and 20 updates; 30 updates force a write.
    row = A.flush_accounting(done, 500, 30).collect()[0]
    assert (row["flushes"], row["updates_flushed"], row["updates_coalesced"]) == (5, 120, 115)


def test_one_bucket_at_one_time_is_cut_into_pieces(spark):
    rng = random.Random(12)
    at = T0 + timedelta(seconds=5)
    events = [
        (f"h{i:05d}", rng.choice(["click", "click", "impression"]), "hot", "d", "c", at, rng.choice([None, "x"]))
        for i in rng.sample(range(50_000), 3000)
    ]
    events += make_events(3, n=400)
    _, rejected = sequential(events, {})
    done = A.admit_clicks(spark.createDataFrame(events, EVENT), piece_rows=64)
    runs = done.runs.collect()
    assert {r["event_id"]: r["rejected"] for r in runs if r["rejected"]} == rejected
    sizes = {}
    for r in runs:
        sizes[r["piece"]] = sizes.get(r["piece"], 0) + (r["occurred_at"] == at.replace(tzinfo=None))
    assert len([n for n in sizes.values() if n]) > 10 and max(sizes.values()) < 1000


def test_a_burst_of_one_bucket_is_more_than_one_task(spark):
    keys = {"ad_category": "a", "publisher_domain": "d", "conversation_category": "c"}
    burst = spark.range(200_000).select(
        F.concat(F.lit("e"), "id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, "impression").otherwise("click").alias("event_type"),
        *[F.lit(v).alias(k) for k, v in keys.items()],
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 50).alias("occurred_at"),
        F.lit(None).cast("string").alias("impression_event_id"),
    )
    runs = A.admit_clicks(burst, distinct_events=True).runs
    sizes = [r["count"] for r in runs.groupBy("slot", "piece").count().collect()]
    assert sum(sizes) == 200_000 and len(sizes) > 1 and max(sizes) < 160_000
    # Every third event shows, each shows allows one of the two clicks after it.
    assert runs.agg(F.sum("rejected")).first()[0] == 200_000 - 2 * len(range(0, 200_000, 3))


def test_quiet_slots_are_settled_by_counts(spark):
    draw, rows = random.Random(5), []
    for bucket in range(6):
        for i in range(400):
            # Impressions are many in some buckets, and a few slots begin with clicks.
            kind = "impression" if draw.random() < 0.35 + 0.1 * bucket else "click"
            at = T0 + timedelta(seconds=draw.randrange(1_200))
            rows.append((f"e{i % 390}", kind, "finance", f"d{bucket}", "c", at, None))
    events = spark.createDataFrame(rows, EVENT)
    stored = spark.createDataFrame(
        [("finance", "d1", "c", 9, 2)], "ad_category string, publisher_domain string, conversation_category string, impressions long, clicks long"
    )
    for start in (None, stored):
        whole = A.admit_clicks(events, start)
        slots = A.screened_slots(events, start).cache()
        quiet, busy = slots.filter("quiet"), slots.filter("NOT quiet")
        assert quiet.count() > 20 and busy.count() > 5
        part = A.admit_clicks(A.in_slots(events, busy), start, quiet=quiet)
        key = lambda frame: sorted(map(str, frame.collect()))
        letters, seen = key(A.rejected_clicks(whole)), part.runs.agg(F.sum("copies")).first()[0]
        assert letters and key(A.rejected_clicks(part)) == letters
        assert key(part.totals) == key(whole.totals) == key(A.totals_of(part.runs, start, quiet).select(*whole.totals.columns))
        assert seen < len(rows)
        # Every row that is ordered has the counts that it has when all of them are.
        shared = [c for c in whole.runs.columns if c != "piece"]
        assert part.runs.select(*shared).exceptAll(whole.runs.select(*shared)).count() == 0
