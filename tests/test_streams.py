import os
import shutil
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from clicklens.operators import admission as A
from clicklens.operators.learning import Learning
from clicklens.operators.model import seed_model
from clicklens.schemas import BUCKET
from clicklens.session import shared_folder
from clicklens.sources import adapters as X
from clicklens.sources.events import parse_events, text_event_stream, valid_events
from clicklens.sources.tables import AppendTable, ModelStore, SnapshotTable
from clicklens.streaming.evidence import EvidenceStream, Recalibrator
from clicklens.streaming.realtime import PER_EVENT, TIMED, RealtimeCtr

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The event log as text files in time order; one file per micro-batch."""
    out = tmp_path_factory.mktemp("topic")
    rows = X.event_log(spark, FOLDER).orderBy("occurred_at", "event_id")
    texts = [r["value"] for r in X.event_text(rows).collect()]
    step = len(texts) // 4 + 1
    for i in range(4):
        path = out / f"part-{i}.txt"
        path.write_text("\n".join(texts[i * step : (i + 1) * step]) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(out)


def batch_result(spark):
    done = A.admit_clicks(X.valid_event_log(spark, FOLDER))
    return done, A.new_buckets(done, None, seed_model(spark))


def run(spark, files, folder=None, **options):
    job = RealtimeCtr(spark, folder or shared_folder(spark, "rt"), seed_model(spark), **options)
    job.start(text_event_stream(spark, files, 1)).awaitTermination()
    return job


def same(a, b):
    a, b = a.select(*b.columns), b
    rounded = [F.round(c, 10).alias(c) if t == "double" else F.col(c) for c, t in b.dtypes]
    a, b = a.select(*rounded), b.select(*rounded)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_equals_batch_and_survives_repeats(spark, files):
    done, expected = batch_result(spark)
    job = run(spark, files)
    assert job.state.versions() == [0, 1, 2, 3]
    assert same(job.buckets(), expected)
    rejected = job.dead_letters().filter(F.col("reason") == "clicks_would_exceed_impressions")
    assert same(rejected, A.rejected_clicks(done))
    progress = job.progress().orderBy("seq").collect()
    log = X.event_log(spark, FOLDER)
    assert progress[-1]["processed_events"] == log.count() and len(progress) == 4
    assert progress[-1]["valid_events"] == done.totals.agg(F.sum("accepted")).collect()[0][0]
    assert progress[-1]["dead_letters"] == log.count() - progress[-1]["valid_events"]
    assert all(r["clicks"] <= r["impressions"] for r in job.buckets().collect())

    # Repeating the last batch, as after a lost commit, changes nothing.
    letters = job.dead_letters().count()
    last = spark.read.text(os.path.join(files, "part-3.txt"))
    job.process(last, 3)
    assert same(job.buckets(), expected) and job.dead_letters().count() == letters


def test_continues_from_stored_buckets(spark, files):
    cut = X.event_log(spark, FOLDER).agg(F.expr("percentile_approx(occurred_at, 0.5)")).collect()[0][0]
    log = X.valid_event_log(spark, FOLDER)
    first = A.admit_clicks(log.filter(F.col("occurred_at") < F.lit(cut)))
    stored = A.new_buckets(first, None, seed_model(spark))
    folder = shared_folder(spark, "resume")
    job = RealtimeCtr(spark, folder, seed_model(spark), initial=stored)
    job.process(X.event_text(log.filter(F.col("occurred_at") >= F.lit(cut))), 0)
    assert same(job.buckets(), batch_result(spark)[1])


def test_a_write_per_event(spark, files):
    done, expected = batch_result(spark)
    job = run(spark, files, flush_mode=PER_EVENT)
    writes = job.writes()
    assert writes.count() == done.totals.agg(F.sum("accepted")).collect()[0][0]
    assert writes.filter("clicks > impressions").count() == 0
    assert same(job.buckets(), expected)


def test_evidence_and_clock(spark, files):
    job = EvidenceStream(spark, shared_folder(spark, "ev"))
    models = ModelStore(spark, shared_folder(spark, "models"))
    models.append(seed_model(spark))
    config = Learning(baseline_max_ci_width=1.0, max_feature_ci_width=1.0, min_feature_impressions=1)
    clock = Recalibrator(job, models, config)
    assert clock.tick() is None
    job.start(text_event_stream(spark, files, 1)).awaitTermination()
    counts, invalid = job.counts()
    log = X.valid_event_log(spark, FOLDER)
    assert counts.agg(F.sum("impressions") + F.sum("clicks")).collect()[0][0] == log.count()
    assert invalid.collect()[0][0] == X.event_log(spark, FOLDER).count() - log.count()

    at = datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    first = clock.tick(at)
    assert first["accepted"] and first["snapshot_name"] == "streaming_weights_20260102_030405"
    second = clock.tick()
    assert second["snapshot_id"] == first["snapshot_id"] + 1
    assert second["old_w0"] == first["new_w0"]
    dry = Recalibrator(job, models, Learning(baseline_max_ci_width=1.0, dry_run=True)).tick()
    assert dry["accepted"] and not dry["write_applied"]
    assert models.heads.count().collect()[0]["rows"] == 3


def armed_clock(spark, files, **options):
    job = EvidenceStream(spark, shared_folder(spark, "ev"))
    models = ModelStore(spark, shared_folder(spark, "models"))
    models.append(seed_model(spark))
    config = dict(baseline_max_ci_width=1.0, max_feature_ci_width=1.0, min_feature_impressions=1) | options
    return job, models, Recalibrator(job, models, Learning(**config))


def test_clock_is_armed_by_the_first_valid_event(spark, files):
    job, models, clock = armed_clock(spark, files)
    assert clock.poll(10.0, 1e12) is None
    job.process(spark.createDataFrame([("not an event",)], "value string"), "run", 0)
    assert job.armed_at() is None and clock.poll(10.0, 1e12) is None
    text = spark.read.text(os.path.join(files, "part-0.txt"))
    job.process(text, "run", 1)
    armed = job.armed_at()
    job.process(text, "run", 1)  # a repeat counts once and does not arm again
    job.process(spark.read.text(os.path.join(files, "part-1.txt")), "run", 2)
    assert job.armed_at() == armed
    assert clock.poll(10.0, armed + 9.9) is None and models.last_id() == 1
    assert clock.poll(10.0, armed + 13.0)["accepted"] and models.last_id() == 2
    assert clock.poll(10.0, armed + 22.9) is None  # the next one is due after the time that one fired
    assert clock.poll(10.0, armed + 23.0)["snapshot_id"] == 3
    assert EvidenceStream(spark, job.folder).armed_at() == armed


def test_a_repeated_pass_learns_once(spark, files):
    job, models, clock = armed_clock(spark, files)
    job.process(spark.read.text(os.path.join(files, "part-0.txt")), "run", 0)
    now = job.armed_at() + 5.0
    first = clock.tick(datetime.fromtimestamp(now, timezone.utc), 1)  # the model is there, its record is not
    assert first["snapshot_id"] == 2
    assert clock.poll(5.0, now)["snapshot_id"] == 2 and models.last_id() == 2
    assert clock.poll(5.0, now) is None
    again = Recalibrator(job, models, clock.config)  # after a restart
    assert again.poll(5.0, now + 4.9) is None and again.poll(5.0, now + 5.0)["snapshot_id"] == 3


def test_clock_fires_without_new_events(spark, files):
    job, models, clock = armed_clock(spark, files)
    job.process(spark.read.text(os.path.join(files, "part-0.txt")), "run", 0)
    query = clock.start(1.0, shared_folder(spark, "clock"))
    try:
        for _ in range(60):
            if models.last_id() >= 3:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert models.last_id() >= 3


def test_snapshot_table_keeps_the_last_good_version(spark):
    schema = "v int"
    from pyspark.sql.types import _parse_datatype_string

    table = SnapshotTable(spark, shared_folder(spark, "snap"), _parse_datatype_string(schema), retain_seconds=0)
    assert table.read() is None
    for v in range(5):
        assert table.write(spark.range(v + 1).select(F.col("id").cast("int").alias("v"))) == v
    assert table.versions() == [2, 3, 4] and table.read().count() == 5
    assert table.read(before=4).count() == 4
    with pytest.raises(Exception):
        table.write(spark.range(3).select(F.raise_error(F.lit("broken")).cast("int").alias("v")))
    assert table.read().count() == 5


def test_a_reader_keeps_its_version_across_writes(spark):
    from pyspark.sql.types import _parse_datatype_string

    table = SnapshotTable(spark, shared_folder(spark, "reader"), _parse_datatype_string("v long"))
    table.write(spark.range(7).select(F.col("id").alias("v")), "run", 0)
    early = table.read()
    for batch in range(1, 5):
        assert table.write(spark.range(batch).select(F.col("id").alias("v")), "run", batch) == batch
    assert early.count() == 7 and table.read().count() == 4
    assert table.write(spark.range(9).select(F.col("id").alias("v")), "run", 4) == 4  # a repeat changes nothing
    assert table.read().count() == 4
    assert table.write(spark.range(2).select(F.col("id").alias("v")), "other run", 0) == 5


def test_a_fresh_checkpoint_goes_on_from_the_state(spark, files, tmp_path):
    expected = batch_result(spark)[1]
    folder = shared_folder(spark, "fresh")
    evidence = shared_folder(spark, "fresh-evidence")
    for half in range(2):
        part = tmp_path / str(half)
        part.mkdir()
        for i in (2 * half, 2 * half + 1):
            shutil.copy2(os.path.join(files, f"part-{i}.txt"), part)
        job = RealtimeCtr(spark, folder, seed_model(spark))
        text = text_event_stream(spark, str(part), 1)
        job.start(text, checkpoint=str(tmp_path / f"c{half}")).awaitTermination()
        counts = EvidenceStream(spark, evidence)
        counts.start(text, checkpoint=str(tmp_path / f"e{half}")).awaitTermination()
    assert same(job.buckets(), expected)
    assert job.progress().agg(F.max("processed_events")).first()[0] == X.event_log(spark, FOLDER).count()
    total = counts.counts()[0].agg(F.sum("impressions") + F.sum("clicks")).first()[0]
    assert total == X.valid_event_log(spark, FOLDER).count()


def test_shared_folder_on_a_cluster_must_be_named():
    from types import SimpleNamespace

    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        conf = SimpleNamespace(get=lambda key, default=None, m=master: m if key == "spark.master" else default)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(SimpleNamespace(conf=conf), "x")


def test_append_table_ids(spark):
    table = AppendTable(spark, shared_folder(spark, "app"), BUCKET)
    assert table.read().count() == 0
    row = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in BUCKET.fields])
    assert [table.append(row), table.append(row)] == [1, 2]


def test_missing_model(spark):
    with pytest.raises(ValueError, match="missing"):
        ModelStore(spark, shared_folder(spark, "none")).current()


def test_writers_at_once_get_ids_of_their_own(spark):
    from concurrent.futures import ThreadPoolExecutor

    path = shared_folder(spark, "writers")
    tables = [AppendTable(spark, path, BUCKET) for _ in range(4)]

    def append(number: int) -> int:
        row = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in BUCKET.fields])
        return tables[number % 4].append(row.withColumn("impressions", F.lit(number).cast("bigint")))

    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(append, range(12)))
    assert sorted(ids) == list(range(1, 13))
    found = {r["id"]: r["impressions"] for r in tables[0].read().collect()}
    assert found == {new_id: number for number, new_id in enumerate(ids)}


def test_an_id_that_another_writer_took_is_passed(spark, monkeypatch):
    path = shared_folder(spark, "taken")
    early, late = AppendTable(spark, path, BUCKET), AppendTable(spark, path, BUCKET)
    row = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in BUCKET.fields])
    assert late.append(row) == 1
    monkeypatch.setattr(early, "next_id", lambda: 1)  # as read before the other one wrote
    assert early.append(row) == 2 and early.read().count() == 2


def test_models_of_two_writers_keep_their_weights(spark):
    path = shared_folder(spark, "two-models")
    one, two = ModelStore(spark, path), ModelStore(spark, path)
    first, second = seed_model(spark), seed_model(spark)
    second = type(first)(second.head, second.weights.withColumn("weight", F.lit(0.25)), second.features)
    assert [one.append(first), two.append(second), one.append(first)] == [1, 2, 3]
    assert same(one.weights(1), first.weights) and same(one.weights(2), second.weights)
    assert same(two.current().weights, first.weights)
    with pytest.raises(ValueError, match="no model"):
        one.weights(9)


def arrive(files, topic, numbers):
    for i in numbers:
        shutil.copy2(os.path.join(files, f"part-{i}.txt"), topic)


def counted(job):
    found = job.counts()
    return 0 if found is None else found[0].agg(F.sum("impressions") + F.sum("clicks")).first()[0] or 0


def valid_rows_of(spark, files, numbers):
    return valid_events(parse_events(spark.read.text([os.path.join(files, f"part-{i}.txt") for i in numbers])))


def valid_rows(spark, files, numbers):
    return valid_rows_of(spark, files, numbers).count()


def test_latest_skips_the_backlog_once(spark, files, tmp_path):
    topic = tmp_path / "topic"
    topic.mkdir()
    arrive(files, topic, (0, 1))
    job = EvidenceStream(spark, shared_folder(spark, "latest"))
    text = text_event_stream(spark, str(topic), 1)
    job.start(text, starting="latest").awaitTermination()
    assert counted(job) == 0
    arrive(files, topic, (2,))
    job.start(text, starting="latest").awaitTermination()
    assert counted(job) == valid_rows(spark, files, (2,))
    arrive(files, topic, (3,))  # a backlog of a checkpoint that is there is never skipped
    job.start(text, starting="earliest").awaitTermination()
    assert counted(job) == valid_rows(spark, files, (2, 3))


def test_earliest_then_latest_goes_on_from_the_checkpoint(spark, files, tmp_path):
    topic = tmp_path / "topic"
    topic.mkdir()
    arrive(files, topic, (0,))
    job = RealtimeCtr(spark, shared_folder(spark, "earliest"), seed_model(spark))
    text = text_event_stream(spark, str(topic), 1)
    job.start(text).awaitTermination()
    arrive(files, topic, (1,))
    job.start(text, starting="latest").awaitTermination()
    done = A.admit_clicks(valid_rows_of(spark, files, (0, 1)))
    assert same(job.buckets(), A.new_buckets(done, None, seed_model(spark)))


def test_a_skip_cut_short_is_made_again(spark, files, tmp_path):
    from clicklens.sources.keyed import Commits

    topic = tmp_path / "topic"
    topic.mkdir()
    arrive(files, topic, (0,))
    job = EvidenceStream(spark, shared_folder(spark, "cut-short"))
    Commits(spark, f"{job.folder}/checkpoint/begin").put(0, {"starting": "latest"})
    text = text_event_stream(spark, str(topic), 1)
    job.start(text, starting="earliest").awaitTermination()  # the choice is kept
    assert counted(job) == 0
    with pytest.raises(ValueError, match="starting"):
        job.start(text, starting="newest")


def timed_reference(rows, interval, most):
    """Writes of one bucket by a loop: (impressions, clicks, updates) from (micros, is_click) in order."""
    shown = clicked = dirty = 0
    open_at, out = None, []
    for micros, click in rows:
        if click and clicked >= shown:
            continue
        if open_at is not None and micros // interval != open_at and dirty:
            out.append((shown, clicked, dirty))
            dirty = 0
        open_at = micros // interval
        shown, clicked, dirty = shown + (not click), clicked + click, dirty + 1
        if dirty == most:
            out.append((shown, clicked, dirty))
            dirty = 0
    return out, (shown, clicked, dirty)


@pytest.mark.parametrize("interval_ms, most", [(86_400_000, 3), (3_600_000, 100), (10 * 86_400_000, 7)])
def test_timed_writes_follow_a_loop_over_batches(spark, files, interval_ms, most):
    job = run(spark, files, flush_mode=TIMED, interval_ms=interval_ms, max_updates=most)
    log = X.valid_event_log(spark, FOLDER).withColumn("micros", F.unix_micros("occurred_at"))
    histories = {}
    order = ["occurred_at", "event_id", F.col("event_type").desc()]
    for r in log.orderBy(*order).collect():
        key = (r["ad_category"], r["publisher_domain"], r["conversation_category"])
        histories.setdefault(key, []).append((r["micros"], r["event_type"] == "click"))
    expected = {k: timed_reference(h, interval_ms * 1000, most) for k, h in histories.items()}

    def written():
        found = {}
        for r in job.writes().collect():
            key = (r["ad_category"], r["publisher_domain"], r["conversation_category"])
            assert r["flushes"] == 1 and r["ctr"] is not None
            found.setdefault(key, []).append((r["impressions"], r["clicks"], r["updates"]))
        return {k: sorted(v) for k, v in found.items()}

    assert written() == {k: sorted(out) for k, (out, _) in expected.items() if out}
    left = sum(1 for _, (_, _, dirty) in expected.values() if dirty)
    assert job.flush(datetime(2000, 1, 1, tzinfo=timezone.utc)) == 0
    assert job.flush() == left and job.flush() == 0
    full = {k: sorted([*out, rest] if rest[2] else out) for k, (out, rest) in expected.items()}
    assert written() == {k: v for k, v in full.items() if v}
    last = job.progress().orderBy(F.col("seq").desc()).first()
    assert last["redis_updates_flushed"] == last["valid_events"]
    assert last["redis_flushes"] == sum(len(v) for v in full.values())
    assert same(job.buckets(), batch_result(spark)[1])


def test_copies_of_an_event_share_a_timed_write(spark, files):
    text = spark.read.text(os.path.join(files, "part-0.txt")).filter("value LIKE '%impression\",%'").limit(1)
    copies = text.crossJoin(spark.range(250)).select("value")
    job = RealtimeCtr(spark, shared_folder(spark, "copies"), seed_model(spark), flush_mode=TIMED)
    job.process(copies, 0)
    assert [(r["updates"], r["flushes"]) for r in job.writes().collect()] == [(200, 2)]
    assert job.flush() == 1 and job.writes().agg(F.sum("updates")).first()[0] == 250


def timed_totals(job):
    return job.writes().agg(F.sum("updates").alias("updates"), F.sum("flushes").alias("flushes")).first()


def test_timed_writes_go_on_after_a_restart(spark, files):
    options = {"flush_mode": TIMED, "interval_ms": 10 * 86_400_000, "max_updates": 7}
    folder = shared_folder(spark, "timed-restart")
    for half in ((0, 1), (2, 3)):
        job = RealtimeCtr(spark, folder, seed_model(spark), **options)
        job._run = f"run-{half[0]}"
        for i in half:
            job.process(spark.read.text(os.path.join(files, f"part-{i}.txt")), i)
    job.flush()
    needed = A.flush_accounting(batch_result(spark)[0], options["interval_ms"], options["max_updates"])
    written = job.writes().groupBy("ad_category", "publisher_domain", "conversation_category").agg(
        F.sum("flushes").alias("flushes"), F.sum("updates").alias("updates_flushed")
    )
    assert same(written, needed.drop("updates_coalesced"))


def test_timed_writes_of_late_events_lose_no_update(spark, files):
    job = RealtimeCtr(
        spark, shared_folder(spark, "timed-late"), seed_model(spark), flush_mode=TIMED, interval_ms=10 * 86_400_000, max_updates=7
    )
    for n, i in enumerate((2, 0, 1)):
        job.process(spark.read.text(os.path.join(files, f"part-{i}.txt")), n)
    job.flush()
    accepted = job.progress().agg(F.max("valid_events")).first()[0]
    assert timed_totals(job).updates == accepted
    counts = job.buckets().agg(F.sum(F.col("impressions") + F.col("clicks"))).first()[0]
    assert counts == accepted


def test_timed_writes_join_by_keys(spark, model):
    done = A.admit_clicks(X.valid_event_log(spark, FOLDER))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        writes, _ = A.timed_writes(done, None, model)
        plan = writes._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_large_batches_order_only_slots_that_may_reject(spark, files, monkeypatch):
    done, expected = batch_result(spark)
    monkeypatch.setattr(A, "PIECE_ROWS", 64)
    ordered, admit = [], A.admit_clicks

    def watched(events, *args, **options):
        ordered.append((events.count(), options["quiet"] is not None))
        return admit(events, *args, **options)

    monkeypatch.setattr(A, "admit_clicks", watched)
    job = run(spark, files, slot_seconds=86_400)
    assert [screened for _, screened in ordered] == [True] * 4
    assert sum(rows for rows, _ in ordered) < done.runs.count()
    assert same(job.buckets(), expected)
    rejected = job.dead_letters().filter(F.col("reason") == "clicks_would_exceed_impressions")
    assert same(rejected, A.rejected_clicks(done))
    invalid = job.dead_letters().filter(F.col("reason") != "clicks_would_exceed_impressions")
    assert invalid.count() > 0 and invalid.filter("event IS NULL OR event = '{}'").count() == 0
    assert not os.listdir(f"{job.folder}/aside")


def test_large_timed_batches_find_totals_in_files(spark, files, monkeypatch):
    monkeypatch.setattr(A, "PIECE_ROWS", 64)
    plans, timed = [], A.timed_writes

    def watched(admission, *args):
        plans.append(admission.totals._jdf.queryExecution().optimizedPlan().toString())
        return timed(admission, *args)

    monkeypatch.setattr(A, "timed_writes", watched)
    job = run(spark, files, flush_mode=TIMED, interval_ms=86_400_000, max_updates=3)
    job.flush()
    assert len(plans) == 4 and not any("Aggregate" in plan for plan in plans)
    counted = job.writes().groupBy(*A.K.BUCKET_KEYS).agg(F.sum("flushes").alias("flushes"), F.sum("updates").alias("updates_flushed"))
    expected = A.flush_accounting(A.admit_clicks(X.valid_event_log(spark, FOLDER)), 86_400_000, 3)
    assert same(expected, counted)
