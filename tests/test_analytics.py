import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clicklens.operators import ranks as R
from clicklens.operators import throughput as P
from clicklens.operators import validity as V
from clicklens.schemas import PROCESSOR_RECORD
from clicklens.sources import logs


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(5)
    rows = []
    for g in ("a", "b"):
        for _ in range(700):
            # A third of the values are equal.
            x = 0.5 if rng.random() < 0.34 else round(rng.random(), 2)
            rows.append((g, x, round(x + rng.gauss(0, 0.3), 1)))
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    return pdf, spark.createDataFrame(pdf).persist()


def test_ranks(numbers):
    pdf, frame = numbers
    got = {(r["g"], r["x"]): r["rank"] for r in R.average_ranks(frame, "g", "x").collect()}
    pdf = pdf.assign(rank=pdf.groupby("g")["x"].rank())
    assert got == {(r.g, r.x): r.rank for r in pdf.itertuples()} or all(
        got[r.g, r.x] == pdf.loc[r.Index, "rank"] for r in pdf.itertuples()
    )


def test_correlation(numbers):
    pdf, frame = numbers
    got = {r["g"]: r["spearman_rank"] for r in R.rank_correlation(frame, "g", "x", "y").collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(part["x"].rank().corr(part["y"].rank()), abs=1e-12)


def test_quantiles(numbers):
    pdf, frame = numbers
    shares = [0.0, 0.2, 0.37, 0.5, 1.0]
    got = {r["g"]: r["edges"] for r in R.quantiles(frame, "g", "y", shares).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(list(part["y"].quantile(shares)), abs=1e-12)


def test_any_number_of_groups(spark):
    rows = spark.range(6000).select((F.col("id") % 1500).alias("g"), F.col("id").alias("v"))
    got = R.positions(rows, "g", "v").groupBy("g").agg(F.max("before").alias("last"), F.count("*").alias("n"))
    assert got.filter("last = 3 AND n = 4").count() == 1500


def test_pivot_takes_the_subtasks_it_finds(spark):
    rows = records(spark).filter("subtask_index = 0")
    pivot = P.subtask_distribution(rows.unionByName(rows.withColumn("subtask_index", F.lit(5).cast("bigint"))))
    assert set(pivot.columns) == {"run_id", "subtask_0", "subtask_5"}
    assert all(r["subtask_5"] == r["subtask_0"] > 0 for r in pivot.collect())


def frame_of(spark):
    rng = random.Random(11)
    rows = []
    for i in range(120):
        p = rng.choice([0.01, 0.02, 0.02, 0.02, round(rng.random() / 10, 3)])
        n = rng.randrange(1, 3000)
        c = sum(rng.random() < p for _ in range(n))
        f = p + rng.gauss(0, 0.01)
        rows.append((f"a{i % 3}", f"d{i % 4}", f"c{i}", p, n, c, c / n, f, n + 10, p + rng.gauss(0, 0.02)))
    names = [
        "ad_category", "publisher_domain", "conversation_category", "generator_ctr", "batch_impressions",
        "batch_clicks", "batch_raw_ctr", "final_posterior_ctr", "final_impressions", "seed_posterior_ctr",
    ]
    pdf = pd.DataFrame(rows, columns=names)
    return pdf, spark.createDataFrame(pdf)


def test_calibration_bands(spark):
    pdf, frame = frame_of(spark)
    pdf["band"] = pd.qcut(pdf["generator_ctr"], q=5, duplicates="drop")
    rows = V.calibration_bands(frame).collect()
    groups = list(pdf.groupby("band", observed=True))
    assert len(rows) == len(groups)
    for row, (_, part) in zip(rows, groups):
        assert row["buckets"] == len(part)
        assert row["expected_ctr"] == pytest.approx(np.average(part["generator_ctr"], weights=part["batch_impressions"]))
        assert row["observed_ctr"] == pytest.approx(part["batch_clicks"].sum() / part["batch_impressions"].sum())
        assert row["posterior_ctr"] == pytest.approx(
            np.average(part["final_posterior_ctr"], weights=part["final_impressions"])
        )


def test_estimator_quality(spark):
    pdf, frame = frame_of(spark)
    got = {r["estimator"]: r for r in V.estimator_quality(frame).collect()}
    for label, column in V.ESTIMATORS.items():
        e = pdf[column] - pdf["generator_ctr"]
        row = got[label]
        assert row["mean_bias_pp"] == pytest.approx(100 * e.mean())
        assert row["mae_pp"] == pytest.approx(100 * e.abs().mean())
        assert row["rmse_pp"] == pytest.approx(100 * np.sqrt((e**2).mean()))
        assert row["weighted_rmse_pp"] == pytest.approx(
            100 * np.sqrt(np.average(e**2, weights=pdf["batch_impressions"]))
        )
        assert row["spearman_rank"] == pytest.approx(pdf[column].rank().corr(pdf["generator_ctr"].rank()))


def test_sampling(spark):
    pdf, frame = frame_of(spark)
    row = V.sampling_plausibility(frame).collect()[0]
    n, p = pdf["batch_impressions"], pdf["generator_ctr"]
    se = np.sqrt((n * p * (1 - p)).sum()) / n.sum()
    assert row["expected_clicks"] == pytest.approx((n * p).sum())
    assert row["z_score"] == pytest.approx((pdf["batch_clicks"].sum() / n.sum() - (n * p).sum() / n.sum()) / se)


def test_reconcile_flags_differences(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "measurement string, value double")
    b = spark.createDataFrame([("x", 1.0), ("y", 2.5)], "measurement string, value double")
    assert {r["measurement"]: r["matches"] for r in V.reconcile(a, b).collect()} == {"x": True, "y": False, "z": False}


def records(spark):
    rows = [
        (1, 0, 3, 3, 2, 1, 0, "periodic", 2, 3, 1, 1.0, 3.0, 3, 1.0, 3.0),
        (2, 0, 6, 6, 4, 2, 0, "periodic", 3, 6, 3, 2.0, 3.0, 3, 1.0, 5.0),
        (3, 1, 10, 10, 8, 2, 0, "periodic", 2, 10, 8, 2.0, 5.0, 10, 2.0, 5.0),
    ]
    schema = PROCESSOR_RECORD.fieldNames()
    frame = spark.createDataFrame(rows, "seq bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PROCESSOR_RECORD.fields))
    assert frame.columns[1:] == schema
    return frame.withColumn("run_id", F.lit(1).cast("bigint"))


def test_aggregate_over_subtasks(spark):
    row = P.aggregate_metrics(records(spark), ["run_id"]).collect()[0]
    assert (row["subtask_count"], row["processed_events"], row["events_per_second"]) == (2, 16, 8.0)
    assert (row["redis_flushes"], row["redis_updates_coalesced"]) == (5, 11)
    assert row["window_events_per_second"] == 4.0 + 5.0
    assert row["post_warmup_eps"] == 5.0 + 5.0
    shares = {r["subtask_index"]: r["share"] for r in P.subtask_shares(records(spark)).collect()}
    assert shares == {0: 6 / 16, 1: 10 / 16}


def test_a_column_for_each_subtask_of_the_records(spark):
    one = P.subtask_distribution(records(spark)).collect()
    assert [r.asDict() for r in one] == [{"run_id": 1, "subtask_0": 6, "subtask_1": 10}]
    other = records(spark).filter("subtask_index = 1").withColumns({"run_id": F.lit(2), "subtask_index": F.lit(5)})
    both = P.subtask_distribution(records(spark).unionByName(other)).orderBy("run_id").collect()
    assert [r.asDict() for r in both] == [
        {"run_id": 1, "subtask_0": 6, "subtask_1": 10, "subtask_5": 0},
        {"run_id": 2, "subtask_0": 0, "subtask_1": 0, "subtask_5": 10},
    ]


def test_averages(spark):
    rows = P.average_metrics(records(spark).filter("seq <> 2"), ["run_id"]).collect()
    got = {r["metric"]: r["average"] for r in rows}
    assert got["processed_events"] == 6.5 and "subtask_index" not in got and "redis_flush_mode" not in got


def test_log_lines(spark):
    lines = spark.createDataFrame(
        [
            ('\u001b[36mINFO x: CTR_PROCESSOR_METRICS {"processed_events": 10, "subtask_index": 0}\u001b[0m',),
            ('\u001b[36mINFO x: CTR_PROCESSOR_METRICS {"processed_events": 20, "valid_events": true}\u001b[0m',),
            ("INFO x: something else {}",),
            ("INFO x: CTR_PROCESSOR_METRICS {broken}",),
            ("INFO x: CTR_PROCESSOR_METRICS none",),
        ],
        "value string",
    )
    rows = logs.parse_metrics_lines(lines).collect()
    assert [r["processed_events"] for r in rows] == [10, 20]
    assert rows[1]["valid_events"] is None


def test_log_records_keep_their_order(spark, tmp_path):
    def line(n):
        return logs.K.METRICS_MARKER + f' {{"subtask_index": 0, "processed_events": {n}.0, "elapsed_seconds": {n}}}'

    (tmp_path / "a.log").write_text("\n".join(["start", line(6), "noise", line(9), line(7)]) + "\n")
    rows = logs.ordered_records(logs.read_log(spark, str(tmp_path / "a.log"))).orderBy("seq").collect()
    assert [(r["seq"], r["processed_events"]) for r in rows] == [(1, 6), (2, 9), (3, 7)]
    last = P.last_records(logs.ordered_records(logs.read_log(spark, str(tmp_path))), ["file"]).collect()
    assert [r["processed_events"] for r in last] == [7]
