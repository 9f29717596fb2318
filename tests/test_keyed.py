import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicklens.session import shared_folder
from clicklens.sources.keyed import Commits, KeyedLog

SCHEMA = T.StructType().add("k", "long").add("name", "string").add("n", "long")


def rows(spark, ids, value):
    return spark.createDataFrame([(i, f"key {i}", value) for i in ids], SCHEMA)


def files(folder):
    found = {}
    for path, _, names in os.walk(folder):
        found |= {os.path.join(path, n): os.stat(os.path.join(path, n)).st_mtime_ns for n in names if n.endswith("parquet")}
    return found


def content(log):
    return {(r["k"], r["name"]): r["n"] for r in log.read().collect()}


def test_a_batch_writes_its_own_rows_only(spark):
    log = KeyedLog(spark, shared_folder(spark, "log"), SCHEMA, ["k", "name"], parts=8, most_deltas=2)
    assert log.read() is None
    big = spark.range(1_000_000).select(F.col("id").alias("k"), F.concat(F.lit("key "), "id").alias("name"), F.lit(0).cast("long").alias("n"))
    log.load(big, "initial")
    before = files(log.path)
    for batch in range(5):  # deltas are folded into one on the way
        assert log.write(rows(spark, [1, 2, 3 + batch], batch + 1), "run", batch) == batch + 1
    after = files(log.path)
    assert {p: t for p, t in after.items() if p in before} == before
    assert all("/base/" not in p for p in after.keys() - before.keys()) and len(log.head["deltas"]) <= 2
    assert sum(os.path.getsize(p) for p in after.keys() - before.keys()) < 100_000
    assert {r["k"]: r["n"] for r in log.read().filter("n > 0").collect()} == {1: 5, 2: 5, 3: 1, 4: 2, 5: 3, 6: 4, 7: 5}
    assert log.read().count() == 1_000_000
    part = log.read().filter("k = 6").select(log.part()).first()[0]
    some = log.read(parts=[part])
    assert some.filter("k = 6").first()["n"] == 4 and some.count() < 200_000
    assert log.write(rows(spark, [9], 9), "run", 4) == 5 and log.next_version() == 6  # a repeat changes nothing


def test_only_touched_partitions_are_rewritten(spark):
    log = KeyedLog(spark, shared_folder(spark, "fold"), SCHEMA, ["k", "name"], parts=8, most_deltas=2, retain_seconds=0)
    log.load(rows(spark, range(100), 0), "initial")
    base = dict(log.head["base"])
    expected = {(i, f"key {i}"): 0 for i in range(100)}
    for batch in range(4):
        changed = [7] * 1 + list(range(200 + 15 * batch, 215 + 15 * batch)) if batch else [7]
        log.write(rows(spark, changed, batch + 1), "run", batch)
        expected |= {(i, f"key {i}"): batch + 1 for i in changed}
        assert content(log) == expected
    assert any(v not in base.values() for v in log.head["base"].values())
    again = KeyedLog(spark, log.path, SCHEMA, ["k", "name"], parts=8)
    assert content(again) == expected and again.versions() == log.versions()
    assert len(log.versions()) == KeyedLog.KEEP and set(base) <= set(log.head["base"])


def test_sums_and_nulls(spark):
    log = KeyedLog(spark, shared_folder(spark, "sums"), SCHEMA, ["k", "name"], sums=["n"], parts=3, most_deltas=1)
    for batch in range(4):
        delta = spark.createDataFrame([(None, None, 1), (1, "a", 2), (batch, None, 3)], SCHEMA)
        log.write(delta, "run", batch)
        log.write(delta, "run", batch)
    found = {(r["k"], r["name"]): r["n"] for r in log.read().collect()}
    assert found == {(None, None): 4, (1, "a"): 8, (0, None): 3, (1, None): 3, (2, None): 3, (3, None): 3}
    log.write(spark.createDataFrame([], SCHEMA), "run", 9)
    assert log.read().count() == 6


def test_two_writers_lose_nothing(spark):
    path = shared_folder(spark, "two")
    one = KeyedLog(spark, path, SCHEMA, ["k", "name"])
    two = KeyedLog(spark, path, SCHEMA, ["k", "name"])
    assert one.write(rows(spark, [1], 1), "one", 0) == 0
    with pytest.raises(RuntimeError, match="another writer"):
        two.write(rows(spark, [2], 2), "two", 0)
    assert two.write(rows(spark, [2], 2), "two", 0) == 1  # it has read the commits again
    one.refresh()
    assert content(one) == {(1, "key 1"): 1, (2, "key 2"): 2}
    commits = Commits(spark, f"{path}/numbers")
    assert commits.all() == [] and commits.put(3, {"a": 1}) and not commits.put(3, {"a": 2})
    assert commits.all() == [(3, {"a": 1})]
