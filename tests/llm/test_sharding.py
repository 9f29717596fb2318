import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clicklens.llm import sharding as S


def order(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])


def check(texts, found, shards):
    """Every row is there once, in order of the keys, in shards that are cut at equal bytes, with gapless slots."""
    sized = sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts if i is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found if r["doc_id"] is not None) == sized
    assert len(found) == len(texts)
    rows, whole, so_far = sorted(found, key=lambda r: (r["shard"], r["slot"])), sum(r["size"] for r in found), 0
    assert [order(r) for r in rows] == sorted(order(r) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        assert r["shard"] == min(shards - 1, (2 * so_far + r["size"]) * shards // (2 * whole))
        so_far += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(v == list(range(len(v))) for v in slots.values())


def texts(seed=3, n=4000):
    rng = random.Random(seed)
    hot = [(7, "the same text")] * (n // 3)
    rest = [(rng.choice([None, 1, 2, 3, 50, 10**15]), "é" * rng.randint(0, 40)) for _ in range(n)]
    rows = hot + rest + [(9, "y" * 200_000), (9, None), (9, ""), (9, "y" * 200_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("range_rows", [S.RANGE_ROWS, 40])
def test_bytes(spark, monkeypatch, range_rows):
    monkeypatch.setattr(S, "RANGE_ROWS", range_rows)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(rows, S.shard_report(docs, 6).collect(), 6)


def test_overfull_ranges_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(S, "DRAWS", 1)  # a poor sample leaves overfull ranges
    rows = texts(5, 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(rows, S.shard_report(docs, 3).collect(), 3)


def test_rows_law_and_kept_columns(spark):
    rows = [(i % 7, f"row {i}", i) for i in range(1003)]
    placed = S.sharded(spark.createDataFrame(rows, "a int, `b.c` string, shard int"), 10, ["a", "b.c"])
    assert placed.columns == ["a", "b.c", "shard", "slot"]
    counts = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert len(counts) == 10 and max(counts) - min(counts) <= 1
    assert sorted(r["b.c"] for r in placed.collect()) == sorted(r[1] for r in rows)


def test_written_shards(spark, tmp_path):
    rows = texts(8, 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    S.write_shards(docs, str(tmp_path / "out"), 4, ["doc_id"], S.text_bytes(F.col("text")))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in back.collect()) == sorted(
        (i or -1, t or "") for i, t in rows
    )
    sizes = [r[0] for r in back.groupBy("shard").agg(F.sum(S.text_bytes(F.col("text")))).collect()]
    assert len(sizes) == 4


def test_odd_rows(odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    check(rows, S.shard_report(odd_documents).collect(), 24)
    assert S.shard_report(no_documents).count() == 0
    one = S.shard_report(odd_documents.filter("doc_id = 2")).collect()
    assert [(r["size"], r["slot"], r["grown_shard"]) for r in one] == [(8, 0, None)]
