import zlib

import numpy as np
import pyarrow as pa
import pytest

from clicklens.llm import gated, quality, toxicity
from clicklens.llm.textbytes import Words, pieces

FOLDER = "/root/testdata/sf0.1"


def labelled(spark, report, column, folds, fold):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = report(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels)
    found = rows.join(labels.filter(f"{column} IS NOT NULL"), "doc_id").filter("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % folds == fold for i in found.doc_id)
    return found


def test_quality_on_held_out_rows(spark):
    found = labelled(spark, quality.classify_quality, "quality", 3, 1)
    assert (found.predicted == found.quality).mean() > 0.98
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.5)).all()


def test_toxicity_on_held_out_rows(spark):
    found = labelled(spark, toxicity.classify_toxicity, "toxic", 4, 2)
    toxic = found[found.toxic == 1]
    assert toxic.predicted.mean() > 0.8  # 329 toxic documents to learn from
    assert found[found.toxic == 0].predicted.mean() < 0.03


@pytest.mark.parametrize("classify", [quality.classify_quality, toxicity.classify_toxicity])
def test_odd_rows(odd_documents, no_documents, no_labels, classify):
    rows = classify(odd_documents, no_labels).collect()
    assert len(rows) == 8 and len({r.score for r in rows}) == 1
    empty = {r.score for r in rows if r.doc_id in (2, 3, 4)}
    assert len(empty) == 1
    assert classify(no_documents, no_labels).count() == 0


def test_one_class_of_labels(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for classify in (quality.classify_quality, toxicity.classify_toxicity):
        assert classify(odd_documents, labels).count() == 8


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(1)
    rows = rng.random((4000, len(quality.FEATURES)))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    model = quality.fit(rows, labels)
    assert (1, 0) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.score(rows) > 0.5) == labels).mean() > 0.9


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in gated.initial().items()}
    p = {k: np.asarray(v, dtype=np.float64) for k, v in p.items()}
    vectors = rng.standard_normal((6, 2 * gated.EMBED))
    ids = rng.integers(0, 6, (5, 7))
    real = np.arange(7) < rng.integers(1, 8, 5)[:, None]
    target = rng.integers(0, 2, 5).astype(float)

    def loss():
        z = gated.logits(p, vectors, ids, real).astype(float)
        return np.mean(np.log1p(np.exp(z)) - target * z)

    g, d_vectors = gated.gradients(p, vectors, ids, real, target)
    for name, change in [*g.items(), (None, d_vectors)]:
        array = vectors if name is None else p[name]
        for at in [tuple(rng.integers(0, s) for s in array.shape) for _ in range(4)]:
            step, old = 1e-2, array[at]
            array[at] = old + step
            up = loss()
            array[at] = old - step
            down = loss()
            array[at] = old
            assert change[at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_windows_cover_every_word():
    texts = ["", "a", " ".join(f"w{i}" for i in range(100)), None, "x y"]
    w = toxicity.windows(Words(pa.array(texts)))
    starts = {}
    for owner, ids in zip(w.owner, w.ids):
        starts.setdefault(int(owner), set()).update(int(i) for i in ids if i < len(w.words))
    assert [len(starts.get(i, ())) for i in range(5)] == [0, 1, 100, 0, 2]


def test_every_window_is_scored():
    p = gated.initial()
    rng = np.random.default_rng(3)
    sizes = [0, 3, *(toxicity.WINDOW + more for more in (0, 1, 7, 66))]
    texts = [" ".join(rng.choice(["a", "bc", "idiot", "x1", "why", "so"], n)) for n in sizes]
    w = toxicity.windows(Words(pa.array(texts)))
    assert np.bincount(w.owner).tolist() == [1, 1, 1, 2, 8, 67]
    vectors = gated.embed(p, w.words, w.grams, w.starts)
    want = gated.logits(p, vectors, w.ids, w.counted[w.spread()])
    assert np.allclose(toxicity.window_logits(p, w), want, atol=1e-5)
    passage = " ".join(f"p{i}" for i in range(toxicity.WINDOW))
    moved = toxicity.text_scores(p, pa.array(["clean " * k + passage + " clean" * 9 for k in range(40)]))
    assert (moved >= toxicity.text_scores(p, pa.array([passage])) - 1e-6).all()


def test_scores_do_not_depend_on_the_batch():
    p = gated.initial()
    texts = pa.array([f"some words {i} idiot" * (i % 7) for i in range(50)])
    whole = toxicity.text_scores(p, texts)
    single = np.concatenate([toxicity.text_scores(p, texts.slice(i, 1)) for i in range(50)])
    assert np.allclose(whole, single, atol=1e-6)


def test_pieces_keep_all_texts():
    texts = pa.array(["ab", None, "", "cdef", "g" * 10, "h"]).slice(1)
    parts = [(row, p.to_pylist()) for row, p in pieces(texts, limit=5)]
    assert sum((p for _, p in parts), []) == texts.to_pylist()
    assert all(row == sum(len(q) for _, q in parts[:i]) for i, (row, _) in enumerate(parts))
