import random
from hashlib import sha256

import numpy as np
import pytest

from clicklens.llm.centroids import Simplex, bounds, cluster_report, nearest, squared
from clicklens.llm.vector_codes import Slices, code_report

SCHEMA = "vec_id long, embedding array<float>, label int, code string, cluster int"


def cases():
    rng = np.random.default_rng(4)
    for scale in (2, 10, 300, 10**6):
        for places in (1, 4, 7):
            entries = rng.integers(-scale, scale + 1, (rng.integers(1, 65), places))
            yield entries, rng.integers(-scale, scale + 1, (400, places))


def test_masks_find_the_nearest_entry():
    for entries, parts in cases():
        full = squared(parts, entries)
        book = Slices(entries)
        number, distance = book.nearest(parts)
        assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
        masks = book.candidates(parts, book.radius(parts))
        assert all(int(masks[i]) >> int(n) & 1 for i, n in enumerate(number))


def test_a_mask_turns_entries_away():
    rng = np.random.default_rng(5)
    book = Slices(rng.integers(-40, 41, (64, 4)))
    parts = rng.integers(-40, 41, (2000, 4))
    assert np.bitwise_count(book.candidates(parts, book.radius(parts))).mean() < 24


def test_bounds_hold_and_filter():
    for entries, vectors in cases():
        simplex = Simplex(entries)
        a, b = simplex.apexes(squared(vectors, simplex.pivots)), simplex.apexes(squared(entries, simplex.pivots))
        full = squared(vectors, entries)
        low, high = bounds(a, b)
        room = 1e-6 * (full.max() + 1)
        assert (low <= full + room).all() and (full <= high + room).all()
        number, distance, _ = nearest(vectors, a, entries, b)
        assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    rng = np.random.default_rng(6)
    vectors = rng.integers(-100, 101, (2000, 64))
    simplex, centroids = Simplex(vectors[:80]), vectors[100:140]
    apexes = [simplex.apexes(squared(x, simplex.pivots)) for x in (vectors, centroids)]
    assert len(simplex.pivots) == 60 and nearest(vectors, apexes[0], centroids, apexes[1])[2] < 10 * len(vectors)


def rows(seed, n, width, spread=1.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append((i * 3, [rng.gauss(0, 0.2) * spread for _ in range(width)], rng.choice([None, 1, 1, 1, 2]), "x", -1))
    out += [out[5]] * 4 + [(out[7][0], out[8][1], 2, None, None)]  # repeated rows, one id with two vectors
    out += [(10**12, None, 1, "x", 0), (None, [0.25] * width, None, None, None)]
    bad = [float("nan"), float("inf"), float("-inf"), None]
    out += [(2000 + i, [x] + [0.1] * (width - 1), 1, "x", 0) for i, x in enumerate(bad)]
    rng.shuffle(out)
    return out


def kept(data):
    good = [r for r in data if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    vectors = np.array([r[1] for r in good], np.float32).astype(float)
    return good, np.floor(256 * vectors).astype(np.int64)


def means(vectors, number, entries):
    out = entries.copy()
    for j in range(len(entries)):
        if (number == j).any():
            out[j] = vectors[number == j].sum(axis=0) // (number == j).sum()
    return out


@pytest.mark.parametrize("n", [300, 20])
def test_clusters_equal_brute_force(spark, n):
    data = rows(n, n, 64) + [(7777, [0.5] * 63, 1, "x", 0), (7778, [], 1, "x", 0)]
    good, vectors = kept([r for r in data if r[1] is None or len(r[1]) == 64])

    def place(i):
        vec_id = good[i][0]
        return (vec_id is None, sha256(f"2:{vec_id}".encode()).hexdigest(), good[i][1])

    centroids = vectors[sorted(range(len(good)), key=place)[:40]].copy()
    for _ in range(5):
        centroids = means(vectors, squared(vectors, centroids).argmin(axis=1), centroids)
    full = squared(vectors, centroids)
    number, distance = full.argmin(axis=1), full.min(axis=1)
    expected = sorted(
        (-1 if r[0] is None else r[0], int(c), int(d), int(distance[number == c].sum()), int(distance.sum()),
         sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for r, c, d in zip(good, number, distance)
    )
    got = cluster_report(spark.createDataFrame(data, SCHEMA).repartition(5))
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == expected


@pytest.mark.parametrize("n,width", [(300, 64), (30, 32)])
def test_codes_equal_brute_force(spark, n, width):
    data = rows(n, n, width) + [(7777, [0.5] * 5, 1, "x", 0), (7778, [], 1, "x", 0)]
    good, vectors = kept([r for r in data if r[1] is None or len(r[1]) == width])
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, good[i][1]))[:64]
    step, books, codes, error = width // 16, [], [], np.zeros(len(good), np.int64)
    for p in range(16):
        part = vectors[:, p * step : (p + 1) * step]
        book = part[order].copy()
        for _ in range(2):
            book = means(part, squared(part, book).argmin(axis=1), book)
        full = squared(part, book)
        books.append(book)
        codes.append(full.argmin(axis=1))
        error += full.min(axis=1)
    digest = sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    by_label = {}
    for r, e in zip(good, error):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    expected = sorted(
        (-1 if r[0] is None else r[0], "".join(f"{c[i]:02x}" for c in codes), int(error[i]), by_label[r[2]], digest)
        for i, r in enumerate(good)
    )
    got = code_report(spark.createDataFrame(data, SCHEMA).repartition(5))
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == expected


def test_empty_and_extreme(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cluster_report(none).count() == 0 and code_report(none).count() == 0
    odd = spark.createDataFrame([(1, [1.0] * 17, 1, "x", 0)], SCHEMA)  # 16 parts do not divide it
    assert code_report(odd).count() == 0 and cluster_report(odd).count() == 0
    far = [(1, [3e38] * 64, 1, "x", 0), (2, [-3e38] * 64, 1, "x", 0), (3, [0.0] * 64, 1, "x", 0)]
    far = spark.createDataFrame(far, SCHEMA)
    assert [r["distance"] for r in cluster_report(far).collect()] == [0, 0, 0]
    assert [r["error"] for r in code_report(far).collect()] == [0, 0, 0]
