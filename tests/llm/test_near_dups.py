import random

from clicklens.llm.components import connected_components
from clicklens.llm.near_dups import collection_size, near_duplicates


def shingles(text, k):
    words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
    low = "".join(c.lower() if c.isascii() else c for c in " ".join(w for w in words if w)).split(" ")
    low = [w for w in low if w]
    if not low:
        return set()
    return {tuple(low)} if len(low) < k else {tuple(low[i : i + k]) for i in range(len(low) - k + 1)}


def brute(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(60)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    texts += [f"{passage} {' '.join(rng.choices(vocabulary, k=rng.randint(5, 40)))}" for _ in range(40)]
    base = rng.choices(vocabulary, k=120)
    texts += family(rng, base, 90, 12)  # a group whose outer copies are no links of each other
    texts += [texts[3]] * 25 + ["", "  ", "Same Words", "same words", "one", "One"]
    rng.shuffle(texts)
    return dict(enumerate(texts, start=10))


def test_equals_all_pairs(spark):
    texts = corpus()
    for k, percent in ((3, 85), (5, 80)):
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, k, percent).collect()}
        assert got == brute(texts, k, percent)


def test_misses_are_rare_by_construction():
    for percent in (80, 85):
        m = collection_size(percent)
        assert 2 * (1 - (percent / 100) ** 4) ** m <= 5e-5
        assert 2 * m * 4 < m * m * 8 / 10  # far fewer minhashes than one collection for each table


def test_odd_rows(odd_documents, no_documents):
    rows = near_duplicates(odd_documents, 3, 85).collect()
    assert len(rows) == 8
    by = {(r.doc_id, r.n_shingles): r for r in rows}
    assert by[1, 12].kept and by[1, 12].component_id == 1
    assert all(by[i, 0].component_id == i and by[i, 0].kept for i in (2, 3, 4))
    assert by[None, 11].component_id is None and by[None, 11].kept
    assert by[6, 1].component_id == 6
    assert near_duplicates(no_documents).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (1, 2), (300, 299)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)} | {299: 299, 300: 299}
    assert {r.id: r.component for r in rows} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
