"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters with an embedding of itself and one summed over its character grams (with its start marked), so
that unseen words with a known stem are recognised. The network reads all windows of WINDOW words, one from
every word on, over the whole text; the score of a text is that of its worst window. Labels are per document,
so training picks the telling window of a toxic document itself: at first by the words and grams that mark
toxic documents, then by the network's own scores, against windows of clean documents and the hardest of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicklens.llm.gated import BUCKETS, Adam, embed, gradients, initial, sliding_logits
from clicklens.llm.labelled import fold, training_sample
from clicklens.llm.textbytes import LOWER, Words, mix, pieces

WINDOW = 12
GRAMS = (3, 5)


@dataclass
class Windows:
    """Windows of a batch of texts over its distinct words.

    hashes: the distinct words; words, grams, starts: their embedding rows; sequence: the words of all texts in
    turn, each text padded to WINDOW words at least; counted: which of them attention sees; begin, owner: the
    place in the sequence and the text of each window. A text without words has one window of padding.
    """

    hashes: np.ndarray
    words: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    sequence: np.ndarray
    counted: np.ndarray
    begin: np.ndarray
    owner: np.ndarray

    def spread(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Places in the sequence of the steps of windows, as windows x WINDOW."""
        return self.begin[rows][:, None] + np.arange(WINDOW)

    @property
    def ids(self) -> np.ndarray:
        return self.sequence[self.spread()]


def _bucket(x: np.ndarray) -> np.ndarray:
    return (mix(x) & np.uint64(BUCKETS - 1)).astype(np.int64)


def windows(texts: Words) -> Windows:
    distinct, first, ids = np.unique(texts.hashes, return_index=True, return_inverse=True)
    lengths = texts.lengths[first]
    ends = np.cumsum(lengths)
    place = np.arange(int(lengths.sum())) - np.repeat(ends - lengths, lengths)
    at = np.repeat(texts.starts[first], lengths) + place
    lower = LOWER[texts.data].astype(np.uint64)
    found = []
    for size in GRAMS:
        code = np.full(len(at), size, dtype=np.uint64)
        for back in range(size):
            inside = place >= back
            letter = np.where(inside, lower[np.maximum(at - back, 0)], 0) if len(at) else code
            code = code * np.uint64(257) + letter
        found.append(_bucket(code))
    grams = np.stack(found, axis=1).ravel() if len(at) else np.zeros(0, np.int64)
    counts = np.diff(texts.ranges)
    padded = np.maximum(counts, WINDOW)
    text_begins = np.cumsum(padded) - padded
    sequence = np.full(int(padded.sum()), len(distinct), dtype=np.int32)
    sequence[np.arange(len(ids)) + np.repeat(text_begins - texts.ranges[:-1], counts)] = ids
    counted = sequence < len(distinct)
    counted[text_begins[counts == 0]] = True  # attention needs one step
    per = padded - WINDOW + 1
    owner = np.repeat(np.arange(len(counts)), per)
    begin = np.arange(len(owner)) + np.repeat(text_begins - np.cumsum(per) + per, per)
    return Windows(distinct, _bucket(distinct), grams, (ends - lengths) * len(GRAMS), sequence, counted, begin, owner)


def joined(texts: pa.Array) -> Windows:
    """The windows of all texts over one list of distinct words, built piece by piece."""
    parts = [(row, windows(Words(piece))) for row, piece in pieces(texts)]
    hashes, first = np.unique(np.concatenate([w.hashes for _, w in parts]), return_index=True)
    sizes = np.concatenate([np.diff(np.append(w.starts, len(w.grams))) for _, w in parts])
    begins = np.cumsum(sizes) - sizes
    grams, sizes, begins = np.concatenate([w.grams for _, w in parts]), sizes[first], begins[first]
    starts = np.cumsum(sizes) - sizes
    grams = grams[np.repeat(begins - starts, sizes) + np.arange(int(sizes.sum()))]
    sequence = [
        np.append(np.searchsorted(hashes, w.hashes), len(hashes)).astype(np.int32)[w.sequence] for _, w in parts
    ]  # the padding word keeps the last number
    offsets = np.cumsum([0] + [len(w.sequence) for _, w in parts])
    return Windows(
        hashes,
        _bucket(hashes),
        grams,
        starts,
        np.concatenate(sequence),
        np.concatenate([w.counted for _, w in parts]),
        np.concatenate([w.begin + offset for (_, w), offset in zip(parts, offsets)]),
        np.concatenate([w.owner + row for row, w in parts]),
    )


def window_logits(p: dict, w: Windows) -> np.ndarray:
    vectors = embed(p, w.words, w.grams, w.starts)
    return sliding_logits(p, vectors, w.sequence, w.counted, WINDOW)[w.begin]


def text_scores(p: dict, texts: pa.Array) -> np.ndarray:
    out = []
    for _, piece in pieces(texts):
        w = windows(Words(piece))
        best = np.maximum.reduceat(window_logits(p, w), np.flatnonzero(np.diff(w.owner, prepend=-1)))
        out.append(1 / (1 + np.exp(-best.astype(float))))
    return np.concatenate(out) if out else np.zeros(0)


def _evidence(w: Windows, toxic: np.ndarray) -> np.ndarray:
    """Log-odds that a window's most telling word or gram belongs to toxic documents, over the sample itself."""
    n, count = len(toxic), len(w.words)

    def odds(t: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.log((t + 0.5) / (toxic.sum() + 1)) - np.log((c + 0.5) / (n - toxic.sum() + 1))

    text_begins = w.begin[np.diff(w.owner, prepend=-1) > 0]
    texts = np.repeat(np.arange(n), np.diff(np.append(text_begins, len(w.sequence))))
    real = w.sequence < count
    pairs = np.unique(w.sequence[real].astype(np.int64) * n + texts[real])
    word, hot = pairs // n, toxic[pairs % n]
    in_toxic, in_clean = np.bincount(word, hot, count), np.bincount(word, 1 - hot, count)
    owner = np.repeat(np.arange(count), np.diff(np.append(w.starts, len(w.grams))))
    by_gram = odds(*[np.bincount(w.grams, c[owner], BUCKETS) for c in (in_toxic, in_clean)])
    telling = np.maximum(odds(in_toxic, in_clean), np.maximum.reduceat(by_gram[w.grams], w.starts))
    at = np.append(telling, -9.0)[w.sequence]
    best = at[w.begin]
    for step in range(1, WINDOW):
        np.maximum(best, at[w.begin + step], out=best)
    return best


def fit(texts: pa.Array, toxic: np.ndarray, rounds: int = 4, steps: int = 150, batch: int = 128) -> dict:
    """Network parameters learned from whole texts with a label of 0 or 1 each."""
    p = initial()
    if len(np.unique(toxic)) < 2:
        p["out"][:] = 0
        p["bias"][:] = 4.0 if len(toxic) and toxic[0] == 1 else -4.0
        return p
    w = joined(texts)
    if not len(w.words):
        return p
    rng = np.random.default_rng(9)
    value = _evidence(w, toxic)
    optimiser = Adam(p, 0.01)
    first = np.flatnonzero(np.diff(w.owner, prepend=-1))
    clean = np.flatnonzero(toxic[w.owner] == 0)
    sizes = np.diff(np.append(w.starts, len(w.grams)))
    for turn in range(rounds):
        top = np.maximum.reduceat(value, first)[w.owner]
        telling = np.flatnonzero((toxic[w.owner] == 1) & (value >= top - 1e-6))
        hard = clean[np.argsort(-value[clean])[: max(batch, len(clean) // 20)]]
        for _ in range(steps):
            optimiser.tick()
            chosen = np.concatenate(
                [rng.choice(telling, batch // 2), rng.choice(clean, batch // 4), rng.choice(hard, batch // 4)]
            )
            spread = w.spread(chosen)
            used, ids = np.unique(w.sequence[spread], return_inverse=True)
            words = used[used < len(w.words)]
            lengths = sizes[words]
            at = np.repeat(w.starts[words] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
            grams = w.grams[at]
            # The padding word has the highest number and so stays last.
            vectors = embed(p, w.words[words], grams, np.cumsum(lengths) - lengths)
            real, target = w.counted[spread], toxic[w.owner[chosen]].astype(np.float32)
            g, d_vectors = gradients(p, vectors, ids.reshape(len(chosen), -1), real, target)
            for name, change in g.items():
                optimiser.apply(name, change)
            for name, rows, change in (
                ("word", w.words[words], d_vectors[:-1, : d_vectors.shape[1] // 2]),
                ("gram", grams, np.repeat(d_vectors[:-1, d_vectors.shape[1] // 2 :], lengths, axis=0)),
            ):
                touched, where = np.unique(rows, return_inverse=True)
                total = np.zeros((len(touched), change.shape[1]), np.float32)
                np.add.at(total, where, change)
                optimiser.apply(name, total, touched)
        if turn + 1 < rounds:
            value = window_logits(p, w)
    return p


def train(docs: DataFrame, labels: DataFrame, rows: int = 1500, without: tuple[int, int] = (4, 2)) -> dict:
    """Fit on at most ``rows`` labelled documents of each class outside the held-out fold."""
    sample = training_sample(docs, labels, "toxic", rows, without).select("doc_id", "text", "label")
    found = sample.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    return fit(found["text"].combine_chunks(), np.array(found["label"].to_pylist(), dtype=float))


def toxicity_score(p: dict, text: Column) -> Column:
    """Score of 0 to 1 for a whole text; a null text is an empty one."""
    carried = {k: v.astype(np.float32) for k, v in p.items()}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        distinct = texts.dictionary_encode(null_encoding="encode")  # copies in a batch share a score
        return pa.array(text_scores(carried, distinct.dictionary)[distinct.indices.to_numpy(zero_copy_only=False)])

    return score(text)


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text, ...).

    Trained on ``labels`` (doc_id, toxic) without fold 2 of 4. Other columns of either table are not read. Empty
    and null texts get the score of an empty window, repeated rows equal scores, a null doc_id is not held out.
    With fewer than two classes of labels the score is constant (low without labels).
    """
    p = train(docs, labels)
    return (
        docs.select("doc_id", toxicity_score(p, F.col("text")).alias("score"))
        .withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))
        .select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    )
