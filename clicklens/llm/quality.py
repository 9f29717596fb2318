"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically.

The score is the logistic of a sum of lookup tables, one per feature and one per chosen pair of features.
Shallow trees over binned features are fitted in turn, feature by feature, each with a small step, and added
into the table of their feature; then the pairs that explain most of what is left get tables of their own.
Scoring finds the bin of every feature for a whole Arrow batch and adds table entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicklens.llm.labelled import fold, training_sample
from clicklens.llm.textbytes import SPACE, Words, pieces

FEATURES = [
    "upper_share", "symbol_share", "digit_share", "non_ascii_share", "exclaims_per_word", "bars_per_word",
    "stops_per_word", "lines_per_word", "repeat_share", "distinct_share", "log_words", "word_length",
    "worst_upper", "worst_symbol", "worst_repeat", "worst_bar",
]
WINDOW = 16

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "symbol": b"#$%&*+<=>@^_~{}[]\\/",
    "digit": b"0123456789",
    "exclaim": b"!",
    "bar": b"|",
    "stop": b".,;:?",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}
_TABLES = {name: np.isin(np.arange(256), list(found)) for name, found in _CLASSES.items()}


def features(words: Words) -> np.ndarray:
    """Feature rows (texts x FEATURES), as shares of the whole text and of its worst run of WINDOW words."""

    def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])

    def worst(flags: np.ndarray) -> np.ndarray:
        """Largest share of flagged words in a run of WINDOW words of the text (of all words if fewer)."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        ends = np.repeat(words.ranges[1:], counts)
        at = np.arange(len(flags))
        runs = (total[np.minimum(at + WINDOW, ends)] - total[at]) / WINDOW
        out = np.zeros(len(counts))
        full = np.flatnonzero(counts)
        if len(full):
            out[full] = np.maximum.reduceat(runs, words.ranges[:-1][full])
        return out

    data, bounds = words.data, words.bounds
    counts = np.diff(words.ranges)
    n = np.maximum(counts, 1)
    flags = {name: table[data] for name, table in _TABLES.items()}
    seen = {name: per_text(f, bounds) for name, f in flags.items()}
    size = np.maximum(np.diff(bounds), 1)
    letters = np.maximum(seen["upper"] + seen["lower"], 1)
    repeated = np.zeros(len(words.hashes), dtype=bool)
    repeated[1:] = words.hashes[1:] == words.hashes[:-1]
    repeated[words.ranges[:-1][counts > 0]] = False
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((words.hashes, owner))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])

    def word_flags(name: str, most: float) -> np.ndarray:
        if not len(words.starts):
            return np.zeros(0, dtype=bool)
        return np.add.reduceat(flags[name].astype(np.int32), words.starts) > most * words.lengths

    return np.column_stack(
        [
            seen["upper"] / letters,
            seen["symbol"] / size,
            seen["digit"] / size,
            seen["high"] / size,
            seen["exclaim"] / n,
            seen["bar"] / n,
            seen["stop"] / n,
            seen["line"] / n,
            per_text(repeated, words.ranges) / n,
            per_text(fresh, words.ranges) / n,
            np.log1p(counts),
            per_text(~SPACE[data], bounds) / n,
            worst(word_flags("upper", 0.5)),
            worst(word_flags("symbol", 0.0)),
            worst(repeated),
            worst(word_flags("bar", 0.0)),
        ]
    )


def feature_rows(texts: pa.Array) -> np.ndarray:
    parts = [features(Words(piece)) for _, piece in pieces(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Additive:
    """Cut points per feature, a table per feature, and tables of feature pairs over coarser cuts."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cut, rows[:, j], side="right")]
        for i, j, table in self.pairs:
            total += table[
                np.searchsorted(self.coarse[i], rows[:, i], side="right"),
                np.searchsorted(self.coarse[j], rows[:, j], side="right"),
            ]
        return total

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(rows)))


RIDGE = 2.0


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best single cut of ordered bins with gradient and curvature sums."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf value of each bin for a tree of at most ``depth`` levels."""
    gain, at = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the better two-level tree: a cut of one feature, then one of the other on each side."""
    best = (0.0, np.zeros(g.shape))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        root, at = _best_cut(a.sum(1), b.sum(1))
        if root <= 0:
            continue
        out, gain = np.zeros(a.shape), root
        for side in (slice(0, at), slice(at, None)):
            ga, ha = a[side].sum(0), b[side].sum(0)
            more, _ = _best_cut(ga, ha)
            gain += max(more, 0.0)
            out[side] = _tree(ga, ha, 1)
        if gain > best[0]:
            best = (gain, out.T if turned else out)
    return best


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = 150, step: float = 0.1, pairs: int = 6) -> Additive:
    """The model of the labelled feature rows; with fewer than two classes, a constant of their smoothed rate."""
    rate = (labels.sum() + 1) / (len(labels) + 2)
    model = Additive(float(np.log(rate / (1 - rate))))
    if len(np.unique(labels)) < 2:
        return model
    for j in range(rows.shape[1]):
        model.cuts.append(np.unique(np.quantile(rows[:, j], np.linspace(0, 1, 65)[1:-1])))
        model.coarse.append(np.unique(np.quantile(rows[:, j], np.linspace(0, 1, 9)[1:-1])))
        model.tables.append(np.zeros(len(model.cuts[j]) + 1))
    bins = [np.searchsorted(c, rows[:, j], side="right") for j, c in enumerate(model.cuts)]
    margin = np.full(len(rows), model.base)

    def push(where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return np.bincount(where, labels - p, size), np.bincount(where, p * (1 - p), size)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            change = step * _tree(*push(bins[j], len(table)), depth=2)
            table += change
            margin += change[bins[j]]
    coarse = [np.searchsorted(c, rows[:, j], side="right") for j, c in enumerate(model.coarse)]
    shapes = [len(c) + 1 for c in model.coarse]

    def cells(i: int, j: int) -> np.ndarray:
        return coarse[i] * shapes[j] + coarse[j]

    def pair_tree(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = push(cells(i, j), shapes[i] * shapes[j])
        return _pair_tree(g.reshape(shapes[i], shapes[j]), h.reshape(shapes[i], shapes[j]))

    gains = {(i, j): pair_tree(i, j)[0] for i in range(len(shapes)) for j in range(i)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
    model.pairs = [(i, j, np.zeros((shapes[i], shapes[j]))) for i, j in chosen]
    for _ in range(rounds // 3):
        for i, j, table in model.pairs:
            change = step * pair_tree(i, j)[1]
            table += change
            margin += change.ravel()[cells(i, j)]
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = 10_000, without: tuple[int, int] = (3, 1)) -> Additive:
    """Fit on at most ``rows`` labelled documents of each class outside the held-out fold.

    Features are made on the executors; the driver sees ``2 * rows`` short feature rows at most.
    """

    @F.arrow_udf("array<double>")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array(list(feature_rows(texts)), pa.list_(pa.float64()))

    sample = training_sample(docs, labels, "quality", rows, without).select("doc_id", "label", made("text").alias("f"))
    found = sample.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    matrix = np.array(found["f"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(matrix, np.array(found["label"].to_pylist(), dtype=float))


def quality_score(model: Additive, text: Column) -> Column:
    """Score of 0 to 1 for a whole text; a null text is an empty one."""
    carried = model

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(carried.score(feature_rows(texts)))

    return score(text)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text, ...).

    Trained on ``labels`` (doc_id, quality) without fold 1 of 3. Other columns of either table are not read.
    Empty and null texts get the score of an empty text, repeated rows equal scores, a null doc_id is not held
    out. Without labels every score is 0.5.
    """
    model = train(docs, labels)
    return (
        docs.select("doc_id", quality_score(model, F.col("text")).alias("score"))
        .withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)))
        .select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    )
