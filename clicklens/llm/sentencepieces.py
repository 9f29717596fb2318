"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

Reads the pieces and scores of a given model file and segments by the best sum of scores. The automaton reports
every piece that ends at a position by following its output links, and each of them relaxes the best score of
that position, so a text is read once. Characters outside the pieces are spelled in byte pieces where the model
has them, at the cost of an unknown character. Ties go to the segmentation whose last piece is longest. White
space is escaped as the model says, and decoding gives back the exact text.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicklens.llm.textbytes import pieces

MARK = "▁"
MEMO = 400_000
UNKNOWN_PENALTY = 10.0


def model_pieces(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """The (piece, score, type) rows of a model file, and whether it puts a space before a text.

    Types: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
        raise ValueError("only models that leave the text as it is can be decoded exactly")
    return [(p.piece, p.score, p.type) for p in model.pieces], spec.add_dummy_prefix


class Codec:
    """Encoder and decoder of one model. Words are encoded once per process and memo of bounded size."""

    def __init__(self, rows: list[tuple[str, float, int]], prefix: bool) -> None:
        self.rows, self.prefix = rows, prefix
        self.unknown = next((i for i, r in enumerate(rows) if r[2] == 2), -1)
        self.bytes = {int(r[0][3:5], 16): i for i, r in enumerate(rows) if r[2] == 6}
        self.automaton = ahocorasick.Automaton()
        scores = [r[1] for r in rows if r[2] in (1, 4)]
        self.floor = min(scores, default=0.0) - UNKNOWN_PENALTY
        for i, (piece, score, kind) in enumerate(rows):
            if kind in (1, 4) and piece:
                self.automaton.add_word(piece, (len(piece), score, i))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.single = {r[0] for r in rows if r[2] in (1, 4) and len(r[0]) == 1}
        # No piece goes on from text into a space, so words are independent of each other.
        self.by_word = not any(MARK in r[0].lstrip(MARK) for r in rows if r[2] in (1, 4))
        self.memo: dict[str, list[int]] = {}

    def segment(self, text: str) -> list[tuple[int, int]]:
        """Best (piece id or -1, length) steps of an escaped text in one pass."""
        n = len(text)
        best, back, size = [0.0] + [-np.inf] * n, [-1] * (n + 1), [1] * (n + 1)
        plain = self.single.issuperset(text)
        done = 0

        def settle(end: int) -> None:
            """Complete the positions up to ``end``: a character that is no piece may be an unknown one."""
            nonlocal done
            while done < end:
                done += 1
                value = best[done - 1] + self.floor
                if value > best[done] and text[done - 1] not in self.single:
                    best[done], back[done], size[done] = value, -1, 1

        # Pieces with the same end come longest first, so the first of equal scores stays.
        for last, (length, score, piece) in self.automaton.iter(text) if len(self.automaton) else ():
            if not plain and done < last:
                settle(last)
            end = last + 1
            value = best[end - length] + score
            if value > best[end]:
                best[end], back[end], size[end] = value, piece, length
        if not plain:
            settle(n)
        steps, at = [], n
        while at:
            steps.append((back[at], size[at]))
            at -= size[at]
        return steps[::-1]

    def _ids(self, text: str) -> list[int]:
        out, at = [], 0
        for piece, length in self.segment(text):
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out.extend(self.bytes[b] for b in text[at : at + length].encode("utf-8"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at += length
        return out

    def encode(self, text: str) -> list[int]:
        """Piece ids of a whole text; an empty text has none."""
        if not text:
            return []
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if not self.by_word:
            return self._ids(text)
        out, memo, marks = [], self.memo, ""
        for k, part in enumerate(text.split(MARK)):
            if k:
                marks += MARK
            if not part:
                continue
            word, marks = marks + part, ""
            ids = memo.get(word)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = memo[word] = self._ids(word)
            out.extend(ids)
        return out + self._ids(marks) if marks else out

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids; control pieces add nothing, broken bytes become U+FFFD."""
        out, raw = [], bytearray()
        for i in ids:
            piece, _, kind = self.rows[i]
            if kind == 6:
                raw.append(int(piece[3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if kind in (1, 4, 5):
                out.append(piece)
            elif kind == 2:
                out.append("⁇")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _coder(model_file: str) -> Callable[[], Codec]:
    """Builds the codec on first use in a task; the pieces of the model travel with the function."""
    rows, prefix = model_pieces(model_file)
    built: list[Codec] = []

    def get() -> Codec:
        if not built:
            built.append(Codec(rows, prefix))
        return built[0]

    return get


def encode_pieces(docs: DataFrame, model_file: str, column: str = "text", ids: str = "piece_ids") -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``n_pieces`` (long) and ``round_trip`` (boolean) added.

    round_trip says that decoding the ids gives the text back; it is false only for a text that holds the
    space mark U+2581 itself, which decodes to a space. Null and empty texts have no pieces. Columns of the
    same names are replaced, others kept as they are; ties and repeated rows encode alike. The model file is
    read on the driver (its size is that of a vocabulary) and travels with the function.
    """
    get = _coder(model_file)
    kind = f"struct<{ids}: array<int>, n_pieces: bigint, round_trip: boolean>"

    @F.arrow_udf(kind)
    def encoded(texts: pa.Array) -> pa.Array:
        coder = get()
        flat, sizes, same = [], [], []
        for _, part in pieces(texts):
            own = []
            for text in part.to_pylist():
                text = text or ""
                found = coder.encode(text)
                own.extend(found)
                sizes.append(len(found))
                same.append(coder.decode(found) == text)
            flat.append(np.array(own, dtype=np.int32))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
        values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, values), pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())],
            [ids, "n_pieces", "round_trip"],
        )

    kept = [c for c in docs.columns if c.lower() not in (ids.lower(), "n_pieces", "round_trip")]
    # The generator keeps the encoder from running once per field.
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(encoded(F.col(column)))))


def decode_pieces(rows: DataFrame, model_file: str, ids: str = "piece_ids", column: str = "text") -> DataFrame:
    """``rows`` with ``column`` decoded from ``ids``; null ids give an empty text, unknown ids an error."""
    get = _coder(model_file)

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        coder = get()
        return pa.array([coder.decode(x or []) for x in lists.to_pylist()], pa.string())

    return rows.withColumn(column, decoded(F.col(ids)))
