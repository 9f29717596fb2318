"""Words and shingles of whole Arrow string batches as numpy arrays.

Works on the UTF-8 bytes of many texts at once, so no text is split into Python strings. A word is a run of
characters other than space and ``\\x09-\\x0D``; A-Z count as a-z in hashes. Nulls are empty texts. Work goes by
``pieces`` of bounded bytes, so that memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute

PIECE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = stream(11, 256)
_BYTE[SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Bytes, word bounds, word hashes and the word range of each text."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = (int(bounds[0]), int(bounds[-1])) if len(texts) else (0, 0)
        self.data = np.frombuffer(data, dtype=np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
        self.bounds = bounds - first if len(texts) else np.zeros(1, np.int64)
        inside = ~SPACE[self.data]
        before = np.zeros(len(self.data), dtype=bool)
        before[1:] = inside[:-1]
        cuts = self.bounds[:-1][self.bounds[:-1] < len(self.data)]
        before[cuts] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.lengths = np.zeros(len(self.starts), np.int64)
        self.hashes = np.zeros(len(self.starts), np.uint64)
        if len(self.starts):
            self.lengths = np.add.reduceat(inside.astype(np.int64), self.starts)
            place = self._place()
            powers = self._powers(int(self.lengths.max()) + 1)
            with np.errstate(over="ignore"):
                value = _BYTE[LOWER[self.data]] * powers[np.minimum(place, len(powers) - 1)]
                self.hashes = mix(np.add.reduceat(value, self.starts) + self.lengths.astype(np.uint64) * _STEP)
        self.ranges = np.searchsorted(self.starts, self.bounds)

    def _place(self) -> np.ndarray:
        place = np.zeros(len(self.data), np.int64)
        tail = len(self.data) - self.starts[0]
        place[self.starts[0] :] = np.arange(tail) - np.repeat(
            self.starts - self.starts[0], np.diff(np.append(self.starts, len(self.data)))
        )
        return place

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.cumprod(np.full(n, 0xD6E8FEB86659FD93, dtype=np.uint64), dtype=np.uint64)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words inside a text, and their range for each text.

        A text with fewer than ``k`` words gives one hash of its whole sequence; one without words gives none.
        """
        h, n = self.hashes, len(self.hashes)
        counts = np.diff(self.ranges)
        ends = np.repeat(self.ranges[1:], counts)
        length = np.minimum(counts, k)[np.repeat(np.arange(len(counts)), counts)]
        keep = np.arange(n) + length <= ends
        at, length = np.flatnonzero(keep), length[keep]
        out = np.full(len(at), 0x51ED270B, dtype=np.uint64) + length.astype(np.uint64)
        for j in range(k):
            live = length > j
            if live.all():
                out = mix(out ^ h[at + j])
            elif live.any():
                out[live] = mix(out[live] ^ h[at[live] + j])
        per = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
        return out, np.concatenate([[0], np.cumsum(per)])


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of about ``limit`` bytes (one text at least), with their first row."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    row, n = 0, len(texts)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    while row < n:
        end = max(row + 1, int(np.searchsorted(total, total[row] + limit, side="right")) - 1)
        yield row, texts.slice(row, end - row)
        row = end
