"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

The leaves of a tree are runs of whole pre-tokens of about LEAF characters, cut where a pre-token surely begins
(a space after a non-space and before a letter), so the token count of a text is the sum of its leaves. An edit
re-encodes the leaves it touches and one on either side as boundary context, cut anew, and updates the sums
above; everything else keeps its counts.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicklens.llm.textbytes import pieces

LEAF = 256

# Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = regex.compile(r"(?<=\S) (?=\p{L})")


def rank_encoding(lines: bytes, pattern: str):
    """A byte-pair encoding from the lines of base64 tokens and ranks of a vocabulary file."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def leaves(text: str) -> list[str]:
    """The text in runs of whole pre-tokens of LEAF characters or a little more; none for an empty text."""
    out, at, n = [], 0, len(text)
    while at < n:
        found = _CUT.search(text, at + LEAF) if at + LEAF < n else None
        end = found.start() if found else n
        out.append(text[at:end])
        at = end
    return out


class CountTree:
    """Leaves with their characters and token counts, and the sums of both over a complete binary tree.

    ``sums[1]`` is the root and the children of node i are 2i and 2i + 1. ``encoded`` counts the characters
    that were encoded and ``updated`` the inner sums that were rewritten since the tree was built.
    """

    def __init__(self, text: str, count: Callable[[list[str]], list[int]]) -> None:
        self.count = count
        self.parts = leaves(text)
        self._plant(count(self.parts))
        self.encoded = self.updated = 0

    def _plant(self, tokens: list[int]) -> None:
        self.width = 1
        while self.width < max(len(self.parts), 1):
            self.width *= 2
        pad = [(0, 0)] * (self.width - len(self.parts))
        self.sums = [(0, 0)] * self.width + [(len(p), t) for p, t in zip(self.parts, tokens)] + pad
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        (a, x), (b, y) = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a + b, x + y)

    @property
    def chars(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, and where it begins (the last leaf for the end)."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if position - begin >= self.sums[i][0] and self.sums[i + 1][0]:
                begin += self.sums[i][0]
                i += 1
        return i - self.width, begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to ``end`` (exclusive, both cut to the text) by ``new``."""
        end = min(max(end, start), self.chars)
        start = min(start, end)
        if not self.parts:
            self._replace(0, 0, new)
            return
        first, begin = self.leaf_at(start)
        last, _ = self.leaf_at(max(end - 1, start))
        if first:  # boundary context: the new text may join what stands before and after it
            first -= 1
            begin -= len(self.parts[first])
        last = min(last + 1, len(self.parts) - 1)
        old = "".join(self.parts[first : last + 1])
        self._replace(first, last + 1, old[: start - begin] + new + old[end - begin :])

    def _replace(self, first: int, last: int, text: str) -> None:
        fresh = leaves(text)
        tokens = self.count(fresh)
        self.encoded += len(text)
        if len(fresh) == last - first:
            self.parts[first:last] = fresh
            for k, (part, t) in enumerate(zip(fresh, tokens)):
                self.sums[self.width + first + k] = (len(part), t)
            touched = {(self.width + k) // 2 for k in range(first, last)}
            while touched and max(touched) > 0:
                for i in touched:
                    self._sum(i)
                self.updated += len(touched)
                touched = {i // 2 for i in touched if i > 1}
            return
        kept = [t for _, t in self.sums[self.width : self.width + len(self.parts)]]
        self.parts[first:last] = fresh
        self._plant(kept[:first] + tokens + kept[last:])  # another number of leaves: sums anew, no encoding
        self.updated += self.width - 1


def edited_counts(
    docs: DataFrame,
    edits: Callable[[str], list[tuple[int, int, str]]],
    rank_file: str,
    pattern: str,
    text: Column | None = None,
) -> DataFrame:
    """(doc_id, n_chars, n_tokens, edited_chars, edited_tokens, encoded_chars, updated_sums) per row of ``docs``.

    ``edits`` gives the edits of a text as (start, end, replacement) in code points, applied in order to what
    the earlier ones left. n_tokens is the count before them and edited_tokens after; encoded_chars says how
    much text the edits had encoded again. The vocabulary file is read on the driver and travels with the function. Null and empty texts have no tokens and may still be edited; repeated
    rows give equal rows; other columns are not read. A text is worked on as a whole inside its row.
    """
    kind = (
        "struct<n_chars: bigint, n_tokens: bigint, edited_chars: bigint, edited_tokens: bigint, "
        "encoded_chars: bigint, updated_sums: bigint>"
    )
    with open(rank_file, "rb") as f:
        lines = f.read()
    built: list = []

    @F.arrow_udf(kind)
    def counted(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(rank_encoding(lines, pattern))
        encode = built[0].encode_ordinary

        def count(parts: list[str]) -> list[int]:
            return [len(encode(p)) for p in parts]

        out = []
        for _, part in pieces(texts):
            for value in part.to_pylist():
                tree = CountTree(value or "", count)
                row = [tree.chars, tree.tokens]
                for start, end, new in edits(value or ""):
                    tree.edit(start, end, new)
                out.append([*row, tree.chars, tree.tokens, tree.encoded, tree.updated])
        names = ["n_chars", "n_tokens", "edited_chars", "edited_tokens", "encoded_chars", "updated_sums"]
        columns = zip(*out) if out else [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select("doc_id", F.inline(F.array(counted(F.col("text") if text is None else text))))


def middle_edit(text: str) -> list[tuple[int, int, str]]:
    """A stated edit: the twentieth of a text after its first third becomes its opening, in upper case."""
    n = len(text)
    return [(n // 3, n // 3 + n // 20, text[: n // 20].upper())]
