"""Order MinHash fingerprints in SQL functions, sensitive to edit distance.

A k-mer is a run of SPAN words (words are runs of characters other than space and ``\\x09-\\x0D``), numbered by
its occurrence in the text, so that a repeat is a k-mer of its own. The numbered k-mers fall into BINS by their
hash; in each bin the KEPT smallest are selected, put back into text order, and hashed as a tuple. A tuple
changes when a k-mer is edited or when two change places. Likeness is the share of bins whose tuples agree.

A word of more than LONG characters enters as its overlapping pieces of PIECE characters, in turn, so that texts
without white space are sensitive to edits as well.

Taking k-mers of words keeps the arrays of a text as long as its words; the bins come from one hash of each
k-mer, so a text is sorted twice whatever the number of bins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicklens.functions.plan import evaluated_once

SPAN = 2
BINS = 32
KEPT = 2
LONG = 16  # characters; a longer word, or text without white space, is cut into pieces
PIECE = 3
_PLACE_BITS = 24  # text order within 16 million words; later places wrap


def _bin(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - BINS.bit_length() + 1)


def _place(key: Column) -> Column:
    return key.bitwiseAND((1 << _PLACE_BITS) - 1)


def _packed(hashed: Column, place: Column) -> Column:
    """The upper bits of a hash over a place, as one long."""
    high = F.shiftleft(F.shiftrightunsigned(hashed, _PLACE_BITS), _PLACE_BITS)
    return high.bitwiseOR(place.cast("long").bitwiseAND((1 << _PLACE_BITS) - 1))


def fingerprints(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``rows`` with an array of (bin, tuple hash) longs for each of ``columns`` (text column to new column).

    Equal texts have equal arrays. A null or blank text has an empty one; a text of fewer than SPAN words
    (pieces of a long word count as words) is one k-mer. Sorted by bin.
    """

    def each(frame: DataFrame, values) -> DataFrame:
        return evaluated_once(frame.withColumns({new: values(F.col(text), F.col(new)) for text, new in columns.items()}))

    def words(text: Column, _: Column) -> Column:
        return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+"), lambda w: w != "")

    def is_long(w: Column) -> Column:
        return (F.octet_length(w) > LONG) & (F.length(w) > LONG)

    def cut(_: Column, ws: Column) -> Column:
        """Pieces in place of long words; the characters are split once, as substring counts from the start."""

        def pieces(w: Column) -> Column:
            def each_place(c: Column) -> Column:
                starts = F.slice(c, 1, F.size(c) - PIECE + 1)
                return F.transform(starts, lambda x, i: F.concat(x, *[F.get(c, i + j) for j in range(1, PIECE)]))

            return F.get(F.transform(F.array(F.split(w, "")), each_place), F.lit(0))

        parts = F.flatten(F.transform(ws, lambda w: F.when(is_long(w), pieces(w)).otherwise(F.array(w))))
        return F.when(F.exists(ws, is_long), parts).otherwise(ws)

    def kmers(_: Column, w: Column) -> Column:
        """Hash over place, sorted, so that the occurrences of a k-mer stand together in text order."""
        runs = F.slice(w, 1, F.greatest(F.size(w) - SPAN + 1, F.least(F.size(w), F.lit(1))))
        hashed = F.transform(
            runs, lambda x, i: _packed(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, SPAN)]), i)
        )
        return F.sort_array(hashed)

    def heads(_: Column, s: Column) -> Column:
        """Where each distinct k-mer begins in the sorted array, kept beside it."""
        same = lambda x, y: F.shiftrightunsigned(x, _PLACE_BITS) == F.shiftrightunsigned(y, _PLACE_BITS)
        marked = F.transform(s, lambda x, j: F.when((j > 0) & same(x, F.get(s, j - 1)), -1).otherwise(j))
        return F.struct(s.alias("s"), F.filter(marked, lambda j: j >= 0).alias("heads"))

    def numbered(_: Column, c: Column) -> Column:
        """Hash of k-mer and occurrence number over place, sorted by bin and hash."""
        s, first = c["s"], c["heads"]

        def occurrences(j: Column, g: Column) -> Column:
            length = F.coalesce(F.get(first, g + 1), F.size(s)) - j
            return F.transform(
                F.slice(s, j + 1, length),
                lambda x, n: _packed(F.xxhash64(F.shiftrightunsigned(x, _PLACE_BITS), n), _place(x)),
            )

        return F.sort_array(F.flatten(F.transform(first, occurrences)))

    def selected(_: Column, keys: Column) -> Column:
        return F.filter(keys, lambda k, j: (j < KEPT) | (_bin(F.get(keys, j - KEPT)) != _bin(k)))

    def tuples(_: Column, picked: Column) -> Column:
        def one(k: Column, j: Column) -> Column:
            group = F.filter(F.slice(picked, j + 1, KEPT), lambda o: _bin(o) == _bin(k))
            ordered = F.array_sort(group, lambda a, b: (_place(a) - _place(b)).cast("int"))
            hashed = F.xxhash64(F.transform(ordered, lambda o: F.shiftrightunsigned(o, _PLACE_BITS)))
            return F.shiftleft(_bin(k), 32).bitwiseOR(hashed.bitwiseAND(0xFFFFFFFF))

        starts = F.transform(
            picked,
            lambda k, j: F.when((j == 0) | (_bin(F.get(picked, F.greatest(j - 1, F.lit(0)))) != _bin(k)), one(k, j)),
        )
        return F.filter(starts, lambda t: t.isNotNull())

    begun = rows.withColumns({new: words(F.col(text), None) for text, new in columns.items()})
    return reduce(each, [cut, kmers, heads, numbered, selected, tuples], evaluated_once(begun))


def as_text(fingerprint: Column) -> Column:
    """Ten hexadecimal digits per bin that has k-mers: its number and its tuple's hash."""
    return F.array_join(F.transform(fingerprint, lambda t: F.lpad(F.lower(F.hex(t)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins used by either text whose tuples agree; two empty fingerprints are alike."""

    def used(x: Column) -> Column:
        return F.transform(x, lambda t: F.shiftrightunsigned(t, 32))

    either = F.size(F.array_union(used(a), used(b)))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(1.0))


ROWS_PER_RANGE = 1024
MAX_RANGES = 1 << 20


def with_next(rows: DataFrame, values: list[str], ids: DataFrame | None = None) -> DataFrame:
    """``rows`` (doc_id, text, ...) with ``next_*`` for each of ``values``, from the next row by (doc_id, text).

    ``ids`` has the doc_ids of ``rows``, for reading them without computing the rest of a row. Null ids come first; after the last row comes the first. Rows are dealt by equal ranges of doc_id of about
    ROWS_PER_RANGE rows, and the first document of each range is dealt to the range before it as well, so
    every range knows its successors without a global sort. The heads of at most MAX_RANGES ranges are
    broadcast, which bounds them to some 20 MB.
    """
    ids = (rows if ids is None else ids).select("doc_id")
    low, high, count = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = (0, 0) if low is None else (low, high)
    ranges = min(MAX_RANGES, count // ROWS_PER_RANGE + 1)
    width = (high - low) // ranges + 1
    of = F.expr(f"coalesce(doc_id - {low}L, 0L) div {width}L")
    dealt = rows.withColumn("_range", of)
    heads = ids.groupBy(of.alias("_range")).agg(F.min(F.coalesce("doc_id", F.lit(low))).alias("_head"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("_range", "_head"))).alias("h")).select(
        F.explode(
            F.transform(
                "h",
                lambda x, i: F.struct(
                    x["_head"].alias("_head"),
                    F.element_at("h", F.when(i == 0, F.size("h")).otherwise(i))["_range"].alias("_before"),
                ),
            )
        ).alias("x")
    )
    heads = heads.select("x.*")
    copied = dealt.join(F.broadcast(heads), F.coalesce("doc_id", F.lit(low)) == F.col("_head"), "left").select(
        *rows.columns,
        F.explode(
            F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_range"), F.lit(False).alias("_extra")))).otherwise(
                F.array(
                    F.struct(F.col("_range"), F.lit(False).alias("_extra")),
                    F.struct(F.col("_before").alias("_range"), F.lit(True).alias("_extra")),
                )
            )
        ).alias("_at"),
    )
    order = Window.partitionBy("_at._range").orderBy("_at._extra", F.col("doc_id").asc_nulls_first(), "text")
    follow = copied.select("*", *[F.lead(v).over(order).alias(f"next_{v}") for v in values])
    return follow.filter(~F.col("_at._extra")).drop("_at")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likeness to the edited and to the next text.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the
    next document by doc_id (after the last: the first). Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next per row of ``docs`` (doc_id, text, ...). A null text is an empty
    one, rows that repeat a doc_id follow each other by text, a single row is its own next, and other columns
    are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(fingerprints(rows, {"text": "mark"}), ["text", "mark"], docs)
    cut = F.expr("length(text) div 4").cast("int")
    rows = rows.withColumn("cut", cut).withColumn(
        "edited",
        F.concat(
            F.substring("text", F.lit(1), F.length("text") - F.col("cut")), F.substring("next_text", F.lit(1), F.col("cut"))
        ),
    )
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "mark", F.col("next_mark").alias("next_mark")
    )
    rows = fingerprints(evaluated_once(rows), {"edited": "edited_mark"})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("mark")).alias("fingerprint"),
        as_text(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )
