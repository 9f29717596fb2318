"""Benchmark decontamination by templates, in SQL functions.

Words become template tokens: numbers, names and units turn into typed placeholders, all else is kept in lower
case without punctuation. Windows of tokens are hash-joined between documents and benchmark items, so an item
with other numbers or names still meets its origin. A bitmap of the benchmark's window hashes, of a fixed size,
keeps all other windows of a document from leaving their row. Windows that line up are then held together: each value
of the item must stand for one value of the document throughout. A window that holds a value that does not is dropped
and its tokens do not count, those of the other windows do; together they must cover enough of the item.

Windows of plain lower-case words go through the same join beside those of template tokens, whatever their share of
placeholders: what is there word for word counts without a look at slots, so neither case nor many numbers hide a copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicklens.functions.plan import evaluated_once
from clicklens.sources.tables import staged

WINDOW = 8
LITERALS = 0.5  # share of a window's tokens that are no placeholders, at least
COVERAGE = 0.5
LEAST_ITEM = 5  # tokens; a shorter item is met word for word only, with other numbers it is a phrase of clean texts
LEAST_PHRASE = 2  # tokens; a shorter item is met by a text that consists of it only
FILTER_BITS = 1 << 20

# Number words and units that become placeholders.
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
half dozen""".split()
UNITS = """mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces
pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days
week weeks month months year years cent cents dollar dollars euro euros percent degree degrees meter meters metre
metres kilometer kilometers kilometre kilometres mph kmh""".split()

_NAME, _NUMBER = "\x01", "\x02"


def _words(text: Column) -> Column:
    """Lower-case words without punctuation; names and numbers carry a mark before them.

    A name is a capitalised word after another word of the same sentence. The tests for a mark begin with the
    character that can start one, so a text costs one step per character and pass.
    """
    text = F.coalesce(text, F.lit(""))
    text = F.regexp_replace(text, r"\p{Lu}(?<=[^\s.!?:]\x20\p{Lu})(?=\p{Ll})", f"{_NAME}$0")
    text = F.regexp_replace(text, r"[0-9](?<![^\s(\[\"'$€£+-][0-9])(?=[0-9.,:/]*(%|st|nd|rd|th)?[^\p{L}\p{N}]*(\s|$))", f"{_NUMBER}$0")
    text = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s\x01\x02]+", "")
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _token(word: Column) -> Column:
    """The template token of a word."""
    mark = F.substring(word, 1, 1)
    return (
        F.when((mark == _NUMBER) | word.isin(NUMBER_WORDS), "<number>")
        .when(mark == _NAME, "<name>")
        .when(word.isin(UNITS), "<unit>")
        .otherwise(word)
    )


def _plain(word: Column) -> Column:
    """The word without its mark."""
    marked = F.contains(word, F.lit(_NAME)) | F.contains(word, F.lit(_NUMBER))
    return F.when(marked, F.translate(word, _NAME + _NUMBER, "")).otherwise(word)


def _is_slot(token: Column) -> Column:
    return token.isin("<number>", "<name>", "<unit>")


def _tokenised(rows: DataFrame) -> DataFrame:
    """``rows`` with words, tokens and plain words, evaluated once."""
    rows = evaluated_once(rows.withColumn("words", _words(F.col("text"))))
    return evaluated_once(rows.withColumns({"tokens": F.transform("words", _token), "plain": F.transform("words", _plain)}))


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with a hash of each token and each plain word; windows are hashed over these, not over strings."""
    return evaluated_once(rows.withColumns({c: F.transform(c, lambda x: F.xxhash64(x)) for c in ("tokens", "plain")}))


def _window_hashes(length: int, column: str) -> Column:
    """Hashes of all windows of ``length`` of ``column``, by position; none if there are fewer tokens."""
    starts = F.when(F.size("tokens") >= length, F.sequence(F.lit(1), F.size("tokens") - length + 1)).otherwise(
        F.expr("CAST(array() AS array<int>)")
    )
    return F.transform(starts, lambda i: F.xxhash64(F.slice(column, i, length)))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, n_tokens, item_at, length, exact, hash, item_words) of every telling window of the items.

    The windows of plain words are ``exact``, and all of them are telling.
    """
    items = _tokenised(benchmark.select("item_id", "text")).withColumn("n_tokens", F.size("tokens"))
    items = items.filter("n_tokens > 0").withColumn("length", F.least(F.lit(window), "n_tokens"))
    starts = F.explode(F.sequence(F.lit(1), F.expr("n_tokens - length + 1")))
    part = items.select("*", starts.alias("item_at")).select(
        "item_id",
        "n_tokens",
        "item_at",
        "length",
        F.expr("slice(tokens, item_at, length)").alias("tokens"),
        F.expr("slice(words, item_at, length)").alias("item_words"),
        F.explode(F.array(F.lit(False), F.lit(True))).alias("exact"),
        F.expr("slice(plain, item_at, length)").alias("plain"),
    )
    literal = F.size(F.filter("tokens", lambda t: ~_is_slot(t)))
    telling = (literal >= F.ceil(F.col("length") * LITERALS)) & (F.col("n_tokens") >= LEAST_ITEM)
    part = _hashed(part.filter(F.col("exact") | telling))
    hashed = F.xxhash64(F.when(F.col("exact"), F.col("plain")).otherwise(F.col("tokens")))
    return part.withColumn("hash", hashed).drop("tokens", "plain").distinct()


def _bitmap(hashes: DataFrame) -> Column:
    """FILTER_BITS bits as a constant array of longs, of which the bits of all ``hash`` values are set.

    Its size is fixed, so it may pass the driver whatever the size of the benchmark.
    """
    word = F.shiftright(F.pmod("hash", F.lit(FILTER_BITS)), 6).cast("int")
    set_bits = F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(hash, {FILTER_BITS}) & 63 as int))"))
    words = dict(hashes.groupBy(word.alias("word")).agg(set_bits).collect())
    listed = ",".join(str(words.get(i, 0)) for i in range(FILTER_BITS // 64))
    return F.split(F.lit(listed), ",").cast("array<bigint>")  # folded into one constant


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, _text_hash, item_id, coverage, slots, changed) of the items that documents contain."""
    items = staged(item_windows(benchmark, window), "template-windows")
    kinds = items.select("length", "exact").distinct().orderBy("length", "exact").collect()  # at most 2 * ``window``
    bits = _bitmap(items.select("hash"))
    rows = _hashed(_tokenised(docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), "text"))).drop("text")

    def known(h: Column) -> Column:
        place = F.pmod(h, F.lit(FILTER_BITS))
        word = F.get(bits, F.shiftright(place, 6).cast("int"))
        return F.getbit(word, place.bitwiseAND(63).cast("int")) == 1

    def placed(length: int, exact: bool) -> Column:
        """The known windows of a row; a place is made only for those."""
        places = F.transform(
            _window_hashes(length, "plain" if exact else "tokens"),
            lambda h, i: F.when(
                known(h),
                F.struct(h.alias("hash"), (i + 1).alias("at"), F.lit(length).alias("length"), F.lit(exact).alias("exact")),
            ),
        )
        return F.filter(places, lambda p: p.isNotNull())

    none = F.expr("CAST(array() AS array<struct<hash: bigint, at: int, length: int, exact: boolean>>)")
    found = F.concat(none, *[placed(*kind) for kind in kinds])
    hits = rows.withColumn("hits", found).select(
        "doc_id",
        "_text_hash",
        F.size("words").alias("n_words"),
        F.explode(
            F.transform(
                "hits",
                lambda h: F.struct(
                    h["hash"], h["at"], h["length"], h["exact"], F.slice("words", h["at"], h["length"]).alias("words")
                ),
            )
        ).alias("h"),
    )
    met = hits.select("doc_id", "_text_hash", "n_words", "h.*").join(items, ["hash", "length", "exact"])
    met = met.filter((F.col("n_tokens") >= LEAST_PHRASE) | (F.col("n_words") == F.col("n_tokens")))
    # Equal hashes of equal tokens only; what is left of a pair of windows is its slots.
    same = lambda f: F.transform("words", f) == F.transform("item_words", f)
    met = met.filter(F.when(F.col("exact"), same(_plain)).otherwise(same(_token)))
    pairs = F.transform(
        F.filter(
            F.zip_with("item_words", "words", lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            lambda p: _is_slot(_token(p["a"])),
        ),
        lambda p: F.struct(_plain(p["a"]).alias("a"), _plain(p["b"]).alias("b")),
    )
    gathered = lambda c, which: F.array_distinct(F.flatten(F.collect_set(F.when(which, F.col(c)))))
    lines = (
        met.select(
            "doc_id",
            "_text_hash",
            "item_id",
            "n_tokens",
            "exact",
            (F.col("at") - F.col("item_at")).alias("line"),
            F.expr("sequence(item_at, item_at + length - 1)").alias("covered"),
            pairs.alias("pairs"),
        )
        .groupBy("doc_id", "_text_hash", "item_id", "n_tokens", "line")
        .agg(
            gathered("covered", F.col("exact")).alias("exact"),
            gathered("pairs", F.col("exact")).alias("exact_pairs"),
            gathered("pairs", ~F.col("exact")).alias("pairs"),
            F.collect_set(F.when(~F.col("exact"), F.struct("covered", "pairs"))).alias("windows"),
        )
    )
    # Sorted by the item's value, pairs of a value that stands for several are neighbours.
    lines = evaluated_once(lines.withColumn("pairs", F.sort_array("pairs")))
    split = F.filter(
        F.transform("pairs", lambda p, i: F.when((i > 0) & (F.get("pairs", i - 1)["a"] == p["a"]), p["a"])),
        lambda v: v.isNotNull(),
    )
    lines = evaluated_once(lines.withColumn("split", F.array_distinct(split)))
    clash = lambda w: F.arrays_overlap(F.transform(w["pairs"], lambda p: p["a"]), "split")
    parts = lambda which, part: F.array_distinct(
        F.flatten(F.transform(F.filter("windows", which), lambda w: w[part]))
    )
    loose = F.array_except(parts(lambda w: ~clash(w), "covered"), parts(clash, "covered"))
    lines = lines.select(
        "doc_id",
        "_text_hash",
        "item_id",
        "n_tokens",
        F.array_union("exact", loose).alias("covered"),
        F.array_union("exact_pairs", parts(lambda w: ~clash(w), "pairs")).alias("pairs"),
    )
    return (
        lines.groupBy("doc_id", "_text_hash", "item_id", "n_tokens")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("covered"),
            F.max(F.size("pairs")).cast("long").alias("slots"),
            F.max(F.size(F.filter("pairs", lambda p: p["a"] != p["b"]))).cast("long").alias("changed"),
        )
        .withColumn("coverage", F.col("covered") / F.col("n_tokens"))
        .filter(F.col("coverage") >= coverage)
        .select("doc_id", "_text_hash", "item_id", "coverage", "slots", "changed")
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, slots, changed): one row per document and benchmark item that it contains.

    coverage is the share of the item's tokens in windows that line up, slots the number of distinct values
    that placeholders stand for and changed how many of them differ from the item's. Clean documents have no
    row. Null, empty and token-less texts and items match nothing; an item shorter than a window must be there
    whole, one of fewer than LEAST_ITEM tokens also word for word, and one of a single word must be all of the text.
    Repeated rows of a document give one row, texts that share a doc_id the row of the better match, and
    rows without a doc_id are reported under null. Other columns are not read.
    """
    return matches(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.max("coverage").alias("coverage"), F.max("slots").alias("slots"), F.max("changed").alias("changed")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item of ``benchmark``, with all their columns."""
    bad = matches(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("_text_hash").alias("_bad")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_bad"))
    return docs.join(bad, same, "left_anti")
