"""Secret scan in SQL functions: known forms, and sliding-window entropy over candidate strings.

Every kind is found leftmost and non-overlapping over the whole text, with spans in code points. A candidate
string is a run of one character class; a window of WINDOW characters slides over it and keeps the counts of its
characters, of which one goes down and one up per step, so the entropy follows from four terms a step. A
candidate with a window at or above the threshold of its class is a secret, unless the allow-list suppresses it
or a known form already covers it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicklens.functions.plan import evaluated_once

# The known forms, with the group whose length counts (0: the match) and its least length. A run
# of characters carries its least length in the pattern: a run is found from its start, so nothing else changes.
FORMS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}

WINDOW = 20

# Character classes of candidate strings: alphabet, the same as a pattern, and bits that a window must reach.
CLASSES = {
    "entropy_hex": ("0123456789ABCDEFabcdef", "[0-9A-Fa-f]", 3.0),
    "entropy_base64": (
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
        "[A-Za-z0-9+/_=-]",
        3.7,
    ),
}

# Strings of these forms are no secrets. Each is found by characters that it must not or must have, or at a fixed
# length: a repeated group would be walked by recursion, once for each part of a long path.
def _allowed(value: Column) -> Column:
    words = ~value.rlike("[^A-Za-z_/+=-]") & ~value.rlike("[a-z][A-Z]")  # words and paths of words
    numbers = ~value.rlike("[^0-9_/+=-]")  # numbers, dates, rules
    public = value.rlike("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")
    return words | numbers | public | value.rlike("EXAMPLE|example|XXXX|xxxx")  # identifiers, placeholders


KINDS = [*FORMS, *CLASSES]
_NONE = "CAST(array() AS array<struct<start: int, end: int, value: string, size: int>>)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _distances(least_size: Callable[[Column], Column]) -> Column:
    return F.filter(F.array(*[F.lit(1 << i) for i in range(31)]), least_size)


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running sum (or maximum) of an array by doubling: every step reaches twice as far back."""

    def all_steps(first: Column) -> Column:
        def step(found: Column, back: Column) -> Column:
            return F.transform(
                found, lambda v, i: F.when(i >= back, combine(v, F.get(found, i - back))).otherwise(v)
            )

        return F.aggregate(_distances(lambda d: d < F.size(first)), first, step)

    return _let(values, all_steps)


def _spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Matches as structs of start, end, value and size, where size counts the group's characters.

    \\G makes each search start where the last one ended, so a text is read once and the gaps between the
    matches give their places.
    """
    whole = F.lit(rf"\G(?s)(.*?)({pattern})")
    parts = F.arrays_zip(
        F.regexp_extract_all(text, whole, F.lit(1)).alias("gap"),
        F.regexp_extract_all(text, whole, F.lit(2)).alias("hit"),
        F.regexp_extract_all(text, whole, F.lit(2 + group)).alias("counted"),
    )

    def located(found: Column) -> Column:
        steps = F.transform(found, lambda p: F.length(p["gap"]) + F.length(p["hit"]))

        def place(ends: Column) -> Column:
            return F.transform(
                found,
                lambda p, i: F.struct(
                    (F.get(ends, i) - F.length(p["hit"])).alias("start"),
                    F.get(ends, i).alias("end"),
                    p["hit"].alias("value"),
                    F.length(p["counted"]).alias("size"),
                ),
            )

        return _let(_running(steps, lambda a, b: a + b), place)

    return F.when(text.rlike(pattern), F.filter(_let(parts, located), lambda s: s["size"] >= least)).otherwise(
        F.expr(_NONE)
    )


def _covered(spans: Column, s: Column) -> Column:
    """Whether one of the sorted, separate spans covers ``s``: only the last that begins no later can."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        open_, below = state["low"] < state["high"], F.get(spans, middle)["start"] <= s["start"]
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(open_ & ~below, middle).otherwise(state["high"]).alias("high"),
        )

    first = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    count = F.aggregate(_distances(lambda d: d <= F.size(spans)), first, halve, lambda state: state["low"])
    return F.coalesce(F.get(spans, count - 1)["end"] >= s["end"], F.lit(False))


# Counts of a window are packed, so many to a long.
_BITS, _PACKED = 5, 12


def window_entropy(value: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of a string's windows; a shorter string is one window."""
    if window >= 1 << _BITS:
        raise ValueError("a window must fit its packed counts")

    def weight(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    longs = len(alphabet) // _PACKED + 1
    packed, none = F.lit(_PACKED), F.lit(0).cast("long")

    def slot(c: Column) -> Column:
        return F.call_function("div", c, packed).cast("int")

    def bits(c: Column) -> Column:
        return F.pmod(c, packed) * _BITS

    def one(c: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), bits(c))

    def largest(codes: Column) -> Column:
        def step(state: Column, code: Column) -> Column:
            # The character that leaves is counted out, then the new one is counted in.
            at = state["at"] + 1
            old = F.when(state["at"] >= window, F.get(codes, state["at"] - window)).otherwise(F.lit(0))

            def count(c: Column) -> Column:
                found = F.call_function("shiftright", F.get(state["counts"], slot(c)), bits(c))
                return found.bitwiseAND((1 << _BITS) - 1).cast("int")

            n_old = count(old)
            less = F.when(old > 0, state["sum"] - weight(n_old) + weight(n_old - 1)).otherwise(state["sum"])
            n_new = count(code) - F.when(old == code, 1).otherwise(0)
            total = less - weight(n_new) + weight(n_new + 1)
            counts = F.transform(
                state["counts"],
                lambda n, j: n
                + F.when(j == slot(code), one(code)).otherwise(none)
                - F.when((old > 0) & (j == slot(old)), one(old)).otherwise(none),
            )
            width = F.least(at, F.lit(window))
            entropy = F.log2(width.cast("double")) - total / width
            full = (at >= window) | (at == F.size(codes))
            return F.struct(
                counts.alias("counts"),
                total.alias("sum"),
                at.alias("at"),
                F.when(full, F.greatest(state["best"], entropy)).otherwise(state["best"]).alias("best"),
            )

        first = F.struct(
            F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"),
            F.lit(0.0).alias("sum"),
            F.lit(0).alias("at"),
            F.lit(0.0).alias("best"),
        )
        return F.aggregate(codes, first, step, lambda s: s["best"])

    letters = F.filter(F.split(value, ""), lambda c: c != "")
    return _let(F.transform(letters, lambda c: F.instr(F.lit(alphabet), c)), largest)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_all``: arrays of (start, kind number, end, kind), in order.

    ``_base`` has the known forms alone. A null text has no secrets.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = evaluated_once(
        docs.withColumns({f"_{kind}": _spans(text, *form) for kind, form in FORMS.items()}).withColumns(
            {f"_{kind}": _spans(text, f"{run}{{{WINDOW},}}", 0, WINDOW) for kind, (_, run, _) in CLASSES.items()}
        )
    )

    def placed(kind: str) -> Column:
        return F.transform(
            f"_{kind}",
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(KINDS.index(kind)).alias("kind_no"),
                s["end"].alias("end"),
                F.lit(kind).alias("kind"),
            ),
        )

    rows = evaluated_once(rows.withColumn("_base", F.sort_array(F.concat(*[placed(k) for k in FORMS]))))
    def suspect(alphabet: str, least: float) -> Callable[[Column], Column]:
        return lambda s: (
            ~_allowed(s["value"])
            & ~reduce(or_, [_covered(F.col(f"_{kind}"), s) for kind in FORMS])
            & (window_entropy(s["value"], alphabet) >= least)
        )

    rows = rows.withColumns({f"_{k}": F.filter(f"_{k}", suspect(a, least)) for k, (a, _, least) in CLASSES.items()})
    rows = evaluated_once(rows).withColumn("_all", F.sort_array(F.concat("_base", *[placed(k) for k in CLASSES])))
    return evaluated_once(rows.drop(*[f"_{k}" for k in KINDS]))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of ``docs`` (doc_id, text, ...).

    base_sha256 is over the kind:start:end of the known forms by start and kind, spans lists all kinds
    alike. A null or empty text has no spans and the hash of an empty string; repeated rows give equal rows;
    other columns are not read.
    """

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")

    return find_secrets(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in FORMS],
        F.sha2(_listed("_base"), 256).alias("base_sha256"),
        _listed("_all").alias("spans"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``mark`` and, where there is one, n_chars to match.

    Overlapping and touching spans become one mark. Texts without secrets stay as they are, null stays null,
    and all columns keep their names, order and types.
    """
    block = 256  # a substring is searched from the start of its text, so the text is cut into blocks first

    def cut(blocks: Column, first: Column, end: Column) -> Column:
        """The characters from ``first`` to before ``end``, of one block or of several."""
        a, b = F.floor(first / block).cast("int"), F.floor(end / block).cast("int")
        head, tail = F.coalesce(F.get(blocks, a), F.lit("")), F.coalesce(F.get(blocks, b), F.lit(""))
        inside = F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0)))
        rest = F.concat(
            F.substring(head, first - a * block + 1, F.lit(block)),
            F.array_join(inside, ""),
            F.substring(tail, F.lit(1), end - b * block),
        )
        return F.when(a == b, F.substring(head, first - a * block + 1, end - first)).otherwise(rest)

    def marked(blocks: Column) -> Column:
        def joined(ends: Column) -> Column:
            gaps = F.transform(
                "_all", lambda s, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(-1)).alias("at"), s["start"].alias("to"))
            )
            gaps = F.filter(gaps, lambda g: g["to"] > g["at"])
            pieces = F.transform(gaps, lambda g: F.concat(cut(blocks, F.greatest(g["at"], F.lit(0)), g["to"]), F.lit(mark)))
            return F.concat(F.array_join(pieces, ""), cut(blocks, F.element_at(ends, -1), F.length("text")))

        return _let(_running(F.transform("_all", lambda s: s["end"]), F.greatest), joined)

    clean = _let(F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), marked)
    rows = find_secrets(docs)
    changed = F.size("_all") > 0
    rows = evaluated_once(rows.withColumn("text", F.when(changed, clean).otherwise(F.col("text"))))
    if "n_chars" in docs.columns:
        count = F.when(changed, F.length("text")).otherwise(F.col("n_chars"))
        rows = rows.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
