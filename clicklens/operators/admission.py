"""Click admission: a click is rejected iff it would make clicks exceed impressions.

Per bucket, in the order (occurred_at, event_id), let the slack be impressions minus clicks so far
with every click counted. The number of clicks rejected so far is ``max(0, -min(slack))``, which
needs no sequential loop, only a running sum and a running minimum.

A bucket may hold a third of all events, so its history is never one window group. Both running
values combine over pieces: each (bucket, time slot, range of rows) piece gets its own net change and
lowest point, the pieces of a bucket are scanned in order (one small row per piece), and every event adds
the result of the earlier pieces to its position inside its own. A slot with many events, also at one time, is
cut at quantiles of the order of its rows, found in a sample. Copies of one event are collapsed to a row with a
count before anything is grouped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklens import constants as K
from clicklens.functions.payload import event_json
from clicklens.functions.plan import count_at_most, evaluated_once
from clicklens.operators.counts import is_click, is_impression
from clicklens.operators.model import Model, with_priors
from clicklens.operators.posterior import Trust, bucket_rows, with_posterior

DEFAULT_SLOT_SECONDS = 60

# Rows of a piece, about; a slot with fewer stays whole. Sampled rows between two cuts.
PIECE_ROWS, DRAWS = 65_536, 16

_EVENT = ["event_id", "event_type", *K.BUCKET_KEYS, "occurred_at", "impression_event_id"]
_SLOT = [*K.BUCKET_KEYS, "slot"]
_PIECE = [*_SLOT, "piece"]


@dataclass(frozen=True)
class Admission:
    """Lazy frames of one admission pass.

    ``runs``: one row per distinct event with copies, accepted, rejected and the counts after it.
    ``slots``: one row per bucket, slot and piece. ``totals``: one row per bucket that has any state.
    """

    runs: DataFrame
    slots: DataFrame
    totals: DataFrame


def _order() -> list[Column]:
    # An impression precedes a click of the same time and id.
    return [
        F.col("occurred_at"),
        F.col("event_id"),
        F.col("event_type").desc(),
        F.col("impression_event_id"),
    ]


def _place() -> Column:
    """The same order as one value."""
    kind = F.when(is_impression(), 0).otherwise(1)
    return F.struct("occurred_at", "event_id", kind.alias("kind"), "impression_event_id")


def _with_pieces(slotted: DataFrame, piece_rows: int | None) -> DataFrame:
    """Rows with the number of their piece in their slot; None leaves every slot whole.

    One row in some is sampled by its hash, and every so many of a slot's sampled rows are a cut: most slots have
    none. The cuts are few, so their join is left to the size check; the rows are then dealt by piece.
    """
    if piece_rows is None:
        return slotted.withColumn("piece", F.lit(0))
    rows = evaluated_once(slotted)  # the sample must not filter below, which would read the events again
    sample = rows.filter(F.pmod(F.xxhash64(*_EVENT), F.lit(max(1, piece_rows // DRAWS))) == 0)
    number = F.row_number().over(W.partitionBy(*_SLOT).orderBy(*_order()))
    cuts = (
        sample.select(*_SLOT, _place().alias("_cut"), number.alias("_number"))
        .filter(F.col("_number") % DRAWS == 0)
        .groupBy(*_SLOT)
        .agg(F.array_sort(F.collect_list("_cut")).alias("_cuts"))
    )
    piece = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(count_at_most(F.col("_cuts"), _place()))
    return rows.join(cuts, _SLOT, "left").withColumn("piece", piece).drop("_cuts").repartition(*_PIECE)


def _rejected(low: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), -low)


def collapse_copies(events: DataFrame) -> DataFrame:
    """Identical events to one row with ``copies``; the copies combine before the shuffle."""
    return events.groupBy(*_EVENT).agg(F.count("*").alias("copies"))


def _with_slot(rows: DataFrame, slot_seconds: float) -> DataFrame:
    """Rows of known buckets and times, with the number of their time slot."""
    width = int(slot_seconds * 1_000_000)
    if width <= 0:
        raise ValueError("slot width must be positive")
    micros = "unix_micros(occurred_at)"
    slotted = rows.withColumn(
        "slot", F.expr(f"{micros} div {width} - if({micros} % {width} < 0, 1, 0)")
    )
    # Always true for valid events. Stated once here, because the join of admission would add it to one
    # of its two readers only, and the shuffle could then not be shared between them.
    return slotted.filter(" AND ".join(f"{c} IS NOT NULL" for c in _SLOT))


def _opened(slots: DataFrame, start: DataFrame | None) -> DataFrame:
    """Slots or pieces with the stored counts of their bucket."""
    if start is None:
        return slots.withColumns(
            {"_imp0": F.lit(0).cast("bigint"), "_clk0": F.lit(0).cast("bigint")}
        )
    counts = start.select(
        *K.BUCKET_KEYS, F.col("impressions").alias("_imp0"), F.col("clicks").alias("_clk0")
    )
    return slots.join(counts, K.BUCKET_KEYS, "left").fillna(0, ["_imp0", "_clk0"])


def screened_slots(
    events: DataFrame, start: DataFrame | None = None, slot_seconds: float = DEFAULT_SLOT_SECONDS
) -> DataFrame:
    """One row per bucket and slot: net, shown, events, and whether it is ``quiet``, from counts alone.

    In a quiet slot no click can be rejected, in whatever order its rows come: with all its clicks first the slack
    stays at or above zero, or above a value that it had at the end of an earlier slot. Only the rows of other
    slots need their order, see ``admit_clicks``.
    """
    slotted = _with_slot(events.select(*K.BUCKET_KEYS, "event_type", "occurred_at"), slot_seconds)
    slots = slotted.groupBy(*_SLOT).agg(F.count_if(is_impression()).alias("shown"), F.count("*").alias("events"))
    slots = slots.withColumn("net", F.col("shown") * 2 - F.col("events"))
    ordered = W.partitionBy(*K.BUCKET_KEYS).orderBy("slot")
    earlier = ordered.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    ended = F.col("_imp0") - F.col("_clk0") + F.sum("net").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    clicks = F.col("events") - F.col("shown")
    return (
        _opened(slots, start)
        .withColumn("_ended", ended)
        .withColumn("_reached", F.least(zero, F.min("_ended").over(earlier)))
        .select(*_SLOT, "net", "shown", "events", (F.col("_ended") - F.col("net") - clicks >= F.col("_reached")).alias("quiet"))
    )


def in_slots(events: DataFrame, slots: DataFrame, slot_seconds: float = DEFAULT_SLOT_SECONDS) -> DataFrame:
    """The events that lie in some slots, which are joined by the size check."""
    return _with_slot(events, slot_seconds).join(slots.select(*_SLOT), _SLOT, "left_semi").drop("slot")


def admit_clicks(
    events: DataFrame,
    start: DataFrame | None = None,
    slot_seconds: float = DEFAULT_SLOT_SECONDS,
    distinct_events: bool = False,
    piece_rows: int | None = PIECE_ROWS,
    quiet: DataFrame | None = None,
) -> Admission:
    """Admit impressions and clicks on top of the counts in ``start`` (keys, impressions, clicks).

    ``distinct_events`` says that no event occurs twice and saves the shuffle that collapses
    copies. ``slot_seconds`` and ``piece_rows`` bound the piece of a bucket that one task sorts; they never change
    the result. Without ``piece_rows`` a slot is one piece, for inputs known to be small.

    ``quiet`` holds slots of ``screened_slots`` whose rows are not among ``events``: they count in ``slots`` and
    ``totals``, and the rows of ``runs`` are those of the other slots, which hold every rejected click.
    """
    runs = (
        events.select(*_EVENT, F.lit(1).cast("bigint").alias("copies"))
        if distinct_events
        else collapse_copies(events)
    )
    sign = F.when(is_impression(), F.col("copies")).otherwise(-F.col("copies"))
    shown = F.when(is_impression(), F.col("copies")).otherwise(F.lit(0).cast("bigint"))
    inside = W.partitionBy(*_PIECE).orderBy(*_order())
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    placed = (
        _with_pieces(_with_slot(runs, slot_seconds), piece_rows)
        .withColumn("_slack", F.sum(sign).over(so_far))
        .withColumn("_shown", F.sum(shown).over(so_far))
        .withColumn("_low", F.min("_slack").over(so_far))
        .withColumn("_low_before", F.min("_slack").over(before))
    )

    slots = placed.groupBy(*_PIECE).agg(
        F.sum(sign).alias("net"),
        F.sum(shown).alias("shown"),
        F.min("_low").alias("low"),
        F.sum("copies").alias("events"),
    )
    if quiet is not None:
        slots = slots.unionByName(
            quiet.select(*_SLOT, F.lit(0).alias("piece"), "net", "shown", F.lit(None).cast("bigint").alias("low"), "events")
        )
    opened = _opened(slots, start)
    # One row per piece: the window below is bounded by elapsed time and by events over the rows of a piece.
    ordered = W.partitionBy(*K.BUCKET_KEYS).orderBy("slot", "piece")
    earlier = ordered.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    scanned = (
        opened.withColumns(
            {
                "_slack0": F.col("_imp0") - F.col("_clk0") + F.coalesce(F.sum("net").over(earlier), zero),
                "_shown0": F.col("_imp0") + F.coalesce(F.sum("shown").over(earlier), zero),
            }
        )
        .withColumn("_low0", F.min(F.col("_slack0") + F.col("low")).over(earlier))
        .withColumn("_low1", F.least(F.col("_low0"), F.col("_slack0") + F.col("low")))
    )

    joined = placed.join(
        scanned.select(*_PIECE, "_slack0", "_shown0", "_low0"), _PIECE
    )
    low = F.least(F.col("_low0"), F.col("_slack0") + F.col("_low"))
    low_before = F.least(F.col("_low0"), F.col("_slack0") + F.col("_low_before"))
    detailed = (
        joined.withColumn("_rejected", F.coalesce(_rejected(low), zero))
        .withColumn("rejected", F.col("_rejected") - F.coalesce(_rejected(low_before), zero))
        .withColumn("impressions_after", F.col("_shown0") + F.col("_shown"))
    )
    # slack = impressions - all clicks, so accepted clicks = impressions - slack - rejected.
    admitted = detailed.select(
        *_EVENT,
        "slot",
        "piece",
        "copies",
        (F.col("copies") - F.col("rejected")).alias("accepted"),
        "rejected",
        "impressions_after",
        (
            F.col("impressions_after") - (F.col("_slack0") + F.col("_slack")) - F.col("_rejected")
        ).alias("clicks_after"),
    )

    totals = (
        scanned.groupBy(*K.BUCKET_KEYS)
        .agg(
            F.sum("shown").alias("_new_imp"),
            F.sum(F.col("shown") - F.col("net")).alias("_new_clk"),
            _rejected(F.min("_low1")).alias("rejected"),
            F.sum("events").alias("events"),
            F.max("_imp0").alias("_imp0"),
            F.max("_clk0").alias("_clk0"),
        )
        .select(
            *K.BUCKET_KEYS,
            (F.col("_imp0") + F.col("_new_imp")).alias("impressions"),
            (F.col("_clk0") + F.col("_new_clk") - F.col("rejected")).alias("clicks"),
            F.col("rejected"),
            (F.col("events") - F.col("rejected")).alias("accepted"),
        )
        # A bucket that saw nothing but rejected clicks is neither created nor changed.
        .filter("accepted > 0")
    )
    return Admission(admitted, scanned, totals)


def totals_of(runs: DataFrame, start: DataFrame | None, quiet: DataFrame | None = None) -> DataFrame:
    """The totals of an admission pass whose ``runs`` are already at hand, with its ``quiet`` slots."""
    zero = F.lit(0).cast("bigint")
    new = runs.groupBy(*K.BUCKET_KEYS).agg(
        F.coalesce(F.sum(F.when(is_impression(), F.col("accepted"))), zero).alias("impressions"),
        F.coalesce(F.sum(F.when(is_click(), F.col("accepted"))), zero).alias("clicks"),
        F.sum("rejected").alias("rejected"),
        F.sum("accepted").alias("accepted"),
    )
    if quiet is not None:
        clicks = F.col("events") - F.col("shown")
        still = quiet.groupBy(*K.BUCKET_KEYS).agg(
            F.sum("shown").alias("impressions"),
            F.sum(clicks).alias("clicks"),
            F.lit(0).cast("bigint").alias("rejected"),
            F.sum("events").alias("accepted"),
        )
        counted = ["impressions", "clicks", "rejected", "accepted"]
        new = new.unionByName(still).groupBy(*K.BUCKET_KEYS).agg(*[F.sum(c).alias(c) for c in counted])
    new = new.filter("accepted > 0")
    if start is None:
        return new
    stored = start.select(
        *K.BUCKET_KEYS, F.col("impressions").alias("_imp0"), F.col("clicks").alias("_clk0")
    )
    return new.join(stored, K.BUCKET_KEYS, "left").select(
        *K.BUCKET_KEYS,
        (F.col("impressions") + F.coalesce("_imp0", zero)).alias("impressions"),
        (F.col("clicks") + F.coalesce("_clk0", zero)).alias("clicks"),
        "rejected",
        "accepted",
    )


def rejected_clicks(admission: Admission) -> DataFrame:
    """Dead letters of rejected clicks. Copies of one event share a row."""
    return admission.runs.filter("rejected > 0").select(
        F.lit(K.REASON_EXCESS_CLICK).alias("reason"),
        event_json().alias("event"),
        F.col("rejected").alias("copies"),
    )


def invalid_dead_letters(invalid: DataFrame) -> DataFrame:
    """Dead letters of event text that failed validation, row by row without a shuffle."""
    return invalid.select(
        F.lit(K.REASON_INVALID).alias("reason"),
        F.to_json(F.struct("raw")).alias("event"),
        F.lit(1).cast("bigint").alias("copies"),
    )


def expand_copies(letters: DataFrame, block: int = 10_000) -> DataFrame:
    """One row per message. Two bounded steps, so no array grows with the number of copies."""
    blocks = letters.select(
        "reason",
        "event",
        "copies",
        F.explode(F.expr(f"sequence(0L, (copies - 1) div {block})")).alias("_block"),
    )
    return blocks.select(
        "reason",
        "event",
        F.explode(
            F.expr(f"sequence(1L, least({block}L, copies - _block * {block}))")
        ).alias("_copy"),
    ).select("reason", "event")


def new_buckets(
    admission: Admission, start: DataFrame | None, model: Model, trust: Trust = Trust()
) -> DataFrame:
    """Bucket rows after admission, for the buckets that changed.

    Priors of known buckets are kept; only buckets without a stored row take them from the model.
    """
    counted = admission.totals.select(*K.BUCKET_KEYS, "impressions", "clicks")
    primed = with_priors(counted, model).drop("prior_ctr")
    if start is not None:
        stored = start.select(
            *K.BUCKET_KEYS,
            F.col("alpha_prior").alias("_alpha"),
            F.col("beta_prior").alias("_beta"),
        )
        primed = primed.join(stored, K.BUCKET_KEYS, "left").select(
            *counted.columns,
            F.coalesce("_alpha", "alpha_prior").alias("alpha_prior"),
            F.coalesce("_beta", "beta_prior").alias("beta_prior"),
        )
    return bucket_rows(primed, trust)


def running_buckets(
    admission: Admission, start: DataFrame | None, model: Model, trust: Trust = Trust()
) -> DataFrame:
    """The bucket row after each accepted event: what a write per event would store."""
    changed = admission.runs.filter("accepted > 0").select(
        "event_id",
        "event_type",
        "occurred_at",
        *_PIECE,
        F.col("impressions_after").alias("impressions"),
        F.col("clicks_after").alias("clicks"),
        F.col("accepted").alias("updates"),
    )
    # Priors are looked up once per bucket and go to its pieces. The events then join by piece, as they already lie
    # after admission; by bucket alone a hot one would meet in one task.
    priors = new_buckets(admission, start, model, trust).select(
        *K.BUCKET_KEYS, "alpha_prior", "beta_prior"
    )
    pieces = admission.runs.select(*_PIECE).distinct().join(priors, K.BUCKET_KEYS)
    return with_posterior(changed.join(pieces, _PIECE).drop("slot", "piece"), trust)


def timed_writes(
    admission: Admission,
    start: DataFrame | None,
    model: Model,
    trust: Trust = Trust(),
    interval_ms: int = K.FLUSH_INTERVAL_MS,
    max_updates: int = K.FLUSH_MAX_UPDATES,
) -> tuple[DataFrame, DataFrame]:
    """The writes of coalesced updates, and the interval that each changed bucket leaves open.

    Accepted updates of a bucket are numbered by its counts after them, so no window over a bucket is needed: an
    interval begins at the least number in it. A bucket is written at every ``max_updates`` of an interval and, with
    the rest, when a later interval begins. The last interval stays open, as (``flush_window``, ``flush_since``, the
    number it began at); ``start`` holds those of the batch before, which go on or are written as they were stored.
    A row carries ``updates`` and stands for ``flushes`` writes (copies of one event share a row). Over a log in order
    of time the writes are those that ``flush_accounting`` counts, however it is cut into batches.
    """
    micros = interval_ms * 1000
    changed = admission.runs.filter("accepted > 0").select(
        *_PIECE,
        F.expr(f"unix_micros(occurred_at) div {micros}").alias("_window"),
        "impressions_after",
        "clicks_after",
        (F.col("impressions_after") + F.col("clicks_after")).alias("_after"),
        (F.col("impressions_after") + F.col("clicks_after") - F.col("accepted")).alias("_before"),
    )
    # An interval may lie in several pieces: its bounds are combined and go back to them, as do the facts of a bucket.
    inside = changed.groupBy(*_PIECE, "_window").agg(F.min("_before").alias("_from"), F.max("_after").alias("_to"))
    interval = [*K.BUCKET_KEYS, "_window"]
    whole = inside.groupBy(*interval).agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    windows = inside.drop("_from", "_to").join(whole, interval)
    buckets = new_buckets(admission, start, model, trust).select(
        *K.BUCKET_KEYS, "alpha_prior", "beta_prior", (F.col("impressions") + F.col("clicks")).alias("_last")
    )
    none = F.lit(None).cast("bigint")
    stored = ["_imp0", "_clk0", "_window0", "_since0"]
    if start is None:
        buckets = buckets.withColumns({c: none for c in stored})
    else:
        old = start.select(*K.BUCKET_KEYS, *[
            F.col(c).alias(n) for c, n in zip(["impressions", "clicks", "flush_window", "flush_since"], stored)
        ])
        buckets = buckets.join(old, K.BUCKET_KEYS, "left")
    pieces = admission.runs.select(*_PIECE).distinct().join(buckets, K.BUCKET_KEYS)
    c = F.col
    stood = F.coalesce(c("_imp0") + c("_clk0"), F.lit(0).cast("bigint"))
    goes_on = F.coalesce((c("_window") == c("_window0")) & (c("_from") == stood), F.lit(False))
    rows = (
        changed.join(pieces, _PIECE)
        .join(windows, [*_PIECE, "_window"])
        .withColumn("_since", F.when(goes_on, c("_since0")).otherwise(c("_from")))
        .withColumn("_full", F.expr(f"(_after - _since) div {max_updates} - (_before - _since) div {max_updates}"))
        .withColumn("_rest", F.when((c("_after") == c("_to")) & (c("_to") < c("_last")),
                                    F.expr(f"(_after - _since) % {max_updates}")).otherwise(0))
        # The first update of the batch writes the interval that was open, unless it goes on in it.
        .withColumn("_due", F.when((c("_before") == stood) & ~goes_on, (stood - c("_since0")) % max_updates))
    )
    due = F.struct(
        c("_imp0").alias("impressions"),
        c("_clk0").alias("clicks"),
        F.coalesce("_due", F.lit(0)).cast("bigint").alias("updates"),
        F.when(c("_due") > 0, 1).otherwise(0).cast("bigint").alias("flushes"),
    )
    own = F.struct(
        c("impressions_after").alias("impressions"),
        c("clicks_after").alias("clicks"),
        (c("_full") * max_updates + c("_rest")).cast("bigint").alias("updates"),
        (c("_full") + F.when(c("_rest") > 0, 1).otherwise(0)).cast("bigint").alias("flushes"),
    )
    writes = rows.select(
        *K.BUCKET_KEYS, "alpha_prior", "beta_prior", F.inline(F.filter(F.array(due, own), lambda w: w["flushes"] > 0))
    )
    left_open = rows.filter("_after = _last").select(
        *K.BUCKET_KEYS, c("_window").alias("flush_window"), c("_since").alias("flush_since")
    )
    return with_posterior(writes, trust), left_open


def flush_accounting(
    admission: Admission,
    interval_ms: int = K.FLUSH_INTERVAL_MS,
    max_updates: int = K.FLUSH_MAX_UPDATES,
) -> DataFrame:
    """Writes needed when accepted updates of a bucket are coalesced.

    A bucket is written once per tumbling interval and once more for every ``max_updates``.
    """
    micros = interval_ms * 1000
    per_window = (
        admission.runs.filter("accepted > 0")
        .withColumn("_window", F.expr(f"unix_micros(occurred_at) div {micros}"))
        .groupBy(*K.BUCKET_KEYS, "_window")
        .agg(F.sum("accepted").alias("updates"))
        .withColumn("flushes", F.expr(f"(updates + {max_updates - 1}) div {max_updates}"))
    )
    return per_window.groupBy(*K.BUCKET_KEYS).agg(
        F.sum("flushes").alias("flushes"),
        F.sum("updates").alias("updates_flushed"),
        F.sum(F.col("updates") - F.col("flushes")).alias("updates_coalesced"),
    )
