"""Event sources and strict parsing of event text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clicklens import constants as K
from clicklens.functions import checks
from clicklens.functions.plan import evaluated_once
from clicklens.schemas import EVENT

_FIELDS = EVENT.fieldNames()
# As text, a JSON number looks like a string, so fields that must be JSON strings have their type looked up as well.
# The type and the time need no such care: only fixed words match the one, and the other may be a number as well.
_STRICT = ["event_id", *K.BUCKET_KEYS, "impression_event_id"]
# Text that a number, boolean, object or array would give as well.
_AMBIGUOUS = r"^([-+.0-9{\[]|true$|false$)"
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"
_NUMBER = r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"
# Epoch numbers beyond this are milliseconds.
_SECONDS_LIMIT = 2e10
_MAX_EPOCH = 253402300799.0


def _text(field: str) -> Column:
    return F.try_variant_get("_whole", f"$[0].{field}", "string")


def _is_string(field: str) -> Column:
    """Whether the JSON value was a string; its type is looked up only where the text leaves doubt."""
    kind = F.schema_of_variant(F.try_variant_get("_whole", f"$[0].{field}", "variant"))
    return F.when(F.col(field).rlike(_AMBIGUOUS), kind == "STRING").otherwise(
        F.col(field).isNotNull()
    )


def _is_absent(field: str) -> Column:
    value = F.try_variant_get("_whole", f"$[0].{field}", "variant")
    return value.isNull() | F.is_variant_null(value)


def _from_epoch(number: Column) -> Column:
    seconds = F.when(F.abs(number) > _SECONDS_LIMIT, number / 1000.0).otherwise(number)
    return F.when(F.abs(seconds) <= _MAX_EPOCH, F.timestamp_seconds(seconds))


def _timestamp(text: Column) -> Column:
    """ISO text or an epoch number; NULL for anything else."""
    iso = F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")),
    )
    return F.when(text.rlike(_ISO_DATE), iso).when(
        text.rlike(_NUMBER), _from_epoch(text.try_cast("double"))
    )


def one_json_object(text: Column) -> Column:
    """The object that a text holds, as a variant, if the text is exactly one JSON object; else NULL.

    Nothing may stand behind it, and single quotes and NaN are no JSON. The parsers ignore what follows a first
    value. Inside an array and before the text's own hash, anything else than one value breaks the array or moves
    the hash.
    """
    seal = _seal(text)
    whole = _sealed(text, seal)
    return F.when(_is_object(text, whole, seal), F.try_variant_get(whole, "$[0]", "variant"))


def _seal(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _sealed(text: Column, seal: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]')))


def _is_object(text: Column, whole: Column, seal: Column) -> Column:
    """Whether the seal is intact and the one value before it an object, which a look at its first character tells."""
    intact = F.try_variant_get(whole, "$[1]", "string") == seal
    return F.coalesce(intact & F.startswith(F.ltrim(text, F.lit(" \t\r\n")), F.lit("{")), F.lit(False))


def parse_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Event text to typed columns, the raw text and ``valid``.

    Strings must be JSON strings, unknown extra fields are ignored, the impression id may be
    absent or null, and the time may be ISO text or epoch numbers. A text that is more or less than one JSON
    object is invalid. Each text is parsed once: all fields are taken from the parsed value.
    """
    text = F.col(column)
    seal = _seal(text)
    sealed = evaluated_once(raw.select(text.alias("raw"), seal.alias("_seal"), _sealed(text, seal).alias("_whole")))
    texts = sealed.select(
        "raw",
        "_whole",
        _is_object(F.col("raw"), F.col("_whole"), F.col("_seal")).alias("_object"),
        _text("event_type").alias("event_type"),
        _text("occurred_at").alias("_time"),
        *[_text(name).alias(name) for name in _STRICT],
    )
    # A JSON null has no text.
    optional_ok = F.col("impression_event_id").isNull() & _is_absent("impression_event_id")
    optional_ok = optional_ok | _is_string("impression_event_id")
    fields = {name: F.when(_is_string(name), F.col(name)) for name in _STRICT}
    fields |= {"event_type": F.col("event_type"), "occurred_at": _timestamp(F.col("_time"))}
    found = F.col("_object")
    typed = texts.select(
        "raw",
        *[F.when(found, fields[name]).alias(name) for name in _FIELDS],
        (found & optional_ok).alias("_optional_ok"),
    )
    return evaluated_once(
        typed.select("raw", *_FIELDS, (checks.valid_event() & F.col("_optional_ok")).alias("valid"))
    )


def valid_events(parsed: DataFrame) -> DataFrame:
    return parsed.filter("valid").select(*_FIELDS)


def invalid_events(parsed: DataFrame) -> DataFrame:
    return parsed.filter("NOT valid").select("raw")


def raw_bucket_key(column: str = "value") -> Column:
    """Key text read before validation; the fixed invalid key for malformed text or a missing part.

    Null parts print as None and booleans as True and False.
    """
    json = one_json_object(F.col(column))
    parts = []
    for key in K.BUCKET_KEYS:
        v = F.try_variant_get(json, f"$.{key}", "variant")
        printed = F.try_variant_get(json, f"$.{key}", "string")
        parts.append(
            F.when(F.is_variant_null(v), F.lit("None"))
            .when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(printed))
            .otherwise(printed)
        )
    return F.coalesce(
        F.concat(parts[0], F.lit(":"), parts[1], F.lit(":"), parts[2]), F.lit(K.INVALID_KEY)
    )


def kafka_event_stream(
    spark: SparkSession,
    servers: str,
    topics: tuple[str, ...] = (K.IMPRESSION_TOPIC, K.CLICK_TOPIC),
    starting: str = "latest",
    max_per_trigger: int | None = None,
) -> DataFrame:
    """Several topics as one stream of text. Needs the Kafka connector on the class path.

    ``starting`` counts only for a fresh checkpoint.
    """
    if starting not in ("earliest", "latest"):
        raise ValueError("starting must be earliest or latest")
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", starting)
    )
    if max_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def text_event_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """One JSON event per line from files that keep arriving below ``path``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)
