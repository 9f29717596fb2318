import json

import pytest

from clicklens.sources.events import kafka_event_stream, parse_events, raw_bucket_key

BASE = {
    "event_id": "e-1",
    "event_type": "click",
    "ad_category": "finance",
    "publisher_domain": "news.example",
    "conversation_category": "gaming",
    "occurred_at": "2026-01-01T00:00:00+00:00",
    "impression_event_id": "i-1",
}


def changed(drop=(), **values):
    return json.dumps({k: v for k, v in {**BASE, **values}.items() if k not in drop})


CASES = [
    (changed(), True),
    (changed(event_type="impression", impression_event_id=None), True),
    (changed(drop=["impression_event_id"]), True),
    (changed(extra={"event_id": 1}), True),
    (changed(event_id=""), True),
    (changed(event_id="123"), True),
    (changed(event_id="true"), True),
    (changed(event_id="{not json}"), True),
    (changed(occurred_at="2026-01-01T00:00:00Z"), True),
    (changed(occurred_at="2026-01-01 00:00:00.5+0200"), True),
    (changed(occurred_at="2026-01-01"), True),
    (changed(occurred_at=1767225600), True),
    (changed(occurred_at=1767225600123), True),
    (changed(occurred_at="1767225600"), True),
    (changed(event_id=1), False),
    (changed(event_id=True), False),
    (changed(event_id={"a": 1}), False),
    (changed(event_id=None), False),
    (changed(ad_category=2.5), False),
    (changed(impression_event_id=7), False),
    (changed(event_type="view"), False),
    (changed(event_type=1), False),
    (changed(drop=["publisher_domain"]), False),
    (changed(occurred_at="soon"), False),
    (changed(occurred_at="2026-13-01T00:00:00Z"), False),
    (changed(occurred_at="2026"), True),  # epoch seconds
    (changed(occurred_at=True), False),
    (changed(occurred_at=None), False),
    ("not json", False),
    ("[1]", False),
    ('"text"', False),
    ("", False),
    (None, False),
]


def test_validation_is_strict(spark):
    raw = spark.createDataFrame(list(enumerate(c[0] for c in CASES)), "n int, value string")
    parsed = parse_events(raw)
    assert parsed.count() == len(CASES)
    got = {}
    for row in parsed.collect():
        got.setdefault(row["raw"], row["valid"])
    wrong = [(text, ok) for text, ok in CASES if got[text] != ok]
    assert wrong == []


def test_times(spark):
    texts = [changed(occurred_at=t) for t in ("2026-01-01 02:00:00+0200", 1767225600, "1767225600000")]
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    times = {r["occurred_at"].isoformat() for r in parse_events(raw).collect()}
    assert len(times) == 1


def test_json_is_parsed_once(spark):
    raw = spark.createDataFrame([(changed(),)], "value string")
    plan = parse_events(raw).filter("valid").select("event_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("parseJson") == 1 and "from_json" not in text


def test_raw_key(spark):
    raw = spark.createDataFrame(
        [(changed(event_id=1),), ("{",), (changed(drop=["ad_category"]),), (changed(ad_category=None),), (changed(ad_category=5),)],
        "value string",
    )
    keys = [r["k"] for r in raw.select(raw_bucket_key().alias("k")).collect()]
    tail = "news.example:gaming"
    assert keys == [f"finance:{tail}", "__invalid_event__", "__invalid_event__", f"None:{tail}", f"5:{tail}"]


def test_offsets_are_checked(spark):
    with pytest.raises(ValueError):
        kafka_event_stream(spark, "localhost:1", starting="middle")


GOOD = (
    '{"event_id":"e","event_type":"impression","ad_category":"finance","publisher_domain":"news.example",'
    '"conversation_category":"gaming","occurred_at":"2026-01-02T03:04:05Z"}'
)


def test_text_must_be_one_json_object(spark):
    bad = [GOOD + " trailing", GOOD + GOOD, GOOD + "," + GOOD, GOOD.replace('"', "'"), f"[{GOOD}]", "1", "NaN", "", GOOD[:-1], GOOD + ',"x"']
    rows = [(GOOD,), (f"  {GOOD}\n",), *[(b,) for b in bad], (None,)]
    parsed = parse_events(spark.createDataFrame(rows, "value string")).select("raw", "valid").collect()
    assert {r["raw"] for r in parsed if r["valid"]} == {GOOD, f"  {GOOD}\n"}
    keys = spark.createDataFrame(rows, "value string").select("value", raw_bucket_key().alias("k")).collect()
    assert {r["value"] for r in keys if r["k"] == "finance:news.example:gaming"} == {GOOD, f"  {GOOD}\n"}
    odd = GOOD.replace('"finance"', "true").replace('"gaming"', "null")
    assert spark.createDataFrame([(odd,)], "value string").select(raw_bucket_key()).first()[0] == "True:news.example:None"


def test_values_are_taken_from_the_one_parsed_text(spark):
    parsed = parse_events(spark.createDataFrame([(GOOD,)], "value string"))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    # No second variant is cut out of the first, and the schema of a whole text is never made.
    assert "$[0], VariantType" not in plan and plan.count("parseJson") == 1
