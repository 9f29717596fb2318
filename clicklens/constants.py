"""Names, thresholds, seed lists and seed weights that results depend on."""

BUCKET_KEYS = ["ad_category", "publisher_domain", "conversation_category"]

# Weight families and the key column each family describes.
FAMILY_COLUMNS = {
    "ad": "ad_category",
    "domain": "publisher_domain",
    "context": "conversation_category",
}

IMPRESSION = "impression"
CLICK = "click"

# Topics and store keys.
IMPRESSION_TOPIC = "ctr.impressions"
CLICK_TOPIC = "ctr.clicks"
EVENT_TOPIC = "ctr.events"
DEAD_LETTER_TOPIC = "ctr.dead-letter"
STORE_PREFIX = "ctr"
CURRENT_MODEL_KEY = "weights:current"
INVALID_KEY = "__invalid_event__"

# Dead-letter reasons.
REASON_INVALID = "invalid_event_payload"
REASON_EXCESS_CLICK = "clicks_would_exceed_impressions"

# Log marker in front of a processor metrics JSON object.
METRICS_MARKER = "CTR_PROCESSOR_METRICS "

# Trust thresholds.
TRUST_Z = 1.96
TRUST_MIN_IMPRESSIONS = 100
TRUST_MAX_VARIANCE = 0.0005
TRUST_MAX_CI_WIDTH = 0.05

# Probability clipping of the safe log-odds.
MIN_PROBABILITY = 1e-6
MAX_PROBABILITY = 1.0 - 1e-6

# Learning.
LEARNING_Z = 1.645
CENTERED_TOLERANCE = 1e-12

# Write coalescing of the latest-state sink.
FLUSH_INTERVAL_MS = 500
FLUSH_MAX_UPDATES = 100

# Seed model.
SEED_SNAPSHOT_NAME = "seed_values_v1"
SEED_BASELINE_CTR = 0.02
SEED_TRIPLET_STRENGTH = 100.0
SEED_GLOBAL_STRENGTH = 500.0
SEED_FAMILY_STRENGTHS = {"ad": 200.0, "domain": 200.0, "context": 150.0}

# Seed values and their weights, in seed index order.
SEED_WEIGHTS = {
    "ad": [
        ("finance", 0.18),
        ("travel", 0.08),
        ("education", 0.02),
        ("health", -0.06),
        ("gaming", -0.22),
    ],
    "domain": [
        ("news.example", 0.05),
        ("tech.example", 0.12),
        ("lifestyle.example", -0.03),
        ("sports.example", -0.14),
    ],
    "context": [
        ("personal_finance", 0.16),
        ("trip_planning", 0.09),
        ("online_learning", 0.02),
        ("wellness", -0.04),
        ("gaming", -0.23),
    ],
}
