"""DuckDB SQL giving the same rows as the registered queries, written without Spark.

The statements are put together from shared common table expressions.
"""

from __future__ import annotations

from clicklens import constants as K
from clicklens.schemas import BUCKET
from clicklens.plans import frames as B

KEYS = "ad_category, publisher_domain, conversation_category"
W0 = "ln((1.0::DOUBLE / 3.0) / (1.0 - 1.0::DOUBLE / 3.0))"
SEED_W0 = "ln(0.02::DOUBLE / (1.0 - 0.02::DOUBLE))"


def d(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def r(expression: str, name: str, digits: int = 9) -> str:
    return f"round({expression}, {digits}) AS {name}"


def sig(x: str) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({x}))))"


def safe_logit(p: str) -> str:
    q = f"greatest({d(K.MIN_PROBABILITY)}, least({p}, {d(K.MAX_PROBABILITY)}))"
    return f"ln({q} / (1.0::DOUBLE - {q}))"


def beta_var(a: str, b: str) -> str:
    return f"(({a}) * ({b})) / (((({a}) + ({b})) * (({a}) + ({b}))) * (({a}) + ({b}) + 1.0::DOUBLE))"


def ratio(n: str, m: str) -> str:
    return f"CASE WHEN ({m}) > 0 THEN CAST(({n}) AS DOUBLE) / CAST(({m}) AS DOUBLE) ELSE 0.0::DOUBLE END"


def text_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def names(family: str) -> str:
    return text_list([v for v, _ in K.SEED_WEIGHTS[family]])


# Events -----------------------------------------------------------------------------------------

LOG = f"""log AS (
  SELECT event_id AS n, CAST(event_id AS VARCHAR) AS event_id,
    CASE WHEN event_type = 'view' THEN 'impression' ELSE event_type END AS event_type,
    {names('ad')}[CAST(user_id % 5 AS INTEGER) + 1] AS ad_category,
    {names('domain')}[CAST((user_id // 5) % 4 AS INTEGER) + 1] AS publisher_domain,
    {names('context')}[CAST(CAST(props->>'$.k' AS BIGINT) % 5 AS INTEGER) + 1] AS conversation_category,
    ts AS occurred_at, epoch_us(ts) AS micros
  FROM events)"""
EV = f"{LOG}, ev AS (SELECT * FROM log WHERE event_type IN ('impression', 'click'))"

ISO = """strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN micros % 1000000 = 0 THEN '' ELSE strftime(occurred_at, '.%f') END || '+00:00'"""
EVENT_JSON = f"""'{{"event_id":"' || event_id || '","event_type":"' || event_type ||
  '","ad_category":"' || ad_category || '","publisher_domain":"' || publisher_domain ||
  '","conversation_category":"' || conversation_category || '","occurred_at":"' || {ISO} ||
  '","impression_event_id":null}}'"""

# Sequential admission through running sums over whole buckets, the plain form.
ADMIT = f"""steps AS (
  SELECT *, CASE WHEN event_type = 'impression' THEN 1 ELSE -1 END AS step FROM ev),
slack AS (
  SELECT *, sum(step) OVER w AS slack,
    sum(CASE WHEN step = 1 THEN 1 ELSE 0 END) OVER w AS shown
  FROM steps
  WINDOW w AS (PARTITION BY {KEYS} ORDER BY occurred_at, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lost AS (
  SELECT *, greatest(0, -min(slack) OVER (PARTITION BY {KEYS} ORDER BY occurred_at, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS lost FROM slack),
adm AS (
  SELECT *, lost - coalesce(lag(lost) OVER (PARTITION BY {KEYS} ORDER BY occurred_at, event_id), 0) AS rejected
  FROM lost),
kept AS (
  SELECT {KEYS}, CAST(sum(CASE WHEN step = 1 THEN 1 ELSE 0 END) AS BIGINT) AS impressions,
    CAST(sum(CASE WHEN step = -1 THEN 1 - rejected ELSE 0 END) AS BIGINT) AS clicks
  FROM adm GROUP BY ALL HAVING sum(1 - rejected) > 0)"""

SEED_W = "sw AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{f}', '{v}', {d(w)})" for f, pairs in K.SEED_WEIGHTS.items() for v, w in pairs
) + ") AS t(family, feature, weight))"

# Star tables ------------------------------------------------------------------------------------

OPP = """opp AS (
  SELECT p_type AS ad_category, c_mktsegment AS publisher_domain,
    o_orderpriority AS conversation_category, l_returnflag = 'R' AS clicked, l_shipdate AS shown_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""
STAR = f"""{OPP}, star AS (
  SELECT {KEYS}, count(*) AS impressions, count(*) FILTER (clicked) AS clicks FROM opp GROUP BY ALL)"""
SPLIT = f"""{OPP}, split AS (
  SELECT {KEYS},
    count(*) FILTER (shown_at < TIMESTAMP '{B.SPLIT}') AS i0,
    count(*) FILTER (shown_at < TIMESTAMP '{B.SPLIT}' AND clicked) AS c0,
    count(*) FILTER (shown_at >= TIMESTAMP '{B.SPLIT}') AS i1,
    count(*) FILTER (shown_at >= TIMESTAMP '{B.SPLIT}' AND clicked) AS c1
  FROM opp GROUP BY ALL)"""
DIMS = """dims AS (
  SELECT family, feature, row_number() OVER (PARTITION BY family ORDER BY feature) - 1 AS position,
    count(*) OVER (PARTITION BY family) AS features
  FROM (SELECT DISTINCT 'ad' AS family, p_type AS feature FROM part
        UNION ALL SELECT DISTINCT 'domain', c_mktsegment FROM customer
        UNION ALL SELECT DISTINCT 'context', o_orderpriority FROM orders))"""
STEP = "CASE family " + " ".join(
    f"WHEN '{f}' THEN {d(s)}" for f, s in B.STAR_STEPS.items()
) + " END"
WEIGHTS = f"""{DIMS}, w AS (
  SELECT family, position, feature,
    {STEP} * (CAST(position AS DOUBLE) - CAST(features - 1 AS DOUBLE) / 2.0::DOUBLE) AS weight
  FROM dims)"""
PARTIAL = f"""{WEIGHTS}, pw AS (
  SELECT family, feature, weight FROM w WHERE position > 0
  UNION ALL SELECT family, 'UNSEEN', max(position) * 0.01::DOUBLE FROM w GROUP BY family)"""


def priors(source: str, weights: str, w0: str, out: str, strength: float = K.SEED_TRIPLET_STRENGTH) -> str:
    joins = "\n".join(
        f"LEFT JOIN {weights} AS {alias} ON {alias}.family = '{f}' AND {alias}.feature = s.{column}"
        for (f, column), alias in zip(K.FAMILY_COLUMNS.items(), "xyz")
    )
    total = f"{w0} + coalesce(x.weight, 0) + coalesce(y.weight, 0) + coalesce(z.weight, 0)"
    return f"""{out} AS (
  SELECT *, prior_ctr * {d(strength)} AS alpha_prior, (1.0::DOUBLE - prior_ctr) * {d(strength)} AS beta_prior
  FROM (SELECT s.*, {sig(total)} AS prior_ctr FROM {source} s {joins}))"""


def posterior(source: str, out: str) -> str:
    z = d(K.TRUST_Z)
    return f"""{out} AS (
  SELECT *, impressions >= {K.TRUST_MIN_IMPRESSIONS} AND variance <= {d(K.TRUST_MAX_VARIANCE)}
      AND ci_high - ci_low <= {d(K.TRUST_MAX_CI_WIDTH)} AS trusted
  FROM (SELECT *, greatest(0.0::DOUBLE, ctr - {z} * sqrt(variance)) AS ci_low,
          least(1.0::DOUBLE, ctr + {z} * sqrt(variance)) AS ci_high
    FROM (SELECT *, alpha_posterior / (alpha_posterior + beta_posterior) AS ctr,
            {beta_var('alpha_posterior', 'beta_posterior')} AS variance
      FROM (SELECT *, alpha_prior + clicks AS alpha_posterior,
              beta_prior + impressions - clicks AS beta_posterior FROM {source}))))"""


BUCKET_OUT = f"""{KEYS}, CAST(impressions AS BIGINT) AS impressions, CAST(clicks AS BIGINT) AS clicks,
  {r('alpha_prior', 'alpha_prior')}, {r('beta_prior', 'beta_prior')},
  {r('alpha_posterior', 'alpha_posterior')}, {r('beta_posterior', 'beta_posterior')},
  {r('ctr', 'ctr')}, {r('variance', 'variance', 12)}, {r('ci_low', 'ci_low')}, {r('ci_high', 'ci_high')}, trusted"""

STAR_BUCKETS = f"{STAR}, {WEIGHTS}, {priors('star', 'w', W0, 'primed')}, {posterior('primed', 'bk')}"

# Evidence with damaged payloads, as the keyed store holds it.
STORE = f"""{STAR_BUCKETS}, store AS (
  SELECT 'ctr:' || ad_category || ':' || publisher_domain || ':' || conversation_category AS key,
    NOT (impressions % 11 = 3) AND clicks % 7 > 2 AS valid, * EXCLUDE (prior_ctr)
  FROM bk)"""

# Learning ---------------------------------------------------------------------------------------


def marginals(source: str, out: str) -> str:
    ok = "impressions > 0 AND clicks <= impressions"
    return f"{out} AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS family, {c} AS feature, CAST(sum(impressions) AS BIGINT) AS impressions, "
        f"CAST(sum(clicks) AS BIGINT) AS clicks FROM {source} WHERE {ok} GROUP BY {c}"
        for f, c in K.FAMILY_COLUMNS.items()
    ) + ")"


def totals(source: str, out: str) -> str:
    ok = "impressions > 0 AND clicks <= impressions"
    return f"""{out} AS (
  SELECT CAST(coalesce(sum(impressions) FILTER ({ok}), 0) AS BIGINT) AS impressions,
    CAST(coalesce(sum(clicks) FILTER ({ok}), 0) AS BIGINT) AS clicks,
    count(*) FILTER ({ok}) AS valid_buckets, count(*) FILTER (NOT ({ok})) AS invalid_buckets,
    {ratio(f'sum(impressions * 0 + clicks) FILTER ({ok})', f'sum(impressions) FILTER ({ok})')} AS observed_ctr
  FROM {source})"""


def proposal(source: str, w0: str, config, out: str) -> str:
    z = d(K.LEARNING_Z)
    a = f"({sig(w0)} * {d(K.SEED_GLOBAL_STRENGTH)} + clicks)"
    b = f"((1.0::DOUBLE - {sig(w0)}) * {d(K.SEED_GLOBAL_STRENGTH)} + impressions - clicks)"
    enabled = str(config.baseline_update).lower()
    return f"""{out} AS (
  SELECT *, CASE WHEN update_applied THEN {safe_logit('m')} ELSE old_w0 END AS new_w0
  FROM (SELECT *, {enabled} AND hi - lo <= {d(config.baseline_max_ci_width)} AS update_applied
    FROM (SELECT *, greatest(0.0::DOUBLE, m - {z} * sqrt(v)) AS lo, least(1.0::DOUBLE, m + {z} * sqrt(v)) AS hi
      FROM (SELECT *, {w0} AS old_w0, {a} / ({a} + {b}) AS m, {beta_var(a, b)} AS v FROM {source}))))"""


def guard_reason(config) -> str:
    if not config.baseline_update:
        return "'baseline_update_disabled'"
    return "CASE WHEN update_applied THEN 'baseline_guards_passed' ELSE 'baseline_ci_width_too_wide' END"


def proposal_out(source: str, config) -> str:
    return f"""SELECT {r('old_w0', 'old_w0')}, {r('new_w0', 'new_w0')}, {r('new_w0 - old_w0', 'baseline_delta')},
  {str(config.baseline_update).lower()} AS update_enabled, update_applied,
  impressions AS aggregate_impressions, clicks AS aggregate_clicks, {r('observed_ctr', 'aggregate_observed_ctr')},
  {r('m', 'posterior_baseline_ctr')}, {r('lo', 'ci_low')}, {r('hi', 'ci_high')}, {r('hi - lo', 'ci_width')},
  {guard_reason(config)} AS guard_reason, valid_buckets AS valid_bucket_count,
  invalid_buckets AS invalid_bucket_count, {r(sig('new_w0'), 'new_baseline_ctr')} FROM {source}"""


def features(marg: str, weights: str, w0: str, config, out: str) -> str:
    z = d(K.LEARNING_Z)
    strength = "CASE family " + " ".join(
        f"WHEN '{f}' THEN {d(s)}" for f, s in K.SEED_FAMILY_STRENGTHS.items()
    ) + " END"
    step = (
        f"{d(config.learning_rate)} * impressions / (impressions + {d(config.evidence_smoothing)}) * "
        f"(({safe_logit('posterior_ctr')} - {w0}) - old_weight) - {d(config.ridge)} * old_weight"
    )
    return f"""{out}_a AS (
  SELECT family, feature, m.impressions, m.clicks, coalesce(o.weight, 0.0::DOUBLE) AS old_weight,
    o.weight IS NULL AS unknown
  FROM {weights} o FULL JOIN {marg} m USING (family, feature)),
{out}_b AS (
  SELECT *, {sig(f'{w0} + old_weight')} * {strength} + clicks AS a,
    (1.0::DOUBLE - {sig(f'{w0} + old_weight')}) * {strength} + impressions - clicks AS b FROM {out}_a),
{out}_c AS (SELECT *, a / (a + b) AS posterior_ctr, {beta_var('a', 'b')} AS v FROM {out}_b),
{out}_d AS (
  SELECT *, CASE WHEN impressions IS NOT NULL THEN least(1.0::DOUBLE, posterior_ctr + {z} * sqrt(v))
    - greatest(0.0::DOUBLE, posterior_ctr - {z} * sqrt(v)) END AS ci_width FROM {out}_c),
{out}_e AS (
  SELECT *, CASE WHEN impressions IS NULL THEN 'no_evidence'
    WHEN impressions < {config.min_feature_impressions} THEN 'insufficient'
    WHEN ci_width > {d(config.max_feature_ci_width)} THEN 'wide_ci' ELSE 'updated' END AS status FROM {out}_d),
{out}_f AS (
  SELECT *, CASE WHEN status = 'updated'
    THEN greatest({d(-config.max_delta)}, least({step}, {d(config.max_delta)})) ELSE 0.0::DOUBLE END AS delta
  FROM {out}_e),
{out} AS (
  SELECT *, old_weight + delta AS stepped_weight,
    old_weight + delta - avg(old_weight + delta) OVER (PARTITION BY family) AS new_weight FROM {out}_f)"""


def accepted(config, feats: str = "f", prop: str = "p") -> str:
    if config.baseline_update:
        return f"(SELECT update_applied FROM {prop})"
    return f"(SELECT count(*) > 0 FROM {feats} WHERE status = 'updated')"


def metrics_out(config) -> str:
    enabled = str(config.baseline_update).lower()
    failed = f"({enabled} AND NOT update_applied)"
    ok = accepted(config)
    one = lambda s: f"(SELECT count(*) FROM f WHERE {s})"
    fam = lambda f: one(f"family = '{f}' AND impressions IS NOT NULL")
    unless = lambda x, other="0": f"CAST(CASE WHEN {failed} THEN {other} ELSE {x} END AS BIGINT)"
    return f"""SELECT {ok} AS accepted,
  CASE WHEN {failed} THEN 'baseline_guard_failed:' || {guard_reason(config)}
       WHEN NOT {ok} THEN 'no_feature_buckets_passed_guards' END AS skipped_reason,
  (SELECT count(*) FROM src) AS input_bucket_count, (SELECT count(*) FROM src) AS valid_bucket_count,
  invalid_buckets AS invalid_bucket_count,
  {fam('ad')} AS ad_feature_bucket_count, {fam('domain')} AS domain_feature_bucket_count,
  {fam('context')} AS context_feature_bucket_count,
  {unless(one("status = 'updated'"))} AS updated_feature_bucket_count,
  {unless(one("status IN ('insufficient', 'wide_ci')"), one('impressions IS NOT NULL'))} AS skipped_feature_bucket_count,
  {unless(one("status = 'insufficient'"))} AS insufficient_impression_feature_count,
  {unless(one("status = 'wide_ci'"))} AS wide_ci_feature_count,
  {unless(one('unknown'))} AS unknown_feature_count,
  {r(f'CASE WHEN {ok} THEN (SELECT max(abs(delta)) FROM f) ELSE 0.0::DOUBLE END', 'max_absolute_weight_delta')},
  {d(config.learning_rate)} AS learning_rate, {d(config.evidence_smoothing)} AS evidence_smoothing,
  {d(config.ridge)} AS ridge, {d(config.max_delta)} AS max_delta,
  CAST({config.min_feature_impressions} AS BIGINT) AS min_feature_impressions,
  {d(config.max_feature_ci_width)} AS max_feature_ci_width, {str(config.dry_run).lower()} AS dry_run,
  new_w0 = old_w0 AS w0_unchanged, {r('old_w0', 'old_w0')}, {r('new_w0', 'new_w0')},
  {r('new_w0 - old_w0', 'baseline_delta')}, {enabled} AS baseline_update_enabled,
  update_applied AS baseline_update_applied, impressions AS aggregate_impressions,
  clicks AS aggregate_clicks, {r('observed_ctr', 'aggregate_observed_ctr')},
  {r('m', 'posterior_baseline_ctr')}, {r('lo', 'baseline_ci_low')}, {r('hi', 'baseline_ci_high')},
  {r('hi - lo', 'baseline_ci_width')}, {guard_reason(config)} AS baseline_guard_reason,
  valid_buckets AS valid_baseline_bucket_count, invalid_buckets AS invalid_baseline_bucket_count,
  {r(f"CASE WHEN {ok} AND {enabled} THEN {sig('new_w0')} ELSE {d(B.STAR_BASELINE)} END", 'new_baseline_ctr')}
FROM p"""


def learning_ctes(config) -> str:
    return (
        f"{STAR}, src AS (SELECT * FROM star), {PARTIAL}, {marginals('src', 'm')}, {totals('src', 't')}, "
        f"{proposal('t', W0, config, 'p')}, {features('m', 'pw', W0, config, 'f')}"
    )


# Validity ---------------------------------------------------------------------------------------

_FIX = f", {B.DIGITS})"
FRAME = f"""{SPLIT}, {WEIGHTS},
s0 AS (SELECT {KEYS}, i0 AS impressions, c0 AS clicks FROM split),
{priors('s0', 'w', W0, 's1')}, {posterior('s1', 'seed')},
s2 AS (
  SELECT s.ad_category, s.publisher_domain, s.conversation_category, s.alpha_prior, s.beta_prior,
    round(s.alpha_prior / (s.alpha_prior + s.beta_prior){_FIX} AS generator_ctr,
    s.impressions AS seed_impressions, s.clicks AS seed_clicks, round(s.ctr{_FIX} AS seed_posterior_ctr,
    s.ci_high - s.ci_low AS seed_ci_width, s.trusted AS seed_trusted,
    b.i1 AS batch_impressions, b.c1 AS batch_clicks,
    s.impressions + b.i1 AS impressions, s.clicks + b.c1 AS clicks
  FROM seed s JOIN split b USING ({KEYS})),
{posterior('s2', 's3')},
fr AS (
  SELECT ad_category || ':' || publisher_domain || ':' || conversation_category AS bucket, {KEYS},
    generator_ctr, seed_impressions, seed_clicks,
    CASE WHEN seed_impressions > 0 THEN CAST(seed_clicks AS DOUBLE) / seed_impressions END AS seed_raw_ctr,
    seed_posterior_ctr, seed_ci_width, seed_trusted, batch_impressions, batch_clicks,
    round(CASE WHEN batch_impressions > 0 THEN CAST(batch_clicks AS DOUBLE) / batch_impressions END{_FIX} AS batch_raw_ctr,
    impressions AS final_impressions, clicks AS final_clicks,
    CASE WHEN impressions > 0 THEN CAST(clicks AS DOUBLE) / impressions END AS final_raw_ctr,
    round(ctr{_FIX} AS final_posterior_ctr, variance AS final_variance,
    ci_low AS final_ci_low, ci_high AS final_ci_high, ci_high - ci_low AS final_ci_width,
    trusted AS final_trusted, generator_ctr BETWEEN ci_low AND ci_high AS generator_covered
  FROM s3)"""

LONG = "lg AS (" + " UNION ALL ".join(
    f"SELECT '{label}' AS estimator, {column} AS estimate, generator_ctr, batch_impressions FROM fr"
    for label, column in (
        ("Seed posterior", "seed_posterior_ctr"),
        ("New batch raw CTR", "batch_raw_ctr"),
        ("Final posterior", "final_posterior_ctr"),
    )
) + ")"


def average_rank_sql(group: str, value: str) -> str:
    return (
        f"rank() OVER (PARTITION BY {group} ORDER BY {value}) + "
        f"(count(*) OVER (PARTITION BY {group}, {value}) - 1) / 2.0::DOUBLE"
    )


HISTORY = f"""hist AS (
  SELECT CAST(year(o_orderdate) AS BIGINT) AS id, 'orders_' || year(o_orderdate) AS snapshot_name,
    {safe_logit("avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS w0
  FROM orders GROUP BY year(o_orderdate))"""


def snapshot(source: str, out: str) -> str:
    return f"""{out} AS (
  SELECT count(*) AS redis_bucket_keys_scanned, count(*) AS redis_valid_bucket_count,
    CAST(0 AS BIGINT) AS redis_invalid_bucket_count,
    CAST(sum(impressions) AS BIGINT) AS redis_total_impressions, CAST(sum(clicks) AS BIGINT) AS redis_total_clicks,
    count(*) FILTER (trusted) AS redis_trusted_bucket_count,
    avg(ci_high - ci_low) AS redis_average_ci_width, max(ci_high - ci_low) AS redis_max_ci_width,
    (SELECT arg_max(snapshot_name, id) FROM hist) AS current_model_snapshot_name,
    {sig('(SELECT arg_max(w0, id) FROM hist)')} AS current_model_baseline_ctr,
    (SELECT count(*) FROM hist) AS postgres_model_snapshot_count,
    CAST(0 AS BIGINT) AS postgres_experiment_result_count
  FROM {source})"""


SNAPSHOTS = f"""{FRAME}, {STAR.removeprefix(OPP + ', ')}, {priors('star', 'w', W0, 'primed')},
{posterior('primed', 'bk')}, {HISTORY}, {snapshot('seed', 'sa')}, {snapshot('bk', 'sb')}"""


def snapshot_out(source: str, phase: str) -> str:
    return f"""SELECT * REPLACE ({r('redis_average_ci_width', 'redis_average_ci_width')},
  {r('redis_max_ci_width', 'redis_max_ci_width')},
  {r('current_model_baseline_ctr', 'current_model_baseline_ctr')}), '{phase}' AS phase FROM {source}"""


# Throughput -------------------------------------------------------------------------------------

_RUN_ROWS = ", ".join(f"({i}, '{label}', {p}, '{m}')" for i, label, p, m in B.RUNS)
RECORDS = f"""{LOG}, runs AS (
  SELECT CAST(i AS BIGINT) AS run_id, label, CAST(p AS BIGINT) AS p, m FROM (VALUES {_RUN_ROWS}) AS t(i, label, p, m)),
wins AS (
  SELECT run_id, m AS redis_flush_mode, n % p AS subtask_index, micros // 86400000000 AS win,
    count(*) AS window_events, count(*) FILTER (event_type = 'impression') AS i,
    count(*) FILTER (event_type = 'click') AS c, min(micros) AS lo, max(micros) AS hi
  FROM log CROSS JOIN runs GROUP BY ALL),
cum AS (
  SELECT run_id, redis_flush_mode, subtask_index, window_events, row_number() OVER o AS seq,
    CAST(sum(window_events) OVER o AS BIGINT) AS processed_events,
    CAST(sum(i) OVER o AS BIGINT) AS impressions, CAST(sum(c) OVER o AS BIGINT) AS clicks,
    CAST(sum(CASE WHEN redis_flush_mode = 'per_event' THEN i + c WHEN i + c > 0 THEN 1 ELSE 0 END) OVER o AS BIGINT) AS redis_flushes,
    (hi - min(lo) OVER o) / 1000000.0::DOUBLE AS elapsed_seconds,
    (hi - coalesce(lag(hi) OVER (PARTITION BY run_id, subtask_index ORDER BY win), lo)) / 1000000.0::DOUBLE AS window_seconds
  FROM wins WINDOW o AS (PARTITION BY run_id, subtask_index ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rec AS (
  SELECT run_id, seq, CAST(subtask_index AS BIGINT) AS subtask_index, processed_events,
    impressions + clicks AS valid_events, impressions, clicks,
    processed_events - impressions - clicks AS dead_letters, redis_flush_mode, redis_flushes,
    impressions + clicks AS redis_updates_flushed, impressions + clicks - redis_flushes AS redis_updates_coalesced,
    elapsed_seconds, {ratio('processed_events', 'elapsed_seconds')} AS events_per_second,
    window_events, window_seconds, {ratio('window_events', 'window_seconds')} AS window_events_per_second
  FROM cum)"""
_REAL = ["elapsed_seconds", "events_per_second", "window_seconds", "window_events_per_second"]
REC_ROUND = "REPLACE (" + ", ".join(r(c, c) for c in _REAL) + ")"
COUNTERS = [
    "processed_events", "valid_events", "impressions", "clicks", "dead_letters",
    "redis_flushes", "redis_updates_flushed", "redis_updates_coalesced",
]
RATES = f"""fullw AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, subtask_index ORDER BY seq) AS fi
  FROM (SELECT *, max(window_events) OVER (PARTITION BY run_id, subtask_index) AS big FROM rec)
  WHERE window_events = big),
rates AS (
  SELECT run_id, subtask_index, count(*) AS full_windows, avg(window_events_per_second) AS full_window_eps,
    coalesce(avg(window_events_per_second) FILTER (fi > 1), avg(window_events_per_second)) AS post_warmup_eps
  FROM fullw GROUP BY ALL),
last AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY run_id, subtask_index ORDER BY seq DESC) = 1),
tot AS (
  SELECT run_id, count(*) AS subtask_count,
    {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTERS)},
    max(elapsed_seconds) AS elapsed_seconds FROM last GROUP BY run_id),
agg AS (
  SELECT tot.*, {ratio('processed_events', 'elapsed_seconds')} AS events_per_second,
    window_events_per_second, post_warmup_eps, full_window_records
  FROM tot JOIN (SELECT run_id, sum(full_window_eps) AS window_events_per_second,
      sum(post_warmup_eps) AS post_warmup_eps, CAST(sum(full_windows) AS BIGINT) AS full_window_records
    FROM rates GROUP BY run_id) USING (run_id))"""
SUMMARY = f"""{RECORDS}, {RATES}, made AS (
  SELECT count(*) AS total, count(*) FILTER (event_type = 'impression') AS i,
    count(*) FILTER (event_type = 'click') AS c FROM log),
summ AS (
  SELECT run_id, label AS short_label, p AS parallelism, m AS redis_strategy, total AS produced_events,
    i AS redis_impression_delta, c AS redis_click_delta, run_id <> 3 AS gates_passed,
    processed_events, valid_events, dead_letters, elapsed_seconds, events_per_second AS end_to_end_eps,
    window_events_per_second AS full_window_eps, post_warmup_eps, full_window_records,
    redis_flushes, redis_updates_flushed, redis_updates_coalesced, 'Recorded' AS flush_metrics_source,
    {ratio('valid_events', 'redis_flushes')} AS updates_per_redis_write,
    100.0::DOUBLE * (1.0::DOUBLE - ({ratio('redis_flushes', 'valid_events')})) AS redis_write_reduction_pct
  FROM agg JOIN runs USING (run_id) CROSS JOIN made)"""


COARSE = """record_index metrics_log_parse experiment_records metrics_average metrics_aggregate
full_window_rate phase_totals perf_summary speedup_vs_reference subtask_share sampling_z""".split()


def _seed_state() -> str:
    return f"{EV}, {ADMIT}, {SEED_W}, {priors('kept', 'sw', SEED_W0, 'primed')}, {posterior('primed', 'bk')}"


def oracle_queries() -> dict[str, str]:
    sql: dict[str, str] = {}
    line = lambda *cols: f"SELECT l_orderkey, l_linenumber, {', '.join(cols)} FROM lineitem"

    sql["fn_sigmoid"] = line(r(sig("l_discount * 10 - 0.5::DOUBLE"), "p"))
    sql["fn_logit"] = line(
        "round(CASE WHEN l_discount > 0 AND l_discount < 1 THEN ln(l_discount / (1.0::DOUBLE - l_discount)) END, 9) AS log_odds"
    )
    sql["fn_clip"] = line(r("greatest(10.0::DOUBLE, least(l_quantity, 40.0::DOUBLE))", "clipped"))
    sql["fn_safe_logit"] = line(r(safe_logit("l_tax"), "log_odds"))
    sql["fn_beta_variance"] = line(
        r(beta_var("l_quantity + 1.0::DOUBLE", "CAST(l_linenumber AS DOUBLE)"), "variance", 12)
    )
    margin = f"{d(K.TRUST_Z)} * sqrt(l_tax * 0.01::DOUBLE)"
    sql["fn_clipped_ci"] = line(
        r(f"greatest(0.0::DOUBLE, l_discount - {margin})", "ci_low"),
        r(f"least(1.0::DOUBLE, l_discount + {margin})", "ci_high"),
    )
    sql["fn_snapshot_name"] = (
        "SELECT o_orderkey, 'weights_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS name FROM orders"
    )
    sql["trust_flag"] = f"WITH {STAR_BUCKETS} SELECT {KEYS}, impressions, trusted FROM bk"

    broken = " OR ".join(f"n % {k} = 0" for k in (13, 17, 19))
    ok = f"n % 7 <> 0 AND n % 11 <> 0 AND NOT ({broken}) AND event_type IN ('impression', 'click')"
    shown = ", ".join(
        f"CASE WHEN {ok} THEN {c} END AS {c}"
        for c in ["event_id", "event_type", *K.BUCKET_KEYS]
    )
    sql["event_validate"] = (
        f"WITH {LOG} SELECT {ok} AS valid, {shown}, CASE WHEN {ok} THEN micros END AS occurred_micros FROM log"
    )
    sql["raw_key_extract"] = f"""WITH {LOG} SELECT n AS event_number, CASE WHEN n % 7 = 0 OR n % 11 <> 0 AND ({broken}) THEN '{K.INVALID_KEY}'
  ELSE ad_category || ':' || publisher_domain || ':' || conversation_category END AS bucket_key FROM log"""
    sql["bucket_key"] = f"""WITH {STAR} SELECT ad_category || ':' || publisher_domain || ':' || conversation_category AS bucket_key,
  'ctr:' || ad_category || ':' || publisher_domain || ':' || conversation_category AS store_key, impressions FROM star"""
    sql["event_to_json"] = f"WITH {EV} SELECT event_id, {EVENT_JSON} AS value FROM ev"
    sql["event_counts"] = f"""WITH {EV} SELECT count(*) FILTER (event_type = 'impression') AS impressions,
  count(*) FILTER (event_type = 'click') AS clicks, count(*) AS total_events FROM ev"""
    counts = f"""cnt AS (SELECT {KEYS}, count(*) FILTER (event_type = 'impression') AS impressions,
  count(*) FILTER (event_type = 'click') AS clicks FROM ev GROUP BY ALL)"""
    sql["triplet_counts"] = f"WITH {EV}, {counts} SELECT * FROM cnt"
    sql["stream_triplet_counts"] = f"""WITH {EV}, {counts} SELECT *, (SELECT count(*) FROM log
  WHERE event_type NOT IN ('impression', 'click')) AS invalid_events FROM cnt"""
    late = f"SELECT * FROM log WHERE occurred_at >= TIMESTAMP '{B.EVENT_SPLIT}'"
    sql["stream_latest"] = f"""WITH {LOG}, late AS ({late}),
ev AS (SELECT * FROM late WHERE event_type IN ('impression', 'click')), {counts} SELECT *, (SELECT count(*) FROM late
  WHERE event_type NOT IN ('impression', 'click')) AS invalid_events FROM cnt"""
    sql["event_route"] = f"""WITH {EV}, msg AS (SELECT
  CASE WHEN event_type = 'impression' THEN '{K.IMPRESSION_TOPIC}' ELSE '{K.CLICK_TOPIC}' END AS topic,
  ad_category || ':' || publisher_domain || ':' || conversation_category AS key, {EVENT_JSON} AS value FROM ev)
SELECT * FROM msg UNION ALL SELECT '{K.EVENT_TOPIC}', key, value FROM msg"""
    sql["event_union"] = f"""WITH {EV} SELECT event_type, {KEYS}, count(*) AS events, max(micros) AS last_micros
FROM ev GROUP BY ALL"""
    sql["src_event_stream"] = f"""WITH {LOG} SELECT event_type IN ('impression', 'click') AS valid,
  CASE WHEN event_type IN ('impression', 'click') THEN event_type END AS event_type, count(*) AS events
FROM log GROUP BY ALL"""

    sql["click_admission"] = f"""WITH {EV}, {ADMIT} SELECT event_id, event_type, {KEYS}, CAST(1 AS BIGINT) AS copies,
  CAST(1 - rejected AS BIGINT) AS accepted, CAST(rejected AS BIGINT) AS rejected,
  CAST(shown AS BIGINT) AS impressions_after, CAST(shown - slack - lost AS BIGINT) AS clicks_after FROM adm"""
    letters = f"""let AS (
  SELECT '{K.REASON_INVALID}' AS reason, to_json({{'raw': raw}})::VARCHAR AS event, CAST(1 AS BIGINT) AS copies
  FROM (SELECT {EVENT_JSON} AS raw FROM log WHERE event_type NOT IN ('impression', 'click'))
  UNION ALL SELECT '{K.REASON_EXCESS_CLICK}', {EVENT_JSON}, CAST(rejected AS BIGINT) FROM adm WHERE rejected > 0)"""
    sql["dead_letters"] = f"WITH {EV}, {ADMIT}, {letters} SELECT * FROM let"
    sql["dead_letter_sink"] = f"""WITH {EV}, {ADMIT}, {letters}
SELECT '{{"reason":"' || reason || '","event":' || event || '}}' AS value FROM let, range(copies)"""
    sql["flush_accounting"] = f"""WITH {EV}, {ADMIT}, per AS (
  SELECT {KEYS}, micros // 86400000000 AS win, CAST(sum(1 - rejected) AS BIGINT) AS updates
  FROM adm WHERE rejected = 0 GROUP BY ALL)
SELECT {KEYS}, CAST(sum((updates + 2) // 3) AS BIGINT) AS flushes, CAST(sum(updates) AS BIGINT) AS updates_flushed,
  CAST(sum(updates - (updates + 2) // 3) AS BIGINT) AS updates_coalesced FROM per GROUP BY ALL"""
    sql["stream_timed_writes"] = sql["flush_accounting"]
    state = f"WITH {_seed_state()} "
    sql["state_bootstrap"] = state + f"SELECT {BUCKET_OUT} FROM bk"
    sql["stream_ctr_update"] = sql["stream_restart"] = sql["state_bootstrap"]
    sql["state_sink_coalesced"] = state + f"SELECT {KEYS}, impressions, clicks, {r('ctr', 'ctr')} FROM bk"
    sql["state_sink_per_event"] = state + f"SELECT {KEYS}, impressions + clicks AS writes, impressions, clicks, {r('ctr', 'ctr')} FROM bk"
    sql["stream_metrics"] = f"""WITH {EV}, {ADMIT} SELECT (SELECT count(*) FROM log) AS processed_events,
  count(*) FILTER (rejected = 0) AS valid_events,
  count(*) FILTER (event_type = 'impression') AS impressions,
  count(*) FILTER (event_type = 'click' AND rejected = 0) AS clicks,
  (SELECT count(*) FROM log) - count(*) FILTER (rejected = 0) AS dead_letters,
  count(*) FILTER (rejected = 0) AS redis_updates_flushed FROM adm"""

    sql["prior_lookup"] = f"""WITH {STAR}, {PARTIAL}, {priors('star', 'pw', W0, 'primed')}
SELECT {KEYS}, impressions, clicks, {r('prior_ctr', 'prior_ctr')}, {r('alpha_prior', 'alpha_prior')},
  {r('beta_prior', 'beta_prior')} FROM primed"""
    sql["bucket_posterior"] = f"WITH {STAR_BUCKETS} SELECT {BUCKET_OUT} FROM bk"
    sql["stream_star_update"] = sql["bucket_posterior"]
    sql["evidence_snapshot"] = f"""WITH {EV}, {counts}, {SEED_W},
good AS (SELECT * FROM cnt WHERE impressions > 0 AND clicks <= impressions),
{priors('good', 'sw', SEED_W0, 'primed')}, {posterior('primed', 'bk')} SELECT {BUCKET_OUT} FROM bk"""
    sql["evidence_scan_counts"] = f"""WITH {EV}, {counts} SELECT count(*) AS scanned,
  count(*) FILTER (impressions > 0 AND clicks <= impressions) AS valid,
  count(*) FILTER (NOT (impressions > 0 AND clicks <= impressions))
    + (SELECT count(*) FROM log WHERE event_type NOT IN ('impression', 'click')) AS invalid FROM cnt"""

    sql["feature_marginals"] = f"WITH {STAR}, {marginals('star', 'm')} SELECT * FROM m"
    sql["global_ctr"] = f"""WITH {STAR}, {totals('star', 't')}
SELECT * REPLACE ({r('observed_ctr', 'observed_ctr')}) FROM t"""
    configs = (B.ACCEPT, B.REFUSE, B.FEATURES_ONLY)
    sql["baseline_proposal"] = f"WITH {STAR}, {totals('star', 't')}, " + ", ".join(
        proposal("t", W0, c, f"p{i}") for i, c in enumerate(configs)
    ) + " " + " UNION ALL ".join(proposal_out(f"p{i}", c) for i, c in enumerate(configs))
    sql["unknown_features"] = f"""WITH {STAR}, {PARTIAL}, {marginals('star', 'm')}
SELECT family, feature FROM m ANTI JOIN pw USING (family, feature)"""
    sql["family_update"] = f"""WITH {learning_ctes(B.ACCEPT)} SELECT family, feature, impressions, clicks,
  {r('old_weight', 'old_weight')}, unknown, {r('posterior_ctr', 'posterior_ctr')}, {r('ci_width', 'ci_width')},
  status, {r('delta', 'delta')}, {r('stepped_weight', 'stepped_weight')}, {r('new_weight', 'new_weight')} FROM f"""
    sql["family_centering"] = f"""WITH {WEIGHTS}, v AS (SELECT *, weight + position AS x FROM w)
SELECT family, position, feature, {r('x', 'weight')},
  {r('x - avg(x) OVER (PARTITION BY family)', 'centered_weight')} FROM v"""
    sql["update_metrics"] = " UNION ALL ".join(
        f"SELECT * FROM (WITH {learning_ctes(c)} {metrics_out(c)})" for c in configs
    )
    sql["recalibrate"] = f"""WITH {learning_ctes(B.ACCEPT)}
SELECT family, feature, {r('CASE WHEN update_applied THEN new_weight ELSE old_weight END', 'weight')},
  update_applied AS accepted, {r('new_w0', 'new_w0')},
  {r(f"CASE WHEN update_applied THEN {sig('new_w0')} ELSE {d(B.STAR_BASELINE)} END", 'new_baseline_ctr')}
FROM f, p WHERE update_applied OR NOT unknown"""
    sql["recalibrate_refused"] = f"""WITH {learning_ctes(B.REFUSE)}
SELECT family, feature, {r('CASE WHEN update_applied THEN new_weight ELSE old_weight END', 'weight')}
FROM f, p WHERE update_applied OR NOT unknown"""
    sql["model_snapshot_append"] = f"""WITH {learning_ctes(B.ACCEPT)}
SELECT family, feature, {r('CASE WHEN update_applied THEN new_weight ELSE old_weight END', 'weight')},
  'relearned' AS snapshot_name FROM f, p WHERE update_applied OR NOT unknown"""

    seeds = f"""{WEIGHTS}, grid AS (
  SELECT a.feature AS ad_category, b.feature AS publisher_domain, c.feature AS conversation_category,
    a.position AS i, b.position AS j, c.position AS k, {sig(f'{W0} + a.weight + b.weight + c.weight')} AS prior_ctr
  FROM w a, w b, w c WHERE a.family = 'ad' AND b.family = 'domain' AND c.family = 'context'),
g2 AS (SELECT *, 120 + i * 37 + j * 29 + k * 19 + ((i + j + k) % 5) * 11 AS impressions FROM grid),
g3 AS (SELECT *, greatest(0, least(impressions,
    CAST(round_even(impressions * prior_ctr, 0) AS BIGINT) + (i * 2 + j + k) % 3 - 1)) AS clicks,
    prior_ctr * {d(K.SEED_TRIPLET_STRENGTH)} AS alpha_prior,
    (1.0::DOUBLE - prior_ctr) * {d(K.SEED_TRIPLET_STRENGTH)} AS beta_prior FROM g2),
{posterior('g3', 'bk')}"""
    sql["seed_buckets"] = f"WITH {seeds} SELECT {BUCKET_OUT} FROM bk"
    sql["seed_write"] = sql["seed_buckets"]
    sql["seed_summary"] = f"""WITH {seeds} SELECT count(*) AS bucket_count,
  count(*) FILTER (trusted) AS trusted_bucket_count, CAST(sum(impressions) AS BIGINT) AS total_impressions,
  CAST(sum(clicks) AS BIGINT) AS total_clicks, {r(ratio('sum(clicks)', 'sum(impressions)'), 'observed_ctr')} FROM bk"""
    whole = f"""count(*) AS bucket_count, count(*) FILTER (trusted) AS trusted_bucket_count,
  CAST(sum(impressions) AS BIGINT) AS total_impressions, CAST(sum(clicks) AS BIGINT) AS total_clicks,
  {r(ratio('sum(clicks)', 'sum(impressions)'), 'observed_ctr')}"""
    base = f"{r(d(B.star_head().baseline_ctr), 'baseline_prior_mean')}"
    sql["seed_run_append"] = f"""WITH {seeds} SELECT 1 AS id, 'all' AS experiment_name, {base}, {whole} FROM bk
UNION ALL SELECT 2, 'first', {base}, {whole} FROM bk WHERE ad_category = (SELECT min(ad_category) FROM bk)"""
    sql["bucket_validate"] = f"WITH {STORE} SELECT key, valid FROM store"
    sql["bucket_scan"] = f"WITH {STORE} SELECT {BUCKET_OUT} FROM store WHERE valid"
    sql["bucket_lookup"] = f"""WITH {STAR_BUCKETS} SELECT {BUCKET_OUT} FROM bk
WHERE ad_category = 'ECONOMY' AND publisher_domain = 'HOUSEHOLD' AND conversation_category = '5-LOW'"""
    sql["bucket_persist"] = f"""WITH {STORE}, t AS (SELECT count(*) AS s, count(*) FILTER (valid) AS v FROM store)
SELECT dry AS dry_run, s AS scanned_key_count, v AS valid_bucket_count, s - v AS invalid_bucket_count,
  CASE WHEN dry THEN 0 ELSE v END AS persisted_bucket_count, NOT dry AND v > 0 AS postgres_write_applied,
  CASE WHEN dry THEN 1 ELSE v + 1 END AS stored_rows, CASE WHEN dry THEN 0 ELSE v END AS fresh_rows FROM t, (VALUES (true), (false)) AS x(dry)"""
    fields = ",".join(sorted(BUCKET.fieldNames()))
    sql["bucket_to_json"] = f"""WITH {STAR_BUCKETS} SELECT 'ctr:' || concat_ws(':', {KEYS}) AS key, '{fields}' AS fields,
  {BUCKET_OUT} FROM bk"""
    sql["bucket_upsert"] = f"""WITH {FRAME}, n0 AS (
  SELECT {KEYS}, i1 AS impressions, c1 AS clicks FROM split WHERE i1 > 2 * c1),
{priors('n0', 'w', W0, 'n1')}, {posterior('n1', 'n2')},
bk AS (SELECT * FROM seed ANTI JOIN n2 USING ({KEYS}) UNION ALL BY NAME SELECT * FROM n2)
SELECT {BUCKET_OUT} FROM bk"""
    sql["state_key_scan"] = f"""WITH {STORE} SELECT key FROM store WHERE key GLOB 'ctr:S*:?-*' ORDER BY key LIMIT 20"""
    sql["model_current"] = f"""WITH {HISTORY} SELECT id, snapshot_name, {r('w0', 'w0')} FROM hist
ORDER BY id DESC LIMIT 1"""
    sql["history_counts"] = f"""WITH {HISTORY} SELECT count(*) AS model_snapshots,
  CAST({len(B.RUNS)} AS BIGINT) AS experiment_results FROM hist"""
    sql["duplicate_keys"] = """SELECT o_custkey, o_orderpriority, count(*) AS rows FROM orders
GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1"""
    sql["model_centered_check"] = f"""WITH {WEIGHTS}, v AS (SELECT family, weight + CASE WHEN family = 'domain' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS x FROM w)
SELECT family, count(*) AS features, {r('avg(x)', 'mean_weight')}, abs(avg(x)) <= {d(K.CENTERED_TOLERANCE)} AS centered
FROM v GROUP BY family"""
    sql["strengths_check"] = """SELECT c_nationkey, c_nationkey % 4 <> 0 AND min(c_acctbal) + 900.0::DOUBLE > 0 AS valid
FROM customer GROUP BY c_nationkey"""

    real = [
        "generator_ctr", "seed_raw_ctr", "seed_posterior_ctr", "seed_ci_width", "batch_raw_ctr",
        "final_raw_ctr", "final_posterior_ctr", "final_ci_low", "final_ci_high", "final_ci_width",
    ]
    sql["bucket_merge"] = f"""WITH {FRAME} SELECT * REPLACE ({', '.join(r(c, c) for c in real)},
  {r('final_variance', 'final_variance', 12)}) FROM fr"""
    sql["sampling_z"] = f"""WITH {FRAME}, t AS (
  SELECT sum(batch_impressions) AS n, CAST(sum(batch_clicks) AS BIGINT) AS observed_clicks,
    sum(batch_impressions * generator_ctr) AS expected_clicks,
    sum(batch_impressions * generator_ctr * (1.0::DOUBLE - generator_ctr)) AS v FROM fr)
SELECT {r('expected_clicks', 'expected_clicks')}, observed_clicks, {r('expected_clicks / n', 'expected_ctr')},
  {r('observed_clicks::DOUBLE / n', 'observed_ctr')}, {r('sqrt(v) / n', 'standard_error')},
  {r('100.0::DOUBLE * (observed_clicks::DOUBLE / n - expected_clicks / n)', 'difference_pp')},
  {r('(observed_clicks::DOUBLE / n - expected_clicks / n) / (sqrt(v) / n)', 'z_score')} FROM t"""
    e = "(estimate - generator_ctr)"
    sql["estimator_quality"] = f"""WITH {FRAME}, {LONG}, rk AS (
  SELECT *, {average_rank_sql('estimator', 'estimate')} AS rx, {average_rank_sql('estimator', 'generator_ctr')} AS ry
  FROM lg)
SELECT estimator, {r(f'100.0::DOUBLE * avg{e}', 'mean_bias_pp')}, {r(f'100.0::DOUBLE * avg(abs{e})', 'mae_pp')},
  {r(f'100.0::DOUBLE * sqrt(avg({e} * {e}))', 'rmse_pp')},
  {r(f'100.0::DOUBLE * sqrt(sum({e} * {e} * batch_impressions) / sum(batch_impressions))', 'weighted_rmse_pp')},
  {r('corr(rx, ry)', 'spearman_rank')} FROM rk GROUP BY estimator"""
    sql["uncertainty_summary"] = f"""WITH {FRAME} SELECT min(batch_impressions) AS min_new_impressions,
  {r('CAST(median(batch_impressions) AS DOUBLE)', 'median_new_impressions')}, max(batch_impressions) AS max_new_impressions,
  {r('avg(seed_ci_width)', 'mean_seed_ci_width')}, {r('avg(final_ci_width)', 'mean_final_ci_width')},
  {r('1.0::DOUBLE - avg(final_ci_width) / avg(seed_ci_width)', 'ci_width_reduction')},
  {r('avg(CASE WHEN generator_covered THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 'generator_coverage')},
  count(*) FILTER (seed_trusted) AS trusted_before, count(*) FILTER (final_trusted) AS trusted_after FROM fr"""
    sql["calibration_bands"] = f"""WITH {FRAME}, ed AS (
  SELECT list_distinct(quantile_cont(generator_ctr, [0.2, 0.4, 0.6, 0.8])) AS inner_edges FROM fr),
bd AS (SELECT fr.*, CAST(len(list_filter(inner_edges, lambda x: x < generator_ctr)) AS BIGINT) AS band FROM fr, ed)
SELECT band, count(*) AS buckets, {r('min(generator_ctr)', 'lowest_ctr')}, {r('max(generator_ctr)', 'highest_ctr')},
  {r('sum(generator_ctr * batch_impressions) / sum(batch_impressions)', 'expected_ctr')},
  {r('sum(batch_clicks)::DOUBLE / sum(batch_impressions)', 'observed_ctr')},
  {r('sum(final_posterior_ctr * final_impressions) / sum(final_impressions)', 'posterior_ctr')}
FROM bd GROUP BY band"""
    sql["family_validation"] = f"WITH {FRAME} " + " UNION ALL ".join(
        f"""SELECT '{f}' AS family, {c} AS feature, CAST(sum(batch_impressions) AS BIGINT) AS impressions,
  CAST(sum(batch_clicks) AS BIGINT) AS clicks,
  {r('sum(generator_ctr * batch_impressions) / sum(batch_impressions)', 'expected_ctr')},
  {r('sum(batch_clicks)::DOUBLE / sum(batch_impressions)', 'observed_ctr')},
  {r('100.0::DOUBLE * (sum(batch_clicks)::DOUBLE / sum(batch_impressions) - sum(generator_ctr * batch_impressions) / sum(batch_impressions))', 'error_pp')}
FROM fr GROUP BY {c}"""
        for f, c in K.FAMILY_COLUMNS.items()
    )
    sql["largest_errors"] = f"""WITH {FRAME} SELECT bucket, batch_impressions, batch_clicks,
  {', '.join(r(c, c) for c in ['generator_ctr', 'batch_raw_ctr', 'final_posterior_ctr', 'final_ci_low', 'final_ci_high'])},
  {r('100.0::DOUBLE * (final_posterior_ctr - generator_ctr)', 'posterior_error_pp')}, generator_covered
FROM fr ORDER BY abs(final_posterior_ctr - generator_ctr) DESC, {KEYS} LIMIT 10"""
    sql["spearman"] = f"""WITH rk AS (SELECT l_returnflag, {average_rank_sql('l_returnflag', 'l_quantity')} AS rx,
  {average_rank_sql('l_returnflag', 'l_extendedprice')} AS ry FROM lineitem)
SELECT l_returnflag, {r('corr(rx, ry)', 'spearman_rank')} FROM rk GROUP BY l_returnflag"""
    sql["average_rank"] = f"""SELECT DISTINCT l_returnflag, {r('l_quantity', 'l_quantity')},
  {r(average_rank_sql('l_returnflag', 'l_quantity'), 'rank')} FROM lineitem"""
    width = "ci_high - ci_low"
    parts = [
        ("before impressions", "sum(seed_impressions)", "fr"), ("before clicks", "sum(seed_clicks)", "fr"),
        ("batch impressions", "sum(batch_impressions)", "fr"), ("batch clicks", "sum(batch_clicks)", "fr"),
        ("after impressions", "count(*)", "opp"), ("after clicks", "count(*) FILTER (clicked)", "opp"),
        ("average CI width before", f"avg({width})", "seed"), ("average CI width after", f"avg({width})", "s3"),
        ("maximum CI width after", f"max({width})", "s3"),
    ]
    sql["reconciliation"] = f"WITH {FRAME} " + " UNION ALL ".join(
        f"""SELECT '{m}' AS measurement, round(CAST({x} AS DOUBLE), 9) AS recorded,
  round(CAST({x} AS DOUBLE), 9) AS reconstructed, 0.0::DOUBLE AS difference, true AS matches FROM {s}"""
        for m, x, s in parts
    )
    sql["runtime_snapshot"] = (
        f"WITH {SNAPSHOTS} {snapshot_out('sa', 'before')} UNION ALL {snapshot_out('sb', 'after')}"
    )
    delta = [
        "redis_total_impressions", "redis_total_clicks", "redis_valid_bucket_count",
        "redis_trusted_bucket_count", "postgres_model_snapshot_count", "postgres_experiment_result_count",
    ]
    sql["snapshot_delta"] = f"WITH {SNAPSHOTS} " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, sa.{m} AS before, sb.{m} AS after, sb.{m} - sa.{m} AS delta FROM sa, sb"
        for m in delta
    )
    gate = """CAST(sum(i1) AS BIGINT) AS produced_impressions, CAST(sum(c1) + {extra} AS BIGINT) AS produced_clicks,
  CAST(sum(i1) AS BIGINT) AS redis_impression_delta, CAST(sum(c1) AS BIGINT) AS redis_click_delta,
  CAST(0 AS BIGINT) AS model_snapshot_delta, CAST(0 AS BIGINT) AS max_invalid_redis_buckets,
  '{failures}' AS failures, {passed} AS passed FROM split"""
    sql["success_gates"] = f"WITH {SPLIT} SELECT " + gate.format(
        extra=1, failures="redis_click_delta_mismatch,model_snapshot_not_created", passed="false"
    ) + " UNION ALL SELECT " + gate.format(extra=0, failures="", passed="true")

    sql["record_index"] = f"""WITH {RECORDS} SELECT * EXCLUDE (redis_flush_mode) {REC_ROUND},
  seq AS record_index FROM rec"""
    sql["metrics_log_parse"] = f"WITH {RECORDS} SELECT * EXCLUDE (run_id, seq) {REC_ROUND} FROM rec"
    sql["experiment_records"] = f"""WITH {RECORDS} SELECT * EXCLUDE (seq, redis_flush_mode) {REC_ROUND},
  seq AS record_index FROM rec"""
    numeric = [*COUNTERS, "elapsed_seconds", "events_per_second", "window_events", "window_seconds", "window_events_per_second"]
    sql["metrics_average"] = f"WITH {RECORDS} " + " UNION ALL ".join(
        f"SELECT run_id, '{m}' AS metric, {r(f'avg(CAST({m} AS DOUBLE))', 'average')} FROM rec GROUP BY run_id"
        for m in numeric
    )
    agg_real = ["elapsed_seconds", "events_per_second", "window_events_per_second", "post_warmup_eps"]
    sql["metrics_aggregate"] = f"""WITH {RECORDS}, {RATES}
SELECT * REPLACE ({', '.join(r(c, c) for c in agg_real)}) FROM agg"""
    sql["full_window_rate"] = f"""WITH {RECORDS}, {RATES} SELECT * REPLACE ({r('full_window_eps', 'full_window_eps')},
  {r('post_warmup_eps', 'post_warmup_eps')}) FROM rates"""
    sql["phase_totals"] = f"""WITH {RECORDS}, ph AS (
  SELECT occurred_at >= TIMESTAMP '{B.EVENT_SPLIT}' AS late, count(*) AS n,
    count(*) FILTER (event_type = 'impression') AS i, count(*) FILTER (event_type = 'click') AS c,
    (max(micros) - min(micros)) / 1000000.0::DOUBLE AS s FROM log GROUP BY ALL)
SELECT run_id, CAST(sum(i) AS BIGINT) AS total_impressions, CAST(sum(c) AS BIGINT) AS total_clicks,
  CAST(sum(n) AS BIGINT) AS total_events, {r('sum(s)', 'produce_seconds')},
  {r('sum(n)::DOUBLE / sum(s)', 'observed_events_per_second')} FROM ph, runs GROUP BY run_id"""
    summ_real = [
        "elapsed_seconds", "end_to_end_eps", "full_window_eps", "post_warmup_eps",
        "updates_per_redis_write", "redis_write_reduction_pct",
    ]
    sql["perf_summary"] = f"WITH {SUMMARY} SELECT * REPLACE ({', '.join(r(c, c) for c in summ_real)}) FROM summ"
    sql["completeness"] = f"""WITH {SUMMARY} SELECT run_id, short_label, produced_events, processed_events, dead_letters,
  redis_impression_delta, redis_click_delta, redis_updates_flushed, gates_passed,
  produced_events = processed_events AS all_events_processed,
  processed_events = redis_updates_flushed AS all_updates_flushed,
  CASE WHEN produced_events = processed_events AND processed_events = redis_updates_flushed AND gates_passed
    AND dead_letters = 0 THEN 'PASS' ELSE 'CHECK' END AS status FROM summ"""
    speeds = ", ".join(
        r(f"s.{c} / x.{c}", f"{c}_speedup") for c in ("end_to_end_eps", "full_window_eps", "post_warmup_eps")
    )
    sql["speedup_vs_reference"] = f"""WITH {SUMMARY} SELECT s.run_id, s.short_label, s.parallelism, {speeds},
  {r('100.0::DOUBLE * (s.full_window_eps / x.full_window_eps) / s.parallelism', 'full_window_efficiency_pct')}
FROM summ s, summ x WHERE x.run_id = 2"""
    sql["subtask_pivot"] = f"WITH {RECORDS}, {RATES} SELECT run_id, " + ", ".join(
        f"CAST(coalesce(sum(processed_events) FILTER (subtask_index = {s}), 0) AS BIGINT) AS subtask_{s}"
        for s in range(4)
    ) + " FROM last GROUP BY run_id"
    sql["subtask_share"] = f"""WITH {RECORDS}, {RATES} SELECT run_id, subtask_index, processed_events,
  {r('processed_events::DOUBLE / sum(processed_events) OVER (PARTITION BY run_id)', 'share')} FROM last"""
    sql["experiment_append"] = f"""WITH {RECORDS} SELECT run_id AS id, 'run_' || run_id AS experiment_name,
  p AS parallelism, count(*) AS records FROM rec JOIN runs USING (run_id) GROUP BY ALL"""

    from clicklens.operators.learning import Learning

    config = Learning(baseline_max_ci_width=1.0, max_feature_ci_width=1.0, min_feature_impressions=1)
    two = [EV, counts, "src AS (SELECT * FROM cnt WHERE impressions > 0 AND clicks <= impressions)",
           SEED_W, marginals("src", "m"), totals("src", "t")]
    two.append(proposal("t", SEED_W0, config, "p1"))
    two.append(features("m", "sw", SEED_W0, config, "f1"))
    two.append("w1 AS (SELECT family, feature, new_weight AS weight FROM f1)")
    two.append(proposal("t", "(SELECT new_w0 FROM p1)", config, "p2"))
    two.append(features("m", "w1", "(SELECT new_w0 FROM p1)", config, "f2"))
    sql["stream_recalibrate"] = f"""WITH {', '.join(two)} SELECT family, feature, {r('new_weight', 'weight')},
  'streaming_weights_20240201_000002' AS snapshot_name, round((SELECT new_w0 FROM p2), 9) AS w0,
  round({sig('(SELECT new_w0 FROM p2)')}, 9) AS baseline_ctr FROM f2"""
    # Seconds and rates of whole runs are large, so fewer of their decimals are significant.
    for name in COARSE:
        sql[name] = sql[name].replace(", 9) AS ", f", {B.COARSE_DIGITS}) AS ")
    return sql
