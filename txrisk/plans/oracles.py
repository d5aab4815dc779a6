"""The registered queries as SQL for DuckDB, written from the definitions and not
from the Spark code. Doubles carry an exponent, because a plain decimal literal
is exact decimal arithmetic there."""

from __future__ import annotations

from txrisk import constants as C

TX_SQL = """
c0 AS (
  SELECT event_id, ts, user_id,
    CASE event_type WHEN 'view' THEN 'CASH_IN' WHEN 'click' THEN 'CASH_OUT' WHEN 'error' THEN 'DEBIT'
                    WHEN 'purchase' THEN 'PAYMENT' ELSE 'TRANSFER' END AS type,
    CAST(round(value * 100) AS BIGINT) AS v
  FROM events),
c1 AS (
  SELECT event_id, ts, user_id, type,
    CASE WHEN event_id % 41 = 0 THEN CAST(1000000 AS BIGINT) WHEN event_id % 43 = 0 THEN CAST(999900 AS BIGINT)
         WHEN event_id % 47 = 0 THEN CAST(2500000 AS BIGINT) ELSE v * v - CAST(floor(v * v / 2.0) AS BIGINT) END AS amt
  FROM c0),
c2 AS (
  SELECT event_id, ts, user_id, type, amt,
    CASE event_id % 4 WHEN 0 THEN amt WHEN 1 THEN amt * 2 WHEN 2 THEN CAST(0 AS BIGINT)
         ELSE CAST(floor(amt / 2.0) AS BIGINT) END AS old_o,
    (event_id % 17) * 100000 AS old_d,
    CASE WHEN type = 'PAYMENT' OR event_id % 10 = 0 THEN concat('M', CAST(event_id % 97 AS VARCHAR(20)))
         ELSE concat('C', CAST(event_id % 149 AS VARCHAR(20))) END AS dest
  FROM c1),
tx AS (
SELECT event_id, ts,
  CAST((EXTRACT(DAY FROM ts) - 1) * 24 + EXTRACT(HOUR FROM ts) + 1 AS INT) AS step,
  type, CAST(amt AS DOUBLE) / 100 AS amount,
  concat('C', CAST(user_id AS VARCHAR(20))) AS nameOrig,
  CAST(old_o AS DOUBLE) / 100 AS oldbalanceOrg,
  CAST(CASE WHEN old_o > amt THEN old_o - amt ELSE 0 END AS DOUBLE) / 100 AS newbalanceOrig,
  dest AS nameDest,
  CAST(old_d AS DOUBLE) / 100 AS oldbalanceDest,
  CAST(CASE WHEN event_id % 3 = 0 THEN old_d ELSE old_d + amt END AS DOUBLE) / 100 AS newbalanceDest,
  CAST(CASE WHEN type IN ('TRANSFER','CASH_OUT') AND event_id % 4 = 0 AND event_id % 5 <> 0 THEN 1 ELSE 0 END AS INT) AS isFraud,
  CAST(CASE WHEN type = 'TRANSFER' AND amt > 20000000 THEN 1 ELSE 0 END AS INT) AS isFlaggedFraud,
  epoch_us(ts) AS us, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS sec, amt AS cents
FROM c2)
"""

TX_LIST = ", ".join(["event_id", *C.TX_COLUMNS])

# Faulty rows: NaN is written as NULL here, as the readers do.
UNTIDY_SQL = f"""
, spoiled AS (
  SELECT event_id, ts, step,
    CASE WHEN event_id % 61 = 13 THEN lower(type) WHEN event_id % 67 = 17 THEN 'WIRE' ELSE type END AS type,
    CASE WHEN event_id % 29 = 3 THEN -amount WHEN event_id % 31 = 5 THEN NULL WHEN event_id % 37 = 7 THEN NULL
         WHEN event_id % 53 = 9 THEN 0e0 ELSE amount END AS amount,
    nameOrig, oldbalanceOrg, newbalanceOrig,
    CASE WHEN event_id % 71 = 19 THEN NULL ELSE nameDest END AS nameDest,
    CASE WHEN event_id % 59 = 11 THEN -1e0 ELSE oldbalanceDest END AS oldbalanceDest,
    newbalanceDest, isFraud, isFlaggedFraud
  FROM tx),
untidy AS (SELECT * FROM spoiled UNION ALL SELECT * FROM spoiled WHERE event_id % 7 = 2)
"""
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in C.TX_COLUMNS)
BALANCES_OK = " AND ".join(f"{c} >= 0" for c in C.BALANCES)

# ---------------------------------------------------------------- rule scoring
WEIGHTS = [
    ("r1", "R1", "high", "0.8e0", "format('needs {} but holds less', whole)"),
    ("r2", "R2", "high", "0.7e0", "'under 5 % of the opening balance is left'"),
    ("r3a", "R3a", "high", "0.6e0", "format('share sent: {} % (limit 80)', share)"),
    ("r3b", "R3b", "medium", "0.4e0", "format('share sent: {} % (limit 50)', share)"),
    ("r4a", "R4a", "medium", "0.5e0", "format('value {}, limit 10000', whole)"),
    ("r4b", "R4b", "low", "0.3e0", "format('value {}, limit 5000', whole)"),
    ("r5", "R5", "medium", "0.5e0", "'payee of a TRANSFER has a merchant number'"),
    ("r6", "R6", "medium", "0.5e0", "format('closing balance 0 after paying {}', whole)"),
    ("r7", "R7", "medium", "0.4e0", "format('TRANSFER above 1000 closes at 0: {}', whole)"),
    ("r8", "R8", "low", "0.3e0", "format('CASH_OUT takes {} % (limit 50)', share)"),
    ("r9a", "R9a", "medium", "0.4e0", "format('value is a listed one: {}', whole)"),
    ("r9b", "R9b", "low", "0.3e0", "format('last four digits of {} are 0000, 5000 or 9999', whole)"),
]
FACTOR = {"high": "1.0e0", "medium": "0.6e0", "low": "0.3e0"}
RAW = " + ".join(f"(CASE WHEN {f} THEN {w} ELSE 0e0 END)" for f, _, _, w, _ in WEIGHTS)
EVIDENCE = " + ".join(f"(CASE WHEN {f} THEN {w} * {FACTOR[s]} ELSE 0e0 END)" for f, _, s, w, _ in WEIGHTS)
CODES = "concat_ws(' ', " + ", ".join(f"CASE WHEN {f} THEN '{c}' END" for f, c, _, _, _ in WEIGHTS) + ")"
TEXTS = "concat_ws(' | ', " + ", ".join(f"CASE WHEN {f} THEN {t} END" for f, _, _, _, t in WEIGHTS) + ")"
N_REASONS = " + ".join(f"CAST({f} AS INT)" for f, *_ in WEIGHTS)


def rules_over(source: str = "tx") -> str:
    return f"""
, ratios AS (
  SELECT *, CASE WHEN oldbalanceOrg > 0 THEN amount / (oldbalanceOrg + 1) ELSE amount END AS ratio,
    type IN ('TRANSFER', 'CASH_OUT') AS moving, CAST(floor(amount) AS BIGINT) AS whole,
    CAST(floor(100 * CASE WHEN oldbalanceOrg > 0 THEN amount / (oldbalanceOrg + 1) ELSE amount END) AS BIGINT) AS share,
    amount > 1000 AND amount = floor(amount) AS is_whole
  FROM {source}),
hits AS (
  SELECT *,
    coalesce(amount > oldbalanceOrg AND oldbalanceOrg > 0, false) AS r1,
    coalesce(oldbalanceOrg > 0 AND newbalanceOrig < oldbalanceOrg * 0.05e0 AND moving, false) AS r2,
    coalesce(ratio > 0.8e0 AND moving, false) AS r3a,
    coalesce(NOT (ratio > 0.8e0) AND ratio > 0.5e0 AND moving, false) AS r3b,
    coalesce(amount > 10000, false) AS r4a,
    coalesce(amount > 5000 AND NOT amount > 10000, false) AS r4b,
    coalesce(type = 'TRANSFER' AND substr(nameDest, 1, 1) = 'M', false) AS r5,
    coalesce(newbalanceOrig = 0 AND amount > 0 AND oldbalanceOrg > 0, false) AS r6,
    coalesce(type = 'TRANSFER' AND amount > 1000 AND newbalanceOrig = 0, false) AS r7,
    coalesce(type = 'CASH_OUT' AND ratio > 0.5e0, false) AS r8,
    coalesce(is_whole AND whole IN (9999, 10000, 5000), false) AS r9a,
    coalesce(is_whole AND whole NOT IN (9999, 10000, 5000)
      AND right(CAST(whole AS VARCHAR), 4) IN ('0000', '9999', '5000'), false) AS r9b
  FROM ratios),
raw AS (SELECT *, {RAW} AS raw_score, least(({EVIDENCE}) / 2e0, 1e0) AS weighted, {N_REASONS} AS n_reasons FROM hits),
scored0 AS (SELECT *, 1e0 / (1e0 + exp(-10e0 * (raw_score - 0.5e0))) AS score FROM raw),
scored AS (SELECT *, score > 0.5e0 AS verdict,
  CASE WHEN score > 0.7e0 THEN 'high' WHEN score > 0.4e0 THEN 'medium' ELSE 'low' END AS conf FROM scored0)
"""


SIGNS = """
    CASE WHEN amount < 500 THEN 1e0 ELSE 0e0 END AS small_amount,
    CASE WHEN type = 'PAYMENT' THEN 1e0 ELSE 0e0 END AS is_payment,
    CASE WHEN oldbalanceOrg > 0 AND newbalanceOrig / oldbalanceOrg BETWEEN 0.1e0 AND 0.9e0 THEN 1e0 ELSE 0e0 END
      AS proportional,
    CASE WHEN amount / (oldbalanceOrg + 1) > 0.1e0 AND amount / (oldbalanceOrg + 1) < 0.9e0 THEN 1e0 ELSE 0e0 END
      AS regular_pattern"""
LEGIT = "small_amount * 0.3e0 + is_payment * 0.25e0 + proportional * 0.25e0 + regular_pattern * 0.2e0"


def reduced_over(source: str = "scored") -> str:
    """Needs score, conf, weighted, n_reasons."""
    return f"""
, signs AS (SELECT *, {SIGNS} FROM {source}),
legit AS (SELECT *, {LEGIT} AS legitimacy, score > 0.5e0 AS original_is_fraud FROM signs),
cleared AS (SELECT *, original_is_fraud AND (
    (score < 0.65e0 AND legitimacy > 0.5e0) OR (n_reasons < 2 AND legitimacy > 0.6e0)
    OR (amount < 1000 AND weighted < 0.6e0) OR (type = 'PAYMENT' AND score < 0.8e0)) AS fp_reduced FROM legit),
reduced AS (SELECT *, original_is_fraud AND NOT fp_reduced AS is_fraud,
    CASE WHEN fp_reduced THEN greatest(score * 0.7e0, 0.3e0) ELSE score END AS fraud_probability,
    weighted AS risk_score, CASE WHEN fp_reduced THEN 'low' ELSE conf END AS confidence FROM cleared)
"""


# A score of every value from 0.50 to 0.99 and only the first 1..3 reasons.
MODEL_SQL = (
    ", numbered AS (SELECT *, "
    + ", ".join(f"{' + '.join(f'CAST({g} AS INT)' for g, *_ in WEIGHTS[:i + 1])} AS n_{f}"
                for i, (f, *_) in enumerate(WEIGHTS))
    + " FROM scored), modelled0 AS (SELECT * EXCLUDE (score, conf, weighted, n_reasons), "
    "0.5e0 + (event_id % 50) / 100e0 AS score, "
    "least((" + " + ".join(
        f"(CASE WHEN {f} AND n_{f} <= event_id % 3 + 1 THEN {w} * {FACTOR[s]} ELSE 0e0 END)"
        for f, _, s, w, _ in WEIGHTS)
    + ") / 2e0, 1e0) AS weighted, least(n_reasons, event_id % 3 + 1) AS n_reasons FROM numbered), "
    "modelled AS (SELECT *, CASE WHEN score > 0.7e0 THEN 'high' WHEN score > 0.4e0 THEN 'medium' ELSE 'low' END AS conf "
    "FROM modelled0)"
)

FEATURES_SQL = """
, encoded AS (SELECT *,
    CASE type WHEN 'CASH_IN' THEN 0 WHEN 'CASH_OUT' THEN 1 WHEN 'DEBIT' THEN 2 WHEN 'PAYMENT' THEN 3
              WHEN 'TRANSFER' THEN 4 END AS type_encoded,
    CASE substr(nameOrig, 1, 1) WHEN 'C' THEN 0 WHEN 'M' THEN 1 END AS nameOrig_type,
    CASE substr(nameDest, 1, 1) WHEN 'C' THEN 0 WHEN 'M' THEN 1 END AS nameDest_type
  FROM {source}),
limits AS (SELECT quantile_cont(amount, 0.95) AS p95 FROM {fitted}),
derived AS (SELECT encoded.*, round(ln(1 + amount), 6) AS amount_log,
    oldbalanceOrg - newbalanceOrig AS balance_diff_orig, newbalanceDest - oldbalanceDest AS balance_diff_dest,
    CASE WHEN oldbalanceOrg > 0 THEN amount / oldbalanceOrg ELSE 0e0 END AS amount_to_balance_orig,
    CASE WHEN oldbalanceDest > 0 THEN amount / oldbalanceDest ELSE 0e0 END AS amount_to_balance_dest,
    CASE WHEN newbalanceOrig = 0 THEN 1 ELSE 0 END AS is_zero_balance_orig,
    CASE WHEN newbalanceDest = 0 THEN 1 ELSE 0 END AS is_zero_balance_dest,
    CASE WHEN amount > p95 THEN 1 ELSE 0 END AS is_large_amount,
    CASE WHEN type = 'TRANSFER' THEN 1 ELSE 0 END AS is_transfer,
    CASE WHEN type = 'CASH_OUT' THEN 1 ELSE 0 END AS is_cash_out,
    CASE WHEN substr(nameDest, 1, 1) = 'M' THEN 1 ELSE 0 END AS is_merchant_dest,
    step % 24 AS hour_of_day, (step // 24) % 7 AS day_of_week,
    CASE WHEN amount > 1000000 THEN 1 ELSE 0 END AS risk_amount,
    CASE WHEN oldbalanceOrg - newbalanceOrig = amount AND newbalanceDest = 0 THEN 1 ELSE 0 END AS risk_zero_balance
  FROM encoded, limits)
"""

SPLIT_SQL = """
, ordered AS (SELECT *, row_number() OVER (ORDER BY step, event_id) AS rn, count(*) OVER () AS n FROM {source}),
parts AS (SELECT *, CASE WHEN rn <= CAST(floor(n * (1e0 - 0.2e0 - 0.1e0)) AS BIGINT) THEN 'train'
                         WHEN rn <= CAST(floor(n * (1e0 - 0.2e0)) AS BIGINT) THEN 'val' ELSE 'test' END AS part
  FROM ordered)
"""

# ---------------------------------------------------------------- keyed state
AS_OF = 1705708800 * 1000000
STATE_SQL = """
, risky AS (SELECT *, (event_id % 100) / 100e0 AS risk FROM tx WHERE amount > 10000),
entries AS (
  SELECT 'risk' AS kind, nameOrig AS key, risk AS payload, us, 43200 AS ttl_s, event_id FROM risky
  UNION ALL
  SELECT 'fraud', CAST(event_id AS VARCHAR), risk, us, 86400, event_id FROM risky WHERE isFraud = 1)
"""
KNOWN_SQL = STATE_SQL + """
, risk_entries AS (SELECT * FROM entries WHERE kind = 'risk'),
known AS (
  SELECT tx.*, CASE WHEN tx.us < e.us + CAST(e.ttl_s AS BIGINT) * 1000000 THEN e.payload END AS known
  FROM tx ASOF LEFT JOIN risk_entries e ON tx.nameOrig = e.key AND tx.us >= e.us)
"""

# What a stream has passed when its input ends: ten minutes before the latest event, in milliseconds.
LIVE_SQL = KNOWN_SQL + """
, passed AS (SELECT max(us) // 1000 - 600000 AS ms FROM tx),
written AS (SELECT key, us, arg_max(payload, event_id) AS payload, us + 43200000000 AS until_us FROM risk_entries GROUP BY key, us),
gone AS (SELECT DISTINCT nameOrig AS key, us FROM tx WHERE isFlaggedFraud = 1),
newest AS (SELECT tx.event_id, tx.nameOrig, tx.us, w.us AS w_us, w.payload, w.until_us
  FROM tx ASOF LEFT JOIN written w ON tx.nameOrig = w.key AND tx.us >= w.us),
erased AS (SELECT n.*, g.us AS g_us FROM newest n ASOF LEFT JOIN gone g ON n.nameOrig = g.key AND n.us >= g.us),
last_written AS (SELECT key, max(us) AS us, arg_max(payload, us) AS payload, max(until_us) AS until_us FROM written, passed
  WHERE us // 1000 < ms GROUP BY key),
last_gone AS (SELECT key, max(us) AS g_us FROM gone, passed WHERE us // 1000 < ms GROUP BY key)
"""


def anchored_sql(key: str, source: str = "tx") -> str:
    """One recursive walk per key and window length: the n-th event joins the open
    window or opens a new one."""
    steps = "\n".join(f"""
, walk_{name} AS (
  SELECT k, rn, event_id, sec, sec AS anchor, CAST(1 AS BIGINT) AS n FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.k, s.rn, s.event_id, s.sec,
    CASE WHEN s.sec >= w.anchor + {ttl} THEN s.sec ELSE w.anchor END,
    CASE WHEN s.sec >= w.anchor + {ttl} THEN CAST(1 AS BIGINT) ELSE w.n + 1 END
  FROM walk_{name} w JOIN seq s ON s.k = w.k AND s.rn = w.rn + 1)"""
                      for name, ttl in [("minute", 60), ("hour", 3600), ("day", 86400)])
    return f"""
, seq AS (SELECT {key} AS k, event_id, sec, row_number() OVER (PARTITION BY {key} ORDER BY sec, event_id) AS rn FROM {source})
{steps}
, anchored AS (
  SELECT m.event_id, m.n AS tx_count_minute, h.n AS tx_count_hour, d.n AS tx_count_day
  FROM walk_minute m JOIN walk_hour h USING (event_id) JOIN walk_day d USING (event_id))
"""


UNTIMED_SQL = """
, untimed AS (SELECT * REPLACE (CASE WHEN event_id % 13 <> 0 THEN cents END AS cents) FROM tx)
"""
SLIDING_SQL = ", sliding AS (SELECT *, " + ", ".join(
    f"count(*) OVER (PARTITION BY nameOrig ORDER BY sec RANGE BETWEEN {ttl - 1} PRECEDING AND CURRENT ROW) AS tx_count_{n}"
    for n, ttl in [("minute", 60), ("hour", 3600), ("day", 86400)]) + " FROM {source})"


def profile_sql(source: str, before: bool) -> str:
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND " + ("1 PRECEDING" if before else "CURRENT ROW")
    over = f"OVER (PARTITION BY nameOrig, island ORDER BY us, event_id {frame})"
    return f"""
, gaps AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY nameOrig ORDER BY us, event_id) >= 86400000000
    THEN 1 ELSE 0 END AS restart FROM {source}),
islands AS (SELECT *, sum(restart) OVER (PARTITION BY nameOrig ORDER BY us, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM gaps),
profiled0 AS (SELECT *, CAST(sum(cents) {over} AS DOUBLE) / 100e0 AS total_amount, count(*) {over} AS tx_count,
    CAST(max(cents) {over} AS DOUBLE) / 100e0 AS max_amount, max(us) {over} AS last_us FROM islands),
profiled AS (SELECT *, CASE WHEN tx_count > 0 THEN total_amount / tx_count END AS avg_amount FROM profiled0)
"""


RISK_COLUMNS = """
  coalesce(known, 0e0) AS customer_risk_score, CASE WHEN tx_count = 0 THEN 1 ELSE 0 END AS is_new_customer,
  CASE WHEN amount > coalesce(max_amount, 0e0) * 1.5e0 THEN 1 ELSE 0 END AS is_high_amount_customer,
  coalesce((us - last_us) / 3600000000e0, 0e0) AS customer_age_hours,
  abs(amount - coalesce(avg_amount, 0e0)) / greatest(coalesce(avg_amount, 1e0), 1e0) AS avg_amount_deviation"""
RATIO_TO_AVG = "amount / greatest(coalesce(avg_amount, 1e0), 1e0) AS amount_ratio_to_avg"
ODD_HOUR = "(extract(hour FROM ts) < 6 OR extract(hour FROM ts) > 22)"
COUNTS = "tx_count_minute, tx_count_hour, tx_count_day"


def raised(score: str, condition: str, by: str) -> str:
    return f"(CASE WHEN {condition} THEN least(1e0, {score} + {by}) ELSE {score} END)"


def clamped_risk(score: str, fast: str, odd: str, risk: str) -> str:
    step = raised(raised(raised(score, fast, "0.1e0"), odd, "0.05e0"), f"coalesce({risk} > 0.7e0, false)", "0.1e0")
    return f"round(least(1e0, greatest(0e0, {step})), 6)"


AUC_SQL = """
, per_score AS (SELECT {score} AS s, count(*) FILTER (WHERE isFraud = 1) AS pos,
    count(*) FILTER (WHERE isFraud <> 1) AS neg FROM {source} GROUP BY 1),
below AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
  FROM per_score)
SELECT round(sum(pos * (neg_below + neg / 2e0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 9) AS auc FROM below
"""

FALLBACK = """CASE WHEN (amount > 1000000 AND oldbalanceOrg > 0 AND newbalanceOrig = 0
  AND type IN ('TRANSFER', 'CASH_OUT')) OR amount > 5000000 THEN 1 ELSE 0 END"""
COUNT_IF = "count(*) FILTER (WHERE {})"
FP_LIST = """event_id, original_is_fraud, is_fraud, fp_reduced, round(fraud_probability, 6) AS fraud_probability,
  round(risk_score, 6) AS risk_score, confidence"""
REPORT_LIST = """event_id, step, type, amount, nameOrig, nameDest, is_fraud,
  round(fraud_probability, 6) AS fraud_probability, round(risk_score, 6) AS risk_score, confidence, fp_reduced"""
GIVEN_SQL = """
, given AS (SELECT event_id, isFraud, -0.3e0 - (event_id % 97) / 200e0 AS forest_score,
    (event_id % 89) / 89e0 AS boosted_probability FROM tx),
ends AS (SELECT min(forest_score) AS low, max(forest_score) AS high FROM given),
scaled AS (SELECT given.*, CASE WHEN high > low THEN 1e0 - (forest_score - low) / (high - low) END AS forest_probability
  FROM given, ends)
"""
THRESHOLDS = "(VALUES " + ", ".join(f"({t:.2f}e0)" for t in C.FP_THRESHOLDS) + ") AS v(threshold)"
SWEEP_SQL = f"""
, flagged AS (SELECT * FROM legit WHERE original_is_fraud),
sweep0 AS (SELECT threshold, count(*) AS flagged, {COUNT_IF.format(
    "(score < threshold AND legitimacy > 0.5e0) OR (n_reasons < 2 AND legitimacy > 0.6e0) "
    "OR (amount < 1000 AND weighted < 0.6e0) OR (type = 'PAYMENT' AND score < 0.8e0)")} AS cleared
  FROM flagged, {THRESHOLDS} GROUP BY threshold),
sweep AS (SELECT *, CAST(cleared AS DOUBLE) / flagged AS rate, abs(CAST(cleared AS DOUBLE) / flagged - 0.3e0) AS distance
  FROM sweep0)
"""
RUNS_SQL = f"""
, counted AS (SELECT threshold, {COUNT_IF.format('isFraud = 1 AND score > threshold')} AS tp,
    {COUNT_IF.format('isFraud = 0 AND score > threshold')} AS fp,
    {COUNT_IF.format('isFraud = 1 AND NOT score > threshold')} AS fn
  FROM scored, {THRESHOLDS} GROUP BY threshold),
runs AS (SELECT concat('cut-', printf('%.2f', threshold)) AS run_id, threshold AS cut,
    CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0e0 END AS f1_score FROM counted)
"""
CONFUSION = f"""{COUNT_IF.format('isFraud = 0 AND NOT verdict')} AS true_negatives,
  {COUNT_IF.format('isFraud = 0 AND verdict')} AS false_positives,
  {COUNT_IF.format('isFraud = 1 AND NOT verdict')} AS false_negatives,
  {COUNT_IF.format('isFraud = 1 AND verdict')} AS true_positives"""
RATE_SQL = """SELECT epoch_us(time_bucket(INTERVAL '5 minutes', ts)) AS window_us,
  CASE WHEN verdict THEN 'fraud' ELSE 'legitimate' END AS result, count(*) AS predictions,
  count(*) / 300e0 AS per_second FROM scored GROUP BY 1, 2"""
ERRORS = ("concat_ws(' ', "
          + ", ".join([f"CASE WHEN {c} IS NULL THEN 'missing:{c}' END" for c in C.REQUEST_COLUMNS]
                      + [f"CASE WHEN {c} < 0 THEN 'negative:{c}' END" for c in ["amount", *C.BALANCES]]
                      + ["CASE WHEN upper(type) NOT IN ('CASH_IN','CASH_OUT','DEBIT','PAYMENT','TRANSFER') "
                         "THEN 'domain:type' END"]) + ")")
BINS = """CASE WHEN amount > 0 AND amount <= 100 THEN '0-100' WHEN amount > 100 AND amount <= 500 THEN '100-500'
  WHEN amount > 500 AND amount <= 1000 THEN '500-1000' WHEN amount > 1000 AND amount <= 5000 THEN '1000-5000'
  WHEN amount > 5000 AND amount <= 10000 THEN '5000-10000' WHEN amount > 10000 THEN '10000+' END"""


def build() -> dict[str, str]:
    rules, reduced = rules_over(), reduced_over()
    model = rules + MODEL_SQL + reduced_over("modelled")
    untidy_rules = UNTIDY_SQL + rules_over("untidy")
    trained = FEATURES_SQL.format(source="tx", fitted="tx")
    feature_list = ", ".join(C.FEATURES)
    sliding = SLIDING_SQL.format(source="known")
    before = ", less AS (SELECT * REPLACE (" + ", ".join(
        f"tx_count_{n} - 1 AS tx_count_{n}" for n in ["minute", "hour", "day"]) + ") FROM sliding)"
    behind = KNOWN_SQL + sliding + before + profile_sql("less", before=True)
    cleaned = UNTIDY_SQL + (
        f", cleaned AS (SELECT DISTINCT event_id, ts, {', '.join(C.TX_COLUMNS)} FROM untidy "
        f"WHERE {COMPLETE} AND amount >= 0 AND {BALANCES_OK})")
    q: dict[str, str] = {}

    # sources, sinks
    for name in ["tx_view", "csv_scan", "parquet_scan", "json_roundtrip", "stream_dedupe"]:
        q[name] = f"SELECT {TX_LIST} FROM tx"
    q["published_messages"] = f"SELECT {', '.join(C.TX_COLUMNS)} FROM tx"
    q["hash_sample"] = ("SELECT event_id, amount FROM tx ORDER BY md5(concat('42:', CAST(event_id AS VARCHAR))), event_id "
                        "LIMIT 2000")
    q["bounded_head"] = "SELECT event_id, amount FROM tx ORDER BY event_id LIMIT 5000"
    q["coerce_csv"] = """SELECT event_id, CAST(step AS DOUBLE) AS step, type, nameOrig,
      CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN NULL ELSE amount END AS amount FROM tx"""
    q["json_decode"] = """SELECT event_id,
      CASE WHEN event_id % 19 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k,
      CASE WHEN event_id % 19 = 0 THEN substr(props, 1, 4) END AS unreadable FROM events"""
    q["json_envelope"] = f"""SELECT step, type, amount, nameOrig, nameDest, {FALLBACK} AS prediction, event_id,
      amount AS amount_sent, 'rule_based' AS model_used FROM tx"""
    q["stream_score"] = f"SELECT step, type, amount, nameOrig, nameDest, {FALLBACK} AS prediction FROM tx"
    q["stream_quarantine"] = "SELECT 30 AS length FROM tx WHERE event_id % 23 = 0"
    q["stored_predictions"] = f"""SELECT CAST(event_id AS VARCHAR) AS key, {FALLBACK} AS prediction,
      0.5e0 AS probability, 'rule_based' AS model_used FROM tx
      WHERE us <= {AS_OF + 1800 * 1000000} AND {AS_OF + 1800 * 1000000} < us + 3600000000"""
    q["stored_once"] = f"""SELECT CAST(event_id AS VARCHAR) AS key, event_id % 3 AS batch, {FALLBACK} AS prediction,
      'rule_based' AS model_used FROM tx"""
    q["run_log"] = rules + RUNS_SQL + "SELECT run_id, 'rules' AS parent_id, cut, f1_score FROM runs"
    q["best_run"] = rules + RUNS_SQL + "SELECT run_id, f1_score FROM runs ORDER BY f1_score DESC, run_id LIMIT 1"

    # filters, cleaning
    q["distinct_rows"] = UNTIDY_SQL + f"SELECT DISTINCT {TX_LIST} FROM untidy"
    q["complete_rows"] = UNTIDY_SQL + f"SELECT {TX_LIST} FROM untidy WHERE {COMPLETE}"
    q["nonnegative_amount"] = UNTIDY_SQL + f"SELECT {TX_LIST} FROM untidy WHERE amount >= 0"
    q["nonnegative_balances"] = UNTIDY_SQL + f"SELECT {TX_LIST} FROM untidy WHERE {BALANCES_OK}"
    q["clean_table"] = cleaned + f"SELECT {TX_LIST} FROM cleaned"
    q["validate"] = UNTIDY_SQL + f"""SELECT event_id, CASE WHEN upper(type) IN
      ('CASH_IN','CASH_OUT','DEBIT','PAYMENT','TRANSFER') THEN upper(type) ELSE type END AS type, amount,
      {ERRORS} AS errors FROM untidy"""
    q["batch_sizes"] = """SELECT step, count(*) AS size, count(*) BETWEEN 1 AND 100 AS allowed FROM tx GROUP BY step"""
    q["account_search"] = """, found AS (SELECT *, count(*) OVER () AS count FROM tx WHERE nameOrig = 'C42')
      SELECT event_id, step, type, amount, nameDest, count FROM found ORDER BY event_id LIMIT 100"""
    q["account_lookup"] = """SELECT event_id, nameOrig, amount FROM tx
      WHERE nameOrig IN (SELECT nameOrig FROM tx WHERE isFlaggedFraud = 1)"""
    q["verdict_views"] = rules + reduced + """
      (SELECT event_id, type, is_fraud, 'fraud' AS view FROM reduced WHERE is_fraud ORDER BY event_id LIMIT 1000)
      UNION ALL (SELECT event_id, type, is_fraud, 'legit' FROM reduced WHERE NOT is_fraud ORDER BY event_id LIMIT 1000)
      UNION ALL (SELECT event_id, type, is_fraud, 'all' FROM reduced ORDER BY event_id LIMIT 1000)"""

    # encodings, features
    q["encode"] = UNTIDY_SQL + FEATURES_SQL.format(source="untidy", fitted="untidy") + \
        "SELECT event_id, type_encoded, nameOrig_type, nameDest_type FROM encoded"
    q["features_train"] = trained + f"SELECT event_id, {feature_list} FROM derived"
    q["model_features"] = trained + f"SELECT {feature_list} FROM derived"
    q["features_serving"] = """SELECT event_id, step, amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest,
      CASE type WHEN 'CASH_OUT' THEN 1 WHEN 'DEBIT' THEN 2 WHEN 'PAYMENT' THEN 3 WHEN 'TRANSFER' THEN 4 ELSE 0 END
        AS type_encoded,
      CASE WHEN nameOrig LIKE 'M%' THEN 1 ELSE 0 END AS nameOrig_type,
      CASE WHEN nameDest LIKE 'M%' THEN 1 ELSE 0 END AS nameDest_type, round(ln(1 + amount), 6) AS amount_log,
      amount / (oldbalanceOrg + 1) AS amount_to_balance_orig, amount / (oldbalanceDest + 1) AS amount_to_balance_dest,
      oldbalanceOrg - newbalanceOrig AS balance_diff_orig, newbalanceDest - oldbalanceDest AS balance_diff_dest,
      CASE WHEN oldbalanceOrg = 0 THEN 1 ELSE 0 END AS is_zero_balance_orig,
      CASE WHEN oldbalanceDest = 0 THEN 1 ELSE 0 END AS is_zero_balance_dest,
      step % 7 AS day_of_week, step % 24 AS hour_of_day, CASE WHEN type = 'CASH_OUT' THEN 1 ELSE 0 END AS is_cash_out,
      CASE WHEN amount > 10000 THEN 1 ELSE 0 END AS is_large_amount,
      CASE WHEN nameDest LIKE 'M%' THEN 1 ELSE 0 END AS is_merchant_dest FROM tx"""
    q["large_amount_p95"] = """, p AS (SELECT quantile_cont(amount, 0.95) AS p95 FROM tx)
      SELECT count(*) AS rows, count(*) FILTER (WHERE amount > p95) AS large, round(max(p95), 6) AS threshold FROM tx, p"""
    q["display"] = rules + reduced + f"""
      SELECT event_id, step, type, format('${{:,.2f}}', amount) AS amount, nameOrig, nameDest,
        CASE WHEN is_fraud THEN 'FRAUD' ELSE 'LEGITIMATE' END AS verdict,
        printf('%.2f%%', fraud_probability * 100) AS fraud_probability, printf('%.3f', risk_score) AS risk_score,
        concat(CASE WHEN n_reasons = 0 THEN 'no rule applies' ELSE {TEXTS} END,
          CASE WHEN fp_reduced THEN ' | verdict withdrawn: usual conduct' ELSE '' END) AS fraud_reasons FROM reduced"""

    # rules
    q["rule_hits"] = rules + " UNION ALL ".join(
        f"SELECT '{c}' AS rule, count(*) FILTER (WHERE {f}) AS hits FROM hits" for f, c, *_ in WEIGHTS)
    q["rule_score"] = rules + """SELECT event_id, round(raw_score, 6) AS raw_score, round(score, 6) AS score,
      conf AS confidence, verdict AS is_fraud FROM scored"""
    q["rule_reasons"] = rules + f"""SELECT event_id, {CODES} AS codes,
      CASE WHEN n_reasons = 0 THEN 'no rule applies' ELSE {TEXTS} END AS text, n_reasons FROM scored"""
    q["report"] = q["stream_report"] = rules + reduced + f"SELECT {REPORT_LIST} FROM reduced"
    q["report_unreduced"] = rules + """SELECT event_id, step, type, amount, nameOrig, nameDest, verdict AS is_fraud,
      round(score, 6) AS fraud_probability, round(score, 6) AS risk_score, conf AS confidence, false AS fp_reduced
      FROM scored"""
    q["labelled_report"] = rules + """SELECT event_id, step, type, amount, nameOrig, nameDest, verdict AS is_fraud,
      round(score, 6) AS fraud_probability, round(score, 6) AS risk_score, 'rule_based' AS model_used,
      isFraud AS "actual_isFraud", conf AS confidence FROM scored"""
    q["fallback_rule"] = f"SELECT event_id, {FALLBACK} AS prediction, 0.5e0 AS probability FROM tx"
    q["risk_score"] = rules + """, counted AS (SELECT *, count(*) OVER (PARTITION BY nameOrig ORDER BY sec
      RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS day_count FROM scored) SELECT event_id, """ + clamped_risk(
        "score", "day_count > 4", ODD_HOUR, "weighted") + " AS risk_score FROM counted"

    # false positives
    q["reason_weight"] = rules + MODEL_SQL + "SELECT event_id, round(weighted, 6) AS weighted_score FROM modelled"
    q["behaviour"] = f""", signs AS (SELECT *, {SIGNS} FROM tx) SELECT event_id, small_amount, is_payment, proportional,
      regular_pattern, round({LEGIT}, 6) AS legitimacy FROM signs"""
    q["fp_reduce"] = rules + reduced + f"SELECT {FP_LIST} FROM reduced"
    q["fp_model_scores"] = q["fp_paired"] = model + f"SELECT {FP_LIST} FROM reduced"
    q["fp_stats"] = model + f""", c AS (SELECT count(*) AS total_predictions,
      {COUNT_IF.format('original_is_fraud')} AS original_fraud_count,
      {COUNT_IF.format('original_is_fraud AND NOT is_fraud')} AS reduced_fraud_count FROM reduced),
      r AS (SELECT *, CASE WHEN original_fraud_count > 0 THEN CAST(reduced_fraud_count AS DOUBLE) / original_fraud_count
        ELSE 0e0 END AS fp_reduction_rate, 0.3e0 AS target_reduction FROM c)
      SELECT *, fp_reduction_rate >= target_reduction AS target_achieved FROM r"""
    q["fp_threshold_sweep"] = model + SWEEP_SQL + \
        "SELECT threshold, flagged, cleared, rate, round(distance, 9) AS distance FROM sweep"
    q["fp_best_threshold"] = model + SWEEP_SQL + "SELECT threshold, cleared FROM sweep ORDER BY distance, threshold LIMIT 1"
    q["report_reduction"] = rules + reduced + f""", c AS (SELECT {COUNT_IF.format('is_fraud')} AS remaining,
      {COUNT_IF.format('fp_reduced')} AS reduced FROM reduced) SELECT remaining + reduced AS original, remaining, reduced,
      CASE WHEN remaining + reduced > 0 THEN reduced * 100e0 / (remaining + reduced) ELSE 0e0 END AS reduction_rate FROM c"""

    # aggregates
    q["fraud_rate"] = "SELECT type, avg(isFraud) AS fraud_rate FROM tx GROUP BY type"
    q["kpis"] = rules + reduced + f"""SELECT count(*) AS total_count, {COUNT_IF.format('is_fraud')} AS fraud_count,
      {COUNT_IF.format('NOT is_fraud')} AS legit_count, {COUNT_IF.format('is_fraud')} * 100e0 / count(*) AS fraud_rate
      FROM reduced"""
    q["fraud_by_type"] = rules + f"""SELECT type, count(*) AS total, {COUNT_IF.format('verdict')} AS fraud_count
      FROM scored GROUP BY type"""
    q["amount_bins"] = untidy_rules + f""", labels AS (SELECT * FROM (VALUES ('0-100'), ('100-500'), ('500-1000'), ('1000-5000'),
        ('5000-10000'), ('10000+')) AS v(amount_range)),
      binned AS (SELECT {BINS} AS amount_range, verdict FROM scored WHERE amount > 0)
      SELECT amount_range, {COUNT_IF.format('NOT verdict')} AS legit, {COUNT_IF.format('verdict')} AS fraud
      FROM labels LEFT JOIN binned USING (amount_range) GROUP BY amount_range"""
    q["confusion"] = rules + f"SELECT {CONFUSION} FROM scored"
    q["quality"] = rules + f""", c AS (SELECT {CONFUSION} FROM scored)
      SELECT CASE WHEN true_positives + false_positives > 0
          THEN CAST(true_positives AS DOUBLE) / (true_positives + false_positives) ELSE 0e0 END AS precision,
        CASE WHEN true_positives + false_negatives > 0
          THEN CAST(true_positives AS DOUBLE) / (true_positives + false_negatives) ELSE 0e0 END AS recall,
        CASE WHEN 2 * true_positives + false_positives + false_negatives > 0 THEN CAST(2 * true_positives AS DOUBLE)
          / (2 * true_positives + false_positives + false_negatives) ELSE 0e0 END AS f1_score FROM c"""
    q["auc"] = rules + AUC_SQL.format(score="raw_score", source="scored")
    q["auc_amount"] = AUC_SQL.format(score="amount", source="tx")
    q["class_weight"] = """SELECT CAST(count(*) FILTER (WHERE isFraud = 0) AS DOUBLE) / count(*) FILTER (WHERE isFraud = 1)
      AS scale_pos_weight FROM tx"""
    q["prediction_counts"] = rules + f""", judged AS (SELECT 'rule_based' AS model_used, {FALLBACK} = 1 AS v FROM tx
      UNION ALL SELECT 'rules', verdict FROM scored)
      SELECT model_used, CASE WHEN v THEN 'fraud' ELSE 'legitimate' END AS result, count(*) AS predictions
      FROM judged GROUP BY 1, 2"""
    q["fraud_total"] = rules + reduced + f"SELECT {COUNT_IF.format('is_fraud')} AS fraud_detected FROM reduced"
    q["histogram"] = """, edges AS (SELECT * FROM (VALUES (1e4), (1e5), (1e6), (1e7), (NULL)) AS v(le))
      SELECT le, count(*) FILTER (WHERE le IS NULL OR cents <= le) AS in_bucket, count(*) AS n,
        CAST(sum(cents) AS DOUBLE) AS total FROM tx, edges GROUP BY le"""
    q["rate_5m"] = rules + RATE_SQL
    q["stream_rate_5m"] = rules + RATE_SQL
    q["batch_totals"] = """SELECT step, count(*) AS total_predictions, CAST(sum(cents) AS BIGINT) AS total_value,
      CAST(sum(cents) AS DOUBLE) / count(*) AS avg_per_prediction FROM tx GROUP BY step"""
    q["distinct_accounts"] = "SELECT DISTINCT type, nameDest FROM tx"

    # keyed state
    q["state_latest"] = STATE_SQL + f""", newest AS (SELECT *, row_number() OVER (PARTITION BY kind, key
        ORDER BY us DESC, event_id DESC) AS rn FROM entries WHERE us <= {AS_OF})
      SELECT kind, key, payload, ttl_s FROM newest WHERE rn = 1 AND {AS_OF} < us + CAST(ttl_s AS BIGINT) * 1000000"""
    q["state_asof"] = KNOWN_SQL + "SELECT event_id, nameOrig, known FROM known"
    q["stream_state_asof"] = LIVE_SQL + """SELECT event_id, nameOrig, CASE WHEN us < until_us THEN payload END AS known
      FROM newest, passed WHERE us // 1000 < ms"""
    q["stream_state_erased"] = LIVE_SQL + """SELECT event_id, nameOrig,
      CASE WHEN us < until_us AND (g_us IS NULL OR g_us < w_us) THEN payload END AS known FROM erased, passed WHERE us // 1000 < ms"""
    q["stream_state_held"] = LIVE_SQL + """SELECT key, payload, until_us FROM last_written LEFT JOIN last_gone USING (key), passed
      WHERE until_us // 1000 >= ms AND (g_us IS NULL OR g_us < us)"""
    q["counter_anchored"] = anchored_sql("nameOrig") + f"SELECT event_id, {COUNTS} FROM anchored"
    q["counter_anchored_dest"] = anchored_sql("nameDest") + f"SELECT event_id, {COUNTS} FROM anchored"
    q["counter_sliding"] = SLIDING_SQL.format(source="tx") + f"SELECT event_id, {COUNTS} FROM sliding"
    untimed = UNTIMED_SQL + ", placed AS (SELECT * FROM untimed WHERE event_id % 11 <> 0)"
    q["counter_anchored_untimed"] = untimed + anchored_sql("nameOrig", "placed") + \
        f"SELECT event_id, {COUNTS} FROM untimed LEFT JOIN anchored USING (event_id)"
    q["counter_sliding_untimed"] = untimed + SLIDING_SQL.format(source="placed") + \
        f"SELECT event_id, {COUNTS} FROM untimed LEFT JOIN sliding USING (event_id)"
    q["customer_profile_untimed"] = untimed + profile_sql("placed", False) + \
        "SELECT event_id, total_amount, tx_count, avg_amount, max_amount, last_us FROM untimed LEFT JOIN profiled USING (event_id)"
    q["clear_state"] = STATE_SQL + "SELECT kind, count(*) AS entries, 0 AS entries_left FROM entries GROUP BY kind"
    q["customer_profile"] = profile_sql("tx", False) + \
        "SELECT event_id, total_amount, tx_count, avg_amount, max_amount, last_us FROM profiled"
    q["customer_profile_before"] = profile_sql("tx", True) + \
        "SELECT event_id, total_amount, tx_count, avg_amount, max_amount, last_us FROM profiled"
    q["velocity_features"] = behind + f"""SELECT event_id, {COUNTS},
      tx_count_hour / CAST(greatest(1, extract(hour FROM ts) + 1) AS DOUBLE) AS tx_velocity_hour, {RATIO_TO_AVG},
      CASE WHEN tx_count_hour > 10 THEN 1 ELSE 0 END AS is_high_velocity,
      CASE WHEN {ODD_HOUR} THEN 1 ELSE 0 END AS is_unusual_time FROM profiled"""
    q["risk_features"] = behind + f"SELECT event_id, {RISK_COLUMNS} FROM profiled"
    q["realtime_features"] = anchored_sql("nameOrig") + ", known AS (SELECT *, CAST(NULL AS DOUBLE) AS known FROM tx)" + \
        profile_sql("known", False) + f"""SELECT event_id, {RISK_COLUMNS}, {COUNTS}, tx_count, {RATIO_TO_AVG}
      FROM profiled JOIN anchored USING (event_id)"""
    q["stream_velocity"] = anchored_sql("nameOrig") + profile_sql("tx", False) + f"""SELECT event_id, {COUNTS}, tx_count,
      total_amount, max_amount, last_us FROM profiled JOIN anchored USING (event_id)"""
    q["stream_velocity_missing"] = UNTIMED_SQL + profile_sql("untimed", False) + \
        "SELECT event_id, tx_count, total_amount, max_amount FROM profiled"
    q["erase_customer"] = STATE_SQL + """, gone AS (SELECT DISTINCT nameOrig FROM tx WHERE isFlaggedFraud = 1)
      SELECT kind, key, count(*) AS entries FROM (
        SELECT kind, key, CASE WHEN kind = 'risk' THEN key END AS owner FROM entries
        UNION ALL SELECT 'count', concat(nameOrig, ':day'), nameOrig FROM tx)
      WHERE owner IS NULL OR owner NOT IN (SELECT nameOrig FROM gone) GROUP BY kind, key"""
    q["stats_snapshot"] = rules + reduced + f"""SELECT 'stats' AS kind, 'aggregate' AS key, count(*) AS total_count,
      {COUNT_IF.format('is_fraud')} AS fraud_count, {COUNT_IF.format('NOT is_fraud')} AS legit_count, 300 AS ttl_s
      FROM reduced"""

    # sorts, limits, splits
    q["temporal_split"] = SPLIT_SQL.format(source="tx") + "SELECT event_id, step, part FROM parts"
    holed = ", holed AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN step END AS step FROM tx)"
    q["temporal_split_untimed"] = holed + SPLIT_SQL.format(source="holed").replace(
        "ORDER BY step, event_id", "ORDER BY step NULLS LAST, event_id") + "SELECT event_id, step, part FROM parts"
    q["by_step"] = "SELECT step, event_id, amount FROM tx ORDER BY step, event_id"
    q["top_risk"] = rules + """SELECT event_id, round(raw_score, 6) AS raw_score FROM scored
      ORDER BY scored.raw_score DESC, event_id LIMIT 100"""

    # learning
    q["prepare"] = cleaned + SPLIT_SQL.format(source="cleaned") + FEATURES_SQL.format(source="parts", fitted="parts") + \
        f"SELECT event_id, part, {feature_list} FROM derived"
    q["prepare_train_scope"] = SPLIT_SQL.format(source="tx") + \
        ", training AS (SELECT * FROM parts WHERE part = 'train')" + \
        FEATURES_SQL.format(source="parts", fitted="training") + "SELECT event_id, part, is_large_amount FROM derived"
    q["forest_saved"] = "SELECT count(*) AS rows, count(*) AS equal FROM tx"
    q["gbt_checked"] = "SELECT count(*) AS rows, count(*) AS in_range, count(*) AS consistent FROM tx"
    n = len(C.FEATURES)
    q["importance_checked"] = f"SELECT {n} AS features, 1e0 AS total, {n} AS in_range"
    q["ensemble_metrics_checked"] = "SELECT 3 AS models, 3 AS precision, 3 AS recall, 3 AS f1_score, 3 AS auc"
    q["batch_score_checked"] = """SELECT unnest(['ensemble', 'xgboost']) AS model_used, count(*) AS rows, count(*) AS in_range,
      count(*) AS consistent FROM tx"""
    q["search_resume"] = """SELECT * FROM (VALUES (0, 5, 0.01e0, true), (0, 5, 0.02e0, true), (1, 6, 0.03e0, true),
      (2, 5, 0.01e0, true), (2, 5, 0.02e0, true)) AS v(search, trees, contamination, scored)"""
    q["grid_forest"] = """SELECT contamination, n_estimators, true AS scored FROM (VALUES (0.005e0), (0.01e0), (0.02e0)) AS c(contamination),
      (VALUES (50), (100), (200)) AS n(n_estimators)"""
    q["grid_boosted"] = """SELECT 3 AS n_estimators, max_depth, 0.1e0 AS learning_rate, 10 AS scale_pos_weight, true AS scored
      FROM (VALUES (3), (4)) AS d(max_depth)"""
    q["trials_forest"] = "SELECT 4 AS trials, 4 AS in_space, 4 AS scored"
    q["trials_boosted"] = "SELECT 2 AS trials, 2 AS in_space, 2 AS scored"
    q["gbt_penalised"] = "SELECT count(*) AS rows, count(*) AS in_range, count(*) AS consistent, true AS best_kept FROM tx"
    q["stream_ensemble"] = "SELECT 1 AS model_version, 'ensemble' AS model_used, count(*) AS rows, count(*) AS as_in_batch FROM tx"
    q["best_refit"] = "SELECT count(*) AS rows, count(*) AS in_range, 5 AS trees FROM tx"
    # mean path of an unsuccessful search among eight rows
    mean_path = "(2e0 * (ln(7e0) + 0.5772156649015329e0) - 2e0 * 7e0 / 8e0)"
    q["forest_walk"] = f""", walked AS (SELECT event_id,
        CASE WHEN NOT amount > 1000 THEN 3.5e0 WHEN NOT oldbalanceOrg > 5000 THEN 2e0 ELSE 1e0 END
        + CASE WHEN NOT oldbalanceOrg > 100 THEN 2.5e0 ELSE 4.25e0 END AS total FROM tx),
      judged AS (SELECT event_id, -pow(2e0, -total / (2 * {mean_path})) AS score FROM walked)
      SELECT event_id, round(score, 9) AS forest_score, score < -0.55e0 AS is_outlier FROM judged"""
    q["forest_probability"] = GIVEN_SQL + "SELECT event_id, round(forest_probability, 6) AS forest_probability FROM scaled"
    q["forest_cut"] = GIVEN_SQL + """, p AS (SELECT quantile_cont(forest_score, 0.05) AS cut FROM given)
      SELECT count(*) FILTER (WHERE forest_score < cut) AS outliers, round(max(cut), 9) AS cut FROM given, p"""
    mix = "forest_probability * 0.3e0 + boosted_probability * 0.7e0"
    q["ensemble_combine"] = GIVEN_SQL + f"""SELECT event_id, round({mix}, 6) AS ensemble_probability,
      CASE WHEN {mix} >= 0.5e0 THEN 1 ELSE 0 END AS ensemble_verdict FROM scaled"""
    q["score_dispatch"] = behind + f"""SELECT event_id, {FALLBACK} = 1 AS is_fraud, 0.5e0 AS fraud_probability,
      'rule_based' AS model_used, """ + clamped_risk("0.5e0", "tx_count_hour > 10", ODD_HOUR, "known") + \
        " AS risk_score FROM profiled"

    q["prediction_records"] = behind + f"""SELECT event_id, {FALLBACK} = 1 AS is_fraud, 0.5e0 AS fraud_probability,
      'rule_based' AS model_used, 12 AS n_features, CAST(tx_count_day AS DOUBLE) AS tx_count_day, {RATIO_TO_AVG},
      coalesce(known, 0e0) AS customer_risk_score FROM profiled"""

    # all sessions, also those that are open when the input ends
    q["stream_sessions"] = """, gaps AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY nameOrig ORDER BY us) >= 86400000000
        THEN 1 ELSE 0 END AS opens FROM tx),
      islands AS (SELECT *, sum(opens) OVER (PARTITION BY nameOrig ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING
        AND CURRENT ROW) AS island FROM gaps)
      SELECT nameOrig, min(us) AS start_us, max(us) + 86400000000 AS end_us, count(*) AS tx_count,
        CAST(sum(cents) AS DOUBLE) / 100e0 AS total_amount, CAST(max(cents) AS DOUBLE) / 100e0 AS max_amount
      FROM islands GROUP BY nameOrig, island"""

    plain = {"json_decode"}
    return {name: sql if name in plain else _with(sql) for name, sql in q.items()}


def _with(sql: str) -> str:
    """Prefix the transaction view; RECURSIVE covers the counter walks."""
    body = sql.strip()
    return f"WITH RECURSIVE {TX_SQL.strip()}\n{body}"


ORACLES = build()
