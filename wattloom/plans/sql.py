"""Shared pieces of the oracle SQL: the stand-in tables and the window aggregate, written for another engine."""

from __future__ import annotations

from ..schemas import FLAGS, TERMS

TELEMETRY = """tel AS (SELECT event_id, 'CP-' || lpad(user_id::VARCHAR, 5, '0') AS charger_id, ts, event_type AS status,
  CASE WHEN event_type IN ('error', 'view', 'click') THEN 'E' || (k % 4)::VARCHAR ELSE 'NoError' END AS error_code,
  (222 + d * 0.1)::DECIMAL(12,3) AS voltage_v, (d * 0.5)::DECIMAL(12,3) AS current_a, (25 + d * 0.2)::DECIMAL(12,3) AS temp_c, ((k % 10) * 0.9)::DECIMAL(12,3) AS earth_leak_ma,
  k * 30 AS fan_rpm, k * 100 AS power_w, k * 3 - 20 AS soc_percent, k
  FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k, value::DECIMAL(8,2) AS d FROM events))"""

FLAG = "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in FLAGS) + " END"


def _term(column: str, threshold: float, span: float, weight: float, capped: bool) -> str:
    over = f"({column}::DOUBLE - {threshold}::DOUBLE) / {span}::DOUBLE"
    over = f"least(1.0::DOUBLE, {over})" if capped else over
    return f"CASE WHEN {column} > {threshold} THEN {weight}::DOUBLE * ({over}) ELSE 0.0::DOUBLE END"


SCORE = "round(least(1.0::DOUBLE, " + " + ".join(_term(c, t, s, w, capped) for _, c, t, s, w, capped in TERMS) + "), 4)"


def feature(name: str) -> str:
    _, c, t, s, _, _ = next(x for x in TERMS if x[0] == name)
    return f"CASE WHEN {c} > {t} THEN round(least(1.0::DOUBLE, ({c}::DOUBLE - {t}::DOUBLE) / {s}::DOUBLE), 3) END"


def windows(length: str = "1 day") -> str:
    half_up = lambda s, n, scale: f"(((2 * {s} * {scale} + {n}) // (2 * {n}))::DOUBLE / 100)"
    return f"""{TELEMETRY},
g AS (SELECT charger_id, time_bucket(INTERVAL {length}, ts) AS window_start, count(*) AS msg_count, sum(power_w)::HUGEINT AS sp, max(power_w) AS max_power_w, min(voltage_v) AS min_voltage_v, max(voltage_v) AS max_voltage_v,
  sum(voltage_v)::DOUBLE / count(voltage_v)::DOUBLE AS mean, sum(voltage_v * voltage_v)::DOUBLE / count(voltage_v)::DOUBLE AS square, sum((current_a * 1000)::BIGINT)::HUGEINT AS sc, max(temp_c) AS max_temp_c, sum((temp_c * 1000)::BIGINT)::HUGEINT AS st,
  count(*) FILTER (error_code <> 'NoError') AS error_count, count(DISTINCT status) AS status_changes, list_sort(list(DISTINCT error_code) FILTER (error_code <> 'NoError')) AS codes, trunc(avg(fan_rpm))::INTEGER AS avg_fan_rpm, max(earth_leak_ma) AS max_earth_leak
  FROM tel GROUP BY ALL),
w0 AS (SELECT *, window_start + INTERVAL {length} AS window_end, sqrt(greatest(square - mean * mean, 0.0)) AS voltage_stddev, {half_up("sp", "msg_count", 100)}::DECIMAL(10,2) AS avg_power_w,
  ((sc + 5 * msg_count) // (10 * msg_count))::DOUBLE / 100 AS avg_current_a, ((st + 5 * msg_count) // (10 * msg_count))::DOUBLE / 100 AS avg_temp_c, array_to_string(codes, ',') AS distinct_errors FROM g),
win AS (SELECT *, {FLAG} AS flag, {SCORE} AS anomaly_score FROM w0)"""


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


REASONING = f"""{TELEMETRY},
rea AS (SELECT event_id AS id, charger_id, 'S' || (event_id % 40)::VARCHAR AS session_id, ts AS created_at, 'seen ' || status AS observation, CASE WHEN k % 3 > 0 THEN 'cause ' || error_code END AS hypothesis,
  (['confirmed', 'escalated', 'promoted', 'inconclusive'])[(k % 4) + 1] AS resolution, list_filter([CASE WHEN k % 2 = 0 THEN 'temp' END, CASE WHEN k % 3 = 0 THEN 'fan' END, CASE WHEN k % 5 = 0 THEN 'leak' END], lambda x: x IS NOT NULL) AS tags,
  CASE WHEN k % 17 = 0 THEN event_id + 1 END AS superseded_by, CASE WHEN k % 7 = 0 THEN 'fixed' WHEN k % 7 = 1 THEN 'different_fault' END AS verified_outcome, k FROM tel)"""

MEMORY = """mem AS (SELECT c_custkey AS id, lower(c_mktsegment) AS category, CASE WHEN c_custkey % 5 = 0 THEN 'global' ELSE 'site:' || (c_nationkey % 5)::VARCHAR END AS scope, c_name AS content, (['session', 'consolidated', 'verified'])[(c_custkey % 3) + 1] AS provenance,
  (c_custkey % 6)::INTEGER AS verified_confirmations, (c_custkey % 3)::INTEGER AS verified_contradictions, (c_custkey % 4)::INTEGER AS access_count, CASE WHEN c_custkey % 11 = 0 THEN 'superseded' ELSE 'active' END AS status,
  ((20 + c_custkey % 80)::DECIMAL(5,0) * 0.01::DECIMAL(3,2))::DECIMAL(3,2) AS confidence, TIMESTAMP '2024-06-01' - (c_custkey % 200)::INTEGER * INTERVAL 1 DAY AS created_at, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2024-06-01' - (c_custkey % 60)::INTEGER * INTERVAL 1 DAY END AS last_decayed_at,
  ['agent_reasoning:' || (c_custkey * 2)::VARCHAR, 'charger_windows:' || c_custkey::VARCHAR] AS source_refs, CASE WHEN c_custkey % 2 = 0 THEN ['agent_reasoning:' || (c_custkey * 2 + 1)::VARCHAR] ELSE [] END AS pending_refs, (c_custkey % 5 + 1)::INTEGER AS supporting_evidence_count FROM customer)"""


def confidence(p: str, c: str, k: str) -> str:
    """Exact half up in whole hundredths: floor((200 a + b) / (2 b)) of a / b, after the clamp."""
    a = f"CASE {p} WHEN 'consolidated' THEN 3 WHEN 'verified' THEN 2 ELSE 1 END"
    num, den = f"({c} + {a})", f"({c} + {k} + {a} + 1)"
    return f"(CASE WHEN 100 * {num} >= 99 * {den} THEN 99 WHEN 100 * {num} <= 5 * {den} THEN 5 ELSE (200 * {num} + {den}) // (2 * {den}) END)::DOUBLE / 100"
