"""Queries over telemetry windows: aggregate, flags, scores, bands, texts, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import banding as B
from ..functions import scoring, texts
from ..operators.validation import validate_telemetry, validate_windows
from ..operators.windows import merge_states, window_aggregate, window_states, windows_of_states
from ..schemas import TERMS
from ..sources.adapters import telemetry_of_events
from ..sources.scratch import written
from . import sql

START = "yyyy-MM-dd HH:mm:ss"


def daily(spark: SparkSession, sf_dir: str, length: str = "1 day") -> DataFrame:
    return window_aggregate(telemetry_of_events(spark, sf_dir), length)


def daily_of_states(spark: SparkSession, sf_dir: str, length: str = "1 day") -> DataFrame:
    """Days from the stored states of 5 minutes, with those of a tenth of the rows that came after these were stored."""
    t = telemetry_of_events(spark, sf_dir)
    stored, late = (window_states(t.filter(c)) for c in ("event_id % 10 > 0", "event_id % 10 = 0"))
    return windows_of_states(merge_states(written(stored).unionByName(late), length))


def _start() -> Column:
    return F.date_format("window_start", START).alias("window_start")


def _full(length: str, make=daily):  # noqa: ANN001, ANN202
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = lambda c: F.col(c).cast("double").alias(c)
        w = make(spark, sf_dir, length)
        return w.select(
            "charger_id", _start(), "msg_count", d("avg_power_w"), "max_power_w", d("min_voltage_v"), d("max_voltage_v"), "voltage_stddev", d("avg_current_a"), d("max_temp_c"), d("avg_temp_c"), "error_count", "status_changes",
            F.array_join("distinct_errors", ",").alias("distinct_errors"), "avg_fan_rpm", d("max_earth_leak"), F.element_at("anomaly_flags", 1).alias("flag"), "anomaly_score",
        )

    return q


def _column(name: str, make):  # noqa: ANN001, ANN202
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return daily(spark, sf_dir).select("charger_id", _start(), make().alias(name))

    return q


def breakdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("anomaly_breakdown")
    return daily(spark, sf_dir).select("charger_id", _start(), *[F.try_element_at(b, F.lit(t[0])).alias(t[0]) for t in TERMS], scoring.score_of_breakdown(b).alias("score"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry_of_events(spark, sf_dir).withColumns({"power_w": F.when(F.col("k") % 13 == 0, -F.col("power_w") - 1).otherwise(F.col("power_w")), "fan_rpm": F.col("fan_rpm") * 4, "temp_c": F.col("temp_c") * 2, "earth_leak_ma": F.col("earth_leak_ma") * 2 - 1, "status": F.when(F.col("k") % 19 == 0, F.lit(None)).otherwise(F.col("status"))})
    v = validate_telemetry(t)
    return v.select("event_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "is_valid", F.col("soc_percent").cast("int").alias("soc_percent"), F.col("earth_leak_ma").cast("double").alias("earth_leak_ma"))


def validated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = daily(spark, sf_dir).withColumn("anomaly_score", F.col("anomaly_score") * 2).withColumn("window_end", F.when(F.col("msg_count") > 4, F.lit(None)).otherwise(F.col("window_end")))
    return validate_windows(w).select("charger_id", _start(), F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "is_valid", "anomaly_score")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_of_events(spark, sf_dir).select("event_id", "charger_id", "status", "error_code", F.col("voltage_v").cast("double").alias("voltage_v"), "power_w")


_BANDS = {
    "band_power": lambda: B.band_power("avg_power_w", "max_power_w"), "band_voltage": lambda: B.band_voltage("min_voltage_v", "max_voltage_v", "voltage_stddev"), "band_temperature": lambda: B.band_temperature("max_temp_c"),
    "band_leak": lambda: B.band_leak("max_earth_leak"), "band_fan": lambda: B.band_fan("avg_fan_rpm", "avg_power_w"), "band_errors": lambda: B.band_errors("error_count", F.array_join("distinct_errors", ", ")), "band_status": lambda: B.band_status("status_changes"),
    "band_connectivity": lambda: B.band_connectivity(-F.col("max_power_w") / 100),
    "anomaly_flags": lambda: F.element_at("anomaly_flags", 1), "anomaly_score": lambda: F.col("anomaly_score"), "anomaly_detail": texts.anomaly_detail, "trigger_text": texts.trigger_text, "window_text": texts.window_text,
}

QUERIES = {
    "window_agg_1d": _full("1 day"), "window_agg_5m": _full("5 minutes"), "window_agg_of_states": _full("1 day", daily_of_states), "anomaly_breakdown": breakdown_rows, "validate_rows": validated, "validate_windows": validated_windows, "raw_projection": messages,
    **{k: _column(k, v) for k, v in _BANDS.items()},
}

P = "CASE WHEN max_power_w > 0 THEN avg_power_w::DOUBLE / max_power_w::DOUBLE ELSE 0.0::DOUBLE END"
_SQL = {
    "band_power": f"CASE WHEN avg_power_w <= 0 THEN 'power: none' WHEN {P} < 0.1::DOUBLE THEN 'power: minimal' WHEN {P} < 0.4::DOUBLE THEN 'power: low' WHEN {P} < 0.7::DOUBLE THEN 'power: moderate' WHEN {P} < 0.9::DOUBLE THEN 'power: high' ELSE 'power: near maximum' END",
    "band_voltage": "concat_ws('. ', CASE WHEN min_voltage_v < 210 THEN 'voltage: sag below 210V' WHEN min_voltage_v < 220 THEN 'voltage: dip below 220V' END, CASE WHEN voltage_stddev > 12 THEN 'voltage: severe instability' WHEN voltage_stddev > 8 THEN 'voltage: high variance' WHEN voltage_stddev > 5 THEN 'voltage: some fluctuation' ELSE 'voltage: stable' END, CASE WHEN max_voltage_v::DOUBLE - min_voltage_v::DOUBLE > 20 THEN 'voltage: range of ' || round_even(max_voltage_v::DOUBLE - min_voltage_v::DOUBLE, 0)::INTEGER::VARCHAR || 'V' END)",
    "band_temperature": "CASE WHEN max_temp_c > 70 THEN 'temperature: critical' WHEN max_temp_c > 60 THEN 'temperature: high' WHEN max_temp_c > 50 THEN 'temperature: elevated' WHEN max_temp_c > 35 THEN 'temperature: normal' ELSE 'temperature: cool' END",
    "band_leak": "CASE WHEN max_earth_leak > 8 THEN 'leakage: dangerous' WHEN max_earth_leak > 6 THEN 'leakage: elevated' WHEN max_earth_leak > 4 THEN 'leakage: slightly elevated' WHEN max_earth_leak > 2 THEN 'leakage: normal' ELSE 'leakage: minimal' END",
    "band_fan": "CASE WHEN avg_fan_rpm = 0 AND avg_power_w > 0 THEN 'fan: not turning under load' WHEN avg_fan_rpm < 500 AND avg_power_w > 1000 THEN 'fan: critically slow' WHEN avg_fan_rpm < 1000 AND avg_power_w > 5000 THEN 'fan: slow' WHEN avg_fan_rpm > 0 THEN 'fan: normal' ELSE 'fan: idle' END",
    "band_errors": "CASE WHEN error_count = 0 THEN 'errors: none' WHEN error_count <= 2 THEN 'errors: few' WHEN error_count <= 5 THEN 'errors: several' ELSE 'errors: storm' END || CASE WHEN error_count > 0 AND codes IS NOT NULL THEN ' (' || array_to_string(codes, ', ') || ')' ELSE '' END",
    "band_status": "CASE WHEN status_changes <= 2 THEN 'status: stable' WHEN status_changes <= 5 THEN 'status: some changes' WHEN status_changes <= 10 THEN 'status: frequent changes' ELSE 'status: flapping' END",
    "band_connectivity": "CASE WHEN -max_power_w / 100.0 < -90 THEN 'signal: very weak' WHEN -max_power_w / 100.0 < -80 THEN 'signal: weak' WHEN -max_power_w / 100.0 < -70 THEN 'signal: moderate' ELSE 'signal: strong' END",
    "anomaly_flags": "flag", "anomaly_score": "anomaly_score",
    "anomaly_detail": "CASE WHEN max_earth_leak > 0 THEN 'earth_leak' WHEN voltage_stddev > 0 THEN 'voltage_stddev' WHEN error_count > 0 THEN 'error_count' WHEN max_temp_c > 0 THEN 'temp' WHEN avg_fan_rpm IS NOT NULL THEN 'fan_rpm' ELSE 'anomaly_score_only' END",
    "trigger_text": f"concat_ws('. ', 'Anomaly score ' || anomaly_score::DECIMAL(5,3)::VARCHAR || ' for charger ' || charger_id, CASE WHEN voltage_stddev > 0 THEN 'voltage stddev ' || floor(voltage_stddev)::INTEGER::VARCHAR || 'V' END, CASE WHEN max_temp_c > 0 THEN 'max temp ' || max_temp_c::VARCHAR || 'C' END, CASE WHEN avg_power_w > 0 THEN 'avg power ' || avg_power_w::VARCHAR || 'W' END, CASE WHEN error_count > 0 THEN 'errors ' || error_count::VARCHAR END, CASE WHEN max_earth_leak > 0 THEN 'earth leakage ' || max_earth_leak::VARCHAR || 'mA' END, 'fan rpm ' || avg_fan_rpm::VARCHAR, 'flags: ' || flag, 'window start ' || {sql.ts('window_start')}) || '.'",
}
_SQL["window_text"] = f"concat_ws('. ', 'Charger ' || charger_id, 'window ' || {sql.ts('window_start')} || ' to ' || {sql.ts('window_end')}, {', '.join(_SQL[b] for b in ('band_power', 'band_voltage', 'band_temperature', 'band_leak', 'band_fan', 'band_errors', 'band_status'))}, CASE WHEN anomaly_score > 0 THEN 'anomaly_score=' || anomaly_score::DECIMAL(5,3)::VARCHAR END, 'flags=' || flag)"


def _all(length: str) -> str:
    return f"WITH {sql.windows(length)} SELECT charger_id, {sql.ts('window_start')} AS window_start, msg_count, avg_power_w::DOUBLE AS avg_power_w, max_power_w, min_voltage_v::DOUBLE AS min_voltage_v, max_voltage_v::DOUBLE AS max_voltage_v, voltage_stddev, avg_current_a, max_temp_c::DOUBLE AS max_temp_c, avg_temp_c, error_count, status_changes, distinct_errors, avg_fan_rpm, max_earth_leak::DOUBLE AS max_earth_leak, flag, anomaly_score FROM win"


_BROKEN = f"""WITH {sql.TELEMETRY},
t AS (SELECT event_id, k, CASE WHEN k % 13 = 0 THEN -power_w - 1 ELSE power_w END AS power_w, fan_rpm * 4 AS fan_rpm, temp_c * 2 AS temp_c, earth_leak_ma * 2 - 1 AS leak, CASE WHEN k % 19 = 0 THEN NULL ELSE status END AS status, soc_percent, voltage_v FROM tel)
SELECT event_id, CASE WHEN status IS NULL THEN 'missing status' ELSE concat_ws('; ', CASE WHEN voltage_v < 0 OR voltage_v > 500 THEN 'impossible voltage_v' END, CASE WHEN power_w < 0 OR power_w > 500000 THEN 'impossible power_w' END, CASE WHEN temp_c < -40 OR temp_c > 120 THEN 'impossible temp_c' END, CASE WHEN leak > 50 THEN 'impossible earth_leak_ma' END, CASE WHEN fan_rpm > 10000 THEN 'impossible fan_rpm' END) END AS errors,
 CASE WHEN status IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN voltage_v > 0 AND voltage_v < 200 THEN 'low voltage' END, CASE WHEN power_w = 0 AND status = 'Charging' THEN 'no power while charging' END, CASE WHEN temp_c > 80 THEN 'hot' END, CASE WHEN leak > 10 THEN 'high leakage' END, CASE WHEN soc_percent < 0 OR soc_percent > 100 THEN 'soc clamped' END, CASE WHEN leak < 0 THEN 'leakage clamped' END, CASE WHEN fan_rpm < 0 THEN 'fan clamped' END) END AS warnings,
 errors = '' AS is_valid, CASE WHEN status IS NULL THEN soc_percent ELSE greatest(0, least(100, soc_percent)) END AS soc_percent, (CASE WHEN status IS NULL THEN leak ELSE greatest(0, leak) END)::DOUBLE AS earth_leak_ma FROM t"""

ORACLE = {
    "window_agg_1d": _all("1 day"), "window_agg_of_states": _all("1 day"), "window_agg_5m": _all("5 minutes"), "validate_rows": _BROKEN,
    "anomaly_breakdown": f"WITH {sql.windows()}, b AS (SELECT charger_id, {sql.ts('window_start')} AS window_start, {', '.join(f'{sql.feature(t[0])} AS {t[0]}' for t in TERMS)} FROM win) SELECT *, round(least(1.0::DOUBLE, {' + '.join(f'coalesce({t[0]}, 0.0::DOUBLE) * {t[4]}::DOUBLE' for t in TERMS)}), 3) AS score FROM b",
    "validate_windows": f"WITH {sql.windows()} SELECT charger_id, {sql.ts('window_start')} AS window_start, CASE WHEN msg_count > 4 THEN 'missing window_end' ELSE '' END AS errors, CASE WHEN anomaly_score * 2 > 1 THEN 'score clamped' ELSE '' END AS warnings, msg_count <= 4 AS is_valid, greatest(0.0::DOUBLE, least(1.0::DOUBLE, anomaly_score * 2)) AS anomaly_score FROM win",
    "raw_projection": f"WITH {sql.TELEMETRY} SELECT event_id, charger_id, status, error_code, voltage_v::DOUBLE AS voltage_v, power_w FROM tel",
    **{k: f"WITH {sql.windows()} SELECT charger_id, {sql.ts('window_start')} AS window_start, {v} AS {k} FROM win" for k, v in _SQL.items()},
}
