"""Texts built from rows: of windows, catalogue patterns, checkpoints, memories, triggers and snapshots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import banding as B

TS = "yyyy-MM-dd HH:mm:ss"


def _s(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def score_text(score: Column) -> Column:
    """A score with three decimals: the double's thousandths rounded half up, not those of the shortest decimal that stands for it."""
    return (F.round(score * F.lit(1000.0)).cast("decimal(5,0)") * F.lit("0.001").cast("decimal(3,3)")).cast("decimal(5,3)").cast("string")


def window_text() -> Column:
    span = F.concat(F.lit("window "), F.date_format("window_start", TS), F.lit(" to "), F.date_format("window_end", TS))
    return F.concat_ws(
        ". ", F.concat(F.lit("Charger "), F.coalesce("charger_id", F.lit("unknown"))), span, B.band_power("avg_power_w", "max_power_w"), B.band_voltage("min_voltage_v", "max_voltage_v", "voltage_stddev"),
        B.band_temperature("max_temp_c"), B.band_leak("max_earth_leak"), B.band_fan("avg_fan_rpm", "avg_power_w"), B.band_errors("error_count", F.array_join("distinct_errors", ", ")), B.band_status("status_changes"),
        F.when(F.col("anomaly_score") > 0, F.concat(F.lit("anomaly_score="), score_text(F.col("anomaly_score")))),
        F.when(F.size("anomaly_flags") > 0, F.concat(F.lit("flags="), F.array_join("anomaly_flags", ", "))),
    )


def outage_text() -> Column:
    labels = (("Pattern", "pattern_name"), ("Category", "category"), ("Severity", "severity"), ("Root cause", "root_cause"), ("Symptoms", "symptoms"), ("Resolution", "resolution"))
    return F.concat_ws(". ", *[F.concat(F.lit(f"{label}: "), _s(c)) for label, c in labels])


def reasoning_text() -> Column:
    extra = lambda label, c: F.when(F.length(_s(c)) > 0, F.concat(F.lit(f" | {label}: "), _s(c))).otherwise("")
    return F.concat(_s("observation"), extra("Hypothesis", "hypothesis"), extra("Tags", "tags"))


def memory_text() -> Column:
    return F.concat(F.lit("["), _s("category"), F.lit("] ["), _s("scope"), F.lit("] "), _s("content"))


def trigger_text() -> Column:
    """What an investigation of a window begins with: measures only where they are over 0, the fan where it is known."""
    part = lambda label, c, unit: F.when(F.col(c) > 0, F.concat(F.lit(f"{label} "), F.col(c).cast("string"), F.lit(unit)))
    head = F.concat(F.lit("Anomaly score "), score_text(F.col("anomaly_score")), F.lit(" for charger "), F.col("charger_id"))
    parts = [
        head, F.when(F.col("voltage_stddev") > 0, F.concat(F.lit("voltage stddev "), F.floor(F.col("voltage_stddev")).cast("string"), F.lit("V"))), part("max temp", "max_temp_c", "C"), part("avg power", "avg_power_w", "W"), part("errors", "error_count", ""),
        part("earth leakage", "max_earth_leak", "mA"), F.when(F.col("avg_fan_rpm").isNotNull(), F.concat(F.lit("fan rpm "), F.col("avg_fan_rpm").cast("string"))),
        F.when(F.size("anomaly_flags") > 0, F.concat(F.lit("flags: "), F.array_join("anomaly_flags", ", "))), F.concat(F.lit("window start "), F.date_format("window_start", TS)),
    ]
    return F.concat(F.concat_ws(". ", *parts), F.lit("."))


def anomaly_detail() -> Column:
    """The one most telling measure: the first that is not 0."""
    some = lambda c, label: F.when(F.col(c) > 0, F.lit(label))
    return F.coalesce(some("max_earth_leak", "earth_leak"), some("voltage_stddev", "voltage_stddev"), some("error_count", "error_count"), some("max_temp_c", "temp"), F.when(F.col("avg_fan_rpm").isNotNull(), F.lit("fan_rpm")), F.lit("anomaly_score_only"))


def site_of(text: Column) -> Column:
    """The site a profile text names: what follows ' at site ' up to a full stop."""
    return F.regexp_extract(text, r" at site ([^.]*)", 1)


def error_kind(message: Column) -> Column:
    m = F.lower(message)
    return F.when(m.contains("meta tensor"), "meta_tensor").when(m.contains("mysql") | m.contains("database") | m.contains("connection"), "database").when(m.contains("timeout") | m.contains("timed out"), "timeout").otherwise("unknown")
