"""The window aggregate: 13 measures per charger and tumbling window, for batch and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring


def measures(zero_missing: bool = False) -> list[Column]:
    """Exact decimal sums, then one division. A null code is no error; statuses and codes are distinct sets.

    A measure that no row of the window has is null; with ``zero_missing``, power, current, fan and leakage are 0 then.
    """
    or_zero = lambda c: F.coalesce(c, F.lit(0)) if zero_missing else c
    dec = lambda c: F.col(c).cast("decimal(18,3)")
    n = F.count("voltage_v").cast("double")
    mean = F.sum(dec("voltage_v")).cast("double") / n
    square = F.sum(dec("voltage_v") * dec("voltage_v")).cast("double") / n
    statuses = F.size(F.collect_set("status"))  # a few values; a distinct count would shuffle once more
    average = lambda c, places: F.round(F.sum(F.col(c).cast("decimal(18,3)")) / F.count(c), places)
    codes = F.array_sort(F.collect_set(F.when(F.col("error_code") != "NoError", F.col("error_code"))))
    return [
        F.count("*").alias("msg_count"), or_zero(average("power_w", 2)).cast("decimal(10,2)").alias("avg_power_w"), or_zero(F.max("power_w")).alias("max_power_w"), F.min("voltage_v").alias("min_voltage_v"), F.max("voltage_v").alias("max_voltage_v"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("voltage_stddev"), or_zero(average("current_a", 2)).cast("decimal(10,2)").alias("avg_current_a"), F.max("temp_c").alias("max_temp_c"), average("temp_c", 2).cast("decimal(10,2)").alias("avg_temp_c"),
        F.coalesce(F.sum((F.col("error_code") != "NoError").cast("long")), F.lit(0)).alias("error_count"), statuses.cast("long").alias("status_changes"), F.when(F.size(codes) > 0, codes).alias("distinct_errors"),
        or_zero(F.avg(F.col("fan_rpm").cast("double")).cast("int")).alias("avg_fan_rpm"), or_zero(F.max("earth_leak_ma")).alias("max_earth_leak"),
    ]


def window_aggregate(telemetry: DataFrame, length: str = "5 minutes", score: bool = True, zero_missing: bool = False) -> DataFrame:
    """One row per charger and window, with flags, score and breakdown unless ``score`` is off."""
    w = telemetry.groupBy("charger_id", F.window("ts", length).alias("w")).agg(*measures(zero_missing))
    w = w.select("charger_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in w.columns if c not in ("charger_id", "w")])
    return with_scores(w) if score else w


def with_scores(windows: DataFrame) -> DataFrame:
    return windows.withColumns({"anomaly_flags": scoring.anomaly_flags(), "anomaly_score": scoring.stream_score(), "anomaly_breakdown": scoring.breakdown()})


def window_states(telemetry: DataFrame, length: str = "5 minutes") -> DataFrame:
    """What window_aggregate() needs of each charger and window, in a form that can be stored and merged: exact sums, counts, extremes and sets."""
    total = lambda c, kind: F.sum(F.col(c).cast(kind))
    dec, v = "decimal(18,3)", F.col("voltage_v").cast("decimal(18,3)")
    w = telemetry.groupBy("charger_id", F.window("ts", length).alias("w")).agg(
        F.count("*").alias("msg_count"), total("power_w", dec).alias("power_sum"), F.count("power_w").alias("power_n"), F.max("power_w").alias("max_power_w"), F.sum(v).alias("voltage_sum"), F.sum(v * v).alias("voltage_square"), F.count("voltage_v").alias("voltage_n"),
        F.min("voltage_v").alias("min_voltage_v"), F.max("voltage_v").alias("max_voltage_v"), total("current_a", dec).alias("current_sum"), F.count("current_a").alias("current_n"), total("temp_c", dec).alias("temp_sum"), F.count("temp_c").alias("temp_n"), F.max("temp_c").alias("max_temp_c"),
        F.coalesce(F.sum((F.col("error_code") != "NoError").cast("long")), F.lit(0)).alias("error_count"), F.collect_set("status").alias("statuses"), F.collect_set(F.when(F.col("error_code") != "NoError", F.col("error_code"))).alias("codes"),
        total("fan_rpm", "long").alias("fan_sum"), F.count("fan_rpm").alias("fan_n"), F.max("earth_leak_ma").alias("max_earth_leak"),
    )
    return w.select("charger_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in w.columns if c not in ("charger_id", "w")])


def merge_states(states: DataFrame, length: str) -> DataFrame:
    """States of the same or longer windows: stored ones, those of late or backfilled rows, or of the step to a day.

    ``length`` is the states' own or a multiple of it. Each raw row must be in one of the states only.
    """
    w = states.withColumn("w", F.window("window_start", length)).groupBy("charger_id", "w")
    how = lambda c: F.array_distinct(F.flatten(F.collect_set(c))) if c in ("statuses", "codes") else F.min(c) if c.startswith("min_") else F.max(c) if c.startswith("max_") else F.sum(c).cast(states.schema[c].dataType)
    held = [c for c in states.columns if c not in ("charger_id", "window_start", "window_end")]
    return w.agg(*[how(c).alias(c) for c in held]).select("charger_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *held)


def windows_of_states(states: DataFrame, score: bool = True, zero_missing: bool = False) -> DataFrame:
    """The rows of window_aggregate() from states."""
    or_zero = lambda c: F.coalesce(c, F.lit(0)) if zero_missing else c
    average = lambda c: F.round(F.col(f"{c}_sum") / F.col(f"{c}_n"), 2).cast("decimal(10,2)")
    of_n = lambda c: F.col(c).cast("double") / F.col("voltage_n").cast("double")
    codes = F.array_sort("codes")
    known = lambda n, c: F.when(F.col(n) > 0, c)
    w = states.select(
        "charger_id", "window_start", "window_end", "msg_count", or_zero(known("power_n", average("power"))).cast("decimal(10,2)").alias("avg_power_w"), or_zero(F.col("max_power_w")).alias("max_power_w"), "min_voltage_v", "max_voltage_v",
        F.sqrt(F.greatest(of_n("voltage_square") - of_n("voltage_sum") * of_n("voltage_sum"), F.lit(0.0))).alias("voltage_stddev"), or_zero(known("current_n", average("current"))).cast("decimal(10,2)").alias("avg_current_a"), "max_temp_c", known("temp_n", average("temp")).alias("avg_temp_c"),
        "error_count", F.size("statuses").cast("long").alias("status_changes"), F.when(F.size(codes) > 0, codes).alias("distinct_errors"), or_zero(known("fan_n", (F.col("fan_sum").cast("double") / F.col("fan_n")).cast("int"))).alias("avg_fan_rpm"), or_zero(F.col("max_earth_leak")).alias("max_earth_leak"),
    )
    return with_scores(w) if score else w
