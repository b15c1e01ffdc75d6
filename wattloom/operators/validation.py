"""Validation and cleaning. Rows are never dropped: they get errors, warnings, is_valid and cleaned columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import REF

REQUIRED = ("charger_id", "ts", "status")
#: (name, condition that rejects); thresholds themselves are valid.
REJECT = (
    ("voltage_v", "voltage_v < 0 OR voltage_v > 500"), ("power_w", "power_w < 0 OR power_w > 500000"), ("current_a", "current_a < 0 OR current_a > 1000"),
    ("temp_c", "temp_c < -40 OR temp_c > 120"), ("earth_leak_ma", "earth_leak_ma > 50"), ("fan_rpm", "fan_rpm > 10000"),
)
WARN = (
    ("low voltage", "voltage_v > 0 AND voltage_v < 200"), ("no power while charging", "power_w = 0 AND status = 'Charging'"), ("hot", "temp_c > 80"), ("high leakage", "earth_leak_ma > 10"), ("worn contactor", "contactor_cycles > 500000"),
    ("soc clamped", "soc_percent < 0 OR soc_percent > 100"), ("leakage clamped", "earth_leak_ma < 0"), ("fan clamped", "fan_rpm < 0"), ("cycles clamped", "contactor_cycles < 0"),
)


def validate_telemetry(rows: DataFrame) -> DataFrame:
    """A missing required field is the only error reported then, and nothing is cleaned. Absent columns count as null."""
    have = set(rows.columns)
    for c, kind in (("voltage_v", "double"), ("power_w", "int"), ("current_a", "double"), ("temp_c", "double"), ("earth_leak_ma", "double"), ("fan_rpm", "int"), ("contactor_cycles", "int"), ("soc_percent", "int"), ("error_code", "string"), *((r, "string") for r in REQUIRED)):
        if c not in have:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    absent = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    missing = F.coalesce(*[F.when(absent(c), F.lit(f"missing {c}")) for c in REQUIRED])
    errors = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(f"impossible {name}")) for name, cond in REJECT]))
    warnings = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in WARN]))
    none = F.array().cast("array<string>")
    out = rows.withColumns({"errors": F.when(missing.isNotNull(), F.array(missing)).otherwise(errors), "warnings": F.when(missing.isNotNull(), none).otherwise(warnings)})
    whole = missing.isNull()
    clamp = lambda c, low, high=None: F.when(whole & (F.col(c) < low), F.lit(low).cast(dict(rows.dtypes)[c])).when(whole & (F.col(c) > high) if high is not None else F.lit(False), F.lit(high if high is not None else low).cast(dict(rows.dtypes)[c])).otherwise(F.col(c))
    cleaned = {"soc_percent": clamp("soc_percent", 0, 100), "earth_leak_ma": clamp("earth_leak_ma", 0), "fan_rpm": clamp("fan_rpm", 0), "contactor_cycles": clamp("contactor_cycles", 0), "error_code": F.when(whole, F.coalesce("error_code", F.lit("NoError"))).otherwise(F.col("error_code"))}
    return out.withColumns({**cleaned, "is_valid": F.size("errors") == 0})


def validate_windows(rows: DataFrame) -> DataFrame:
    """All missing fields are reported; the score is clamped to [0, 1]."""
    errors = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in ("charger_id", "window_start", "window_end")]))
    odd = (F.col("anomaly_score") < 0) | (F.col("anomaly_score") > 1)
    warnings = F.array_compact(F.array(F.when(odd, F.lit("score clamped"))))
    return rows.withColumns({"errors": errors, "warnings": warnings, "is_valid": F.size(errors) == 0, "anomaly_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("anomaly_score").cast("double")))})


def validate_refs(refs: DataFrame, known: dict[str, DataFrame], id_col: str = "id", ref_col: str = "ref") -> DataFrame:
    """(id, ref, reason): reason is null for a valid reference, else malformed, unknown_prefix or not_found.

    ``known`` has, for each prefix, a one-column table of existing keys; each is met in one join.
    """
    r = refs.select(F.col(id_col).alias("id"), F.trim(F.col(ref_col)).alias("ref"))
    r = r.withColumns({"prefix": F.regexp_extract("ref", r"^([a-z_]+):", 1), "key": F.regexp_extract("ref", r"^[a-z_]+:(.*)$", 1)})
    keys = None
    for prefix, t in known.items():
        k = t.select(F.lit(prefix).alias("prefix"), F.col(t.columns[0]).cast("string").alias("key")).distinct().withColumn("found", F.lit(True))
        keys = k if keys is None else keys.unionByName(k)
    r = r.join(keys, ["prefix", "key"], "left")
    reason = F.when(F.col("ref").isNull() | ~F.col("ref").rlike(REF), "malformed").when(~F.col("prefix").isin(*known), "unknown_prefix").when(F.col("found").isNull(), "not_found")
    return r.select("id", "ref", reason.alias("reason"))
