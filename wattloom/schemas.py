"""Enumerations, thresholds, weights and table schemas in one place. The values are fixed by the domain."""

from __future__ import annotations

STATUSES = ("Available", "Preparing", "Charging", "SuspendedEVSE", "SuspendedEV", "Finishing", "Faulted", "Unavailable")
CATEGORIES = ("electrical", "mechanical", "thermal", "firmware", "network", "environmental")
OUTCOMES = ("fixed", "different_fault", "no_fault_found")
POSITIVE_OUTCOME = "fixed"

#: Flags, first match wins: (flag, SQL condition over a window row).
FLAGS = (
    ("high_voltage_variance", "voltage_stddev > 8"),
    ("high_temperature", "max_temp_c > 60"),
    ("frequent_errors", "error_count > 3"),
    ("earth_leakage", "max_earth_leak > 6"),
    ("fan_failure", "avg_fan_rpm < 500 AND avg_power_w > 1000"),
    ("status_flapping", "status_changes > 10"),
)
#: Score terms: (name, column, threshold, range, weight, capped in the stream form).
TERMS = (
    ("voltage_instability", "voltage_stddev", 5.0, 10.0, 0.25, False),
    ("thermal_stress", "max_temp_c", 50.0, 30.0, 0.20, False),
    ("error_rate", "error_count", 0.0, 5.0, 0.25, True),
    ("earth_leakage", "max_earth_leak", 4.0, 8.0, 0.20, False),
    ("status_flapping", "status_changes", 5.0, 10.0, 0.10, True),
)
#: Beta priors of derived confidence by provenance.
PRIORS = {"session": (1, 1), "consolidated": (3, 1), "verified": (2, 1)}
CONFIDENCE_FLOOR, CONFIDENCE_CEILING = 0.05, 0.99
#: Routing gate.
GATE_CONFIDENCE, GATE_CONFIRMATIONS, GATE_SIMILARITY = 0.85, 3, 0.55
#: Knowledge store distances.
MERGE_DISTANCE, SUPERSEDE_DISTANCE, COMPACT_DISTANCE, SCOPE_BOOST = 0.15, 0.40, 0.20, 0.95
DECAY, DEPRECATE_BELOW = "0.95", "0.30"

#: As DDL texts, which need no session.
TELEMETRY = (
    "charger_id string, connector_id tinyint, ts timestamp, status string, transaction_id string, energy_wh bigint, power_w int, voltage_v decimal(6,2), current_a decimal(6,2), "
    "soc_percent smallint, temp_c decimal(5,2), error_code string, vendor_error string, fan_rpm int, earth_leak_ma decimal(5,2), contactor_cycles int, signal_dbm smallint"
)
CDC = "type string, table string, data array<map<string,string>>"
