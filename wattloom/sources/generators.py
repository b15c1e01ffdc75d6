"""The catalogue of known outages, as reference data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (pattern, name, category, severity, cause, symptoms, resolution) in our own words.
CATALOGUE = [
    ("ELEC-01", "Ground fault", "electrical", "safety", "Insulation worn through", ["leakage over 6 mA", "GroundFailure"], "Replace the cable set"),
    ("ELEC-02", "Voltage sag at peak", "electrical", "degraded", "Transformer too small", ["voltage below 210 V"], "Limit power at peak hours"),
    ("ELEC-03", "Contactor wear", "electrical", "outage", "Contacts pitted", ["retries before charging"], "Replace the contactor"),
    ("ELEC-04", "Phase loss", "electrical", "outage", "Blown fuse on one phase", ["voltage stddev over 12 V"], "Replace the fuse"),
    ("ELEC-05", "Leak sensor drift", "electrical", "degraded", "Sensor past its life", ["leakage rising for weeks"], "Recalibrate the sensor"),
    ("MECH-01", "Latch stuck", "mechanical", "outage", "Dirt in the latch", ["ConnectorLockFailure"], "Clean the latch"),
    ("MECH-02", "Cable strain", "mechanical", "degraded", "Cable pulled often", ["current drops"], "Fit a strain relief"),
    ("MECH-03", "Fan bearing", "mechanical", "degraded", "Bearing worn", ["fan below 500 rpm under load"], "Replace the fan"),
    ("THER-01", "Air filter clogged", "thermal", "degraded", "Dust", ["temperature above 60 C"], "Change the filter"),
    ("THER-02", "Heat soak", "thermal", "degraded", "Direct sun", ["temperature above 50 C at noon"], "Add shade"),
    ("FIRM-01", "Boot loop", "firmware", "outage", "Failed update", ["InternalError"], "Roll firmware back"),
    ("FIRM-02", "Meter freeze", "firmware", "degraded", "Driver hangs", ["same meter value"], "Update to 3.1.2"),
    ("FIRM-03", "Clock drift", "firmware", "minor", "No time server", ["late messages"], "Set a time server"),
    ("FIRM-04", "Status flapping", "firmware", "degraded", "State machine race", ["many status changes"], "Update to 2.9.x"),
    ("NETW-01", "Weak signal", "network", "degraded", "Antenna indoors", ["signal below -90 dBm"], "Move the antenna"),
    ("NETW-02", "Backend timeout", "network", "degraded", "Proxy drops idle links", ["reconnects each hour"], "Shorten the heartbeat"),
    ("NETW-03", "SIM blocked", "network", "outage", "Plan ended", ["no messages"], "Renew the plan"),
    ("ENVI-01", "Salt corrosion", "environmental", "safety", "coastal air", ["leakage", "GroundFailure"], "Seal and coat"),
    ("ENVI-02", "Water ingress", "environmental", "safety", "Seal broken", ["leakage after rain"], "Replace the seal"),
    ("ENVI-03", "Frost", "environmental", "minor", "Below -20 C", ["slow start"], "Add a heater"),
    ("ENVI-04", "Insects", "environmental", "minor", "Nest in the duct", ["fan slow"], "Fit a mesh"),
]


def outage_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "pattern_id string, pattern_name string, category string, severity string, root_cause string, symptoms array<string>, resolution string")
