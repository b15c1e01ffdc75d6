"""Domain tables: readers with declared schemas, and stand-ins built from the tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CDC, TELEMETRY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parse_telemetry(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """JSON messages (batch or stream) as telemetry rows; messages that are no JSON give rows of nulls and are dropped."""
    return lines.select(F.from_json(F.col(value_col).cast("string"), TELEMETRY).alias("t")).select("t.*").filter("charger_id IS NOT NULL OR ts IS NOT NULL")


def parse_changes(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Change messages as rows (type, table, row): inserts and updates only; bad JSON is ignored."""
    m = lines.select(F.from_json(F.col(value_col).cast("string"), CDC, {"mode": "PERMISSIVE"}).alias("m")).filter("m.type IN ('INSERT', 'UPDATE')")
    return m.select("m.type", "m.table", F.explode("m.data").alias("row"))


def changes_to_embed(changes: DataFrame, vector_columns: dict[str, str]) -> DataFrame:
    """(table, id, row) of known tables whose row has an identifier and no vector yet."""
    vectors = F.create_map(*[x for t, c in vector_columns.items() for x in (F.lit(t), F.lit(c))])
    rows = changes.withColumn("vec", F.try_element_at(vectors, F.col("table"))).filter("vec IS NOT NULL")
    rows = rows.withColumn("id", F.try_element_at("row", F.lit("id"))).filter("id IS NOT NULL AND id NOT IN ('', '0')")
    return rows.filter(F.try_element_at("row", F.col("vec")).isNull()).select("table", "id", "row")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of charger configurations."""
    schema = "charger_id string, site_id string, model string, manufacturer string, firmware_version string, install_date date, lat double, lon double, connector_count tinyint, max_power_kw double, environment string"
    return spark.read.schema(schema).json(path, multiLine=True)


def telemetry_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_of(table(spark, sf_dir, "events"))


def telemetry_of(events: DataFrame) -> DataFrame:
    """Stand-in telemetry of events, batch or stream: a user is a charger, an event a message; all measures exact decimals."""
    e = events.withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "d": F.col("value").cast("decimal(8,2)")})
    dec = "decimal(12,3)"
    return e.select(
        "event_id", F.concat(F.lit("CP-"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("charger_id"), "ts", F.col("event_type").alias("status"),
        F.when(F.col("event_type").isin("error", "view", "click"), F.concat(F.lit("E"), (F.col("k") % 4).cast("string"))).otherwise("NoError").alias("error_code"),
        (F.lit(222).cast("decimal(5,0)") + F.col("d") * F.lit("0.1").cast("decimal(2,1)")).cast(dec).alias("voltage_v"),
        (F.col("d") * F.lit("0.5").cast("decimal(2,1)")).cast(dec).alias("current_a"),
        (F.lit(25).cast("decimal(5,0)") + F.col("d") * F.lit("0.2").cast("decimal(2,1)")).cast(dec).alias("temp_c"),
        ((F.col("k") % 10).cast("decimal(5,0)") * F.lit("0.9").cast("decimal(2,1)")).cast(dec).alias("earth_leak_ma"),
        (F.col("k") * 30).alias("fan_rpm"), (F.col("k") * 100).alias("power_w"), (F.col("k") * 3 - 20).cast("int").alias("soc_percent"), "k",
    )


def reasoning_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in checkpoints."""
    t = telemetry_of_events(spark, sf_dir)
    k = F.col("k")
    return t.select(
        F.col("event_id").alias("id"), "charger_id", F.concat(F.lit("S"), (F.col("event_id") % 40).cast("string")).alias("session_id"), F.col("ts").alias("created_at"), F.concat(F.lit("seen "), F.col("status")).alias("observation"),
        F.when(k % 3 > 0, F.concat(F.lit("cause "), F.col("error_code"))).alias("hypothesis"),
        F.element_at(F.array(*map(F.lit, ("confirmed", "escalated", "promoted", "inconclusive"))), (k % 4 + 1).cast("int")).alias("resolution"),
        F.filter(F.array(F.when(k % 2 == 0, "temp"), F.when(k % 3 == 0, "fan"), F.when(k % 5 == 0, "leak")), lambda x: x.isNotNull()).alias("tags"),
        F.when(k % 17 == 0, F.col("event_id") + 1).alias("superseded_by"), F.when(k % 7 == 0, "fixed").when(k % 7 == 1, "different_fault").alias("verified_outcome"),
    )


def memory_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in memories; references point at checkpoints by number."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    ref = lambda n: F.concat(F.lit("agent_reasoning:"), n.cast("string"))
    return c.select(
        key.alias("id"), F.lower("c_mktsegment").alias("category"), F.when(key % 5 == 0, "global").otherwise(F.concat(F.lit("site:"), (F.col("c_nationkey") % 5).cast("string"))).alias("scope"), F.col("c_name").alias("content"),
        F.element_at(F.array(*map(F.lit, ("session", "consolidated", "verified"))), (key % 3 + 1).cast("int")).alias("provenance"), (key % 6).cast("int").alias("verified_confirmations"), (key % 3).cast("int").alias("verified_contradictions"),
        (key % 4).cast("int").alias("access_count"), F.when(key % 11 == 0, "superseded").otherwise("active").alias("status"),
        ((key % 80) / F.lit(100).cast("decimal(3,0)") + F.lit("0.20").cast("decimal(3,2)")).cast("decimal(3,2)").alias("confidence"), (F.lit("2024-06-01").cast("timestamp_ntz") - F.make_dt_interval((key % 200).cast("int"))).alias("created_at"),
        F.when(key % 4 == 0, F.lit("2024-06-01").cast("timestamp_ntz") - F.make_dt_interval((key % 60).cast("int"))).alias("last_decayed_at"),
        F.array(ref(key * 2), F.concat(F.lit("charger_windows:"), key.cast("string"))).alias("source_refs"), F.when(key % 2 == 0, F.array(ref(key * 2 + 1))).otherwise(F.array().cast("array<string>")).alias("pending_refs"), (key % 5 + 1).cast("int").alias("supporting_evidence_count"),
    )
