"""Queries that run streams to their end: windows of a stream, and what it leaves to a batch run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import window_aggregate
from ..sources.adapters import telemetry_of, telemetry_of_events
from ..sources.scratch import scratch_dir
from ..streaming import jobs
from . import sql
from .windows import _start


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that a stream over the events emits, and the tail that it leaves; made_by says which of them made a row.

    All files of the table are one trigger, whose rows may come in any order: the watermark moves after it.
    """
    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = telemetry_of(spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]"))  # a pattern may name a file or a folder
    timed = lambda t: t.withColumn("ts", F.col("ts").cast("timestamp"))
    jobs.start_windows(timed(stream), f"{root}/out", f"{root}/cp", available_now=True).awaitTermination()
    done = spark.read.parquet(f"{root}/out").drop("batch").withColumn("made_by", F.lit("stream"))
    tail = jobs.tail_windows(timed(telemetry_of(events))).withColumn("made_by", F.lit("tail"))
    all_ = done.unionByName(tail, allowMissingColumns=True)
    return all_.select("charger_id", _start(), "msg_count", "status_changes", "anomaly_score", "made_by")


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit, against windows that were stored without a tenth of the rows."""
    t = telemetry_of_events(spark, sf_dir)
    return jobs.late_rows(t, window_aggregate(t.filter("event_id % 10 > 0"), jobs.WINDOW, score=False)).select("charger_id", _start(), "msg_count", "raw")


QUERIES = {"stream_windows": stream_windows, "late_rows": late_rows}
ORACLE = {
    "stream_windows": f"WITH {sql.windows('5 minutes')} SELECT charger_id, {sql.ts('window_start')} AS window_start, msg_count, status_changes, anomaly_score, CASE WHEN window_end <= (SELECT max(ts) FROM events) - INTERVAL 30 SECONDS THEN 'stream' ELSE 'tail' END AS made_by FROM win",
    "late_rows": f"WITH {sql.TELEMETRY}, a AS (SELECT charger_id, time_bucket(INTERVAL 5 minutes, ts) AS w, count(*) AS raw, count(*) FILTER (event_id % 10 > 0) AS kept FROM tel GROUP BY ALL) SELECT charger_id, {sql.ts('w')} AS window_start, nullif(kept, 0) AS msg_count, raw FROM a WHERE kept < raw",
}
