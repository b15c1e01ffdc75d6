"""Structured Streaming: telemetry to windows, changes to vectors. The transformations are those of batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import window_aggregate
from ..schemas import TELEMETRY
from ..sources.adapters import changes_to_embed, parse_changes, parse_telemetry

LATENESS, WINDOW = "30 seconds", "5 minutes"


def kafka_lines(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Messages of a topic from its end on (needs Spark's Kafka package)."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest").load().select(F.col("value").cast("string").alias("value"))


def json_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry from a folder of JSON lines, through the parser that messages go through."""
    return parse_telemetry(spark.readStream.text(path))


def windows_of(telemetry: DataFrame, length: str = WINDOW, lateness: str = LATENESS) -> DataFrame:
    """Scored windows of a stream, each emitted once when the watermark has passed its end; later rows are dropped."""
    return window_aggregate(telemetry.filter("charger_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", lateness), length)


def late_rows(telemetry: DataFrame, windows: DataFrame, length: str = WINDOW) -> DataFrame:
    """Batch audit: windows whose stored count is lower than what the raw rows give, with both counts."""
    full = window_aggregate(telemetry, length, score=False).select("charger_id", "window_start", F.col("msg_count").alias("raw"))
    return full.join(windows.select("charger_id", "window_start", "msg_count"), ["charger_id", "window_start"], "left").filter(F.coalesce("msg_count", F.lit(0)) < F.col("raw"))


def start_windows(telemetry: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends windows as Parquet; a batch that is run again replaces its own folder and doubles nothing."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = windows_of(telemetry).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="60 seconds")).start()


def start_raw(telemetry: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """The raw rows, in the order of the schema, as Parquet."""
    w = telemetry.select([F.col(f.split()[0]) for f in TELEMETRY.split(", ")]).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="60 seconds")).start()


def tail_windows(telemetry: DataFrame, length: str = WINDOW, lateness: str = LATENESS) -> DataFrame:
    """What a finished stream leaves unemitted: the windows that end after its last watermark, from their rows alone."""
    last = telemetry.filter("charger_id IS NOT NULL").agg(F.max("ts").alias("last")).select((F.date_trunc("MILLISECOND", "last") - F.expr(f"INTERVAL {lateness}")).alias("mark"))
    ends = telemetry.filter("charger_id IS NOT NULL").withColumn("_end", F.window("ts", length).getField("end"))
    open_ = ends.join(F.broadcast(last), F.col("_end") > F.col("mark")).drop("_end", "mark")  # one row is broadcast
    return window_aggregate(open_, length)


def start_vectors(lines: DataFrame, vectors: dict[str, str], write: Callable[[DataFrame, int], None], dead_letters: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Changed rows without a vector, batch by batch to ``write``; a batch that fails goes to the dead letters."""

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            write(batch, number)
        except Exception as e:  # noqa: BLE001  one bad batch must not stop the stream
            batch.withColumn("error", F.lit(str(e)[:500])).write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
        finally:
            batch.unpersist()

    w = changes_to_embed(parse_changes(lines), vectors).writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")).start()
