"""Queries for filters, joins, top-k, budgets, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.scalars import count_tokens, effective_budget
from ..operators import context, ranking
from ..operators.lifecycle import snapshots_due
from ..sources import sinks
from ..sources.adapters import changes_to_embed, parse_changes, reasoning_of_events, table, telemetry_of_events
from ..sources.scratch import scratch_dir
from ..sources.store import Store
from . import sql
from .windows import _start, daily

AS_OF = "2024-01-20 00:00:00"
_SEL = f"charger_id, {sql.ts('window_start')} AS window_start, anomaly_score"
_ORDER = "anomaly_score DESC, charger_id, win.window_start"


def _worst() -> list:
    return [F.desc("anomaly_score"), F.asc("charger_id"), F.asc("window_start")]


def top_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(daily(spark, sf_dir).filter("anomaly_score > 0"), _worst(), 20).select("charger_id", _start(), "anomaly_score")


def entities(exact: bool, n: int):  # noqa: ANN202
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ranking.top_entities(daily(spark, sf_dir), n, exact).select("charger_id", _start(), "anomaly_score")

    return q


def latest_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = daily(spark, sf_dir).filter("anomaly_score > 0")
    b = w.groupBy("charger_id").agg(F.max_by(F.struct("window_start", "anomaly_score"), "window_start").alias("b"))
    return b.select("charger_id", F.date_format("b.window_start", texts.TS).alias("window_start"), "b.anomaly_score")


def recent_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = daily(spark, sf_dir).filter("anomaly_score > 0")
    return ranking.first_per_key(w, ["charger_id"], [F.desc("window_start")], 10).select("charger_id", _start(), "anomaly_score", "rank")


def recent_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = daily(spark, sf_dir)
    return w.filter((F.col("window_start") > F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 48 HOURS")) & (F.col("window_start") <= F.lit(AS_OF).cast("timestamp_ntz")) & (F.col("anomaly_score") > 0)).select("charger_id", _start(), "anomaly_score")


def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reasoning_of_events(spark, sf_dir)
    return ranking.first_per_key(r, ["session_id"], [F.desc("created_at"), F.desc("id")]).select("session_id", "id", "resolution")


def active_investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reasoning_of_events(spark, sf_dir).filter(F.col("resolution").isin("confirmed", "escalated") & F.col("superseded_by").isNull())
    return ranking.first_per_key(r, ["charger_id"], [F.desc("created_at"), F.desc("id")], 5).select("charger_id", "id", "rank")


def left_join_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = table(spark, sf_dir, "customer").filter("c_custkey % 7 != 0").select(F.concat(F.lit("CP-"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("charger_id"), F.col("c_mktsegment").alias("model"))
    return reasoning_of_events(spark, sf_dir).join(reg, "charger_id", "left").select("id", "charger_id", "model")


def scalar_count_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = table(spark, sf_dir, "customer").select(F.concat(F.lit("CP-"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("charger_id"), F.concat(F.lit("site-"), F.col("c_nationkey").cast("string")).alias("site_id"))
    return context.profile_snapshot(reg, telemetry_of_events(spark, sf_dir), AS_OF).select("charger_id", "content")


def anomalies_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.anomalies_snapshot(daily(spark, sf_dir), AS_OF, 24 * 30, chargers=_chargers(spark, sf_dir))


def investigations_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.investigations_snapshot(reasoning_of_events(spark, sf_dir), chargers=_chargers(spark, sf_dir))


def _chargers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("CP-"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("charger_id"))


def site_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar_count_24h(spark, sf_dir).select("charger_id", texts.site_of(F.col("content")).alias("site_id"))


def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", count_tokens(F.col("text")).cast("long").alias("tokens"))
    return ranking.running_budget(c, ["conv_id"], [F.asc("turn")], "tokens", F.lit(500)).select("conv_id", "turn", "tokens", "used")


def budget_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", count_tokens(F.col("text")).alias("tokens"))
    return ranking.greedy_fit(c, ["conv_id"], [F.asc("turn")], "tokens", 500)


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", effective_budget((F.col("p_partkey") * 10 + 4000)).alias("budget"), count_tokens(F.col("p_name")).alias("tokens"))


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return sinks.insert_ignore(c.filter("c_custkey % 3 != 0"), c.filter("c_custkey % 2 = 0").withColumn("c_name", F.lit("new")), "c_custkey")


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.filter("c_custkey % 2 = 0").withColumns({"c_name": F.lit("new"), "c_mktsegment": F.lit("NEW")})
    return sinks.upsert(c.filter("c_custkey % 3 != 0"), new, ["c_custkey"], ["c_name"])


def upsert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """upsert, on a stored table in buckets of which only those with new rows are written."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    store = Store(spark, f"{scratch_dir(spark)}/buckets-{uuid.uuid4().hex}")
    store.write_buckets("customer", c.filter("c_custkey % 3 != 0"), ["c_custkey"], buckets=32)
    store.upsert("customer", c.filter("c_custkey % 2 = 0").withColumns({"c_name": F.lit("new"), "c_mktsegment": F.lit("NEW")}), ["c_name"])
    return store.read_buckets("customer")


def retention_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """retention_filter, on a stored table by date of which only the partition with the limit is read."""
    path = f"{scratch_dir(spark)}/retention-{uuid.uuid4().hex}"
    rows = telemetry_of_events(spark, sf_dir).select("event_id", "ts")
    sinks.append(rows, path, by_date_of="ts")
    sinks.drop_partitions(spark, path, "ts", "7 DAYS", AS_OF)
    return spark.read.schema(rows.schema).parquet(path).select("event_id")


def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.retain(telemetry_of_events(spark, sf_dir), "ts", "7 DAYS", AS_OF).select("event_id")


def vector_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.col("label")).alias("label"))
    new = table(spark, sf_dir, "embeddings").filter("vec_id % 3 = 0").select("vec_id", F.lit(-1).alias("label"))
    return sinks.write_vectors(e, new, "vec_id", "label")


def canal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, ("INSERT", "UPDATE", "DELETE"))), (F.col("event_id") % 3 + 1).cast("int"))
    row = F.struct(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 5 == 0, "v").alias("memory_vec"), F.col("event_type").alias("content"))
    t = F.when(F.col("event_id") % 7 == 0, "other").otherwise("fleet_memory")
    line = F.when(F.col("event_id") % 11 == 0, "not json").otherwise(F.to_json(F.struct(kind.alias("type"), t.alias("table"), F.array(row).alias("data"))))
    got = changes_to_embed(parse_changes(e.select(line.alias("value"))), {"fleet_memory": "memory_vec"})
    return got.select("table", F.col("id").cast("long").alias("id"), F.col("row")["content"].alias("content"))


def repeat_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return context.repeats(e, ["user_id"], "event_id", "event_type").select("user_id", "event_id", "event_type")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("role").alias("tool"), (F.length("text") % 97).cast("long").alias("latency_ms"), count_tokens(F.col("text")).cast("long").alias("tokens"), F.when(F.col("turn") % 3 == 0, (F.length("text") % 10) / F.lit(8)).alias("distance"))
    return context.run_summary(log)


def fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.when(F.col("o_orderstatus") == "F", "shortcut").when(F.col("o_orderkey") % 5 == 0, "lookup").when(F.col("o_orderkey") % 7 > 0, "explore").alias("route"), (F.col("o_orderkey") % 1000).alias("duration_ms"), (F.col("o_custkey") % 500).alias("tokens_in"), (F.col("o_orderkey") % 300).alias("cache_read"), (F.col("o_orderkey") % 50).alias("cache_created"))
    return context.fleet_summary(runs, 100_000)


def distinct_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots_due(daily(spark, sf_dir), AS_OF, 60 * 24 * 2, 0.3)


QUERIES = {
    "top_windows": top_windows, "top_entities_exact": entities(True, 25), "top_entities_overfetch": entities(False, 25), "latest_per_entity": latest_per_entity, "recent_per_entity": recent_per_entity, "recent_windows": recent_windows, "latest_checkpoint": latest_checkpoint, "active_investigations": active_investigations,
    "left_join_registry": left_join_registry, "scalar_count_24h": scalar_count_24h, "anomalies_snapshot": anomalies_snapshot, "investigations_snapshot": investigations_snapshot, "site_parse": site_parse, "budget_prefix": budget_prefix, "budget_greedy": budget_greedy, "token_budget": token_budget, "insert_ignore": insert_ignore, "upsert": upsert, "upsert_buckets": upsert_buckets, "retention_filter": retention_filter, "retention_partitions": retention_partitions,
    "vector_write_back": vector_write_back, "canal_parse": canal_parse, "repeat_breaker": repeat_breaker, "run_summary": run_summary, "fleet_summary": fleet_summary, "snapshots_due": distinct_active,
}

W = f"WITH {sql.windows()}"
_TOK = "floor(len(list_filter(regexp_split_to_array(trim(coalesce({0}, '')), '\\s+'), lambda w: w <> '')) * 13 / 10.0)::INTEGER"
_CP = "'CP-' || lpad(c_custkey::VARCHAR, 5, '0')"
_PROFILE = f"WITH {sql.TELEMETRY}, n AS (SELECT charger_id, count(*) AS n FROM tel WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS GROUP BY 1), reg AS (SELECT {_CP} AS charger_id, 'site-' || c_nationkey AS site_id FROM customer)"
ORACLE = {
    "top_windows": f"{W} SELECT {_SEL} FROM win WHERE anomaly_score > 0 ORDER BY {_ORDER} LIMIT 20",
    "top_entities_exact": f"{W}, r AS (SELECT *, row_number() OVER (PARTITION BY charger_id ORDER BY anomaly_score DESC, window_start) AS rn FROM win WHERE anomaly_score > 0) SELECT {_SEL} FROM r WHERE rn = 1 ORDER BY anomaly_score DESC, charger_id LIMIT 25",
    "top_entities_overfetch": f"{W}, t AS (SELECT * FROM win WHERE anomaly_score > 0 ORDER BY {_ORDER} LIMIT 250), r AS (SELECT *, row_number() OVER (PARTITION BY charger_id ORDER BY anomaly_score DESC, window_start) AS rn FROM t) SELECT {_SEL} FROM r WHERE rn = 1 ORDER BY anomaly_score DESC, charger_id LIMIT 25",
    "latest_per_entity": f"{W}, r AS (SELECT *, row_number() OVER (PARTITION BY charger_id ORDER BY window_start DESC) AS rn FROM win WHERE anomaly_score > 0) SELECT {_SEL} FROM r WHERE rn = 1",
    "recent_per_entity": f"{W}, r AS (SELECT *, row_number() OVER (PARTITION BY charger_id ORDER BY window_start DESC)::INTEGER AS rank FROM win WHERE anomaly_score > 0) SELECT {_SEL}, rank FROM r WHERE rank <= 10",
    "recent_windows": f"{W} SELECT {_SEL} FROM win WHERE win.window_start > TIMESTAMP '{AS_OF}' - INTERVAL 48 HOURS AND win.window_start <= TIMESTAMP '{AS_OF}' AND anomaly_score > 0",
    "latest_checkpoint": f"WITH {sql.REASONING} SELECT session_id, max_by(id, (created_at, id)) AS id, max_by(resolution, (created_at, id)) AS resolution FROM rea GROUP BY session_id",
    "active_investigations": f"WITH {sql.REASONING} SELECT * FROM (SELECT charger_id, id, row_number() OVER (PARTITION BY charger_id ORDER BY created_at DESC, id DESC)::INTEGER AS rank FROM rea WHERE resolution IN ('confirmed', 'escalated') AND superseded_by IS NULL) WHERE rank <= 5",
    "left_join_registry": f"WITH {sql.REASONING} SELECT id, charger_id, c_mktsegment AS model FROM rea LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) c ON charger_id = {_CP}",
    "scalar_count_24h": f"{_PROFILE} SELECT charger_id, 'Charger ' || charger_id || ' at site ' || site_id || '. Messages in 24 h: ' || coalesce(n, 0)::VARCHAR || '.' AS content FROM reg LEFT JOIN n USING (charger_id)",
    "site_parse": f"{_PROFILE} SELECT charger_id, site_id FROM reg",
    "anomalies_snapshot": f"{W}, r AS (SELECT *, row_number() OVER (PARTITION BY charger_id ORDER BY window_start DESC) AS rank FROM win WHERE anomaly_score > 0 AND window_start > TIMESTAMP '{AS_OF}' - INTERVAL 720 HOURS), s AS (SELECT charger_id, 'Recent anomalies:' || chr(10) || string_agg(strftime(window_start, '%Y-%m-%d %H:%M') || ' score ' || anomaly_score::DECIMAL(5,3)::VARCHAR, chr(10) ORDER BY rank) AS content FROM r WHERE rank <= 10 GROUP BY charger_id) SELECT charger_id, coalesce(content, 'Nothing unusual seen at ' || charger_id || ' within 720 h.') AS content FROM (SELECT {_CP} AS charger_id FROM customer) LEFT JOIN s USING (charger_id)",
    "investigations_snapshot": f"WITH {sql.REASONING}, r AS (SELECT *, row_number() OVER (PARTITION BY charger_id ORDER BY created_at DESC, id DESC) AS rank FROM rea WHERE resolution IN ('confirmed', 'escalated') AND superseded_by IS NULL), s AS (SELECT charger_id, 'Investigations:' || chr(10) || string_agg('#' || id || ' ' || resolution || ': ' || substr(observation, 1, 120), chr(10) ORDER BY rank) AS content FROM r WHERE rank <= 5 GROUP BY charger_id) SELECT charger_id, coalesce(content, 'Nothing is being looked into at ' || charger_id || '.') AS content FROM (SELECT {_CP} AS charger_id FROM customer) LEFT JOIN s USING (charger_id)",
    "budget_prefix": f"WITH t AS (SELECT conv_id, turn, {_TOK.format('text')}::BIGINT AS tokens FROM conversations) SELECT * FROM (SELECT *, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS used FROM t) WHERE used <= 500",
    "budget_greedy": f"WITH RECURSIVE t AS (SELECT conv_id, turn, {_TOK.format('text')} AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), f AS (SELECT conv_id, 0::BIGINT AS i, 0 AS used, 0::BIGINT AS turn, 0 AS tokens, false AS kept FROM (SELECT DISTINCT conv_id FROM t) UNION ALL SELECT t.conv_id, t.i, CASE WHEN f.used + t.tokens <= 500 THEN f.used + t.tokens ELSE f.used END, t.turn, t.tokens, f.used + t.tokens <= 500 FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1) SELECT conv_id, turn, tokens FROM f WHERE kept",
    "token_budget": f"SELECT p_partkey, ((p_partkey * 10 + 4000) * 9 // 10)::INTEGER AS budget, {_TOK.format('p_name')} AS tokens FROM part",
    "insert_ignore": "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0",
    "upsert": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'NEW' END AS c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0",
    "upsert_buckets": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'NEW' END AS c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0",
    "retention_filter": f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS",
    "retention_partitions": f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS",
    "vector_write_back": "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 WHEN vec_id % 2 = 0 THEN label END AS label FROM embeddings",
    "canal_parse": "SELECT 'fleet_memory' AS \"table\", event_id AS id, event_type AS content FROM events WHERE event_id % 3 <> 2 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 5 <> 0 AND event_id <> 0",
    "repeat_breaker": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = a AND event_type = b",
    "run_summary": f"SELECT conv_id AS session_id, role AS tool, count(*) AS calls, round_even(sum(length(text) % 97)::DOUBLE / count(text), 0)::BIGINT AS mean_latency_ms, sum({_TOK.format('text')})::BIGINT AS tokens, round_even(sum((length(text) % 10) / 8.0::DOUBLE) FILTER (turn % 3 = 0) / nullif(count(text) FILTER (turn % 3 = 0), 0), 4) AS mean_distance FROM conversations GROUP BY 1, 2",
    "fleet_summary": "SELECT count(*) AS runs, sum(o_orderkey % 1000)::BIGINT AS total_ms, min(o_orderkey % 1000) AS min_ms, max(o_orderkey % 1000) AS max_ms, sum(o_orderkey % 1000)::DOUBLE / count(*)::DOUBLE AS mean_ms, sum(o_orderkey % 1000)::DOUBLE / 100000.0::DOUBLE AS speedup, sum(o_orderkey % 300)::DOUBLE / sum(o_custkey % 500 + o_orderkey % 300 + o_orderkey % 50)::DOUBLE AS cache_hit, count(*) FILTER (o_orderstatus = 'F') AS shortcuts, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 5 <> 0 AND o_orderkey % 7 > 0) AS explores, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 5 = 0) AS lookups, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0) AS unknown, shortcuts::DOUBLE / count(*)::DOUBLE AS shortcut_share FROM orders",
    "snapshots_due": f"{W} SELECT charger_id, unnest(['charger_profile', 'recent_anomalies', 'active_investigations']) AS snapshot_type FROM (SELECT DISTINCT charger_id FROM win WHERE window_start > TIMESTAMP '{AS_OF}' - INTERVAL 2880 MINUTES AND anomaly_score > 0.3)",
}
