"""Queries for the knowledge store: confidence, gates, links, outcomes, writes, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.scalars import derive_confidence, flatten_refs
from ..operators import context, lifecycle, memory
from ..operators.validation import validate_refs
from ..sources.adapters import memory_of_customers, reasoning_of_events, table
from . import sql

AS_OF, LATE = "2024-06-01 00:00:00", "2024-01-30 00:00:00"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memory_of_customers(spark, sf_dir)
    return m.select("id", "scope", F.when(F.col("id") % 13 == 0, F.col("id")).alias("superseded_by"), derive_confidence(F.col("provenance"), F.col("verified_confirmations") * 3, F.col("verified_contradictions") % 2).alias("confidence"), "verified_confirmations", ((F.col("id") % 100) / 100.0).cast("double").alias("similarity"))


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memory_of_customers(spark, sf_dir)
    return m.select("id", derive_confidence(F.col("provenance"), F.col("verified_confirmations"), F.col("verified_contradictions")).cast("double").alias("confidence"))


def shortcut_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("id", memory.shortcut_eligible().alias("eligible"))


def gate_fail_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("id", memory.gate_fail_reason().alias("reason"))


def routing_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.stage_routing(_matches(spark, sf_dir), ["scope"])


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = context.stage_routing(_matches(spark, sf_dir), ["scope"])
    r = context.route(F.col("eligible") > 0, F.col("similar") > 0)
    return s.select("scope", r.alias("route"), context.rounds_of(r).alias("rounds"))


def ref_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.link_counts(memory_of_customers(spark, sf_dir), reasoning_of_events(spark, sf_dir))


def recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.recompute_counters(memory_of_customers(spark, sf_dir), reasoning_of_events(spark, sf_dir)).select("id", "verified_confirmations", "verified_contradictions", F.col("confidence").cast("double").alias("confidence"))


def merge_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.accepted_refs(memory_of_customers(spark, sf_dir), reasoning_of_events(spark, sf_dir))


def evidence_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    ref = F.when(k % 5 == 0, F.concat(F.lit("Bad Ref "), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit("nowhere:"), k.cast("string"))).when(k % 5 == 2, F.concat(F.lit("agent_reasoning:"), (k * 2).cast("string"))).otherwise(F.concat(F.lit("fleet_memory:"), (k % 3000).cast("string")))
    e = table(spark, sf_dir, "events")
    return validate_refs(e.select(k.alias("id"), ref.alias("ref")), {"agent_reasoning": e.select("event_id"), "fleet_memory": table(spark, sf_dir, "customer").select("c_custkey")})


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every event an outcome: of five, two are for one checkpoint; some are for none."""
    e = table(spark, sf_dir, "events")
    return e.select(F.expr("CASE WHEN event_id % 97 = 1 THEN -event_id ELSE event_id * 4 div 5 END").alias("reasoning_id"), F.when(F.col("event_id") % 3 == 0, "different_fault").otherwise("fixed").alias("outcome"), F.lit(AS_OF).alias("at"), F.col("event_id").alias("seq"))


def _applied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = memory_of_customers(spark, sf_dir).withColumn("adjudicated", F.when(F.col("id") % 9 == 0, F.col("source_refs")).otherwise(F.array().cast("array<string>")))
    return memory.apply_outcomes(reasoning_of_events(spark, sf_dir), m, _outcomes(spark, sf_dir))


def outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir)[2].select("reasoning_id", "seq", "result", "touched")


def outcome_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir)[1].select("id", "provenance", "verified_confirmations", "verified_contradictions", F.col("confidence").cast("double").alias("confidence"), F.size("pending_refs").alias("pending"), F.size("adjudicated").alias("audited"))


def outcome_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir)[0].select("id", "verified_outcome", "resolution")


def supersede_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reasoning_of_events(spark, sf_dir)
    return memory.supersede_prior(r.filter("id % 10 > 0"), r.filter("id % 10 = 0"), LATE, 10).select("id", "superseded_by")


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("CP-"), F.lpad(k.cast("string"), 5, "0")).alias("charger_id"), F.when(k % 2 == 0, "M1").alias("model"), F.lit("ACME").alias("manufacturer"), F.when(k % 3 == 0, "coastal").otherwise("indoor").alias("environment"))


def tag_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lifecycle.tag_groups(reasoning_of_events(spark, sf_dir), _registry(spark, sf_dir), LATE, 10)
    return g.select("tag_key", "n", "scope", F.array_join("chargers", ",").alias("chargers"), "sample")


def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.consolidate(reasoning_of_events(spark, sf_dir), _registry(spark, sf_dir), LATE)[1].select("id", "resolution")


def consolidated_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.consolidate(reasoning_of_events(spark, sf_dir), _registry(spark, sf_dir), LATE)[0]


def cleanup_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.cleanup(memory_of_customers(spark, sf_dir), AS_OF).select("id", "status", F.col("confidence").cast("double").alias("confidence"), F.date_format("last_decayed_at", texts.TS).alias("last_decayed_at"))


def ref_prefix_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.ref_histogram(memory_of_customers(spark, sf_dir), "source_refs")


def reasoning_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reasoning_of_events(spark, sf_dir).withColumn("tags", F.array_join("tags", ", "))
    return r.select("id", texts.reasoning_text().alias("text"))


def memory_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_of_customers(spark, sf_dir).select("id", texts.memory_text().alias("text"))


def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    value = F.when(k % 4 == 0, F.concat(F.lit('["a:1", ["b:'), k.cast("string"), F.lit('"], "[\\"c:3\\"]"]'))).when(k % 4 == 1, F.lit("null")).when(k % 4 == 2, F.lit('["A:1", 5, null, "a:1", "a:1"]')).otherwise(F.concat(F.lit("x:"), k.cast("string")))
    return table(spark, sf_dir, "events").select(k.alias("id"), flatten_refs(value).alias("f")).select("id", F.array_join("f.refs", ",").alias("refs"), F.col("f.recovered").alias("recovered"), F.col("f.dropped").alias("dropped"))


def _memories_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("site:"), (F.col("vec_id") % 7).cast("string")).alias("scope"), F.when(F.col("label") % 2 == 0, "a").otherwise("b").alias("category"), F.concat(F.lit("m"), F.col("vec_id").cast("string")).alias("content"), F.col("embedding").alias("vec"), F.lit("session").alias("provenance"), F.lit("active").alias("status"), F.lit(None).cast("long").alias("superseded_by"), F.lit(0).alias("corroborations"), F.lit(0).alias("supersede_events"), F.lit(1).alias("supporting_evidence_count"), F.array().cast("array<string>").alias("source_refs"), F.array().cast("array<string>").alias("pending_refs"), ((F.col("vec_id") % 70) / 100.0).alias("confidence"))


def greedy_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.compact(_memories_with_vectors(spark, sf_dir), 0.75)


QUERIES = {
    "derive_confidence": confidence, "shortcut_gate": shortcut_gate, "gate_fail_reason": gate_fail_reason, "routing_stages": routing_stages, "routes": routes, "ref_link_counts": ref_link_counts, "recompute_counters": recomputed, "accepted_refs": merge_refs,
    "evidence_validation": evidence_validation, "verify_outcomes": outcome_report, "verify_outcomes_memories": outcome_memories, "verify_outcomes_checkpoints": outcome_checkpoints, "supersede_prior": supersede_prior, "tag_groups": tag_groups, "consolidate": consolidated,
    "cleanup_decay": cleanup_decay, "ref_prefix_histogram": ref_prefix_histogram, "reasoning_text": reasoning_texts, "memory_text": memory_texts, "flatten_refs": flattened, "greedy_compaction": greedy_compaction, "consolidated_memories": consolidated_memories,
}

_MATCH = f"WITH {sql.MEMORY}, x AS (SELECT id, scope, CASE WHEN id % 13 = 0 THEN id END AS superseded_by, {sql.confidence('provenance', 'verified_confirmations * 3', '(verified_contradictions % 2)')} AS confidence, verified_confirmations, (id % 100)::DOUBLE / 100.0::DOUBLE AS similarity FROM mem)"
_OK = "superseded_by IS NULL AND confidence >= 0.85 AND verified_confirmations >= 3 AND similarity >= 0.55"
_WHY = "CASE WHEN superseded_by IS NOT NULL THEN 'superseded' WHEN confidence < 0.85 THEN 'confidence<0.85' WHEN verified_confirmations < 3 THEN 'verified_confirmations<3' WHEN similarity < 0.55 THEN 'similarity<0.55' END"
_STAGE = f"{_MATCH}, y AS (SELECT *, {_OK} AS ok, {_WHY} AS why, similarity >= 0.55 AS near FROM x), z AS (SELECT scope, count(*) AS candidates, count(*) FILTER (near) AS \"similar\", count(*) FILTER (ok) AS eligible, max_by(id, (confidence, -id)) FILTER (near) AS top_id FROM y GROUP BY scope)"
_LINK = f"{sql.REASONING}, {sql.MEMORY}, l AS (SELECT DISTINCT mem.id AS memory_id, split_part(ref, ':', 2)::BIGINT AS rid FROM (SELECT id, unnest(source_refs) AS ref FROM mem) mem WHERE ref LIKE 'agent_reasoning:%'), n AS (SELECT memory_id, count(DISTINCT rid) AS linked, count(DISTINCT rid) FILTER (verified_outcome = 'fixed') AS confirmed, count(DISTINCT rid) FILTER (verified_outcome <> 'fixed') AS contradicted FROM l JOIN rea ON rea.id = rid GROUP BY 1)"
_OUT = f"""WITH {sql.REASONING}, {sql.MEMORY},
o AS (SELECT CASE WHEN event_id % 97 = 1 THEN -event_id ELSE event_id * 4 // 5 END AS reasoning_id, CASE WHEN event_id % 3 = 0 THEN 'different_fault' ELSE 'fixed' END AS outcome, event_id AS seq FROM events),
s AS (SELECT o.*, rea.verified_outcome, rea.id IS NULL AS missing, first_value(outcome) OVER w AS f, row_number() OVER w AS n FROM o LEFT JOIN rea ON rea.id = reasoning_id WINDOW w AS (PARTITION BY reasoning_id ORDER BY seq)),
st AS (SELECT *, CASE WHEN missing THEN 'unknown' WHEN outcome <> coalesce(verified_outcome, f) THEN 'conflict' WHEN verified_outcome IS NULL AND n = 1 THEN 'stamped' ELSE 'same' END AS state FROM s),
good AS (SELECT 'agent_reasoning:' || reasoning_id AS ref, min(outcome) AS outcome FROM st WHERE state IN ('stamped', 'same') GROUP BY 1),
lk AS (SELECT DISTINCT id, unnest(list_concat(pending_refs, source_refs)) AS ref FROM mem),
h AS (SELECT lk.id, ref, outcome FROM lk JOIN good USING (ref) JOIN mem ON mem.id = lk.id WHERE NOT (mem.id % 9 = 0 AND list_contains(mem.source_refs, ref))),
p AS (SELECT id, count(*) FILTER (outcome = 'fixed') AS pos, count(*) FILTER (outcome <> 'fixed') AS neg, list(ref) AS refs FROM h GROUP BY id)"""
_GROUP = f"""WITH {sql.REASONING}, reg AS (SELECT 'CP-' || lpad(c_custkey::VARCHAR, 5, '0') AS charger_id, CASE WHEN c_custkey % 2 = 0 THEN 'M1' END AS model, 'ACME' AS manufacturer, CASE WHEN c_custkey % 3 = 0 THEN 'coastal' ELSE 'indoor' END AS environment FROM customer),
live AS (SELECT rea.*, model, environment, CASE WHEN len(tags) > 0 THEN array_to_string(list_sort(tags), '|') ELSE 'untagged' END AS tag_key FROM rea LEFT JOIN reg USING (charger_id) WHERE resolution = 'confirmed' AND superseded_by IS NULL AND created_at > TIMESTAMP '{LATE}' - INTERVAL __DAYS__ DAY)"""
#: One row of each scope and category after the other; a step carries the leaders that it has found.
_COMPACT = """WITH RECURSIVE m AS (SELECT vec_id AS id, 'site:' || (vec_id % 7) AS scope, CASE WHEN label % 2 = 0 THEN 'a' ELSE 'b' END AS category, embedding::DOUBLE[] AS vec, (vec_id % 70) / 100.0::DOUBLE AS confidence FROM embeddings),
o AS (SELECT *, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS u, row_number() OVER (PARTITION BY scope, category ORDER BY confidence DESC, id) AS i FROM m),
s AS (SELECT scope, category, i, id, NULL::BIGINT AS led, [{'id': id, 'u': u}] AS leaders FROM o WHERE i = 1
  UNION ALL SELECT scope, category, i, id, led, CASE WHEN led IS NULL THEN list_append(leaders, {'id': id, 'u': u}) ELSE leaders END
  FROM (SELECT o.scope, o.category, o.i, o.id, o.u, s.leaders, list_filter(s.leaders, lambda l: 1 - list_dot_product(l.u, o.u) < 0.75)[1].id AS led FROM s JOIN o ON o.scope = s.scope AND o.category = s.category AND o.i = s.i + 1)),
g AS (SELECT led, count(*) AS n FROM s WHERE led IS NOT NULL GROUP BY led)
SELECT id, CASE WHEN s.led IS NULL THEN 'active' ELSE 'superseded' END AS status, s.led AS superseded_by, (1 + coalesce(n, 0))::INTEGER AS supporting_evidence_count FROM s LEFT JOIN g ON g.led = s.id"""

ORACLE = {
    "greedy_compaction": _COMPACT,
    "derive_confidence": f"WITH {sql.MEMORY} SELECT id, {sql.confidence('provenance', 'verified_confirmations', 'verified_contradictions')} AS confidence FROM mem",
    "shortcut_gate": f"{_MATCH} SELECT id, {_OK} AS eligible FROM x", "gate_fail_reason": f"{_MATCH} SELECT id, {_WHY} AS reason FROM x",
    "routing_stages": f"{_STAGE} SELECT z.*, why AS top_reason FROM z LEFT JOIN y ON y.id = top_id",
    "routes": f"{_STAGE} SELECT scope, CASE WHEN eligible > 0 THEN 'shortcut' WHEN z.\"similar\" > 0 THEN 'lookup' ELSE 'explore' END AS route, CASE WHEN eligible > 0 THEN 3 WHEN z.\"similar\" > 0 THEN 5 ELSE 15 END AS rounds FROM z",
    "ref_link_counts": f"WITH {_LINK} SELECT * FROM n",
    "recompute_counters": f"WITH {_LINK}, c AS (SELECT id, provenance, coalesce(confirmed, 0)::INTEGER AS a, coalesce(contradicted, 0)::INTEGER AS b FROM mem LEFT JOIN n ON memory_id = id) SELECT id, a AS verified_confirmations, b AS verified_contradictions, {sql.confidence('provenance', 'a', 'b')} AS confidence FROM c",
    "accepted_refs": f"WITH {sql.REASONING}, {sql.MEMORY}, r AS (SELECT id AS memory_id, unnest(source_refs) AS ref FROM mem) SELECT memory_id, ref FROM r LEFT JOIN rea ON 'agent_reasoning:' || rea.id::VARCHAR = ref WHERE ref NOT LIKE 'agent_reasoning:%' OR resolution IN ('confirmed', 'promoted')",
    "evidence_validation": "WITH e AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'Bad Ref ' || event_id WHEN 1 THEN 'nowhere:' || event_id WHEN 2 THEN 'agent_reasoning:' || event_id * 2 ELSE 'fleet_memory:' || event_id % 3000 END AS ref FROM events) SELECT id, ref, CASE id % 5 WHEN 0 THEN 'malformed' WHEN 1 THEN 'unknown_prefix' WHEN 2 THEN CASE WHEN NOT EXISTS (SELECT 1 FROM events x WHERE x.event_id = e.id * 2) THEN 'not_found' END ELSE CASE WHEN NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.id % 3000) THEN 'not_found' END END AS reason FROM e",
    "verify_outcomes": f"{_OUT}, t AS (SELECT ref, count(*) AS touched FROM h GROUP BY ref) SELECT reasoning_id, seq, CASE WHEN state IN ('conflict', 'unknown') THEN state WHEN touched > 0 THEN 'ok' ELSE 'ok_no_propagation' END AS result, coalesce(touched, 0) AS touched FROM st LEFT JOIN t ON ref = 'agent_reasoning:' || reasoning_id",
    "verify_outcomes_memories": f"{_OUT}, v AS (SELECT mem.id, CASE WHEN pos > 0 AND provenance = 'session' THEN 'verified' ELSE provenance END AS provenance, (verified_confirmations + coalesce(pos, 0))::INTEGER AS c, (verified_contradictions + coalesce(neg, 0))::INTEGER AS k, p.id IS NOT NULL AS hit, mem.confidence, len(list_filter(pending_refs, lambda x: NOT list_contains(coalesce(refs, []), x))) AS pending, coalesce(len(refs), 0) + CASE WHEN mem.id % 9 = 0 THEN 2 ELSE 0 END AS audited FROM mem LEFT JOIN p USING (id)) SELECT id, provenance, c AS verified_confirmations, k AS verified_contradictions, CASE WHEN hit THEN {sql.confidence('provenance', 'c', 'k')} ELSE confidence::DOUBLE END AS confidence, pending::INTEGER AS pending, audited::INTEGER AS audited FROM v",
    "verify_outcomes_checkpoints": f"{_OUT} SELECT rea.id, coalesce(rea.verified_outcome, x.outcome) AS verified_outcome, CASE WHEN resolution = 'escalated' AND 'agent_reasoning:' || rea.id::VARCHAR IN (SELECT ref FROM h WHERE outcome = 'fixed') THEN 'confirmed' ELSE resolution END AS resolution FROM rea LEFT JOIN (SELECT * FROM st WHERE state = 'stamped') x ON x.reasoning_id = rea.id",
    "supersede_prior": f"WITH {sql.REASONING}, f AS (SELECT charger_id, min(id) AS by_ FROM rea WHERE id % 10 = 0 AND resolution = 'confirmed' GROUP BY 1) SELECT id, CASE WHEN resolution = 'confirmed' AND superseded_by IS NULL AND created_at > TIMESTAMP '{LATE}' - INTERVAL 10 DAY AND by_ IS NOT NULL THEN by_ ELSE superseded_by END AS superseded_by FROM rea LEFT JOIN f USING (charger_id) WHERE id % 10 > 0",
    "tag_groups": f"{_GROUP.replace('__DAYS__', '10')}, r AS (SELECT *, row_number() OVER (PARTITION BY tag_key ORDER BY id) AS rn FROM live) SELECT tag_key, count(*) AS n, CASE WHEN count(DISTINCT model) = 1 THEN 'model:ACME-' || min(model) WHEN count(DISTINCT environment) = 1 THEN 'environment:' || min(environment) ELSE 'global' END AS scope, string_agg(charger_id, ',' ORDER BY id) FILTER (rn <= 5) AS chargers, min_by(observation, id) AS sample FROM r GROUP BY tag_key HAVING count(*) >= 3",
    "consolidate": f"{_GROUP.replace('__DAYS__', '7')}, g AS (SELECT tag_key FROM live GROUP BY 1 HAVING count(*) >= 3) SELECT id, CASE WHEN id IN (SELECT id FROM live JOIN g USING (tag_key)) THEN 'promoted' ELSE resolution END AS resolution FROM rea",
    "consolidated_memories": f"{_GROUP.replace('__DAYS__', '7')}, r AS (SELECT *, row_number() OVER (PARTITION BY tag_key ORDER BY id) AS rn FROM live), g AS (SELECT tag_key, count(*) AS n, CASE WHEN count(DISTINCT model) = 1 THEN 'model:ACME-' || min(model) WHEN count(DISTINCT environment) = 1 THEN 'environment:' || min(environment) ELSE 'global' END AS scope, string_agg(charger_id, ', ' ORDER BY id) FILTER (rn <= 5) AS chargers, min_by(observation, id) AS sample FROM r GROUP BY tag_key HAVING count(*) >= 3) SELECT scope, 'pattern' AS category, 'Seen ' || n || ' times (' || tag_key || ') at ' || chargers || ': ' || sample AS content, 'consolidated' AS provenance, n::INTEGER AS corroborations, tag_key FROM g",
    "flatten_refs": """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'a:1,b:' || event_id || ',c:3' WHEN 1 THEN '' WHEN 2 THEN 'a:1' ELSE 'x:' || event_id END AS refs, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS recovered, CASE event_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS dropped FROM events""",
    "cleanup_decay": f"WITH {sql.MEMORY}, a AS (SELECT *, CASE WHEN status = 'active' AND access_count = 0 AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY THEN 'deprecated' ELSE status END AS s1 FROM mem), b AS (SELECT *, s1 = 'active' AND coalesce(last_decayed_at, created_at) < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS due, (confidence * 100)::INTEGER AS c FROM a), d AS (SELECT *, CASE WHEN due THEN (c * 95 + 50) // 100 ELSE c END AS c2 FROM b) SELECT id, CASE WHEN s1 = 'active' AND c2 < 30 THEN 'deprecated' ELSE s1 END AS status, c2::DOUBLE / 100 AS confidence, {sql.ts(f'''CASE WHEN due THEN TIMESTAMP '{AS_OF}' ELSE last_decayed_at END''')} AS last_decayed_at FROM d",
    "ref_prefix_histogram": f"WITH {sql.MEMORY} SELECT split_part(ref, ':', 1) AS prefix, count(*) AS n, min(ref) AS sample FROM (SELECT unnest(source_refs) AS ref FROM mem) GROUP BY 1",
    "reasoning_text": f"WITH {sql.REASONING} SELECT id, observation || CASE WHEN hypothesis IS NOT NULL THEN ' | Hypothesis: ' || hypothesis ELSE '' END || CASE WHEN len(tags) > 0 THEN ' | Tags: ' || array_to_string(tags, ', ') ELSE '' END AS text FROM rea",
    "memory_text": f"WITH {sql.MEMORY} SELECT id, '[' || category || '] [' || scope || '] ' || content AS text FROM mem",
}
