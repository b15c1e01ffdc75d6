import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.functions import texts
from wattloom.operators import ann, context, lifecycle, memory, ranking, retrieval, validation
from wattloom.operators.tools import Tools
from wattloom.operators.windows import window_aggregate
from wattloom.schemas import TELEMETRY
from wattloom.sources import generators, sinks
from wattloom.sources.adapters import telemetry_of_events
from wattloom.sources.store import Store
from wattloom.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("change", "valid", "n_errors", "n_warnings"),
    [({}, True, 0, 0), ({"voltage_v": -5.0}, False, 1, 0), ({"voltage_v": 600.0}, False, 1, 0), ({"soc_percent": 105}, True, 0, 1), ({"power_w": 0}, True, 0, 1), ({"power_w": -100}, False, 1, 0), ({"earth_leak_ma": -0.5}, True, 0, 1), ({"charger_id": None, "voltage_v": 900.0}, False, 1, 0), ({"voltage_v": 500.0, "temp_c": 120.0, "earth_leak_ma": 50.0, "fan_rpm": 10000}, True, 0, 2)],
)
def test_validation(spark, change, valid, n_errors, n_warnings):
    row = {"charger_id": "c", "ts": "2024-01-01", "status": "Charging", "voltage_v": 227.5, "power_w": 21500, "current_a": 94.5, "temp_c": 33.0, "earth_leak_ma": 0.9, "fan_rpm": 1900, "soc_percent": 61} | change
    schema = "charger_id string, ts string, status string, voltage_v double, power_w int, current_a double, temp_c double, earth_leak_ma double, fan_rpm int, soc_percent int"
    got = validation.validate_telemetry(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert (got.is_valid, len(got.errors), len(got.warnings)) == (valid, n_errors, n_warnings)
    if change.get("soc_percent"):
        assert got.soc_percent == 100


def _reasoning(spark, outcome=None, resolution="escalated"):
    return spark.createDataFrame([(5, "c", resolution, outcome)], "id long, charger_id string, resolution string, verified_outcome string")


def _memory(spark, provenance="session", pending=(), source=(), done=(), c=0, k=0):
    return spark.createDataFrame([(10, provenance, c, k, 0.5, list(source), list(pending), list(done))], "id long, provenance string, verified_confirmations int, verified_contradictions int, confidence double, source_refs array<string>, pending_refs array<string>, adjudicated array<string>").withColumn("confidence", F.col("confidence").cast("decimal(3,2)"))


REF = "agent_reasoning:5"


@pytest.mark.parametrize(
    ("stored", "mem", "outcome", "result", "counters", "provenance"),
    [
        (None, {"pending": [REF]}, "fixed", "ok", (1, 0), "verified"), ("fixed", {"pending": [REF]}, "fixed", "ok", (1, 0), "verified"), ("fixed", {"source": [REF], "done": [REF]}, "fixed", "ok_no_propagation", (0, 0), "session"),
        ("different_fault", {"pending": [REF]}, "fixed", "conflict", (0, 0), "session"), (None, {"provenance": "verified", "c": 2, "pending": [REF]}, "different_fault", "ok", (2, 1), "verified"), (None, {}, "fixed", "ok_no_propagation", (0, 0), "session"),
    ],
)
def test_outcomes(spark, stored, mem, outcome, result, counters, provenance):
    o = spark.createDataFrame([(5, outcome, "2024-01-01", 1)], "reasoning_id long, outcome string, at string, seq long")
    r, m, report = memory.apply_outcomes(_reasoning(spark, stored), _memory(spark, **mem), o)
    row = m.first()
    assert report.first().result == result
    assert (row.verified_confirmations, row.verified_contradictions, row.provenance) == (*counters, provenance)
    if result == "ok":
        r2, m2, report2 = memory.apply_outcomes(r, m, o)  # a second time nothing changes
        assert m2.first() == row
        assert report2.first().result == "ok_no_propagation"
        assert (REF in row.source_refs) == (outcome == "fixed")
        assert r.first().resolution == ("confirmed" if outcome == "fixed" else "escalated")


def test_batch_order_of_outcomes(spark):
    o = spark.createDataFrame([(5, "fixed", "x", 1), (5, "fixed", "x", 2), (5, "different_fault", "x", 3), (6, "fixed", "x", 4)], "reasoning_id long, outcome string, at string, seq long")
    got = {r.seq: r.state for r in memory.resolve_outcomes(_reasoning(spark), o).collect()}
    assert got == {1: "stamped", 2: "same", 3: "conflict", 4: "unknown"}


MEMORIES = "id long, scope string, category string, content string, vec array<float>, provenance string, status string, superseded_by long, corroborations int, supersede_events int, supporting_evidence_count int, source_refs array<string>, pending_refs array<string>, confidence decimal(3,2), verified_confirmations int, adjudicated array<string>"
NEW = "id long, scope string, category string, content string, vec array<float>, provenance string, source_refs array<string>, session_id string, confidence double"


def test_merge_supersede_insert(spark):
    base = [(1, "s", "a", "old", [1.0, 0.0], "verified", "active", None, 0, 0, 1, ["x:1"], [], Decimal("0.81"), 4, ["agent_reasoning:3"])]
    new = [(2, "s", "b", "near", [1.0, 0.1], "session", ["x:2", "agent_reasoning:7", "agent_reasoning:8"], "S1", 0.99), (3, "s", "a", "mid", [1.0, 0.95], "session", ["agent_reasoning:8"], None, 0.99), (4, "s", "z", "mid2", [0.2, 1.0], "session", [], None, None), (5, "t", "a", "own", [1.0, 0.0], "consolidated", None, "S1", 0.1)]
    reasoning = spark.createDataFrame([(7, "S1", "confirmed", 1), (8, "S1", "escalated", 2)], "id long, session_id string, resolution string, created_at int")
    got = {r.id: r for r in memory.write_memories(spark.createDataFrame(base, MEMORIES), spark.createDataFrame(new, NEW), reasoning).collect()}
    assert 2 not in got  # merged into 1, whatever its category
    assert (got[1].corroborations, got[1].supporting_evidence_count, got[1].content) == (1, 2, "near")
    assert got[1].source_refs == ["x:1", "x:2", "agent_reasoning:7"]  # 8 is not confirmed
    assert got[1].pending_refs == ["agent_reasoning:8"]  # but the session's newest
    assert (got[1].confidence, got[1].verified_confirmations, got[1].adjudicated) == (Decimal("0.81"), 4, ["agent_reasoning:3"])
    assert (got[1].status, got[1].superseded_by) == ("superseded", 3)  # same category, between both distances
    assert (got[3].status, got[4].status) == ("active", "active")  # 4 is near 3, but of another category
    assert (got[3].confidence, got[3].verified_confirmations, got[3].source_refs) == (Decimal("0.50"), 0, ["agent_reasoning:8"])
    assert (got[5].action, got[5].confidence, got[5].pending_refs) == ("inserted", Decimal("0.75"), ["agent_reasoning:8"])


def test_nearest_by_matrix_and_pairs(spark):
    rng = np.random.default_rng(2)
    vec = rng.normal(size=(60, 5))
    rows = spark.createDataFrame([(i, i % 2, [float(x) for x in v]) for i, v in enumerate(vec)] + [(100, 0, None), (101, 0, [0.0] * 5)], "id long, k int, vec array<double>").repartition(3)
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    far = 1 - unit @ unit.T
    q = rows.filter("id < 7").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.nearest(rows, q, 4).collect()}
    assert got == {(i, n + 1): int(j) for i in range(7) for n, j in enumerate(np.lexsort((np.arange(60), far[i]))[:4])}
    pairs = sorted((r.a, r.b) for r in retrieval.pairs_within(rows, ["k"], 0.4, block=7).collect())
    assert pairs == [(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and far[i, j] < 0.4]


def test_upsert_takes_the_first_in_order(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k long, t string, n int")
    new = spark.createDataFrame([(1, "z", 1), (1, "b", 2), (2, "y", 1), (2, "x", 1)], "k long, t string, n int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], ["t", "n"], [F.desc("n")]).filter("k = 1").collect())) == [(1, "b", 2)]
    assert sorted(map(tuple, sinks.insert_ignore(old, new, "k").collect())) == [(1, "a", 0), (2, "x", 1)]


def test_windows_of_missing_measures(spark):
    t = spark.createDataFrame([("c", "2024-01-01 00:00:00")], "charger_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    t = t.withColumns({"status": F.lit("Available"), "error_code": F.lit("NoError")} | {c: F.lit(None).cast("int") for c in ("power_w", "voltage_v", "current_a", "temp_c", "fan_rpm", "earth_leak_ma")})
    zero, null = window_aggregate(t, zero_missing=True).first(), window_aggregate(t).first()
    assert (zero.avg_power_w, zero.max_power_w, zero.avg_current_a, zero.avg_fan_rpm, zero.max_earth_leak) == (0, 0, 0, 0, 0)
    assert null.avg_power_w is None


def test_gate(spark):
    rows = [(None, 0.86, 4, 0.7), (None, 0.83, 3, 0.7), (None, 0.9, 0, 0.7), (None, 0.9, 4, 0.4), (9, 0.1, 0, 0.0), (None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, superseded_by long, confidence double, verified_confirmations int, similarity double")
    got = df.select(memory.shortcut_eligible(), memory.gate_fail_reason()).collect()
    assert [r[0] for r in got] == [True, False, False, False, False, False]
    assert [r[1] for r in got] == [None, "confidence<0.85", "verified_confirmations<3", "similarity<0.55", "superseded", "confidence<0.85"]


def vectors(spark, n=900, size=16, seed=3):
    """Rows around a few directions, with copies; some without a direction."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, size))
    v = centre[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, size))
    v[::50] = v[7]
    rows = [(i, None if i % 301 == 300 else [0.0] * size if i % 211 == 210 else v[i].tolist(), int(i % 3 > 0), "Alpha beta." if i % 3 else f"gamma w{i % 40}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, vec array<double>, k int, text string"), rows


def brute_nearest(rows, queries, k, allowed):
    out = {}
    for q in queries:
        d = [(1 - np.dot(r[1], q[1]) / np.linalg.norm(r[1]) / np.linalg.norm(q[1]), r[0]) for r in rows if r[1] is not None and any(r[1]) and allowed(q, r)]
        out[q[0]] = [i for _, i in sorted((round(x, 12), i) for x, i in d)[:k]]
    return {q: ids for q, ids in out.items() if ids}


def ranked(found):
    out = {}
    for r in sorted(found.select("query_id", "rank", "id").collect()):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_index_reads_few_lists_and_finds_most(spark, tmp_path):
    df, rows = vectors(spark)
    q = df.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    asked = [r for r in rows if r[0] % 20 == 0 and r[1] is not None and any(r[1])]
    ann.build_index(df, str(tmp_path / "i"), 30)
    exact = brute_nearest(rows, asked, 10, lambda *_: True)
    assert ranked(ann.search(spark, str(tmp_path / "i"), q, 10, exact=True)) == exact
    some = ranked(ann.search(spark, str(tmp_path / "i"), q, 10, 6))
    hits = sum(len(set(exact[i]) & set(some.get(i, []))) for i in exact) / sum(map(len, exact.values()))
    assert hits >= 0.9
    none = ranked(ann.search(spark, str(tmp_path / "i"), q, 1, 2, not_self=True))
    assert all(i not in ids for i, ids in none.items())
    assert ann.read_lists(spark, str(tmp_path / "i")).count() == sum(r[1] is not None and any(r[1]) for r in rows)
    plan = ann.read_lists(spark, str(tmp_path / "i"), [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "list IN (1,2)" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0] or "list#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    reached = spark.read.parquet(str(tmp_path / "i" / "probes")).first()
    assert reached.recall >= ann.TARGET
    assert reached.probes < 30
    one = df.limit(1).select("id", "vec")
    ann.build_index(one, str(tmp_path / "one"))
    assert ann.search(spark, str(tmp_path / "one"), q, 3).select("id").distinct().count() == 1
    ann.build_index(one.filter("false"), str(tmp_path / "none"))
    assert ann.search(spark, str(tmp_path / "none"), q.limit(0), 3).count() == 0


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_index_recall_on_the_given_vectors(spark, tmp_path, name):
    """Recall at 10 with the parameters of the query."""
    e = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    q = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    ann.build_index(e, str(tmp_path / "i"))
    exact, some = ranked(retrieval.nearest(e, q, 10)), ranked(ann.search(spark, str(tmp_path / "i"), q, 10))
    recall = sum(len(set(exact[i]) & set(some[i])) for i in exact) / sum(map(len, exact.values()))
    print("recall", name, recall)
    assert recall >= 0.9


def test_many_queries_and_hot_keys_in_blocks(spark, monkeypatch):
    """More queries than one block, and a key with most rows: the same as all pairs."""
    df, rows = vectors(spark, 300)
    asked = [r for r in rows if r[0] % 5 == 0 and r[1] is not None and any(r[1])]
    q = df.filter("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), F.col("k").alias("own"))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 17)
    found = retrieval.nearest(df, q, 4)
    assert found.columns == ["id", "vec", "k", "text", "query_id", "own", "distance", "rank"]
    assert ranked(found) == brute_nearest(rows, asked, 4, lambda *_: True)
    keyed = retrieval.nearest_by_key(df, q.withColumnRenamed("own", "k"), "k", 4, block=30, not_self=True)
    assert ranked(keyed) == brute_nearest(rows, asked, 4, lambda a, b: a[2] == b[2] and a[0] != b[0])


def test_hybrid_by_postings(spark, tmp_path):
    """Several keywords of a query count a row once; no nested loop in the plan; the stored index reads few folders."""
    df, rows = vectors(spark, 300)
    words = F.when(F.col("id") % 3 == 0, F.array(F.lit("BETA"), F.lit("alpha"), F.lit("w7"))).when(F.col("id") % 3 == 1, F.array(F.lit("nowhere"))).otherwise(F.array().cast("array<string>"))
    q = df.filter("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), words.alias("keywords"))
    asked = [r for r in rows if r[0] % 10 == 0 and r[1] is not None and any(r[1])]
    allowed = lambda a, b: a[0] % 3 == 2 or (a[0] % 3 == 0 and ("Alpha" in b[3] or b[3].split()[-1] == "w7"))
    found = retrieval.hybrid(df, q, 6, text="text")
    assert ranked(found) == brute_nearest(rows, asked, 6, allowed)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    retrieval.write_postings(df, str(tmp_path / "p"), "text")
    assert ranked(retrieval.hybrid(df, q, 6, text="text", index=str(tmp_path / "p"))) == ranked(found)
    few = retrieval.read_postings(spark, str(tmp_path / "p"), spark.createDataFrame([("w7",)], "term string"))
    assert {r.id for r in few.filter("term = 'w7'").collect()} == {r[0] for r in rows if r[3].split()[-1] == "w7"}


def test_hybrid_keyword_is_a_filter(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "GroundFailure at coastal site"), (2, [0.0, 1.0], "hot"), (3, None, "GroundFailure")], "id long, vec array<double>, text string")
    q = spark.createDataFrame([(1, [0.0, 1.0], ["groundfailure"]), (2, [0.0, 1.0], []), (3, [0.0, 1.0], ["InternalError"]), (4, None, [])], "query_id long, query_vec array<double>, keywords array<string>")
    got = [(r.query_id, r.id, r.ft_used) for r in retrieval.hybrid(rows, q, 1, text="text").orderBy("query_id").collect()]
    assert got == [(1, 1, True), (2, 2, False)]
    assert retrieval.hybrid(rows, q, 1, text="absent").count() == 3
    with pytest.raises(ValueError):
        retrieval.check_searchable("users", "vec")


def test_boost_reorders_only(spark):
    found = spark.createDataFrame([(1, 1, "global", 0.40, 1), (1, 2, "site:1", 0.41, 2)], "query_id long, id long, scope string, distance double, rank int")
    got = retrieval.boost_scope(found, "site:1").orderBy("rank").collect()
    assert [(r.id, r.similarity) for r in got] == [(2, 0.6105), (1, 0.6)]


def test_cleanup_order_and_idempotence(spark):
    rows = [(1, "active", 0, "2024-01-01", None, "0.80"), (2, "active", 5, "2024-05-01", None, "0.30"), (3, "active", 5, "2024-05-30", None, "0.30"), (4, "superseded", 0, "2023-01-01", None, "0.10")]
    m = spark.createDataFrame(rows, "id long, status string, access_count int, c string, last_decayed_at timestamp_ntz, d string").select("id", "status", "access_count", F.col("c").cast("timestamp_ntz").alias("created_at"), "last_decayed_at", F.col("d").cast("decimal(3,2)").alias("confidence"))
    once = lifecycle.cleanup(m, "2024-06-05 00:00:00")
    got = {r.id: (r.status, float(r.confidence)) for r in once.collect()}
    assert got == {1: ("deprecated", 0.8), 2: ("deprecated", 0.29), 3: ("active", 0.3), 4: ("superseded", 0.1)}
    assert sorted(map(tuple, lifecycle.cleanup(once, "2024-06-05 00:00:00").collect())) == sorted(map(tuple, once.collect()))


def test_compaction(spark):
    rows = [(1, "s", "a", 0.9, [1.0, 0.0], 1), (2, "s", "a", 0.8, [1.0, 0.1], 2), (3, "s", "a", 0.7, [1.0, 0.2], 4), (4, "s", "b", 0.6, [1.0, 0.0], 8), (5, "s", "a", 0.5, [0.0, 1.0], 16)]
    m = spark.createDataFrame([(*r, "active") for r in rows], "id long, scope string, category string, confidence double, vec array<double>, supporting_evidence_count int, status string")
    got = {r.id: (r.superseded_by, r.supporting_evidence_count) for r in lifecycle.compact(m).collect()}
    assert got == {1: (None, 7), 2: (1, 2), 3: (1, 4), 4: (None, 8), 5: (None, 16)}
    assert {r.id: r.supporting_evidence_count for r in lifecycle.compact(m, compat=True).collect()}[1] == 5


def sequential_compaction(rows, limit, compat=False):
    """The plain loop, as an oracle: rows (id, scope, category, confidence, vec, evidence, status)."""
    out = {}
    for key in {(r[1], r[2]) for r in rows}:
        own = sorted((r for r in rows if (r[1], r[2]) == key and r[6] == "active" and r[4] is not None and any(r[4])), key=lambda r: (-r[3], r[0]))
        by, count = {}, {}
        for i, r in enumerate(own):
            if r[0] in by:
                continue
            near = [o for o in own[i + 1 :] if o[0] not in by and 1 - np.dot(r[4], o[4]) / np.linalg.norm(r[4]) / np.linalg.norm(o[4]) < limit]
            by |= {o[0]: r[0] for o in near}
            count[r[0]] = r[5] + ((near[-1][5] if near else 0) if compat else sum(o[5] for o in near))
        out |= {r[0]: (by.get(r[0]), count.get(r[0], r[5])) for r in own}
    return out


@pytest.mark.parametrize(("finish", "block", "compat"), [(4, 7, False), (4, 1000, True), (5000, 9, False)])
def test_compaction_in_rounds(spark, finish, block, compat):
    """One hot scope of many tasks, copies, ties in confidence, rows without a vector: as the sequential loop."""
    rng = np.random.default_rng(finish + block)
    vecs = rng.normal(size=(160, 4)).round(2)
    rows = []
    for i in range(160):
        vec = vecs[rng.integers(0, 160)] if i % 4 == 0 else vecs[i]
        vec = None if i % 41 == 0 else [0.0] * 4 if i % 43 == 0 else vec.tolist()
        rows.append((i, "global" if i % 5 else "site:1", "a" if i % 3 else "b", float(rng.integers(0, 9)) / 10, vec, int(rng.integers(1, 9)), "active" if i % 17 else "superseded"))
    m = spark.createDataFrame(rows, "id long, scope string, category string, confidence double, vec array<double>, supporting_evidence_count int, status string")
    got = {r.id: (r.superseded_by, r.supporting_evidence_count) for r in lifecycle.compact(m.repartition(5), 0.2, compat, finish, block).collect()}
    assert got == sequential_compaction(rows, 0.2, compat)
    assert sum(by is not None for by, _ in got.values()) > 20
    assert lifecycle.compact(m.filter("false"), finish_rows=finish).collect() == []


def test_budgets(spark):
    df = spark.createDataFrame([(1, 1, 300), (1, 2, 300), (1, 3, 100)], "k long, i int, tokens long")
    run = ranking.running_budget(df, ["k"], [F.asc("i")], "tokens", F.lit(500))
    assert [r.i for r in run.collect()] == [1]  # stops at the first overflow
    items = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "tokens"))).alias("x"))
    assert [r.i for r in items.select(ranking.greedy_budget(F.col("x"), 500)).first()[0]] == [1, 3]  # skips and goes on


@pytest.mark.parametrize(("fit", "pieces"), [(5, 7), (10_000, 3)])
def test_budgets_of_a_hot_key(spark, fit, pieces):
    """One key over many pieces, a null key, ties of tokens, zeros: as the plain loops."""
    rng = np.random.default_rng(fit)
    rows = [(None if i % 29 == 0 else 1 if i % 10 else i % 7, i, None if i % 31 == 0 else int(rng.integers(0, 60)) * (i % 3 > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, i int, tokens long").repartition(6)
    prefix, fitted = set(), set()
    for key in {r[0] for r in rows}:
        used, ended, rest = 0, False, 900
        for _, i, t in sorted((r for r in rows if r[0] == key), key=lambda r: -r[1]):
            used += t or 0
            ended |= used > 900
            if not ended:
                prefix.add((i, used))
            if (t or 0) <= rest:
                rest -= t or 0
                fitted.add(i)
    run = ranking.running_budget(df, ["k"], [F.desc("i")], "tokens", F.lit(900), pieces)
    assert {(r.i, r.used) for r in run.collect()} == prefix
    parts = ranking.prefix_sums(df, ["k"], [F.desc("i")], "tokens", "used", pieces).filter("k = 1")
    assert parts.select(F.spark_partition_id()).distinct().count() > 1
    got = ranking.greedy_fit(df, ["k"], [F.desc("i")], "tokens", 900, fit, pieces).collect()
    assert {r.i for r in got} == fitted
    assert len(got) == len(fitted)
    assert ranking.greedy_fit(df.filter("false"), ["k"], [F.desc("i")], "tokens", 900).collect() == []


def test_overfetch_falls_short(spark):
    rows = [("hog", f"2024-01-01 00:{i:02d}:00", 0.9) for i in range(30)] + [("b", "2024-01-01 00:00:00", 0.5), ("c", "2024-01-01 00:00:00", 0.4)]
    w = spark.createDataFrame(rows, "charger_id string, window_start string, anomaly_score double")
    assert ranking.top_entities(w, 2).count() == 2
    assert ranking.top_entities(w, 2, exact=False).count() == 1


def test_context(spark):
    s = spark.createDataFrame([("c", "charger_profile", "a b c"), ("c", "recent_anomalies", "w " * 4000), ("c", "active_investigations", "x y")], "charger_id string, snapshot_type string, content string")
    d = spark.createDataFrame([("c", 7, 1, "seen it")], "charger_id string, id long, rank int, text string")
    m = spark.createDataFrame([("c", 8, 1, "know it"), ("c", 9, 2, "z " * 39)], "charger_id string, id long, rank int, text string")
    got = context.assemble(s, d, m).first()
    assert got.sources == ["context_snapshot:charger_profile", "context_snapshot:active_investigations", "prior_diagnosis:7", "fleet_memory:8", "fleet_memory:9"]
    assert got.tokens_used == 3 + 2 + 2 + 2 + 50


def test_snapshot_scores_just_below_a_half(spark):
    scores = {"a": 0.5065, "b": 0.5005, "c": 0.0005, "d": 0.2535, "e": 1.0}  # 1000 times 0.5065 is 506.49999999999994
    w = spark.createDataFrame(list(scores.items()), "charger_id string, anomaly_score double").withColumn("window_start", F.lit("2024-01-19 00:00:00").cast("timestamp_ntz"))
    got = {r.charger_id: r.content.split()[-1] for r in context.anomalies_snapshot(w, "2024-01-20 00:00:00").collect()}
    assert got == {"a": "0.506", "b": "0.500", "c": "0.001", "d": "0.254", "e": "1.000"}


#: A text of a window, and what it says of a score of 0.5065.
WINDOW_TEXTS = [("trigger_text", "Anomaly score 0.506 for"), ("window_text", "anomaly_score=0.506")]


@pytest.mark.parametrize("name, said", WINDOW_TEXTS)
def test_texts_of_scores_just_below_a_half(spark, name, said):
    w = window_aggregate(telemetry_of_events(spark, "/root/testdata/sf0.001"), "1 day").limit(1).withColumn("anomaly_score", F.lit(0.5065))
    assert said in w.select(getattr(texts, name)().alias("t")).first().t


def test_snapshots_of_repeated_chargers(spark):
    rows = [(i, "a", "confirmed", None, "seen x") for i in range(7)] + [(9, "b", "promoted", None, "seen y")]
    r = spark.createDataFrame(rows, "id long, charger_id string, resolution string, superseded_by long, observation string").withColumn("created_at", F.lit("2024-01-19 00:00:00").cast("timestamp_ntz"))
    asked = spark.createDataFrame([("a",), ("b",), ("a",), ("c",), ("b",)], "charger_id string")
    got = sorted((x.charger_id, x.content.count("\n")) for x in context.investigations_snapshot(r, chargers=asked).collect())
    assert got == [("a", 5), ("a", 5), ("b", 0), ("b", 0), ("c", 0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a'b"), (2, None)], "id long, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, nullValue="None").filter("t IS NULL").count() == 1
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert sum(s.statement.count("(") - 1 for s in sinks.insert_statements(df, "x").collect()) == 2


def test_store(spark, tmp_path):
    s = Store(spark, tmp_path.as_uri() + "/s", keep=2)
    a = spark.createDataFrame([(1,)], "id long")
    for _ in range(4):
        s.commit({"a": a, "b": a})
    assert s.versions() == {"a": 4, "b": 4}
    assert s.read("a").count() == 1
    assert s.read("a", 3).count() == 1
    with pytest.raises(Exception):  # noqa: B017  an old version is gone
        s.read("a", 1).count()


def test_windows_of_a_stream_of_json(spark, tmp_path):
    assert generators.outage_catalogue(spark).count() == 21
    kinds = dict(f.split(maxsplit=1) for f in TELEMETRY.split(", "))
    events = telemetry_of_events(spark, SF)
    t = events.select(*[F.col(c).cast(kinds[c]).alias(c) for c in events.columns if c in kinds])
    t.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).repartitionByRange(1, "ts").sortWithinPartitions("ts").write.json(str(tmp_path / "in"))
    (tmp_path / "in" / "bad.json").write_text("not json\n")
    jobs.start_windows(jobs.json_telemetry(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() > 0
    batch = window_aggregate(t)
    tail = jobs.tail_windows(t)
    assert done.count() + tail.count() == batch.count()
    same = done.join(batch.select("charger_id", "window_start", F.col("anomaly_score").alias("s")), ["charger_id", "window_start"])
    assert same.count() == done.count()
    assert same.filter("anomaly_score != s").count() == 0
    assert jobs.late_rows(t, done.unionByName(tail, allowMissingColumns=True)).count() == 0


def test_vectors_of_changes(spark, tmp_path):
    good = {"type": "INSERT", "table": "fleet_memory", "data": [{"id": "1", "content": "x"}, {"id": "2", "memory_vec": "[1]"}, {"content": "no id"}]}
    lines = [json.dumps(good), json.dumps(good | {"type": "DELETE"}), json.dumps(good | {"table": "other"}), "{bad"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    seen = []
    jobs.start_vectors(spark.readStream.text(str(tmp_path / "in")), {"fleet_memory": "memory_vec"}, lambda b, _: seen.extend(r.id for r in b.collect()), str(tmp_path / "dead"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert seen == ["1"]

    def fail(batch, number):
        raise OSError("down")

    jobs.start_vectors(spark.readStream.text(str(tmp_path / "in")), {"fleet_memory": "memory_vec"}, fail, str(tmp_path / "dead"), str(tmp_path / "cp2"), available_now=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 1


def test_refs(spark):
    r = spark.createDataFrame([(1, "a:1"), (2, "a:9"), (3, "zz:1"), (4, "A b"), (5, None)], "id long, ref string")
    got = {x.id: x.reason for x in validation.validate_refs(r, {"a": spark.createDataFrame([(1,)], "k long")}).collect()}
    assert got == {1: None, 2: "not_found", 3: "unknown_prefix", 4: "malformed", 5: "malformed"}


def test_tools(spark):
    t = Tools(spark, {"charger_windows": window_aggregate(telemetry_of_events(spark, SF), "1 day")})
    assert t.call("nothing")["error"] == "unknown_tool"
    assert t.call("top_anomalous_chargers", n=3).count() == 3
    assert t.call("search_similar_outages", queries=None)["error"] == "KeyError"


def test_tools_change_their_tables(spark):
    mem = spark.createDataFrame([(1, "s", "a", "old", [1.0, 0.0], "session", "active", None, 0, 0, 1, [], [], Decimal("0.50"), 0, [])], MEMORIES).withColumnRenamed("vec", "memory_vec").withColumns({"access_count": F.lit(0), "last_accessed": F.lit(None).cast("timestamp_ntz")})
    windows = window_aggregate(telemetry_of_events(spark, SF), "1 day")
    outages = spark.createDataFrame([(1, "heat", [1.0] * 8), (2, "GroundFailure", [0.5] * 7 + [-1.0])], "id long, root_cause string, signature_vec array<double>").withColumns({"severity": F.lit("high"), "category": F.lit("thermal")})
    sessions = spark.createDataFrame([], "session_id string, user_id string, focus_chargers array<string>, focus_site string, investigation_summary string, token_budget int, tokens_used long, last_active timestamp_ntz")
    t = Tools(spark, {"fleet_memory": mem, "charger_windows": windows, "outage_catalog": outages, "session_state": sessions, "context_snapshots": spark.createDataFrame([], "entity_id string, snapshot_type string, content string, token_count int, expires_at timestamp_ntz, is_stale boolean")})
    q = spark.createDataFrame([(1, [1.0, 0.1], [])], "query_id long, query_vec array<double>, keywords array<string>")
    assert [r.id for r in t.call("recall_fleet_memory", queries=q, as_of="2024-06-01 00:00:00").collect()] == [1]
    assert t.t["fleet_memory"].first().access_count == 1
    one = windows.select("charger_id", "window_start").limit(1)
    assert t.call("outages_like_windows", windows=one, k=2).count() == 2
    new = spark.createDataFrame([(9, "s", "b", "new", [0.0, 1.0], "session", [], None, 0.9)], NEW).withColumnRenamed("vec", "memory_vec")
    assert t.call("write_fleet_memory", new=new).count() == t.t["fleet_memory"].count() == 2
    assert t.call("link_memory", links=spark.createDataFrame([(9, "agent_reasoning:1")], "id long, ref string")).first().status == "linked"
    assert t.call("link_memory", links=spark.createDataFrame([(9, "agent_reasoning:1")], "id long, ref string")).first().status == "already_linked"
    who = spark.createDataFrame([("S1", "u")], "session_id string, user_id string")
    assert t.call("get_session_state", wanted=who, as_of="2024-06-01 00:00:00").first().token_budget == 4000
    assert t.call("update_session_state", updates=who.select("session_id", F.lit(7).cast("long").alias("tokens_used")), as_of="2024-06-01 00:00:00").first().status == "updated"
    assert t.t["session_state"].first().tokens_used == 7
    wanted = spark.createDataFrame([("c", "profile")], "entity_id string, snapshot_type string")
    built = wanted.withColumn("content", F.lit("two words"))
    assert t.call("get_charger_context", wanted=wanted, built=built, as_of="2024-06-01 00:00:00").first().token_count == 2
    again = t.call("get_charger_context", wanted=wanted, built=built.withColumn("content", F.lit("other")), as_of="2024-06-01 00:20:00")
    assert again.first().content == "two words"  # still cached


def test_embedding_is_fixed(spark):
    df = spark.createDataFrame([("a b a",), ("a b a",), (None,)], "t string").select(retrieval.embed(F.col("t"), size=16).alias("v")).collect()
    assert df[0].v == df[1].v
    assert df[2].v is None
    assert abs(sum(x * x for x in df[0].v) - 1) < 1e-5
