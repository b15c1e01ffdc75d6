"""Operators that avoid work or cut hot keys, each against a plain version of itself."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import ann, memory, retrieval
from wattloom.operators.windows import merge_states, window_aggregate, window_states, windows_of_states
from wattloom.sources import sinks
from wattloom.sources.adapters import telemetry_of_events
from wattloom.sources.store import Store

SF = "/root/testdata/sf0.001"


def _clusters(n, seed, spread=0.15, size=6, centres=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, size))
    return [[float(x) for x in middle[i % centres] + spread * rng.normal(size=size)] for i in range(n)]


def test_pairs_with_pruned_cells(spark):
    vec = _clusters(300, 1)
    vec[40:60] = [vec[40]] * 20  # copies
    rows = [(i, "hot" if i % 10 else "cold", v) for i, v in enumerate(vec)] + [(900, "hot", None), (901, "hot", [0.0] * 6), (902, "one", vec[0]), (903, None, vec[0])]
    df = spark.createDataFrame(rows, "id long, k string, vec array<double>").repartition(3)
    unit = np.array(vec) / np.linalg.norm(vec, axis=1, keepdims=True)
    far = 1 - unit @ unit.T
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if (a % 10 > 0) == (b % 10 > 0) and far[a, b] < 0.05}
    for prune in (True, False):
        got = [(r.a, r.b) for r in retrieval.pairs_within(df, ["k"], 0.05, block=15, prune=prune).collect()]
        assert len(got) == len(set(got))
        assert set(got) == want
    live = df.filter(F.exists("vec", lambda x: x != 0)).select("k", F.col("id").alias("a"), F.col("vec").alias("v"))
    met = retrieval.cell_pairs(retrieval.cells_of(live, ["k"], 15), ["k"], 0.05)
    assert 0 < met.filter("met").count() < met.count() / 2
    assert retrieval.pairs_within(df.limit(0), ["k"], 0.05).count() == 0


@pytest.mark.parametrize("zero_missing", [False, True])
def test_merged_states_are_the_aggregate(spark, zero_missing):
    t = telemetry_of_events(spark, SF)
    gone = lambda c: F.when(F.col("event_id") % 3 > 0, F.col(c))
    t = t.withColumns({c: gone(c) for c in ("power_w", "current_a", "fan_rpm", "earth_leak_ma", "voltage_v", "temp_c", "status", "error_code")})
    parts = [window_states(t.filter(f"event_id % 4 = {i}"), "5 minutes") for i in range(4)]
    hours = merge_states(parts[0].unionByName(parts[1]), "1 hour").unionByName(merge_states(parts[2].unionByName(parts[3]), "1 hour"))
    got = windows_of_states(merge_states(hours, "1 day"), zero_missing=zero_missing)
    want = window_aggregate(t, "1 day", zero_missing=zero_missing)
    assert got.schema.simpleString() == want.schema.simpleString()
    plain = lambda df: sorted(map(str, df.drop("anomaly_breakdown").collect()))
    assert plain(got) == plain(want)
    assert windows_of_states(merge_states(parts[0].limit(0), "1 day")).count() == 0


def _sequential(old, new):
    """Memories (id, scope, category, vec) and writes, one after the other."""
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    live = {i: (s, c, unit(v)) for i, s, c, v in old}
    out = {}
    for i, s, c, v in sorted(new, key=lambda r: r[0]):
        u = unit(v)
        near = sorted((1 - float(w @ u), j) for j, (t, _, w) in live.items() if t == s)
        d, j = near[0] if near else (9, None)
        if d < memory.MERGE_DISTANCE:
            live[j] = (s, live[j][1], u)
            out[i] = ("merged", j)
            continue
        over = d < memory.SUPERSEDE_DISTANCE and live[j][1] == c
        if over:
            del live[j]
        live[i] = (s, c, u)
        out[i] = ("inserted", j if over else None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_writes_in_groups_equal_writes_in_order(spark, seed):
    rng = np.random.default_rng(seed)
    vec = _clusters(260, seed, spread=0.7 if seed % 2 else 0.35, size=4)
    scope = lambda: "global" if rng.random() < 0.8 else None if rng.random() < 0.3 else f"site:{rng.integers(3)}"
    rows = [(i, scope(), "ab"[int(rng.integers(2))], v) for i, v in enumerate(vec)]
    old, new = rows[:120], rows[120:]
    new = new + [(1000 + i, "global", "a", new[5][3]) for i in range(5)]  # copies that follow each other
    schema = "id long, scope string, category string, vec array<double>"
    memories = spark.createDataFrame(old, schema).withColumn("status", F.lit("active"))
    more = spark.createDataFrame([(5000, "global", "a", None), (5001, "global", "a", [0.0] * 4)], schema)
    got = memory.decide_writes(memories, spark.createDataFrame(new, schema).repartition(3).unionByName(more), block=20).collect()
    assert len(got) == len(new) + 2
    decided = {r.id: (r.action, r.target) for r in got}
    assert decided.pop(5000) == decided.pop(5001) == ("inserted", None)
    assert decided == _sequential(old, new)
    assert {a for a, _ in decided.values()} == {"merged", "inserted"}
    assert memory.decide_writes(memories, spark.createDataFrame([], schema)).count() == 0
    assert {r.action for r in memory.decide_writes(memories.limit(0), more).collect()} == {"inserted"}


def _files(path):
    return {f: os.path.getmtime(f) for f in (os.path.join(d, n) for d, _, names in os.walk(path) for n in names) if f.endswith(".parquet")}


def test_retention_by_partition(spark, tmp_path):
    times = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i)) for i in range(60)] + [(99, None)]
    rows = spark.createDataFrame(times, "id long, ts timestamp_ntz")
    path = str(tmp_path / "t")
    sinks.append(rows, path, by_date_of="ts")
    before = _files(path)
    want = sorted(r.id for r in sinks.retain(rows, "ts", "3 DAYS", "2024-01-09 07:30:00").collect())
    done = sinks.drop_partitions(spark, path, "ts", "3 DAYS", "2024-01-09 07:30:00")
    assert done["cut"] == ["dt=2024-01-06"]
    assert done["dropped"] == ["dt=2024-01-01", "dt=2024-01-02", "dt=2024-01-03", "dt=2024-01-04", "dt=2024-01-05", "dt=__HIVE_DEFAULT_PARTITION__"]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == want
    later = {f: t for f, t in before.items() if f.split("dt=")[1] >= "2024-01-07" and "__" not in f}
    assert later
    assert later.items() <= _files(path).items()  # untouched
    os.rename(f"{path}/dt=2024-01-06", f"{path}/_kept-dt=2024-01-06")  # as a run leaves it that broke off between both steps
    assert sinks.drop_partitions(spark, path, "ts", "3 DAYS", "2024-01-09 07:30:00")["dropped"] == []
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == want


def test_upsert_writes_only_the_buckets_hit(spark, tmp_path):
    s = Store(spark, (tmp_path / "s").as_uri(), keep=2)
    old = spark.createDataFrame([(i, f"n{i}", i) for i in range(200)], "id long, name string, n int")
    s.write_buckets("t", old, ["id"], buckets=16)
    first = _files(tmp_path / "s")
    new = spark.createDataFrame([(7, "seven", -1), (500, "more", -2), (7, "zz", -3)], "id long, name string, n int")
    hit = s.upsert("t", new, ["name"], [F.col("name")])
    assert 1 <= len(hit) <= 2
    wrote = {f.split("_bucket=")[1].split("/")[0] for f in _files(tmp_path / "s").keys() - first.keys()}
    assert wrote == {str(b) for b in hit}
    got = {r.id: (r.name, r.n) for r in s.read_buckets("t").collect()}
    assert len(got) == 201
    assert (got[7], got[500], got[8]) == (("seven", 7), ("more", -2), ("n8", 8))
    assert s.read_buckets("t", hit).count() < 60
    assert s.upsert("t", new.limit(0), ["name"]) == []
    for _ in range(4):
        s.upsert("t", new, ["name"], [F.col("name")])
    assert s.read_buckets("t").count() == 201  # cleaning leaves what is referenced
    old_hit = [f for f in _files(tmp_path / "s") if "/v=2/" in f]
    assert old_hit == []


def test_lock_of_a_dead_writer(spark, tmp_path):
    root = tmp_path / "s"
    a = spark.createDataFrame([(1,)], "id long")
    Store(spark, root.as_uri()).commit({"a": a})
    (root / "_LOCK").write_text("someone")
    with pytest.raises(RuntimeError, match="another writer"):
        Store(spark, root.as_uri()).commit({"a": a})
    os.utime(root / "_LOCK", (1, 1))
    assert Store(spark, root.as_uri()).commit({"a": a}) == {"a": 2}
    assert not (root / "_LOCK").exists()
    s = Store(spark, root.as_uri())
    with pytest.raises(RuntimeError, match="taken over"), s._held() as me:
        Store(spark, root.as_uri())._put("_LOCK", "a later one")
        s._publish(me, {})
    assert s.versions() == {"a": 2}
    assert (root / "_LOCK").exists()  # the later one's


def test_writes_apart_meet_the_stored_memories_only(spark):
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    old = spark.createDataFrame([(1, "s", "a", "m1", at(0)), (2, "s", "b", "m2", at(120)), (3, "t", "a", "m3", at(0))], "id long, scope string, category string, content string, vec array<double>")
    old = old.withColumns({
        "provenance": F.lit("verified"), "status": F.lit("active"), "superseded_by": F.lit(None).cast("long"), "corroborations": F.lit(0), "supersede_events": F.lit(0), "supporting_evidence_count": F.lit(1),
        "source_refs": F.array(F.lit("note:1")), "pending_refs": F.array().cast("array<string>"), "confidence": F.lit("0.80").cast("decimal(3,2)"), "verified_confirmations": F.lit(2),
    })
    # two merges and a supersession of one memory; one too far from it, but near another write; one of another category
    rows = [(11, "s", "a", "x", at(20)), (12, "s", "a", "y", at(-25)), (13, "s", "a", "z", at(45)), (14, "s", "a", "far", at(60)), (15, "s", "a", "other", at(160)), (16, "u", "a", "alone", at(0))]
    new = spark.createDataFrame(rows, "id long, scope string, category string, content string, vec array<double>").withColumns({"provenance": F.lit("session"), "source_refs": F.array(F.lit("note:2"))})
    got = sorted((r.id, r.content, r.action, r.superseded_by or 0, r.corroborations) for r in memory.write_memories(old, new, apart=True).collect())
    assert got == [
        (1, "m1", "superseded", 13, 0), (1, "x", "updated", 0, 1), (1, "y", "updated", 0, 1), (2, "m2", "kept", 0, 0), (3, "m3", "kept", 0, 0),
        (13, "z", "inserted", 0, 0), (14, "far", "inserted", 0, 0), (15, "other", "inserted", 0, 0), (16, "alone", "inserted", 0, 0),
    ]


def test_write_query_is_its_sql_where_writes_are_near_each_other(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 16))
    vec = [[float(x) for x in base[i % 6] + 0.15 * rng.normal(size=16)] for i in range(300)]
    spark.createDataFrame([(i, v, i % 4) for i, v in enumerate(vec)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    os.symlink(f"{SF}/events.parquet", f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df, want = entry.queries()["write_memories"](spark, str(tmp_path)), con.sql(entry.oracle_sql()["write_memories"])
    rows = sorted(str([r[c] for c in want.columns]) for r in df.collect())
    assert rows == sorted(str(list(r)) for r in want.fetchall())
    assert len({r[0] for r in want.fetchall()}) < len(rows)  # some memories are met by several writes


@pytest.mark.parametrize("exact", [False, True])
def test_index_search_repeats_no_query_in_python(spark, tmp_path, exact, monkeypatch):
    vec = _clusters(400, 3)
    df = spark.createDataFrame(list(enumerate(vec)), "id long, vec array<double>")
    ann.build_index(df, str(tmp_path), lists=20)
    q = df.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    asked = []
    by_key = ann.nearest_by_key
    monkeypatch.setattr(ann, "nearest_by_key", lambda rows, queries, *a, **k: asked.append(queries) or by_key(rows, queries, *a, **k))
    got = {(r.query_id, r.rank): r.id for r in ann.search(spark, str(tmp_path), q, 3, probes=5, exact=exact).collect()}
    assert asked[0].count() == (20 if exact else 100)
    unit = np.array(vec) / np.linalg.norm(vec, axis=1, keepdims=True)
    far = 1 - unit @ unit.T
    if exact:
        assert got == {(i, n + 1): int(r) for i in range(0, 400, 20) for n, r in enumerate(np.argsort(far[i], kind="stable")[:3])}
    assert all(got[i, 1] == i for i in range(0, 400, 20))


def test_distances_are_held_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(retrieval, "CELLS", 700)
    seen, rng = [], np.random.default_rng(4)
    vec, ids = rng.normal(size=(200, 8)), rng.permutation(200)
    vec[50:120] = vec[50]  # copies tie
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    took = np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **k: seen.append(x.size) or took(x, *a, **k))
    i, j, far = retrieval._closest(unit, ids, unit[:90], 5, ids[:90])
    want = {(q, int(r)) for q in range(90) for r in sorted((r for r in range(200) if r != q), key=lambda r: (round(1 - float(unit[r] @ unit[q]), 9), ids[r]))[:5]}
    assert max(seen) <= 700
    assert set(zip(j.tolist(), i.tolist(), strict=True)) == want
    assert np.allclose(far, 1 - np.einsum("ij,ij->i", unit[i], unit[:90][j]))


def test_pairs_are_sent_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELLS", 300)
    vec = [[float(1 + i % 3), 1.0] for i in range(60)]
    df = spark.createDataFrame([(i, "k", v) for i, v in enumerate(vec)], "id long, k string, vec array<double>")
    unit = np.array(vec) / np.linalg.norm(vec, axis=1, keepdims=True)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if 1 - unit[a] @ unit[b] < 0.05}
    for block in (20, 2_000):
        got = [(r.a, r.b) for r in retrieval.pairs_within(df, ["k"], 0.05, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
