"""Maintenance jobs of the knowledge store, each a function of tables and an explicit time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import REF, flatten_refs
from ..schemas import COMPACT_DISTANCE, DECAY, DEPRECATE_BELOW
from ..sources.scratch import written
from .ranking import first_per_key

NO_TAG = "untagged"


def tag_key(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.array_join(F.array_sort(tags), "|")).otherwise(NO_TAG)


def tag_groups(reasoning: DataFrame, registry: DataFrame, as_of: str, days: int = 7, least: int = 3) -> DataFrame:
    """Confirmed live checkpoints of the last days by normalised tag set, groups of ``least`` or more.

    n, ids, the first five chargers by id, a sample observation, and the scope: one model, else one environment, else
    global; unknown ones are ignored. The first five come from a bounded top-k, not from a list of all.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    live = reasoning.filter((F.col("resolution") == "confirmed") & F.col("superseded_by").isNull() & (F.col("created_at") > now - F.make_dt_interval(F.lit(days))))
    r = live.join(registry.select("charger_id", "model", "manufacturer", "environment"), "charger_id", "left").withColumn("tag_key", tag_key(F.col("tags")))
    model = F.when(F.col("model").isNotNull() & F.col("manufacturer").isNotNull(), F.concat("manufacturer", F.lit("-"), "model"))
    g = r.groupBy("tag_key").agg(F.count("*").alias("n"), F.min(model).alias("m1"), F.max(model).alias("m2"), F.min("environment").alias("e1"), F.max("environment").alias("e2"), F.min_by("observation", "id").alias("sample")).filter(F.col("n") >= least)
    scope = F.when(F.col("m1") == F.col("m2"), F.concat(F.lit("model:"), "m1")).when(F.col("e1") == F.col("e2"), F.concat(F.lit("environment:"), "e1")).otherwise("global")
    five = first_per_key(r, ["tag_key"], [F.asc("id")], 5).groupBy("tag_key").agg(F.array_sort(F.collect_list(F.struct("id", "charger_id"))).alias("f")).select("tag_key", F.transform("f", lambda x: x["charger_id"]).alias("chargers"))
    return g.join(five, "tag_key").select("tag_key", "n", scope.alias("scope"), "chargers", "sample")


def consolidate(reasoning: DataFrame, registry: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(new memories, reasoning with the group members promoted)."""
    groups = tag_groups(reasoning, registry, as_of)
    text = F.concat(F.lit("Seen "), F.col("n").cast("string"), F.lit(" times ("), "tag_key", F.lit(") at "), F.array_join("chargers", ", "), F.lit(": "), "sample")
    memories = groups.select("scope", F.lit("pattern").alias("category"), text.alias("content"), F.lit("consolidated").alias("provenance"), F.col("n").cast("int").alias("corroborations"), "tag_key")
    now = F.lit(as_of).cast("timestamp_ntz")
    live = (F.col("resolution") == "confirmed") & F.col("superseded_by").isNull() & (F.col("created_at") > now - F.make_dt_interval(F.lit(7)))
    promoted = reasoning.withColumn("_k", tag_key(F.col("tags"))).join(groups.select(F.col("tag_key").alias("_k"), F.lit(True).alias("_g")), "_k", "left")
    return memories, promoted.withColumn("resolution", F.when(live & F.col("_g"), "promoted").otherwise(F.col("resolution"))).select(reasoning.columns)


def cleanup(memories: DataFrame, as_of: str) -> DataFrame:
    """In order: unused for 90 days -> deprecated; confidence decays once in 30 days; active and below the floor -> deprecated."""
    now = F.lit(as_of).cast("timestamp_ntz")
    old = lambda c, days: c < now - F.make_dt_interval(F.lit(days))
    m = memories.withColumn("status", F.when((F.col("status") == "active") & (F.col("access_count") == 0) & old(F.col("created_at"), 90), "deprecated").otherwise(F.col("status")))
    due = (F.col("status") == "active") & old(F.coalesce("last_decayed_at", "created_at"), 30)
    m = m.withColumn("_due", due).withColumns({"confidence": F.when(F.col("_due"), F.round(F.col("confidence") * F.lit(DECAY).cast("decimal(3,2)"), 2).cast("decimal(3,2)")).otherwise(F.col("confidence")), "last_decayed_at": F.when(F.col("_due"), now).otherwise(F.col("last_decayed_at"))})
    low = (F.col("status") == "active") & (F.col("confidence") < F.lit(DEPRECATE_BELOW).cast("decimal(3,2)"))
    return m.withColumn("status", F.when(low, "deprecated").otherwise(F.col("status"))).select(memories.columns)


def drop_expired(sessions: DataFrame, snapshots: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    now = F.lit(as_of).cast("timestamp_ntz")
    return sessions.filter(F.col("last_active") >= now - F.expr("INTERVAL 24 HOURS")), snapshots.filter(F.col("expires_at") >= now)


#: Scopes and categories with more undecided rows than this go in rounds; a block of rows has about so many.
FINISH_ROWS, COMPACT_BLOCK = 5_000, 1_000
_KEYS = ["scope", "category"]


def compact(memories: DataFrame, limit: float = COMPACT_DISTANCE, compat: bool = False, finish_rows: int = FINISH_ROWS, block: int = COMPACT_BLOCK) -> DataFrame:
    """(id, status, superseded_by, supporting_evidence_count) of active memories after a greedy pass per scope and category.

    Rows are led by confidence, then id; each row not yet absorbed absorbs later ones closer than the limit. compat
    stores the leader's evidence plus the last absorbed one's instead of the sum. Rows without a vector are left out.

    The leaders are the lexicographically first independent set, so they can be found in rounds: a row that no earlier
    undecided row is near to leads, and what is near to a leader is decided. Rounds compare blocks of rows, two in a
    task; when a key has at most ``finish_rows`` rows left, one task ends it. Then each absorbed row looks for its first
    leader. Rows with the same vector act as their first one, so copies cost nothing.
    """
    live = memories.filter((F.col("status") == "active") & F.exists("vec", lambda x: x != 0))
    live = written(live.select("id", *_KEYS, F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.col("vec").cast("array<double>").alias("vec"), F.col("supporting_evidence_count").cast("int").alias("n")))
    # the first of equal vectors stands for them
    first = written(live.groupBy(*_KEYS, "vec").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "id")).alias("first")).select(*_KEYS, "vec", (-F.col("first.c")).alias("confidence"), F.col("first.id").alias("id")))
    leaders, left = None, first
    while True:
        sizes = left.groupBy(*_KEYS).agg(F.count("*").alias("size"))
        hot = written(sizes.filter(F.col("size") > finish_rows))
        if not hot.limit(1).count():
            break
        rows = left.join(F.broadcast(hot) if hot.limit(100_001).count() <= 100_000 else hot, _KEYS)
        blocked = _in_blocks(rows, block, _blocked(limit)).select("id").distinct()
        new = written(rows.drop("size").join(blocked, "id", "left_anti"))
        near = _with_leaders(left, new, block, _led(limit)).select("id").distinct()
        leaders = new if leaders is None else written(leaders.unionByName(new))
        left = written(left.join(near, "id", "left_anti").join(new.select("id"), "id", "left_anti"))
    rest = left.groupBy(*_KEYS).applyInPandas(_greedy(limit), left.schema)
    leaders = written(rest if leaders is None else leaders.unionByName(rest))
    led = _with_leaders(first, leaders, block, _led(limit)).groupBy("id").agg(F.min(F.struct("c", "leader")).alias("by")).select(F.col("id").alias("first_id"), F.col("by.leader").alias("leader"))
    led = leaders.select(F.col("id").alias("first_id"), F.col("id").alias("leader")).unionByName(led)
    named = live.join(first.select(*_KEYS, "vec", F.col("id").alias("first_id")), [*_KEYS, "vec"]).join(led, "first_id").select("id", "leader", "confidence", "n")
    named = written(named.withColumn("superseded_by", F.when(F.col("id") != F.col("leader"), F.col("leader"))))
    more = F.max_by("n", F.struct(-F.col("confidence"), "id")) if compat else F.sum("n")
    more = named.filter("superseded_by IS NOT NULL").groupBy(F.col("leader").alias("id")).agg(more.cast("int").alias("more"))
    out = named.join(more, "id", "left").withColumn("supporting_evidence_count", (F.col("n") + F.coalesce("more", F.lit(0))).cast("int"))
    return out.select("id", F.when(F.col("superseded_by").isNull(), "active").otherwise("superseded").alias("status"), "superseded_by", "supporting_evidence_count")


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    v = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _greedy(limit: float):  # noqa: ANN202
    """The leaders of one key, in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "id"], ascending=[False, True], ignore_index=True)
        v, free, chosen = _unit_rows(pdf["vec"]), np.ones(len(pdf), dtype=bool), []
        for i in range(len(pdf)):
            if free[i]:
                chosen.append(i)
                free[i + 1 :] &= 1 - v[i + 1 :] @ v[i] >= limit
        return pdf.iloc[chosen]

    return run


def _in_blocks(rows: DataFrame, block: int, check) -> DataFrame:  # noqa: ANN001
    """check() of each two blocks of a key's rows (size is their number); gives (id)."""
    dealt = rows.withColumn("parts", F.ceil(F.col("size") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"left": F.least("part", "other"), "right": F.greatest("part", "other")})
    return dealt.select(*_KEYS, "left", "right", "id", "confidence", "vec").groupBy(*_KEYS, "left", "right").applyInPandas(check, "id long")


def _blocked(limit: float):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "id"], ascending=[False, True], ignore_index=True)
        v = _unit_rows(pdf["vec"])
        near = np.triu(1 - v @ v.T < limit, 1).any(axis=0)  # an earlier row is near
        return pd.DataFrame({"id": pdf["id"][near]})

    return run


def _with_leaders(rows: DataFrame, leaders: DataFrame, block: int, check) -> DataFrame:  # noqa: ANN001
    """check() of each piece of a key's rows with each block of its leaders; gives (id, c, leader)."""
    count = lambda df, name: df.groupBy(*_KEYS).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    both = written(count(rows, "pieces").join(count(leaders, "blocks"), _KEYS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    cols = [*_KEYS, "piece", "block", "id", "confidence", "vec"]
    left = rows.join(both, _KEYS).withColumn("piece", own("pieces")).withColumn("block", each("blocks")).select(cols)
    right = leaders.join(both, _KEYS).withColumn("block", own("blocks")).withColumn("piece", each("pieces")).select(cols)
    at = [*_KEYS, "piece", "block"]
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(check, "id long, c double, leader long")


def _led(limit: float):  # noqa: ANN202
    """Of each row that is no leader, the first leader of the block that is near."""

    def run(rows: pd.DataFrame, by: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(by):
            return pd.DataFrame({"id": [], "c": [], "leader": []})
        by = by.sort_values(["confidence", "id"], ascending=[False, True], ignore_index=True)
        near = 1 - _unit_rows(rows["vec"]) @ _unit_rows(by["vec"]).T < limit
        own = rows["id"].isin(by["id"]).to_numpy()
        at = np.flatnonzero(near.any(axis=1) & ~own)
        first = near[at].argmax(axis=1)
        return pd.DataFrame({"id": rows["id"].to_numpy()[at], "c": -by["confidence"].to_numpy()[first], "leader": by["id"].to_numpy()[first]})

    return run


def snapshots_due(windows: DataFrame, as_of: str, minutes: int = 30, score: float = 0.3) -> DataFrame:
    """(charger_id, snapshot_type) of chargers with a bad window just now."""
    hot = windows.filter((F.col("window_start") > F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("anomaly_score") > score))
    return hot.select("charger_id").distinct().select("charger_id", F.explode(F.array(*map(F.lit, ("charger_profile", "recent_anomalies", "active_investigations")))).alias("snapshot_type"))


def ref_histogram(rows: DataFrame, refs: str) -> DataFrame:
    """(prefix, n, sample) of references; what is no reference counts under '?'."""
    r = rows.select(F.explode(refs).alias("ref")).withColumn("prefix", F.when(F.col("ref").rlike(REF), F.regexp_extract("ref", r"^([a-z_]+):", 1)).otherwise("?"))
    return r.groupBy("prefix").agg(F.count("*").alias("n"), F.min("ref").alias("sample"))


def rejected_refs(rows: DataFrame, refs: str) -> DataFrame:
    """(ref, n) of values that are no reference, with how often each comes."""
    return rows.select(F.explode(refs).alias("ref")).filter(F.col("ref").isNull() | ~F.col("ref").rlike(REF)).groupBy("ref").agg(F.count("*").alias("n"))


def repair_refs(rows: DataFrame, column: str) -> DataFrame:
    """The column's JSON texts as flat lists of references, with what was found; rows that change are marked."""
    out = rows.withColumn("_f", flatten_refs(F.col(column)))
    return out.withColumns({"refs": F.col("_f.refs"), "recovered": F.col("_f.recovered"), "dropped": F.col("_f.dropped"), "changed": F.coalesce(F.to_json("_f.refs"), F.lit("[]")) != F.coalesce(column, F.lit("[]"))}).drop("_f")


def vector_backlog(rows: DataFrame, vector: str, n: int | None = None, id_col: str = "id") -> DataFrame:
    """Rows without a vector, in order of their id where only n are asked for."""
    todo = rows.filter(F.col(vector).isNull())
    return todo if n is None else todo.orderBy(id_col).limit(n)
