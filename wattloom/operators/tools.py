"""A facade with one method per tool; failures come back as data."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.scalars import extract_keywords
from . import context, lifecycle, memory, ranking, retrieval, sessions

OUTCOMES = ("fixed", "different_fault", "no_fault_found")


def safe(f: Callable) -> Callable:
    @functools.wraps(f)
    def run(*args: object, **kw: object) -> object:
        try:
            return f(*args, **kw)
        except Exception as e:  # noqa: BLE001  a tool's caller gets errors as data
            return {"error": type(e).__name__, "message": str(e)[:500]}

    return run


class Tools:
    """Tables by name; each method returns DataFrames, or a mapping with an error."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]) -> None:
        self.spark, self.t = spark, dict(tables)

    def call(self, name: str, **kw: object) -> object:
        tool = getattr(self, name, None)
        if name.startswith("_") or name == "call" or tool is None:
            return {"error": "unknown_tool", "message": name}
        return safe(tool)(**kw)

    def search_similar_outages(self, queries: DataFrame, severity: str | None = None, category: str | None = None, k: int = 5) -> DataFrame:
        retrieval.check_searchable("outage_catalog", "signature_vec", "root_cause")
        return retrieval.hybrid(retrieval.optional(self.t["outage_catalog"], severity=severity, category=category), queries, k, "signature_vec", "root_cause")

    def outages_like_windows(self, windows: DataFrame, k: int = 5, **filters: str | None) -> DataFrame:
        """Outages like the windows named by windows (charger_id, window_start): loaded, put into words and embedded."""
        w = self.t["charger_windows"].join(windows.select("charger_id", "window_start"), ["charger_id", "window_start"], "left_semi")
        size = len(self.t["outage_catalog"].filter("signature_vec IS NOT NULL").select("signature_vec").first()[0])
        queries = w.select(F.concat("charger_id", F.lit(" "), F.col("window_start").cast("string")).alias("query_id"), texts.window_text().alias("text"))
        queries = queries.select("query_id", retrieval.embed(F.col("text"), size=size).cast("array<double>").alias("query_vec"), extract_keywords(F.col("text")).alias("keywords"))
        return self.search_similar_outages(queries, k=k, **filters)

    def search_prior_diagnoses(self, queries: DataFrame, charger_id: str | None = None, resolution: str | None = None, k: int = 5) -> DataFrame:
        retrieval.check_searchable("agent_reasoning", "reasoning_vec")
        live = self.t["agent_reasoning"].filter("superseded_by IS NULL")
        return retrieval.nearest(retrieval.optional(live, charger_id=charger_id, resolution=resolution), queries, k, "reasoning_vec")

    def recall_fleet_memory(self, queries: DataFrame, as_of: str, scope: str = "any", category: str | None = None, k: int = 5) -> DataFrame:
        """The memories found; each is counted and dated as accessed in the table."""
        retrieval.check_searchable("fleet_memory", "memory_vec", "content")
        live = retrieval.optional(retrieval.in_scope(self.t["fleet_memory"].filter("status = 'active'"), scope), category=category)
        found = retrieval.boost_scope(retrieval.hybrid(live, queries, k, "memory_vec", "content"), scope)
        self.t["fleet_memory"] = retrieval.touch(self.t["fleet_memory"], found, as_of)
        return found

    def get_recent_windows(self, charger_id: str, as_of: str, hours: int = 24, anomalous: bool = False) -> DataFrame:
        w = self.t["charger_windows"].filter((F.col("charger_id") == charger_id) & (F.col("window_start") > F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))))
        return (w.filter("anomaly_score > 0") if anomalous else w).orderBy(F.desc("window_start"))

    def verify_outcome(self, outcomes: DataFrame) -> DataFrame:
        bad = outcomes.filter(~F.col("outcome").isin(*OUTCOMES)).limit(1).count()
        if bad:
            raise ValueError(f"outcome must be one of {OUTCOMES}")
        self.t["agent_reasoning"], self.t["fleet_memory"], report = memory.apply_outcomes(self.t["agent_reasoning"], self.t["fleet_memory"], outcomes)
        return report

    def write_reasoning_checkpoint(self, new: DataFrame, as_of: str, known: dict[str, DataFrame] | None = None) -> dict[str, DataFrame | None]:
        self.t["agent_reasoning"], quarantined = memory.write_checkpoints(self.t["agent_reasoning"], new, as_of, known)
        return {"agent_reasoning": self.t["agent_reasoning"], "quarantined": quarantined}

    def write_fleet_memory(self, new: DataFrame) -> DataFrame:
        plain = lambda t: t.withColumnRenamed("memory_vec", "vec")
        done = memory.write_memories(plain(self.t["fleet_memory"]), plain(new), self.t.get("agent_reasoning")).withColumnRenamed("vec", "memory_vec")
        self.t["fleet_memory"] = done.drop("action")
        return done

    def link_memory(self, links: DataFrame) -> DataFrame:
        report = memory.already_linked(self.t["fleet_memory"], links)
        self.t["fleet_memory"] = memory.link(self.t["fleet_memory"], links)
        return report

    def get_charger_context(self, wanted: DataFrame, built: DataFrame, as_of: str) -> DataFrame:
        self.t["context_snapshots"], served = sessions.charger_context(self.t["context_snapshots"], wanted, built, as_of)
        return served

    def get_session_state(self, wanted: DataFrame, as_of: str) -> DataFrame:
        self.t["session_state"], rows = sessions.get_sessions(self.t["session_state"], wanted, as_of)
        return rows

    def update_session_state(self, updates: DataFrame, as_of: str) -> DataFrame:
        self.t["session_state"], report = sessions.update_sessions(self.t["session_state"], updates, as_of)
        return report

    def top_anomalous_chargers(self, n: int = 5, exact: bool = True) -> DataFrame:
        return ranking.top_entities(self.t["charger_windows"], n, exact)

    def run_maintenance(self, as_of: str) -> DataFrame:
        self.t["fleet_memory"] = lifecycle.cleanup(self.t["fleet_memory"], as_of)
        return self.t["fleet_memory"]

    def stage_routing(self, matches: DataFrame, keys: list[str]) -> DataFrame:
        return context.stage_routing(matches, keys)
