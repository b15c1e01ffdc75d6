"""Session state and cached context snapshots, as functions from old tables to new ones at an explicit time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_tokens

TOKEN_BUDGET, SNAPSHOT_MINUTES = 4000, 30
STATE = "session_id string, user_id string, focus_chargers array<string>, focus_site string, investigation_summary string, token_budget int, tokens_used long, last_active timestamp_ntz"
UPDATABLE = ("focus_chargers", "focus_site", "investigation_summary", "tokens_used")


def _fresh(sessions: DataFrame, as_of: str) -> DataFrame:
    """New sessions (session_id and any columns of STATE) with the defaults for what is missing or null."""
    default = {"token_budget": F.lit(TOKEN_BUDGET), "tokens_used": F.lit(0), "last_active": F.lit(as_of)}
    cols = []
    for field in STATE.split(", "):
        name, kind = field.split(" ", 1)
        value = F.col(name) if name in sessions.columns else F.lit(None)
        cols.append(F.coalesce(value, default.get(name, F.lit(None))).cast(kind).alias(name))
    return sessions.select(*cols)


def get_sessions(state: DataFrame, wanted: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(state, rows) for wanted (session_id, user_id): a session that isn't there is made with the defaults.

    Of several wanted rows of one session the alphabetically first user counts.
    """
    one = wanted.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.min("user_id").alias("user_id"))
    new = _fresh(one.join(state.select("session_id"), "session_id", "left_anti"), as_of)
    state = state.unionByName(new)
    return state, state.join(one.select("session_id"), "session_id", "left_semi")


def update_sessions(state: DataFrame, updates: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(state, report) for updates (session_id and any of UPDATABLE; null: not given; one row a session).

    A session that isn't there is made. Reported are ``updated``, or ``no_changes`` where nothing was given.
    """
    have = [c for c in UPDATABLE if c in updates.columns]
    given = F.greatest(F.lit(False), *[F.col(c).isNotNull() for c in have]) if have else F.lit(False)
    real = updates.filter(given).select("session_id", *have)
    old = state.join(real.select("session_id", *[F.col(c).alias(f"_{c}") for c in have]), "session_id", "left")
    old = old.withColumns({c: F.coalesce(f"_{c}", c) for c in have}).select(state.columns)
    new = _fresh(real.join(state.select("session_id"), "session_id", "left_anti"), as_of)
    return old.unionByName(new), updates.select("session_id", F.when(given, "updated").otherwise("no_changes").alias("status"))


def charger_context(cache: DataFrame, wanted: DataFrame, built: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(cache, served) for wanted (entity_id, snapshot_type).

    cache (entity_id, snapshot_type, content, token_count, expires_at, is_stale) has one row a key. What has not expired
    is served as it is, stale or not; else what ``built`` (entity_id, snapshot_type, content) has for it, which the cache
    then keeps for SNAPSHOT_MINUTES. Nothing is served of what neither has.
    """
    key = ["entity_id", "snapshot_type"]
    now = F.lit(as_of).cast("timestamp_ntz")
    wanted = wanted.select(key).distinct()
    live = cache.filter(F.col("expires_at") > now).join(wanted, key, "left_semi")
    missing = wanted.join(live.select(key), key, "left_anti")
    made = built.filter("content IS NOT NULL").join(missing, key, "left_semi")
    made = made.select(*key, "content", count_tokens(F.col("content")).cast("int").alias("token_count"), (now + F.make_dt_interval(mins=F.lit(SNAPSHOT_MINUTES))).alias("expires_at"), F.lit(False).alias("is_stale"))
    return cache.join(made.select(key), key, "left_anti").unionByName(made), live.select(made.columns).unionByName(made)
