"""The corpus pipeline, whose stages are in wattloom.llm.pipeline: language ID, exact dedup, near duplicates, benchmark, tokens."""

from wattloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
