"""Every query by name, with the SQL that an independent engine checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import knowledge, ranks, retrieval, streams, upkeep, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
for _m in (windows, ranks, retrieval, knowledge, upkeep, streams):
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)
