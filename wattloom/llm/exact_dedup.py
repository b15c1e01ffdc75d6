"""Exact deduplication by a tree-merge of sorted digest runs.

Each input partition, a lane, makes sorted runs of its distinct digests, each entry with the identifier to keep and the
number of rows. Lanes then exchange runs along a binomial tree, ``fan_in`` (a power of two) lanes of it at once: the
lane whose number has zeros in the round's bits takes the runs of the lanes that differ from it in these bits only, and
merges them in one multiway merge, until one lane is left. A run travels as one row of sorted arrays. It is cut by the
first bits of the digest into pieces of about RUN_ENTRIES entries, and the pieces of one lane are merged in separate
tasks, so no task and no row grows with the table. An entry is verified at every level: two entries merge only if digest,
a second independent hash and the length all agree. Only digests travel, never texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, released, small_batches, stored

KEY = ["digest", "check", "size"]
RUN_ENTRIES = 65_536
FAN_IN = 8
HOT_ROWS, HOT_GROUPS = 1_000, 10_000
_RUNS = "lane int, piece long, width int, keys binary, ids binary, known binary, n binary"


@dataclass
class Run:
    """Sorted distinct keys (digest, check and size side by side) with the identifier to keep and the number of rows."""

    keys: np.ndarray  # bytes of one width
    ids: np.ndarray
    known: np.ndarray  # whether any row had an identifier
    n: np.ndarray


def merged(runs: list[Run], keep: str) -> Run:
    """One run of several: a stable sort of runs laid end to end merges them, and equal keys fold into one entry."""
    keys, ids, known, n = (np.concatenate([getattr(r, c) for r in runs]) for c in ("keys", "ids", "known", "n"))
    if not len(keys):
        return Run(keys, ids, known, n)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    best = np.maximum if keep == "max" else np.minimum
    return Run(keys[at], best.reduceat(ids[order], at), np.logical_or.reduceat(known[order], at), np.add.reduceat(n[order], at))


def run_of(pdf: pd.DataFrame, keep: str) -> Run:
    """The run of rows (id, digest, check, size); a row without an identifier counts, but is never the one to keep."""
    width = len(pdf["digest"].iloc[0]) if len(pdf) else 1
    parts = [np.frombuffer(b"".join(pdf["digest"]), dtype=np.uint8).reshape(len(pdf), -1 if len(pdf) else width)]
    parts += [pdf[c].to_numpy().astype(">i8").view(np.uint8).reshape(len(pdf), 8) for c in ("check", "size")]
    keys = np.ascontiguousarray(np.hstack(parts)).view(f"S{width + 16}").ravel()
    known = pdf["id"].notna().to_numpy()
    never = np.iinfo(np.int64).min if keep == "max" else np.iinfo(np.int64).max
    ids = np.array([never if x is None or x != x else int(x) for x in pdf["id"].tolist()], dtype=np.int64)
    return merged([Run(keys, ids, known, np.ones(len(pdf), dtype=np.int64))], keep)


def pieces(run: Run, lane: int, bits: int) -> pd.DataFrame:
    """A run as rows, one for each value that the first ``bits`` bits of its digests have."""
    first = np.frombuffer(run.keys.tobytes(), dtype=np.uint8).reshape(len(run.keys), -1)[:, :8].copy().view(">u8").ravel().astype(np.uint64)
    piece = first >> np.uint64(64 - bits) if bits else np.zeros(len(first), dtype=np.uint64)
    cuts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(piece) else []
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(piece)], strict=True):
        rows.append((lane, int(piece[a]), run.keys.itemsize, run.keys[a:b].tobytes(), run.ids[a:b].tobytes(), run.known[a:b].tobytes(), run.n[a:b].tobytes()))
    return pd.DataFrame(rows, columns=["lane", "piece", "width", "keys", "ids", "known", "n"])


def read_runs(pdf: pd.DataFrame) -> list[Run]:
    cols = zip(pdf["width"], pdf["keys"], pdf["ids"], pdf["known"], pdf["n"], strict=True)
    return [Run(np.frombuffer(k, dtype=f"S{w}"), np.frombuffer(i, dtype=np.int64), np.frombuffer(h, dtype=bool), np.frombuffer(n, dtype=np.int64)) for w, k, i, h, n in cols]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, check, size): null text counts as empty, letters A-Z are lower-cased and nothing else is changed."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("norm"))
    return rows.select("id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("check"), F.length("norm").alias("size"))


def tree_merge(rows: DataFrame, keep: str = "min", fan_in: int = FAN_IN, least: int = 1, run_entries: int = RUN_ENTRIES) -> DataFrame:
    """One entry per digest that ``least`` rows have, at least: (digest, check, size, keep_id, n).

    The smallest identifier is kept, or the largest. rows (id, digest, check, size) is read twice, so it should be a
    stored table. Each round folds an entry before it is sent, so a group of copies costs one entry per run however
    large it is.
    """
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in is a power of two")
    small_batches(rows.sparkSession, rows=20_000)
    by_lane = rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
    sizes = by_lane.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    most, everything = sizes["most"] or 0, sizes["all"] or 0
    lanes, rounds = max(1, rows.rdd.getNumPartitions()), 0
    width = int(math.log2(fan_in))

    def bits(level: int) -> int:
        """Of the digest, to cut the run that a lane can have after so many rounds into pieces."""
        entries = min(everything, most * fan_in**level)
        return max(0, math.ceil(math.log2(max(1, entries / run_entries))))

    @released
    def make(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, runs, held = TaskContext.get().partitionId(), [], 0
        for pdf in it:
            runs.append(run_of(pdf, keep))
            held += len(runs[-1].keys)
            if held >= run_entries:  # a long partition gives several runs
                yield pieces(merged(runs, keep), lane, bits(1))
                runs, held = [], 0
        if held:
            yield pieces(merged(runs, keep), lane, bits(1))

    def merge(level: int):  # noqa: ANN202
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            return pieces(merged(read_runs(pdf), keep), int(pdf["lane"].iloc[0]) >> (width * level) << (width * level), bits(level + 1))

        return one

    runs = rows.select("id", *KEY).mapInPandas(make, _RUNS)
    while rounds == 0 or lanes > 1:
        rounds, lanes = rounds + 1, math.ceil(lanes / fan_in)
        parent = F.shiftright(F.col("lane"), width * rounds)  # the lane with zeros in this round's bits and those before
        runs = runs.groupBy(parent.alias("parent"), "piece").applyInPandas(merge(rounds), _RUNS)
    return runs.mapInPandas(_entries(least), "digest binary, check long, size long, keep_id long, n long")


def _entries(least: int):  # noqa: ANN202
    def read(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for run in read_runs(pdf):
                at = np.flatnonzero(run.n >= least)
                raw = np.frombuffer(run.keys.tobytes(), dtype=np.uint8).reshape(len(run.keys), -1)[at]
                number = lambda a, b, raw=raw: np.ascontiguousarray(raw[:, a:b]).view(">i8").ravel().astype(np.int64)
                end = raw.shape[1]
                keep_id = pd.array(run.ids[at], dtype="Int64")
                keep_id[~run.known[at]] = pd.NA
                yield pd.DataFrame({"digest": [x.tobytes() for x in raw[:, : end - 16]], "check": number(end - 16, end - 8), "size": number(end - 8, end), "keep_id": keep_id, "n": run.n[at]})

    return released(read)


def groups(rows: DataFrame, keep: str = "min", hot_groups: int = HOT_GROUPS, carry: list[str] | None = None) -> DataFrame:
    """Per row of ``rows``: id, digest, keep_id, n and the columns in ``carry``.

    Rows without a copy need no partner. Of the rest, at most ``hot_groups`` of the largest groups (of HOT_ROWS rows or
    more) are broadcast, and their rows leave the join by a salted key; all other groups, each with less than one row in
    ``hot_groups``, meet their rows in a shuffled join.
    """
    copied = stored(tree_merge(rows, keep, least=2))
    hot = copied.filter(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "digest").limit(hot_groups)
    cold = copied.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti").withColumn("salt", F.lit(0).cast("long"))
    hot = hot.withColumnsRenamed({"keep_id": "hot_id", "n": "hot_n"})
    dealt = rows.join(F.broadcast(hot), KEY, "left").withColumn("salt", F.when(F.col("hot_n").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(4096))))
    found = dealt.join(cold, [*KEY, "salt"], "left")
    return found.select("id", "digest", F.coalesce("hot_id", "keep_id", "id").alias("keep_id"), F.coalesce("hot_n", "n", F.lit(1)).cast("long").alias("n"), *(carry or []))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Identifiers are integers. Null text counts as empty, so all null and empty texts are one group; texts of any length
    are hashed whole. Rows that repeat an identifier count in group_size each; where such an identifier is kept, each of
    its rows is marked kept (a caller that filters rows drops repeated identifiers afterwards). A row without an
    identifier counts, but another is kept where there is one. An empty table gives an empty result. Extra columns are
    not read.
    """
    rows = stored(digests(docs, id_col, text_col))
    return groups(rows, keep).select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
