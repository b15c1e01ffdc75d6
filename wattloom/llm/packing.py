"""Packing of documents into windows of tokens by non-negative least squares over length combinations.

1. Every document becomes token ids and an end token. What fills whole windows is cut off its front; its rest, shorter
   than a window, is what has to be combined. Ids are written once, each row with its place among the rests of its
   length in its partition (its lane), so that lane totals give every rest a number among all rests of its length.
2. The histogram of rests, at most one row a length, goes to the driver. All combinations of two or three lengths that
   fill a window exactly are enumerated; non-negative least squares solves how often each is repeated, and the numbers
   are rounded down. A basic solution has at most as many combinations as there are lengths.
3. Residual rests are packed greedily, longest first, and cut where nothing fits, so that windows are full; what is left
   in the end is less than a window, and fills sequences of powers of two.
4. The plan says by length and number where a rest goes. It has a few thousand lines, whatever the number of documents,
   and every worker places its rows by it: no document meets another one.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, chunks, released, small_batches, stored

WINDOW, END, DEPTH = 1024, 0, 3
CHUNK_CHARS = 1_000_000
MOST_BROADCAST_LANES = 2_000
#: Of the solver: combinations added at once, and rounds after which it stops with what it has (the rest is residual).
ADDED, MOST_ROUNDS = 256, 200


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file; special strings are ordinary text."""
    import public_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def combinations(window: int, depth: int = DEPTH) -> np.ndarray:
    """[combinations, 3]: all two and, at depth 3, three lengths in ascending order that fill a window; 0 is no length."""
    if depth not in (2, 3):
        raise ValueError("combinations have two or three lengths")
    a = np.arange(1, window // 2 + 1)
    found = [np.stack([np.zeros_like(a), a, window - a], axis=1)]
    if depth == 3:
        for first in range(1, window // 3 + 1):
            b = np.arange(first, (window - first) // 2 + 1)
            found.append(np.stack([np.full_like(b, first), b, window - first - b], axis=1))
    return np.concatenate(found)


def nnls(columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chosen columns, repeats >= 0) that come nearest to the counts by length, by the active-set method.

    A column counts each of its lengths. Columns enter by their gradient, up to ADDED at once that share no length; those
    that the least squares make negative leave.
    """
    size = len(counts)
    target = counts.astype(float)
    target[0] = 0
    chosen, x, left = np.zeros(0, dtype=int), np.zeros(0), target.copy()
    dense = np.zeros((size, 0))
    added, tolerance = ADDED, max(0.5, 1e-6 * target.max(initial=0))  # counts are whole
    for _ in range(MOST_ROUNDS):
        gain = left[columns].sum(axis=1)
        gain[chosen] = 0
        best = np.flatnonzero(gain > tolerance)
        best = best[np.argsort(-gain[best], kind="stable")[: 64 * added]]
        taken, new = np.zeros(size, dtype=bool), []
        for c in best:
            lengths = columns[c][columns[c] > 0]
            if not taken[lengths].any():
                taken[lengths] = True
                new.append(c)
                if len(new) == added:
                    break
        if not new:
            break
        more = np.zeros((size, len(new)))
        for j, c in enumerate(new):
            np.add.at(more[:, j], columns[c][columns[c] > 0], 1)
        chosen, x, dense = np.append(chosen, new), np.append(x, np.zeros(len(new))), np.hstack([dense, more])
        square = dense.T @ dense
        while len(chosen):
            solved = np.linalg.solve(square + 1e-9 * np.eye(len(chosen)), dense.T @ target)
            if (solved > 0).all():
                x = solved
                break
            low = solved <= 0
            step = np.min(x[low] / np.maximum(x[low] - solved[low], 1e-300))
            x = x + step * (solved - x)
            stay = ~(low & (x <= 1e-9))
            chosen, x, dense, square = chosen[stay], np.maximum(x[stay], 0), dense[:, stay], square[np.ix_(stay, stay)]
        now = target - dense @ x
        stuck = now @ now >= (left @ left) * (1 - 1e-12)
        left = now
        if stuck:
            if added == 1:
                break
            added = 1  # one at a time always improves
    return chosen, x


@dataclass
class Plan:
    """Where rests go: the pieces (length, lo, hi, start, size, sequence, offset, filled) of all rests by their length.

    The rests lo to hi of a length have ``size`` ids from ``start`` on in sequences from ``sequence`` on, at ``offset``;
    the sequence has ``filled`` tokens.
    """

    window: int
    rows: list[tuple[int, ...]] = field(default_factory=list)
    sequences: int = 0
    full: int = 0  # sequences that the solved combinations fill
    cut: int = 0  # rests that are cut

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The pieces sorted by length, start and number, and the first row of each length."""
        rows = np.array(sorted(self.rows, key=lambda r: (r[0], r[3], r[1])), dtype=np.int64).reshape(-1, 8)
        return rows, np.searchsorted(rows[:, 0], np.arange(self.window + 1))


def plan(counts: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> Plan:
    """The plan for ``counts``, the number of rests of each length below the window. Every rest is placed whole."""
    out = Plan(window)
    left = counts.astype(np.int64).copy()
    left[0] = 0
    next_of = np.zeros(window, dtype=np.int64)
    columns = combinations(window, depth)
    columns = columns[((columns == 0) | (left[columns] > 0)).all(axis=1)]  # of lengths that there are
    chosen, repeats = nnls(columns, left)
    for k in np.argsort(-repeats, kind="stable"):
        lengths, times = np.unique(columns[chosen[k]][columns[chosen[k]] > 0], return_counts=True)
        n = int(min(np.floor(repeats[k] + 1e-6), (left[lengths] // times).min()))
        if n <= 0:
            continue
        offset = 0
        for length, t in zip(lengths.tolist(), times.tolist(), strict=True):
            for _ in range(t):
                out.rows.append((length, int(next_of[length]), int(next_of[length]) + n, 0, length, out.sequences, offset, window))
                next_of[length] += n
                left[length] -= n
                offset += length
        out.sequences += n
    out.full = out.sequences
    _residuals(out, left, next_of)
    return out


def _residuals(out: Plan, left: np.ndarray, next_of: np.ndarray) -> None:
    """Packs what is left: runs (length, start, lo, n) of rests by the size that is still to be placed."""
    window = out.window
    runs: list[deque] = [deque() for _ in range(window)]
    for length in np.flatnonzero(left).tolist():
        runs[length].append((length, 0, int(next_of[length]), int(left[length])))

    def place(size: int, n: int, part: int, offset: int, filled: int) -> None:
        """The first ``part`` tokens of n runs of a size go to the next n sequences; what they have more goes back."""
        left[size] -= n
        at, back = out.sequences, []
        while n:
            length, start, lo, m = runs[size].popleft()
            t = min(m, n)
            if t < m:
                runs[size].appendleft((length, start, lo + t, m - t))
            out.rows.append((length, lo, lo + t, start, part, at, offset, filled))
            at, n = at + t, n - t
            if part < size:
                back.append((length, start + part, lo, t))
                out.cut += t
        for run in back:
            runs[size - part].append(run)
            left[size - part] += run[3]

    sizes = np.arange(window)
    total = int((left * sizes).sum())
    while total >= window:
        space, used, parts = window, {}, []
        while space:
            there = left.copy()
            for size, k in used.items():
                there[size] -= k
            there = np.flatnonzero(there > 0)
            fits = there[there <= space]
            size = int(fits[-1] if len(fits) else there[-1])
            k = max(1, min(space // size, int(left[size]) - used.get(size, 0)))
            used[size] = used.get(size, 0) + k
            parts += [(size, min(size, space))] * k
            space -= min(size * k, space)
        n = int(min(left[size] // k for size, k in used.items()))
        offset = 0
        for size, part in parts:
            place(size, n, part, offset, window)
            offset += part
        out.sequences += n
        total -= n * window
    while total:  # less than a window: powers of two need no padding
        filled, offset = 1 << (total.bit_length() - 1), 0
        while offset < filled:
            size = int(np.flatnonzero(left > 0)[-1])
            part = min(size, filled - offset)
            place(size, 1, part, offset, filled)
            offset += part
        out.sequences += 1
        total -= filled


def _encoded(path: str, window: int, end: int):  # noqa: ANN202
    def make(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, lane = encoding(path).encode_ordinary, TaskContext.get().partitionId()
        seen, full = np.zeros(window, dtype=np.int64), 0
        for pdf in chunks(it, "text", CHUNK_CHARS):
            rows = []
            for text in pdf["text"]:
                ids = encode(text or "")
                ids.append(end)
                whole, rest = divmod(len(ids), window)
                rows.append((np.array(ids, dtype="<u4").tobytes(), len(ids), lane, rest, int(seen[rest]), full))
                seen[rest] += 1
                full += whole
            out = pd.DataFrame(rows, columns=["ids", "n", "lane", "rest", "rank", "full"])
            yield out.assign(id=pdf["id"].to_numpy())

    return released(make)


def _placed(found: Plan, window: int):  # noqa: ANN202
    rows, first = found.table()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]

    def make(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for doc, raw, n, rest, number, full in zip(batch["id"].tolist(), batch["ids"], batch["n"].tolist(), batch["rest"].tolist(), batch["number"].tolist(), batch["full"].tolist(), strict=True):
                whole = n - rest
                out += [(doc, a, window, raw[4 * a : 4 * (a + window)], n, found.sequences + full + a // window, 0, window) for a in range(0, whole, window)]
                if rest:
                    of = rows[first[rest] : first[rest + 1]]
                    for _, _lo, _hi, start, size, sequence, offset, filled in of[(of[:, 1] <= number) & (number < of[:, 2])].tolist():
                        a = whole + start
                        out.append((doc, a, size, raw[4 * a : 4 * (a + size)], n, sequence + number - _lo, offset, filled))
            made = pd.DataFrame(out, columns=names)
            yield made.assign(doc_id=pd.array([None if d is None or d != d else int(d) for d in made["doc_id"]], dtype="Int64"))

    return released(make)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, depth: int = DEPTH, end: int = END) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset, sequence_tokens.

    ids are little-endian unsigned 32-bit numbers, those of the document from ``start`` on; the last of a document is the
    end token. Every row is a document, also repeated ones and those without an identifier; null and empty texts have the
    end token alone. Texts of any length are encoded whole. An empty table has no pieces. Sequences have ``window``
    tokens, but for at most ten whose tokens are a power of two. Extra columns are not read.
    """
    small_batches(docs.sparkSession, rows=1_000)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = stored(base.mapInPandas(_encoded(tokenizer or default_tokenizer(), window, end), "ids binary, n long, lane int, rest int, rank long, full long, id long"))
    both = F.array(F.struct(F.col("rest").alias("length"), F.lit(1).cast("long").alias("k")), F.struct(F.lit(window).alias("length"), F.expr(f"n div {window}").alias("k")))
    by_lane = stored(made.select("lane", F.inline(both)).filter("length > 0 AND k > 0").groupBy("lane", "length").agg(F.sum("k").alias("k")))
    counts = np.zeros(window, dtype=np.int64)
    for r in by_lane.filter(F.col("length") < window).groupBy("length").agg(F.sum("k").alias("k")).collect():  # at most one row a length
        counts[r.length] = r.k
    found = plan(counts, window, depth)
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    before = by_lane.select("lane", "length", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k"))
    lanes = stored(before.groupBy("lane").agg(F.map_from_entries(F.collect_list(F.struct("length", "k"))).alias("before")))
    number = lambda length, own: F.coalesce(F.get(F.map_values(F.map_filter("before", lambda k, _: k == length)), F.lit(0)), F.lit(0)) + F.col(own)
    rows = made.join(broadcast_if_small(lanes, MOST_BROADCAST_LANES), "lane", "left")
    rows = rows.select("id", "ids", "n", "rest", number(F.col("rest"), "rank").alias("number"), number(F.lit(window), "full").alias("full"))
    return rows.mapInPandas(_placed(found, window), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long")


def pack_digests(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The pieces of pack() with a checksum in place of their ids."""
    return pack(docs, **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")
