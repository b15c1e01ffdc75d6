"""N-gram Jaccard self-join by MinHash banding.

1. Every text becomes its set of word 5-grams (64-bit hashes), a set digest and ``bands`` band hashes. Bands and rows
   are chosen for the target recall at the threshold.
2. Texts with one set are a class; only its representative goes on, so a thousand copies cost as much as one text.
3. Representatives are shuffled on their band hashes; each bucket links its members to its smallest one, and the
   connected buckets are candidate clusters.
4. Within a cluster all pairs are verified on the full sets. A large cluster is cut into blocks of bounded size and
   every pair of blocks is one task; a task counts links and reports one root for each text, so no pairs are emitted
   however many texts are alike.
5. Verified links give the connected groups.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, chunks, released, small_batches, stored
from .components import components, join_on_hot_keys
from .exact_dedup import groups

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 192
BLOCK_TEXTS, BLOCK_GRAMS = 512, 400_000
CHUNK_CHARS = 500_000
CACHE_WORDS = 100_000
_WORD = re.compile(r"\w+")
_known: dict[str, int] = {}


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with which the bands still reach the recall."""
    best = (1, 1)
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


def _hash(word: str) -> int:
    h = _known.get(word)
    if h is None:
        if len(_known) > CACHE_WORDS:
            _known.clear()
        h = _known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h


def gram_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a shorter text that has words is one gram."""
    out = []
    mix = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, words + 1)], dtype=np.uint64)
    for text in texts:
        h = np.fromiter(map(_hash, _WORD.findall((text or "").lower())), dtype=np.uint64)
        if not len(h):
            out.append(h)
            continue
        n = max(1, len(h) - words + 1)
        s = np.zeros(n, dtype=np.uint64)
        for k in range(min(words, len(h))):
            s += h[k : k + n] * mix[k]
        s ^= s >> np.uint64(29)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(32)
        out.append(np.unique(s))
    return out


def _band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """[texts, bands] of non-empty sets."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    u, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = np.empty((len(sets), bands * rows), dtype=np.uint64)
    buf = np.empty_like(u)
    for k in range(bands * rows):
        np.multiply(u, a[k], out=buf)
        buf += b[k]
        low[:, k] = np.minimum.reduceat(buf, at)
    weights = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
    mixed = (low.reshape(len(sets), bands, rows) * weights).sum(axis=2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(31)
    return (mixed + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(id, digest, check, size, bands) of docs (id, text). The digest is of the whole set."""

    @released
    def sign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(it, "text", CHUNK_CHARS):
            sets = gram_sets(pdf["text"].tolist(), words)
            full = [i for i, s in enumerate(sets) if len(s)]
            band: list = [None] * len(sets)
            if full:
                for i, row in zip(full, _band_hashes([sets[i] for i in full], bands, rows), strict=True):
                    band[i] = row
            raw = [s.tobytes() for s in sets]
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "digest": [xxhash.xxh3_128_digest(r) for r in raw], "check": [xxhash.xxh64_intdigest(r, 1) - (1 << 63) for r in raw], "size": [len(s) for s in sets], "bands": band})
        _known.clear()

    return docs.mapInPandas(sign, "id long, digest binary, check long, size int, bands array<long>")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """[texts, texts] sizes of the common part of each two sets.

    Grams that the same texts have count as one column with a weight, so texts that are alike make few columns.
    """
    m = len(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, who = grams[order], who[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    column = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(grams)))
    mark = np.random.default_rng(3).integers(1, 1 << 63, m, dtype=np.uint64)
    pattern = np.add.reduceat(mark[who], starts)
    shared = np.flatnonzero(sizes > 1)
    total = np.zeros((m, m), dtype=np.float64)
    total[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    if len(shared):
        _, first, weight = np.unique(pattern[shared], return_index=True, return_counts=True)
        first = shared[first]
        off = np.zeros((m, m), dtype=np.float64)
        for k in range(0, len(first), 2048):
            cols, w = first[k : k + 2048], weight[k : k + 2048]
            x = np.zeros((m, len(cols)), dtype=np.float32)
            for j, c in enumerate(cols):
                x[who[starts[c] : starts[c] + sizes[c]], j] = 1
            off += (x * w.astype(np.float32)) @ x.T
        np.fill_diagonal(off, 0)
        total += off
    return total


def _verify(threshold: float):  # noqa: ANN202
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        ids, side, n = pdf["id"].to_numpy(), pdf["part"].to_numpy(), pdf["n"].to_numpy()
        sets = [np.frombuffer(g, dtype=np.uint64) for g in pdf["grams"]]
        both = intersections(sets)
        size = np.array([len(s) for s in sets], dtype=np.float64)
        # the small term keeps a ratio that equals the threshold from falling below it by rounding
        link = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(link, False)
        if pdf["left"].iloc[0] != pdf["right"].iloc[0]:
            link &= side[:, None] != side[None, :]
        root = np.arange(len(ids))
        while True:
            near = np.where(link, root[None, :], len(ids)).min(axis=1, initial=len(ids))
            new = np.minimum(root, near)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"id": ids, "root": ids[root], "links": link @ n, "left": pdf["left"], "right": pdf["right"], "cluster": pdf["cluster"]})

    return block


def _gram_rows(words: int):  # noqa: ANN202
    def make(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(it, "text", CHUNK_CHARS):
            yield pdf.drop(columns="text").assign(grams=[s.tobytes() for s in gram_sets(pdf["text"].tolist(), words)])
        _known.clear()

    return released(make)


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block_texts: int = BLOCK_TEXTS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, set_id, n_links.

    set_id is the smallest identifier with the same n-gram set, class_id the smallest identifier of the group that
    verified links connect, n_links the number of other rows whose similarity is at least the threshold, copies
    included. Null texts and texts without a word have an empty set: copies of one another, linked to nothing else.
    Repeated rows count as copies. Where an identifier is repeated with different texts, each of its rows is judged by its
    own text. Rows without an identifier count as copies in n_links, but are no one's class. Extra columns are not read.
    """
    small_batches(docs.sparkSession)
    bands, rows = bands_and_rows(threshold, recall)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stored(signatures(base, words, bands, rows))
    members = stored(groups(signed, "min", carry=["size", "bands"]))
    several = members.filter("id IS NOT NULL").select("id", "digest").distinct().groupBy("id").count().filter("count > 1")
    if several.limit(1).count():
        return _by_row(base, words, threshold, recall, block_texts)
    reps = members.filter("id = keep_id AND size > 0").dropDuplicates(["id"]).select("id", "n", "size", "bands")
    hashed = reps.select("id", F.explode("bands").alias("band"))
    lead = hashed.groupBy("band").agg(F.min("id").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    edges = join_on_hot_keys(hashed, stored(lead), "band", bands * members.count()).filter("id != lead").select(F.col("id").alias("u"), F.col("lead").alias("v")).distinct()
    cluster = components(edges)
    cluster = stored(cluster.join(reps.select("id", "n", "size"), "id"))
    cut = cluster.groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("grams"))
    cut = cut.select("root", F.ceil(F.greatest(F.col("m") / block_texts, F.col("grams") / BLOCK_GRAMS)).cast("int").alias("parts"))
    placed = stored(cluster.join(cut, "root").select("id", F.col("root").alias("cluster"), "n", "parts", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")))
    found = base.join(broadcast_if_small(placed, 200_000), "id").dropDuplicates(["id"])
    grams = found.mapInPandas(_gram_rows(words), "id long, cluster long, n long, parts int, part int, grams binary")
    grams = grams.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"left": F.least("part", "other"), "right": F.greatest("part", "other")})
    checked = grams.select("id", "cluster", "n", "part", "left", "right", "grams").groupBy("cluster", "left", "right")
    checked = stored(checked.applyInPandas(_verify(threshold), "id long, root long, links long, left int, right int, cluster long"))
    links = checked.groupBy("id").agg(F.sum("links").alias("links"))
    cut_ones = placed.filter("parts > 1").select("id")
    whole = checked.join(cut_ones, "id", "left_anti").select("id", "root")
    joined = components(checked.join(cut_ones, "id", "left_semi").select(F.col("id").alias("u"), F.col("root").alias("v")))
    roots = stored(whole.union(joined).join(links, "id").withColumnRenamed("id", "keep_id"))
    out = members.select("id", "keep_id", "n").join(roots, "keep_id", "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("root", "keep_id").alias("class_id"), F.col("keep_id").alias("set_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def _by_row(base: DataFrame, words: int, threshold: float, recall: float, block_texts: int) -> DataFrame:
    """The join of (id, text) where identifiers are repeated: by numbers of rows, which are translated afterwards."""
    rows = stored(base.withColumn("row", F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())))
    found = stored(jaccard_join(rows, "row", "text", words, threshold, recall, block_texts).withColumnsRenamed({"doc_id": "row", "class_id": "class", "set_id": "set"}))
    named = stored(found.join(rows.select("row", "id"), "row", "left"))
    least = lambda key, name: named.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias(name))
    out = named.join(least("class", "class_id"), "class", "left").join(least("set", "set_id"), "set", "left")
    return out.select(F.col("id").alias("doc_id"), "class_id", "set_id", "n_links")
