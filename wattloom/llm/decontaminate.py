"""Benchmark decontamination by spaced-seed hashing.

A mask such as 11010111 hashes the tokens under its ones and ignores those under its zeros, so a substituted token
under a zero, or outside the mask, does not break the hit. Hashes of every position of every document meet those of
every benchmark position by a hash join; at each hit every aligned window of WINDOW tokens that holds it is compared
token by token, and the pair counts where at least SHARE of them agree (the whole item where it is shorter than the
window). The masks leave no two substitutions in a window without a hit. An item shorter than the window meets
documents by the run of tokens that must be intact in it. DataFrame functions only; documents are never shuffled, only
verified pairs are.

The benchmark is the stated query set. Its items are cut into pieces of PIECE_TOKENS tokens, which overlap so that every
window lies in one, and joined in blocks of about BLOCK_TOKENS tokens: of a block, one narrow row for each seed and one
row for each piece are broadcast. The blocks are counted, and cut again until none is over twice that size, so what is
broadcast has a fixed bound however large the benchmark or one of its items is.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Care (1) and ignored (0) token positions.
MASKS = ("1101011", "11101001")
WINDOW, SHARE = 13, 0.8
PIECE_TOKENS, BLOCK_TOKENS = 1_000, 200_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def intact(length: int) -> str:
    """The mask of the run of tokens that agrees in an item of so many tokens, wherever its substitutions are."""
    need = math.ceil(SHARE * length)
    return "1" * -(-need // (length - need + 1))


def seeds(h: Column, masks: Iterable[str] = MASKS) -> Column:
    """array<struct<seed, pos>> (pos from 0) of every mask at every position that the mask fits."""
    n = F.size(h)

    def of(mask: str) -> Column:
        ones = [i for i, c in enumerate(mask) if c == "1"]
        at = lambda i: F.xxhash64(F.lit(mask), *[F.get(h, i + F.lit(o)) for o in ones])
        last = n - F.lit(len(mask))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(at(i).alias("seed"), i.alias("pos")))).otherwise(F.array().cast("array<struct<seed:bigint,pos:int>>"))

    return F.concat(F.array().cast("array<struct<seed:bigint,pos:int>>"), *[of(m) for m in masks])


def _most_matches(first: Column, last: Column, length: Column) -> Column:
    """The most agreeing tokens in a window of ``length`` that begins at one of the item's tokens first to last."""
    n = last - first + length
    a, b = F.slice("item_h", first + 1, n), F.slice("doc_h", first + F.col("shift") + 1, n)
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.array_max(F.transform(F.sequence(F.lit(1), last - first + 1), lambda k: F.aggregate(F.slice(same, k, length), F.lit(0), lambda s, x: s + x)))


def pieces(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item_id, length, item_h, key) of the items that have tokens: length is that of the item's window."""
    items = benchmark.select(F.col(item_col).alias("item_id"), hashes(tokens(F.col(item_text))).alias("h")).filter(F.size("h") > 0)
    last = F.greatest(F.lit(0), F.floor((F.size("h") - WINDOW) / PIECE_TOKENS)).cast("int")
    items = items.select("item_id", "h", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    cut = items.select("item_id", F.least(F.size("h"), F.lit(WINDOW)).alias("length"), F.slice("h", F.col("k") * PIECE_TOKENS + 1, F.lit(PIECE_TOKENS + WINDOW - 1)).alias("item_h"))
    return cut.withColumn("key", F.xxhash64("item_id", "item_h")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified pairs (doc_id, item_id, matched): matched is the largest number of agreeing tokens in one window.

    Null and empty texts and items have no seeds and match nothing. Items shorter than the window match as a whole.
    Repeated rows of one identifier give one pair, with the best of their windows; ties between windows make no
    difference. Texts and items of any length are read whole. Extra columns are not read. An empty benchmark or an empty
    table gives an empty result.
    """
    items = stored(pieces(benchmark, item_col, item_text))
    lengths = [r["length"] for r in items.select("length").distinct().collect()]  # at most WINDOW values
    masks_of = {n: MASKS if n == WINDOW else (intact(n),) for n in sorted(lengths)}
    item_seeds = seeds(F.col("item_h"), ())
    for n, masks in masks_of.items():
        item_seeds = F.when(F.col("length") == n, seeds(F.col("item_h"), masks)).otherwise(item_seeds)
    blocks = _blocks(items)
    d = docs.select(F.col(id_col).alias("doc_id"), hashes(tokens(F.col(text_col))).alias("doc_h"))
    d = d if blocks == 1 else stored(d)  # each block reads the hashes again, not the texts
    d = d.select("doc_id", "doc_h", F.explode(seeds(F.col("doc_h"), sorted({m for masks in masks_of.values() for m in masks}))).alias("s")).select("doc_id", "doc_h", F.col("s.seed").alias("seed"), F.col("s.pos").alias("doc_pos"))
    parts = []
    for k in range(blocks):
        own = items if blocks == 1 else items.filter(_block(blocks) == k)
        b = own.select("key", F.explode(item_seeds).alias("s")).select("key", F.col("s.seed").alias("seed"), F.col("s.pos").alias("item_pos"))
        parts.append(_verified(d.join(F.broadcast(b), "seed").join(F.broadcast(own), "key")))
    pairs = reduce(DataFrame.unionByName, parts)
    return pairs.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("key", F.lit("block")), F.lit(blocks))


def _blocks(items: DataFrame) -> int:
    """The number of blocks with which none has more than twice BLOCK_TOKENS tokens."""
    all_tokens = items.agg(F.sum(F.size("item_h"))).first()[0] or 0
    blocks = max(1, math.ceil(all_tokens / BLOCK_TOKENS))
    while blocks > 1:
        most = items.groupBy(_block(blocks).alias("k")).agg(F.sum(F.size("item_h")).alias("n")).agg(F.max("n")).first()[0]
        if most <= max(2 * BLOCK_TOKENS, 2 * (PIECE_TOKENS + WINDOW)):
            break
        blocks *= 2
    return blocks


def _verified(hits: DataFrame) -> DataFrame:
    """The windows that hold a hit, from the one ending with it to the one beginning at it, inside what both texts have."""
    hits = hits.withColumn("shift", F.col("doc_pos") - F.col("item_pos"))
    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.size("item_h"), F.size("doc_h") - F.col("shift"))
    hits = hits.withColumn("low", low).withColumn("high", high).filter(F.col("high") - F.col("low") >= F.col("length"))
    inside = lambda start: F.greatest(F.col("low"), F.least(start, F.col("high") - F.col("length")))
    span = min(map(len, MASKS))
    best = _most_matches(inside(F.col("item_pos") + F.lit(span) - F.col("length")), inside(F.col("item_pos")), F.col("length"))
    hits = hits.select("doc_id", "item_id", "length", best.alias("matched"))
    return hits.filter(F.col("matched") >= F.ceil(F.lit(SHARE) * F.col("length"))).select("doc_id", "item_id", "matched")
