"""Phrase collocation mining on a minimal perfect hash.

1. The words of all texts are counted. Then texts become runs: codes of words in a vocabulary of the run, where frequent
   words stand by numbers in a broadcast table. Only frequent words next to each other are kept; what lies between is a break.
2. A phrase can only be frequent if its parts are. So for pairs of frequent words, and then for longer phrases whose
   pairs are all frequent, mappers count hashed buckets; only phrases in a bucket that reaches the threshold are
   candidates, and no frequent phrase is missed.
3. A minimal perfect hash gives every candidate a slot, in rounds of at most ``most_slots`` candidates. It also gives
   slots to phrases that are no candidates, so the key stored there, 128 bits, is compared. Mappers count slots in numpy
   arrays, which are summed up along a tree in blocks, so that no task holds an array of all of them.
4. Every part of a frequent phrase is frequent and has a slot itself: the counts of the two parts of each cut are read by
   slot. Scores are exact decimals.

Broadcast are bit maps (at most 2 ** MOST_BITS bits, of frequent parts and heavy buckets), the hash of one round and that of
the numbered words; with fuller maps more candidates pass and more rounds follow, with more frequent words than a round has
slots the rest stand by their hashes; the result is the same. Counts and candidates are shuffled compressed.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, chunks, few_rows_read, released, small_batches, stored

LEAST, MOST_WORDS, MOST_RANK = 100, 5, 2000
#: Characters that end a piece.
BREAKS = ".,;:!?\n\x0b\x0c\r"
CHUNK_CHARS = 2_000_000
#: Words of one row of the list of words, tokens of one run, and runs that are read at once: rows stay well below 1 MB.
LIST_WORDS, RUN_TOKENS, RUNS_READ = 8_192, 60_000, 16
MOST_SLOTS, MOST_BITS, BLOCK_BITS = 4_000_000, 28, 15
FAN_IN, BUFFER = 16, 2_000_000
#: Bytes of candidate phrases of one length that a mapper holds before it looks for repeated ones.
HELD_BYTES = 9_600_000
_TOKEN = re.compile(r"[^ \n]+|\n")
_MIX = [(0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB)]
_COUNTS = "block int, lane int, at binary, n binary"


# keys


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    """[2, words]: two independent 64-bit hashes of each word in a language."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    raw = b"".join(xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass"), seed) for w in words)
    return np.frombuffer(raw, dtype=np.uint64).reshape(-1, 2).T


def phrase_keys(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """[2, starts]: the keys of the phrases of k words; ``hashes`` [2, words] are those of the words in order."""
    out = np.empty((2, len(starts)), dtype=np.uint64)
    for row, (odd, last) in enumerate(_MIX):
        s = np.full(len(starts), k * odd % (1 << 64), dtype=np.uint64)
        for j in range(k):
            s += hashes[row, starts + j] * np.uint64(pow(odd, j + 2, 1 << 64))
        s ^= s >> np.uint64(29)
        s *= np.uint64(last)
        out[row] = s ^ (s >> np.uint64(32))
    return out


@dataclass
class PerfectHash:
    """A minimal perfect hash of distinct keys [2, n]: levels of bits, each set where one key alone falls.

    Keys that meet go on to the next level; the number of set bits before a key's own is its slot.
    """

    sizes: list[int]
    words: np.ndarray
    before: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, left = [], [], keys
        while left.shape[1]:
            sizes.append(64 * -(-2 * left.shape[1] // 64))
            at = cls._at(left, len(sizes) - 1, sizes[-1])
            alone = np.bincount(at, minlength=sizes[-1]) == 1
            bits.append(alone)
            left = left[:, ~alone[at]]
        packed = np.packbits(np.concatenate(bits), bitorder="little").view(np.uint64) if bits else np.zeros(0, dtype=np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
        out = cls(sizes, packed, before, np.zeros_like(keys))
        out.keys[:, out._slots(keys)] = keys
        return out

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = (keys[0] + np.uint64(level)) * np.uint64(_MIX[0][0]) ^ (keys[1] * np.uint64((2 * level + 1) * _MIX[1][0] % (1 << 64)))
        h ^= h >> np.uint64(31)
        h *= np.uint64(_MIX[0][1])
        return ((h ^ (h >> np.uint64(33))) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, todo, base = np.full(keys.shape[1], -1, dtype=np.int64), np.arange(keys.shape[1]), 0
        for level, size in enumerate(self.sizes):
            at = base + self._at(keys[:, todo], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) > 0
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.before[at >> 6] + below)[hit]
            todo = todo[~hit]
            base += size
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that isn't in the set: the stored key is compared."""
        out = self._slots(keys)
        found = np.flatnonzero(out >= 0)
        wrong = (self.keys[:, out[found]] != keys[:, found]).any(axis=0)
        out[found[wrong]] = -1
        return out


@dataclass
class Words:
    """The frequent words: ``table`` numbers them by their hashes. If they are too many, it has the most frequent ones, and ``rest`` is a map of all."""

    table: PerfectHash
    rest: tuple[np.ndarray, int] | None

    @classmethod
    def of(cls, single: DataFrame, n: int, most_slots: int) -> Words:
        if n <= most_slots:
            top, rest = single, None
        else:
            top, rest = single.filter(F.col("n") > single.approxQuantile("n", [1 - most_slots / n], 0.001)[0]), key_map(single, n)
        pdf = top.select("word_hi", "word_lo").toPandas()
        return cls(PerfectHash.of(pdf.to_numpy(dtype=np.int64).T.copy().view(np.uint64)), rest)

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, known): a word without a number has -1 there."""
        numbers = self.table.slots(hashes)
        known = numbers >= 0
        return numbers, known if self.rest is None else known | _in_map(*self.rest, phrase_keys(hashes, np.arange(hashes.shape[1]), 1)[0])


# counting in arrays


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers compressed, the lowest bytes of all of them first; the number of bytes stands before them."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    if not (size := int.from_bytes(raw[:8], "little")):
        return np.zeros(0, dtype=kind)
    planes = np.frombuffer(pa.decompress(raw[8:], size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _blocks(at: np.ndarray, n: np.ndarray, lane: int, base: int = 0, packed: bool = True) -> pd.DataFrame:
    """Counts by ascending position as rows, one for each block that has any; packed, positions are distances from the one before."""
    block = at >> BLOCK_BITS
    cuts = np.flatnonzero(np.diff(block.astype(np.int64), prepend=-1)).tolist()
    rows = []
    for a, b in itertools.pairwise([*cuts, len(at)]):
        own, many = (at[a:b] & ((1 << BLOCK_BITS) - 1)).astype("<u2"), n[a:b].astype("<i8")
        rows.append((base + int(block[a]), lane, *((_packed(np.diff(own, prepend=own.dtype.type(0))), _packed(many)) if packed else (own.tobytes(), many.tobytes()))))
    return pd.DataFrame(rows, columns=["block", "lane", "at", "n"])


class Tally:
    """Counts positions below ``size``, at most 2 ** 32: buffered, then counted in one array. What it gives is packed."""

    def __init__(self, size: int) -> None:
        self.size, self.held, self.parts = size, 0, []

    def add(self, at: np.ndarray) -> bool:
        """Whether it is time to take what was counted."""
        self.parts.append(at.astype(np.uint32))
        self.held += len(at)
        return self.held >= BUFFER

    def take(self, lane: int) -> pd.DataFrame:
        at = np.concatenate([np.zeros(0, dtype=np.uint32), *self.parts])
        self.held, self.parts = 0, []
        if self.size <= MOST_SLOTS:
            n = np.bincount(at, minlength=self.size)
            at = np.flatnonzero(n)
            return _blocks(at, n[at], lane)
        return _blocks(*np.unique(at, return_counts=True), lane)


def tree_sum(rows: DataFrame, lanes: int) -> DataFrame:
    """The sum of all lanes' arrays, block by block: each round adds those of FAN_IN lanes. A block is one row, not packed."""
    shift = int(math.log2(FAN_IN))

    def added(packed: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(1 << BLOCK_BITS, dtype=np.int64)
            for at, n in zip(pdf["at"], pdf["n"], strict=True):
                total[np.cumsum(_unpacked(at, "<u2"), dtype=np.int64)] += _unpacked(n, "<i8")
            at = np.flatnonzero(total)
            return _blocks(at, total[at], int(pdf["lane"].iloc[0]) >> shift, int(pdf["block"].iloc[0]), packed)

        return one

    while True:
        lanes = -(-lanes // FAN_IN)
        rows = rows.groupBy("block", F.shiftright("lane", shift).alias("parent")).applyInPandas(added(lanes > 1), _COUNTS)
        if lanes <= 1:
            return rows


# bit maps


def _bits_for(n: int, each: float) -> int:
    return min(MOST_BITS, max(BLOCK_BITS, math.ceil(math.log2(max(1, n * each)))))


def _collected(blocks: DataFrame, bits: int) -> np.ndarray:
    """The bit map of rows (block, map); its size is bounded by MOST_BITS."""
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in blocks.toLocalIterator():
        out[r.block << (BLOCK_BITS - 3) : (r.block + 1) << (BLOCK_BITS - 3)] = np.frombuffer(r.map, dtype=np.uint8)
    return out


def _marked(block: int, at: np.ndarray) -> pd.DataFrame:
    bits = np.zeros(1 << BLOCK_BITS, dtype=bool)
    bits[at] = True
    return pd.DataFrame({"block": [int(block)], "map": [np.packbits(bits, bitorder="little").tobytes()]})


def key_map(keys: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(map, bits): a bit for the first bits of every key (hi); others are set with a chance of about 1 in 16."""
    bits = _bits_for(n, 16)
    top = F.shiftrightunsigned("hi", 64 - bits)
    rows = keys.select(F.shiftright(top, BLOCK_BITS).cast("int").alias("block"), top.bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("at")).distinct()
    return _collected(rows.groupBy("block").applyInPandas(lambda pdf: _marked(pdf["block"].iloc[0], pdf["at"].to_numpy()), "block int, map binary"), bits), bits


def _in_map(bitmap: np.ndarray, bits: int, hi: np.ndarray) -> np.ndarray:
    at = (hi >> np.uint64(64 - bits)).astype(np.int64)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


# runs


def _run_ends(codes: np.ndarray) -> list[int]:
    """Where runs of at most RUN_TOKENS end, each after a break; a longer piece is a run of its own."""
    ends, out = np.flatnonzero(codes == 0) + 1, [0]
    while out[-1] < len(codes):
        last = int(np.searchsorted(ends, out[-1] + RUN_TOKENS, "right")) - 1
        fits = last >= 0 and ends[last] > out[-1]
        out.append(int(ends[last if fits else last + 1]))
    return out


def _code_type(words: int) -> str:
    return "<u2" if words <= 1 << 16 else "<u4"


def _kept(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The tokens that a frequent phrase can hold: known words beside another one, and a break after each row of them."""
    word = known[codes] & (codes > 0)
    near = word.copy()
    near[:-1] &= word[1:]
    near[-1:] = False
    near[1:] |= near[:-1]  # of a pair both
    after = np.zeros_like(near)
    after[1:] = near[:-1]
    return np.where(near, codes, 0)[near | after]


def _tokenised(it: Iterator[pd.DataFrame], lists: bool = True, runs: bool = True, frequent: Broadcast | None = None) -> Iterator[pd.DataFrame]:
    """Rows of two kinds: words with their counts in a chunk of texts, and runs: hashes of words and codes of tokens.

    With the frequent Words a run has the numbers of its words, hashes of those without one, and no other words.
    """
    for pdf in chunks(it, "text", CHUNK_CHARS):
        for lang, part in pdf.groupby("lang", sort=False):
            vocabulary: dict[str, int] = defaultdict()
            vocabulary.default_factory = vocabulary.__len__
            vocabulary["\n"]  # noqa: B018  code 0, a break
            codes = [np.fromiter(map(vocabulary.__getitem__, _TOKEN.findall(t + "\n")), dtype="<u4") for t in part["text"]]
            codes = np.concatenate(codes)
            words, rows = list(vocabulary), []
            if len(words) == 1:
                continue
            if lists:
                n = np.bincount(codes, minlength=len(words))
                rows += [(lang, words[a : a + LIST_WORDS], n[a : a + LIST_WORDS], None, None, None) for a in range(1, len(words), LIST_WORDS)]
            if runs:
                hashes, numbers = word_hashes(lang, words), None
                if frequent is not None:
                    numbers, known = frequent.value.found(hashes)
                    numbers[0] = -1
                    codes = _kept(codes, known)
                for a, b in itertools.pairwise(_run_ends(codes)):
                    used, local = np.unique(codes[a:b], return_inverse=True)  # a run ends with a break, which stays code 0
                    own = None if numbers is None else numbers[used].astype("<i4")
                    bare = used if own is None else used[own < 0]
                    rows.append((lang, None, None, None if own is None else own.tobytes(), hashes[:, bare].tobytes(), local.astype(_code_type(len(used))).tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "words", "n", "numbers", "hashes", "codes"])


def _decoded(hashes: bytes, codes: bytes, numbers: np.ndarray | None = None, table: PerfectHash | None = None) -> tuple[np.ndarray, np.ndarray]:
    by_word = np.frombuffer(hashes, dtype=np.uint64).reshape(2, -1)
    if numbers is not None:
        bare, by_word = by_word, np.empty((2, len(numbers)), dtype=np.uint64)
        by_word[:, numbers < 0] = bare
        by_word[:, numbers >= 0] = table.keys[:, numbers[numbers >= 0]]
    return by_word, np.frombuffer(codes, dtype=_code_type(by_word.shape[1]))


def _opened(it: Iterator[pd.DataFrame], frequent: Broadcast) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, hashes, codes) of each run."""
    for pdf in it:
        for i, h, c in zip(pdf["numbers"], pdf["hashes"], pdf["codes"], strict=True):
            numbers = np.frombuffer(i, dtype="<i4")
            yield numbers, *_decoded(h, c, numbers, frequent.value.table)


def _phrases(by_word: np.ndarray, codes: np.ndarray, ks: list[int], pairs: tuple[np.ndarray, int] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, starts, keys) of the phrases of a run, with a map of pairs of those whose pairs are in it."""
    words = by_word[:, codes]
    part, size = codes > 0, 1  # where a phrase of ``size`` words starts that may be frequent
    if pairs is not None:
        starts = np.flatnonzero(part[:-1] & part[1:])
        two = np.zeros(max(0, len(codes) - 1), dtype=bool)
        two[starts] = _in_map(*pairs, phrase_keys(words, starts, 2)[0])
        part, size = two, 2
    for k in ks:
        width = k - size + 1  # a phrase is allowed if all its parts of that size are
        if len(part) < width:
            continue
        allowed = reduce(np.logical_and, [part[j : len(part) - width + 1 + j] for j in range(width)])
        starts = np.flatnonzero(allowed)
        if len(starts):
            yield k, starts, phrase_keys(words, starts, k)


def _bucket_pass(runs: DataFrame, ks: list[int], frequent: Broadcast, pairs: tuple | None, bits: int, least: int) -> np.ndarray:
    """The map of buckets that phrases of ks words reach the threshold in."""
    shared = runs.sparkSession.sparkContext.broadcast(pairs)

    @released
    def make(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally, lane = Tally(1 << bits), TaskContext.get().partitionId()
        for _, by_word, codes in _opened(it, frequent):
            for _, _, keys in _phrases(by_word, codes, ks, shared.value):
                if tally.add(keys[0] >> np.uint64(64 - bits)):
                    yield tally.take(lane)
        yield tally.take(lane)

    def mark(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for block, at, n in zip(pdf["block"], pdf["at"], pdf["n"], strict=True):
                yield _marked(block, np.frombuffer(at, dtype="<u2")[np.frombuffer(n, dtype="<i8") >= least])

    return _collected(tree_sum(runs.mapInPandas(make, _COUNTS), runs.rdd.getNumPartitions()).mapInPandas(mark, "block int, map binary"), bits)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct phrases of arrays [phrases, words of a phrase, parts of a word]."""
    rows = np.ascontiguousarray(np.concatenate(parts))
    whole = rows.reshape(len(rows), rows.shape[1] * rows.shape[2]).view(f"V{rows.shape[1] * rows.shape[2] * rows.itemsize}").ravel()
    return np.unique(whole).view(rows.dtype).reshape(-1, *rows.shape[1:])


def _candidate_pass(runs: DataFrame, ks: list[int], frequent: Broadcast, pairs: tuple | None, heavy: np.ndarray, bits: int) -> DataFrame:
    """(hi, lo, words) of each distinct phrase in a heavy bucket; words are the keys of its words.

    Each mapper gives its distinct phrases as a few sorted rows, cut by their hash; these are merged along a tree. Their
    words are numbers, or both hashes where not all frequent words have one.
    """
    shared, lanes = runs.sparkSession.sparkContext.broadcast((pairs, heavy)), runs.rdd.getNumPartitions()
    cut = max(0, math.ceil(math.log2(max(1, int(np.bitwise_count(heavy).sum()) >> (BLOCK_BITS - 3)))))  # about 8 phrases a bucket
    ddl = "k int, block int, lane int, phrases binary"
    kind, width = ("<u4", 1) if frequent.value.rest is None else ("<u8", 2)

    def hashes(phrases: np.ndarray) -> np.ndarray:
        return frequent.value.table.keys[:, phrases.ravel()] if width == 1 else np.ascontiguousarray(phrases.reshape(-1, 2).T)

    def none(k: int) -> np.ndarray:
        return np.zeros((0, k, width), dtype=kind)

    def rows(phrases: np.ndarray, k: int, lane: int) -> pd.DataFrame:
        mixed = phrase_keys(hashes(phrases), np.arange(len(phrases)) * k, k)[1]
        block = mixed >> np.uint64(64 - cut) if cut else np.zeros(len(phrases), dtype=np.uint64)
        return pd.DataFrame([(k, int(b), lane, _packed(phrases[block == b].reshape(-1))) for b in np.unique(block)], columns=["k", "block", "lane", "phrases"])

    @released
    def make(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, held = TaskContext.get().partitionId(), {k: [none(k)] for k in ks}
        for numbers, by_word, codes in _opened(it, frequent):
            word = numbers.astype(kind)[:, None] if width == 1 else by_word.T
            for k, starts, keys in _phrases(by_word, codes, ks, shared.value[0]):
                starts = starts[_in_map(shared.value[1], bits, keys[0])]
                held[k].append(_distinct([word[codes[starts[:, None] + np.arange(k)]]]))
                if sum(p.nbytes for p in held[k]) > HELD_BYTES:
                    held[k] = [_distinct(held[k])]
                    if held[k][0].nbytes > HELD_BYTES // 2:
                        yield rows(held[k].pop(), k, lane)
                        held[k] = [none(k)]
        for k in ks:
            yield rows(_distinct(held[k]), k, lane)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        k, lane = int(pdf["k"].iloc[0]), int(pdf["lane"].iloc[0]) // FAN_IN
        phrases = _distinct([_unpacked(p, kind).reshape(-1, k, width) for p in pdf["phrases"]])
        return pd.DataFrame({"k": [k], "block": [int(pdf["block"].iloc[0])], "lane": [lane], "phrases": [_packed(phrases.reshape(-1))]})

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for k, raw in zip(pdf["k"], pdf["phrases"], strict=True):
                words = hashes(_unpacked(raw, kind))
                keys = phrase_keys(words, np.arange(0, words.shape[1], k), k).view(np.int64)
                single = phrase_keys(words, np.arange(words.shape[1]), 1).view(np.int64).T.reshape(-1, k * 2)
                yield pd.DataFrame({"hi": keys[0], "lo": keys[1], "words": list(single)})

    found = runs.mapInPandas(make, ddl)
    while True:
        found = found.groupBy("k", "block", F.floor(F.col("lane") / FAN_IN).alias("parent")).applyInPandas(merge, ddl)
        lanes = -(-lanes // FAN_IN)
        if lanes <= 1:
            return found.mapInPandas(read, "hi long, lo long, words array<long>")


def _rounds(keys: DataFrame, n: int, most_slots: int, more: list[str] | None = None) -> Iterator[tuple[int, int, PerfectHash, pd.DataFrame]]:
    """(round, rounds, hash, rows) of the keys (hi, lo and more), at most about ``most_slots`` in each round."""
    rounds = max(1, -(-n // most_slots))
    for r in range(rounds):
        pdf = keys.filter(F.pmod("hi", F.lit(rounds)) == r).select("hi", "lo", *(more or [])).toPandas()
        yield r, rounds, PerfectHash.of(pdf[["hi", "lo"]].to_numpy(dtype=np.int64).T.copy().view(np.uint64)), pdf


def _count_pass(runs: DataFrame, ks: list[int], frequent: Broadcast, pairs: tuple | None, candidates: DataFrame, least: int, most_slots: int) -> DataFrame:
    """(hi, lo, n) of the candidates with ``least`` occurrences or more."""
    out = []
    for r, rounds, table, _ in _rounds(candidates, candidates.count(), most_slots):
        shared = runs.sparkSession.sparkContext.broadcast((pairs, table))
        size = table.keys.shape[1]

        @released
        def make(it: Iterator[pd.DataFrame], shared=shared, size=size, r=r, rounds=rounds) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            tally, lane = Tally(size), TaskContext.get().partitionId()
            for _, by_word, codes in _opened(it, frequent):
                for _, _, keys in _phrases(by_word, codes, ks, shared.value[0]):
                    keys = keys[:, keys[0].view(np.int64) % rounds == r] if rounds > 1 else keys
                    slots = shared.value[1].slots(keys)
                    if tally.add(slots[slots >= 0]):
                        yield tally.take(lane)
            yield tally.take(lane)

        @released
        def read(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            for pdf in it:
                for block, at, n in zip(pdf["block"], pdf["at"], pdf["n"], strict=True):
                    slot, n = (block << BLOCK_BITS) + np.frombuffer(at, dtype="<u2").astype(np.int64), np.frombuffer(n, dtype="<i8")
                    hi, lo = shared.value[1].keys[:, slot[n >= least]].view(np.int64)
                    yield pd.DataFrame({"hi": hi, "lo": lo, "n": n[n >= least]})

        counted = tree_sum(runs.mapInPandas(make, _COUNTS), runs.rdd.getNumPartitions())
        with few_rows_read(runs.sparkSession, RUNS_READ):
            out.append(stored(counted.mapInPandas(read, "hi long, lo long, n long")))
        shared.unpersist()
    return reduce(DataFrame.union, out)


def _frequent(runs: DataFrame, ks: list[int], frequent: Broadcast, pairs: tuple | None, single: DataFrame, at_most: int, least: int, most_slots: int) -> DataFrame:
    """(hi, lo, lang, phrase, n) of the frequent phrases of ks words, of which the corpus has ``at_most`` occurrences."""
    bits = _bits_for(at_most, 1 / 8)
    with few_rows_read(runs.sparkSession, RUNS_READ):
        heavy = _bucket_pass(runs, ks, frequent, pairs, bits, least)
        candidates = stored(_candidate_pass(runs, ks, frequent, pairs, heavy, bits))
    found = stored(candidates.join(_count_pass(runs, ks, frequent, pairs, candidates, least, most_slots), ["hi", "lo"]))
    names = found.select("hi", "lo", "n", F.posexplode("words").alias("at", "w_hi"), "words").filter("at % 2 = 0").withColumn("w_lo", F.get("words", F.col("at") + 1))
    named = names.join(single.select(F.col("hi").alias("w_hi"), F.col("lo").alias("w_lo"), "lang", F.col("phrase").alias("word")), ["w_hi", "w_lo"])
    in_order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    return stored(named.groupBy("hi", "lo", "n").agg(F.first("lang").alias("lang"), in_order.alias("phrase")).select("hi", "lo", "lang", "phrase", "n"))


# cuts


def _keyed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the key and the hashes of each word (lang, phrase)."""
    for pdf in it:
        hashes = np.zeros((2, len(pdf)), dtype=np.uint64)
        for lang, at in pdf.groupby("lang").indices.items():
            hashes[:, at] = word_hashes(lang, pdf["phrase"].iloc[at].tolist())
        hi, lo = phrase_keys(hashes, np.arange(len(pdf)), 1).view(np.int64)
        yield pdf.assign(hi=hi, lo=lo, word_hi=hashes[0].view(np.int64), word_lo=hashes[1].view(np.int64))


def _parts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All proper parts of each phrase: (hi, lo, n) of the phrase, first word and end of the part, its key."""
    for pdf in it:
        out = []
        for lang, phrase, hi, lo, n in zip(pdf["lang"], pdf["phrase"], pdf["hi"], pdf["lo"], pdf["n"], strict=True):
            hashes = word_hashes(lang, words := phrase.split(" "))
            for size in range(1, len(words)):
                keys = phrase_keys(hashes, np.arange(len(words) - size + 1), size).view(np.int64).T.tolist()
                out += [(hi, lo, n, i, i + size, len(words), *key) for i, key in enumerate(keys)]
        yield pd.DataFrame(out, columns=["hi", "lo", "n", "first", "end", "words", "part_hi", "part_lo"])


def _cuts(parts: DataFrame, counts: DataFrame, most_slots: int) -> DataFrame:
    """(hi, lo, cut, l, r): the counts of both sides of each cut, read by slot."""
    sides = stored(parts.filter("first = 0 OR end = words").select("hi", "lo", F.when(F.col("first") == 0, F.col("end")).otherwise(F.col("first")).alias("cut"), (F.col("first") == 0).alias("is_left"), "part_hi", "part_lo"))
    out = []
    for r, rounds, table, pdf in _rounds(counts, counts.count(), most_slots, ["n"]):
        n = np.zeros(len(pdf), dtype=np.int64)
        n[table.slots(pdf[["hi", "lo"]].to_numpy(dtype=np.int64).T.copy().view(np.uint64))] = pdf["n"]
        shared = parts.sparkSession.sparkContext.broadcast((table, n))

        def read(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            table, n = shared.value
            for pdf in it:
                slots = table.slots(pdf[["part_hi", "part_lo"]].to_numpy(dtype=np.int64).T.copy().view(np.uint64))
                found = slots >= 0
                yield pdf.loc[found, ["hi", "lo", "cut", "is_left"]].assign(n=n[slots[found]])

        mine = sides.filter(F.pmod("part_hi", F.lit(rounds)) == r)
        out.append(stored(mine.mapInPandas(released(read), "hi long, lo long, cut int, is_left boolean, n long")))
        shared.unpersist()
    side = lambda left: F.max(F.when(F.col("is_left") == left, F.col("n")))
    return reduce(DataFrame.union, out).groupBy("hi", "lo", "cut").agg(side(True).alias("l"), side(False).alias("r"))


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, most_rank: int = MOST_RANK, most_slots: int = MOST_SLOTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases whose words keep together most, ``most_rank`` a language.

    A phrase of 2 to ``most_words`` words with a >= ``least`` occurrences scores floor(1000 a n / (l r)) at the cut where
    that is least; n is the number of words of its language, l and r count the sides of the cut. Phrases inside a longer
    one that is as frequent are left out. Ties in the rank go by a, then by the phrase. Only letters A-Z are lower-cased.
    Null texts are empty, a null lang is ``und``; every row counts, repeated ones too; texts are read whole. Without a
    frequent phrase, as in an empty table, the result is empty. Extra columns are not read.
    """
    if most_words < 2:
        raise ValueError("a phrase has two words at least")
    small_batches(docs.sparkSession, rows=4_000, size="8m")  # longer runs have less words in common
    text = F.translate(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), BREAKS + "\t", "\n" * len(BREAKS) + " ")
    base = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text.alias("text"))
    ddl = "lang string, words array<string>, n array<long>, numbers binary, hashes binary, codes binary"
    lists = base.mapInPandas(released(partial(_tokenised, runs=False)), ddl)
    words = stored(lists.select("lang", F.inline(F.arrays_zip("words", "n"))).groupBy("lang", F.col("words").alias("phrase")).agg(F.sum("n").alias("n")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    single = stored(words.filter(F.col("n") >= least).mapInPandas(_keyed, "lang string, phrase string, n long, hi long, lo long, word_hi long, word_lo long"))
    size = single.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    frequent = docs.sparkSession.sparkContext.broadcast(Words.of(single, size.k, most_slots))
    runs = stored(base.mapInPandas(released(partial(_tokenised, lists=False, frequent=frequent)), ddl).select("numbers", "hashes", "codes"), "zstd")
    phrases = pairs = _frequent(runs, [2], frequent, None, single, size.n or 0, least, most_slots)
    if most_words > 2:
        size = pairs.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
        ks = list(range(3, most_words + 1))
        phrases = pairs.unionByName(_frequent(runs, ks, frequent, key_map(pairs, size.k), single, (size.n or 0) * len(ks), least, most_slots))
    phrases = stored(phrases)
    parts = stored(phrases.mapInPandas(_parts, "hi long, lo long, n long, first int, end int, words int, part_hi long, part_lo long"))
    cuts = _cuts(parts, phrases.select("hi", "lo", "n").unionByName(single.select("hi", "lo", "n")), most_slots)
    inside = parts.filter("end - first > 1").groupBy(F.col("part_hi").alias("hi"), F.col("part_lo").alias("lo")).agg(F.max("n").alias("longer"))
    kept = phrases.join(inside, ["hi", "lo"], "left").filter("longer IS NULL OR longer < n").drop("longer").withColumnRenamed("n", "a")
    digits = lambda c: F.col(c).cast("decimal(19,0)")
    scored = kept.join(cuts, ["hi", "lo"]).join(F.broadcast(totals.withColumnRenamed("total", "n")) if totals.limit(10_001).count() <= 10_000 else totals.withColumnRenamed("total", "n"), "lang")
    scored = scored.withColumn("score", F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)")) * digits("n"), digits("l") * digits("r")))
    best = scored.groupBy("lang", "hi", "lo").agg(F.min(F.struct("score", "cut", "phrase", "a", "l", "r", "n")).alias("best")).select("lang", "best.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most_rank)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
