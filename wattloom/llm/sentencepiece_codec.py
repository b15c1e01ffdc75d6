"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (a word with the spaces before it; no piece reaches across) are concatenated and a
suffix array, sorted to the length of the longest piece, is built over them. Every piece of the vocabulary is found by
binary search as a range of the array, so all occurrences of all pieces, the edges of the lattice, come from one sorted
index. Edges are sorted by position and relaxed from left to right. For a BPE vocabulary the relaxation rule is exact:
a text's encoding ends with piece p iff the encoding of what is before p ends with a piece q such that p and q stand
next to each other in the encoding of qp; so each position keeps the one piece that its prefix's encoding ends with.
Other vocabularies are refused.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, groupby

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, released, schema_with, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CHUNK_CHARS = 500_000
UNIT_CHARS = 150_000  # of new units that are indexed together: the edges of the lattice take many times that
CACHE_UNITS, CACHE_PAIRS = 100_000, 2_000_000  # at about 150 and 9 bytes each
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
_coders: dict[int, Coder] = {}


class Coder:
    """Encodes and decodes with the pieces of one serialised model."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in ids]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = sp.unk_id()
        #: what a piece shows; bytes of ASCII are characters, the others (high) only make one together
        self.shown = ["" if sp.is_control(i) else chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else self.pieces[i] for i in ids]
        self.high = frozenset(i for i, b in self.byte_of.items() if b > 127)
        self.normal = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.pieces[i]: i for i in self.normal}
        self.score = np.array([sp.get_score(i) for i in ids])
        self.scores = self.score.tolist()
        joined = [self.scores[i] for i in self.normal if len(self.pieces[i]) > 1]
        if any(x > 0 or x != int(x) for x in joined):  # a merge table scores its pieces by the number of the merge
            raise ValueError("not a BPE vocabulary")
        self.size = len(self.pieces)
        self.length = max((len(self.pieces[i]) for i in self.normal), default=1)
        # sorted code points of the pieces, one row each, ended by -1
        self.by_text = np.array(self.normal, dtype=np.int64)
        self.codes = np.full((len(self.normal), self.length), -1, dtype=np.int32)
        for k, i in enumerate(self.normal):
            self.codes[k, : len(self.pieces[i])] = [ord(c) for c in self.pieces[i]]
        self.lengths = np.array([len(p) for p in self.pieces] + [1], dtype=np.int64)
        self.reaches = {}
        self.fit_keys, self.fit = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)  # what pairs_fit() has found, by key
        self.new_fits: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}  # ids as little-endian int32

    def merge(self, text: str) -> list[int]:
        """The plain merge procedure on a short text, which decides on the neighbourhood of two pieces."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            both = parts[a] + parts[b]
            if both in self.id:
                heapq.heappush(heap, (-self.scores[self.id[both]], a, b, both))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or parts[a] + parts[b] != both or right[a] != b:
                continue
            parts[a], parts[b] = both, None
            right[a] = right[b]
            if right[b] < len(parts):
                left[right[b]] = a
                offer(a, right[b])
            if left[a] >= 0:
                offer(left[a], a)
        return [self.id.get(p, self.size) for p in parts if p is not None]

    def pairs_fit(self, keys: np.ndarray) -> np.ndarray:
        """For keys q * (size + 1) + p: whether q and p stand next to each other in the encoding of qp."""
        some, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.fit_keys, some)
        at[at == len(self.fit_keys)] = 0
        known = self.fit_keys[at] == some if len(self.fit_keys) else np.zeros(len(some), dtype=bool)
        out = self.fit[at] if len(self.fit_keys) else np.zeros(len(some), dtype=bool)
        wide, new = self.size + 1, self.new_fits
        for k, key in zip(np.flatnonzero(~known).tolist(), some[~known].tolist(), strict=True):
            ok = new.get(key)
            if ok is None:
                q, p = divmod(key, wide)
                ok = new[key] = q == self.size or p == self.size or self.merge(self.pieces[q] + self.pieces[p]) == [q, p]
            out[k] = ok
        return out[back]

    def keep_fits(self) -> None:
        """Puts the new findings of pairs_fit() among the sorted ones."""
        if not self.new_fits:
            return
        if len(self.fit_keys) > CACHE_PAIRS:
            self.fit_keys, self.fit = self.fit_keys[:0], self.fit[:0]
        keys = np.concatenate([self.fit_keys, np.fromiter(self.new_fits, dtype=np.int64)])
        order = np.argsort(keys, kind="stable")
        self.fit_keys, self.fit = keys[order], np.concatenate([self.fit, np.fromiter(self.new_fits.values(), dtype=bool)])[order]
        self.new_fits = {}

    def whole(self, ids: np.ndarray) -> np.ndarray:
        """Whether each piece is the encoding of its own text, which only some pieces of a merge table are not."""
        some, back = np.unique(ids, return_inverse=True)
        for i in some.tolist():
            if i not in self.reaches:
                self.reaches[i] = self.merge(self.pieces[i]) == [i]
        return np.array([self.reaches[i] for i in some.tolist()], dtype=bool)[back] if len(some) else np.zeros(0, dtype=bool)

    def suffixes(self, text: np.ndarray) -> np.ndarray:
        """Positions of ``text``, sorted by what begins there as far as the longest piece reaches (prefix doubling)."""
        far = np.concatenate([text + 2, np.zeros(2, dtype=np.int64)])  # code points have 21 bits: three make a first key
        key, k = (far[:-2] << 42) | (far[1:-1] << 21) | far[2:], 3
        while True:
            order = np.argsort(key)
            if k >= self.length:
                break
            key = key[order]
            rank = np.empty_like(key)
            rank[order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
            ahead = np.zeros_like(rank)
            ahead[:-k] = rank[k:]
            key, k = rank * (len(text) + 2) + ahead, k * 2
        return order

    def ranges(self, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) in the suffix array of every piece, by binary search: one code point after another narrows it."""
        n = len(text)
        low, high = np.zeros(len(self.codes), dtype=np.int64), np.full(len(self.codes), n, dtype=np.int64)
        padded = np.concatenate([text, np.full(self.length, -2, dtype=np.int64)])
        for d in range(self.length):
            live = np.flatnonzero((self.codes[:, d] >= 0) & (low < high))
            if not len(live):
                break
            want = self.codes[live, d]
            for side in (0, 1):
                a, b = low[live].copy(), high[live].copy()
                while True:
                    open_ = a < b
                    if not open_.any():
                        break
                    mid = (a + b) // 2
                    have = padded[order[np.minimum(mid, n - 1)] + d]
                    goes = (have < want) if side == 0 else (have <= want)
                    a = np.where(open_ & goes, mid + 1, a)
                    b = np.where(open_ & ~goes, mid, b)
                if side == 0:
                    first = a
                else:
                    last = a
            low[live], high[live] = first, last
        return low, high

    def learn_units(self, new: list[str]) -> None:
        """Encodes units that are not known yet and remembers them."""
        sizes = np.array([len(u) for u in new], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text = np.frombuffer("\0".join(new).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        stops = (begin + sizes)[:-1]
        text[stops] = -1  # between units; no piece has it
        order = self.suffixes(text).astype(np.int32)
        low, high = self.ranges(text, order)
        found = np.flatnonzero(low < high)
        many = (high - low)[found]
        flat = np.repeat(low[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        start, piece = order[flat], np.repeat(self.by_text[found].astype(np.int32), many)
        del order, flat
        # characters that no piece has are edges of their own
        covered = np.zeros(len(text), dtype=bool)
        covered[start[self.lengths[piece] == 1]] = True
        covered[stops] = True
        alone = np.flatnonzero(~covered)
        start, piece = np.concatenate([start, alone.astype(np.int32)]), np.concatenate([piece, np.full(len(alone), self.size, dtype=np.int32)])
        known = piece < self.size
        known[known] = ~self.whole(piece[known])
        start, piece = start[~known], piece[~known]
        end = start + self.lengths[piece].astype(np.int32)
        from_ = np.repeat(begin, sizes + 1).astype(np.int32)[start]
        away = end - from_  # edges by the distance of their end from the unit's beginning
        by = np.argsort(away.astype(np.uint16) if len(away) and away.max() < 1 << 16 else away, kind="stable")
        start, piece, end, away, first = start[by], piece[by], end[by], away[by], (start == from_)[by]
        del from_, by
        cuts = np.flatnonzero(np.diff(away)) + 1
        last = np.full(len(text) + 2, -1, dtype=np.int32)  # the piece that the encoding of a prefix ends with, by its end
        for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(start)]]), strict=True):
            s, p, e = start[a:b], piece[a:b], end[a:b]
            good = first[a:b].copy()
            rest = np.flatnonzero(~good)
            before = last[s[rest]]
            rest, before = rest[before >= 0], before[before >= 0]
            good[rest[self.pairs_fit(before.astype(np.int64) * (self.size + 1) + p[rest])]] = True
            last[e[good]] = p[good]
        length, ends, chosen = self.lengths.tolist(), (begin + sizes).tolist(), last.tolist()
        for unit, b, at in zip(new, begin.tolist(), ends, strict=True):
            ids: list[int] = []
            while at > b:
                p = chosen[at]
                if p == self.size:
                    raw = unit[at - b - 1].encode("utf-8", "surrogatepass")
                    ids += [self.byte_id[x] for x in reversed(raw)] if self.byte_id else [self.unknown]
                else:
                    ids.append(p)
                at -= length[p]
            self.units[unit] = np.array(ids[::-1], dtype="<i4").tobytes()
        self.keep_fits()

    def forget(self) -> None:
        """Drops the units that are remembered; what is known of pairs stays."""
        self.units = {}

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian int32."""
        split = [_UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        have = set(chain.from_iterable(split))
        if len(self.units) > CACHE_UNITS:  # what this batch uses again stays
            self.units = {u: x for u in have if (x := self.units.get(u)) is not None}
        new = [u for u in have if u not in self.units]
        while new:
            ends = np.cumsum([len(u) for u in new])
            k = max(1, int(np.searchsorted(ends, UNIT_CHARS)))
            self.learn_units(new[:k])
            new = new[k:]
        get = self.units.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(x, dtype="<i4").tolist() for x in self.encode_bytes(texts)]

    def decode(self, ids: list[int]) -> str:
        if self.high.isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:  # bytes of one character stand side by side; runs of bytes are decoded together
            out: list[str] = []
            for raw, run in groupby(ids, self.byte_of.__contains__):
                out.append(bytes(map(self.byte_of.__getitem__, run)).decode("utf-8", "replace") if raw else "".join(map(self.shown.__getitem__, run)))
            text = "".join(out)
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def model_bytes(spark: SparkSession, path: str = MODEL) -> bytes:
    """The serialised model (half a megabyte): from a path of the driver, or one that Spark reads."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def _coder(model: bytes) -> Coder:
    key = hash(model)
    if key not in _coders:
        _coders[key] = Coder(model)
    return _coders[key]


def encode(docs: DataFrame, text_col: str = "text", path: str = MODEL) -> DataFrame:
    """Adds token_ids (array<int>) to all columns; a column of that name is replaced.

    Null and empty texts have no tokens. Spaces are kept as they are; U+2581 in a text counts as a space. Texts of any
    length are encoded whole; a row's tokens follow from its text alone, so repeated rows come out alike and nothing
    is left to ties. Only texts go to Python workers.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("token_ids")
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(docs.sparkSession, path))

    @F.pandas_udf("array<int>")
    @released
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(model.value)
        for part in chunks((t.to_frame("text") for t in it), "text", CHUNK_CHARS):
            yield pd.Series([np.frombuffer(x, dtype="<i4") for x in coder.encode_bytes(part["text"].tolist())], dtype=object)
        coder.forget()

    return docs.select("*", run.asNondeterministic()(F.col(text_col)).alias("token_ids"))


def decode(tokens: DataFrame, ids_col: str = "token_ids", path: str = MODEL) -> DataFrame:
    """Adds decoded (string) to all columns; null token lists give null."""
    tokens = tokens.drop("decoded")
    model = tokens.sparkSession.sparkContext.broadcast(model_bytes(tokens.sparkSession, path))

    @released
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(model.value)
        for pdf in it:
            yield pdf.assign(decoded=[None if x is None else coder.decode(list(x)) for x in pdf[ids_col]])

    return tokens.mapInPandas(run, schema_with(tokens, "decoded string"))


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the ids as little-endian int32), round_trip.

    round_trip says that decoding gives the text back, with U+2581 read as a space; null counts as empty.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(docs.sparkSession, path))

    @released
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(model.value)
        for pdf in chunks(it, "text", CHUNK_CHARS):
            texts = pdf["text"].tolist()
            raw = coder.encode_bytes(texts)
            same = [coder.decode(np.frombuffer(x, dtype="<i4").tolist()) == t.replace(SPACE, " ") for x, t in zip(raw, texts, strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(x) // 4 for x in raw], "ids_sha256": [sha256(x).hexdigest() for x in raw], "round_trip": same})
        coder.forget()

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, round_trip boolean")
