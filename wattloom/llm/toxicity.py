"""Toxicity scores by noisy-channel deobfuscation.

Obfuscated tokens (letters mixed with digits or signs, stretched letters, letters set apart by spaces or signs) are
restored: each written character stands for a set of letters with a channel cost, repeats may collapse and signs may
vanish, and a Viterbi search over this lattice under a character trigram model of all documents finds the cheapest word. A linear
model over hashed words and letter n-grams, fitted on a bounded sample of labelled documents, scores the restored text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, released, schema_with, small_batches

TRAIN_ROWS = 5_000  # the bound of the labelled sample, half of it for each label at most
TRAIN_CHARS = 50_000  # longer texts aren't taken into the sample, which bounds what the driver holds
DIM = 1 << 20
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
CHUNK_CHARS = 1_000_000
MOST_WORDS = 200_000  # distinct words that a task holds before their trigrams are added up

#: What a written character can stand for, besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
_EDGES = ".,;:?#&%\"'!"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_PLAIN = re.compile(r"[^\W\d_]+")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_APART = re.compile(r"(?<!\S)(?:[^\W_] ){3,}[^\W_](?!\S)")
_SIGNED = re.compile(r"(?<![^\W_])(?:[^\W_][.\-_*]{1,2}){3,}[^\W_](?![^\W_])")
_ODD = re.compile(r"[^\W\d_][0-9@$!|+(€£¡*._\-]+[^\W\d_]|^[0-9@$!|+(€£¡]+[^\W\d_]{2,}|[^\W\d_]{2}[0-9@$|€£¡]")
CHANNEL, DROP, REPEAT = -2.0, -1.0, -0.2


@dataclass
class Letters:
    """A character trigram model: log P(c | a b), trained on plain words."""

    logp: dict[str, float]
    unseen: float

    def restore(self, token: str) -> str:
        """The cheapest word that the channel may have turned into ``token``."""
        states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}  # cost, and the letters written as (before, letter)
        get, unseen = self.logp.get, self.unseen
        ends = {i for m in re.finditer(r"(.)\1\1+", token) for i in range(m.start() + 1, m.end())}  # in a stretch, what repeats
        for i, ch in enumerate(token):
            new: dict[str, tuple[float, tuple | None]] = {}
            own = [(ch, 0.0)] if ch.isalpha() else []
            own += [(c, CHANNEL) for c in LEET.get(ch, "")]
            for ctx, (cost, out) in states.items():
                moves = [(ctx[1:] + c, cost + pay + get(ctx + c, unseen), (out, c)) for c, pay in own]
                if not ch.isalpha():
                    if ch in " .-_*" or not own:
                        moves.append((ctx, cost + DROP, out))
                if i in ends and out:
                    moves.append((ctx, cost + REPEAT, out))
                for state, c, o in moves:
                    if state not in new or c > new[state][0]:
                        new[state] = (c, o)
            states = new  # at most the pairs of letters that signs stand for, and the written ones
        out = max(((cost + get(ctx + "$", unseen), ctx, out) for ctx, (cost, out) in states.items()), key=lambda x: x[:2], default=(0.0, "", None))[2]
        word = []
        while out:
            out, c = out
            word.append(c)
        return "".join(reversed(word))


def trigrams(words: Mapping[str, int]) -> Counter[str]:
    """Letter trigrams of counted words, with their bounds. Stretched words are the channel's, not the language's."""
    n: Counter[str] = Counter()
    for w, c in words.items():
        if not _STRETCHED.search(w):
            p = f"^^{w}$"
            for i in range(len(p) - 2):
                n[p[i : i + 3]] += c
    return n


def letters(n: Mapping[str, int]) -> Letters:
    heads: Counter[str] = Counter()
    for g, c in n.items():
        heads[g[:2]] += c
    kinds = len({g[2] for g in n}) + 1
    return Letters({g: math.log((c + 0.1) / (heads[g[:2]] + 0.1 * kinds)) for g, c in n.items()}, math.log(0.1 / (0.1 * kinds + 50)))


def corpus_trigrams(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Letter trigrams of all documents, labelled or not: added up in each batch of words, then by a shuffle.

    The alphabet bounds what the driver gets, not the number of documents.
    """

    small_batches(docs.sparkSession)

    @released
    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()
        n: Counter[str] = Counter()
        for pdf in it:
            for t in pdf[text_col]:
                words.update(_PLAIN.findall((t or "").lower()))
            if len(words) > MOST_WORDS:
                n.update(trigrams(words))
                words.clear()
        n.update(trigrams(words))
        yield pd.DataFrame(list(n.items()), columns=["gram", "n"])

    counts = docs.select(text_col).mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counts.toLocalIterator()}


def normalised(text: str | None, model: Letters, seen: dict[str, str]) -> str:
    """The plain words of a text, lower-cased, with one space between and around them, then the restored ones.

    ``seen`` remembers restorations of tokens.
    """
    text = (text or "").lower()
    plain = _NOT_LETTERS.sub(" ", f" {text} ")
    more = [m[0] for m in _APART.finditer(text)]
    more += [t for t in set(text.split()) if not t.strip(_EDGES).isalpha()]
    more += [w for w in set(plain.split()) if w[2:3] and _STRETCHED.search(w)] if _STRETCHED.search(plain) else []
    words = []
    for t in more:
        w = seen.get(t)
        if w is None:
            if len(seen) > 100_000:
                seen.clear()
            core = t.strip(_EDGES + "()[]{}").rstrip("!")
            odd = " " in t or _STRETCHED.search(core) or _SIGNED.search(core) or len(core) >= 3 and "." not in core and _ODD.search(core)
            w = model.restore(core) if odd else ""
            if len(t) <= 200:  # longer ones hardly come again
                seen[t] = w
        if w:
            words.append(w)
    return plain + " ".join(sorted(words)) + " " if words else plain


def features(word: str) -> list[str]:
    """A word with its bounds and its 4- and 5-grams: what may occur in a normalised text."""
    p = f" {word} "
    return [p, *(p[i : i + n] for n in (4, 5) for i in range(len(p) - n + 1))]


@dataclass
class Scorer:
    letters: Letters
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.seen: dict[str, str] = {}
        self.find = ahocorasick.Automaton()
        for k, (f, _) in enumerate(sorted(self.weights.items())):
            self.find.add_word(f, k)
        self.find.make_automaton()
        self.values = [v for _, v in sorted(self.weights.items())]

    def __getstate__(self) -> dict:
        return {"letters": self.letters, "weights": self.weights, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: the bias and the weight of every feature that occurs, once."""
        if not self.weights:
            return np.full(len(texts), self.bias)
        found = ({k for _, k in self.find.iter(normalised(t, self.letters, self.seen))} for t in texts)
        return np.array([self.bias + math.fsum(self.values[k] for k in f) for f in found])


def fit(texts: list[str | None], labels: np.ndarray, lm: Letters, rounds: int = 120, select: int = 70, l1: float = 2.5e-3) -> Scorer:
    """Logistic regression on the features that occur in a text; an L1 penalty selects, then they are fitted without it.

    Features are hashed to DIM places while fitting; the model keeps the features themselves.
    """
    seen: dict[str, str] = {}
    words = [set(normalised(t, lm, seen).split()) for t in texts]
    places = {w: np.array([xxhash.xxh32_intdigest(f) & (DIM - 1) for f in features(w)], dtype=np.int32) for w in set().union(*words)}
    rows = [np.unique(np.concatenate([places[w] for w in d])) if d else np.zeros(0, dtype=np.int32) for d in words]
    del words
    y = labels.astype(np.float64)
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    del rows
    keep = np.bincount(flat, minlength=DIM) >= 3
    if len(flat):  # a place that is as common with either label can't carry weight under the penalty
        pos = np.bincount(flat, weights=y[of], minlength=DIM) / max(1, y.sum())
        neg = np.bincount(flat, weights=1 - y[of], minlength=DIM) / max(1, (1 - y).sum())
        keep &= np.abs(pos - neg) > 4 * l1
    place = np.cumsum(keep) - 1
    sel = keep[flat]
    col, row, k = place[flat[sel]], of[sel], int(keep.sum())
    del flat, of, sel
    w = np.zeros(k)
    share = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
    b = math.log(share / (1 - share))
    g2 = np.full(k, 1e-8)
    for r in range(rounds if len(y) else 0):
        z = b + np.bincount(row, weights=w[col], minlength=len(y))
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(col, weights=err[row], minlength=k) / len(y)
        g2 += g * g
        step = 0.3 / np.sqrt(g2)
        w = w - step * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1) * (1 - 1e-3)
        b -= 0.5 * err.mean()
        if r == select:
            l1 = 0.0
            again = (np.abs(w) > 1e-2)[col]
            w[np.abs(w) <= 1e-2] = 0
            col, row, g2 = col[again], row[again], np.full(k, 1e-8)
    full = np.zeros(DIM)
    full[np.flatnonzero(keep)] = w
    live = {word for word, at in places.items() if full[at].any()}
    return Scorer(lm, {f: v for word in live for f, at in zip(features(word), places[word], strict=True) if (v := float(full[at]))}, b)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Fits on at most ``most_rows`` labelled documents whose crc32(identifier) mod FOLDS is not HELD_OUT.

    Which ones is decided by a hash of the identifier, half of the bound for each label; of those, texts longer than
    TRAIN_CHARS are left out. A document labelled 0 and 1 counts as 1; of texts that repeat an identifier the first in
    order is learned from; rows without an identifier are not. The trigram model of the channel is counted over all documents.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) != HELD_OUT
    own = labels.filter(F.col("toxic").isNotNull() & fold).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("id", F.lit("sample")), F.col("id")]
    picked = own.filter("toxic = 1").orderBy(*order).limit(most_rows // 2).union(own.filter("toxic = 0").orderBy(*order).limit(most_rows // 2))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.length("text") <= TRAIN_CHARS)
    sample = texts.join(F.broadcast(picked), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    got = sorted((r["id"], r["text"], r["toxic"]) for r in sample.toLocalIterator())
    return fit([t for _, t, _ in got], np.array([y for _, _, y in got], dtype=np.float64), letters(corpus_trigrams(docs, text_col)))


def score(docs: DataFrame, model: Scorer, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1) to all columns; null and empty texts get the model's bias. A column score is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the bounded sample bounds it

    @released
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(it, text_col, CHUNK_CHARS):
            z = shared.value.logits(pdf[text_col].tolist())
            yield pdf.assign(score=1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.mapInPandas(run, schema_with(docs, "score double"))


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Text is the only input of a score.

    Texts of any length are restored and scored whole; of restorations that cost the same the one that sorts last is
    taken; extra columns, whatever their names, are not read. Without labelled rows every score is the same small prior. Of repeated labels or documents one is
    learned from, see train(). Without an identifier a document is not held out, and its label is never learned from.
    """
    model = train(docs, labels, most_rows)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
