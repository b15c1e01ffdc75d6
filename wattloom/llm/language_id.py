"""Language identification by multilingual mixture inference.

A model holds, for every learned language, smoothed character n-gram log-likelihoods. A document is a bag of words;
each word's likelihood under a language follows from its n-grams. Expectation-maximisation estimates the document's
language proportions, and of the nested language sets that backward elimination goes through, the one with the best
penalised likelihood (the logarithm of the number of words, times PENALTY, for each further language) is selected. All
documents of a batch are estimated together with array operations. Only texts go to Python workers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, released, small_batches

#: Training: at most about this many documents of each language, chosen by a hash of the identifier, and this many of
#: its most frequent n-grams, so that a language with few words keeps its own.
SAMPLE_PER_LANGUAGE = 2_000
GRAMS_PER_LANGUAGE = 20_000
ORDER, ADD = 3, 0.5
ITERATIONS, PENALTY = 8, 1.0
CHUNK_CHARS = 500_000
CACHE_WORDS = 100_000
LONGEST = 24  # longer runs of letters (scripts without spaces) are cut into pieces of this length
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]{0,%d}" % (LONGEST - 1))
HELD_OUT, FOLDS = 0, 5


@dataclass
class Model:
    languages: list[str]
    grams: dict[str, int]  # n-gram -> row of logp
    logp: np.ndarray  # [n-grams + 1, languages]; the last row is an unseen n-gram's

    def __post_init__(self) -> None:
        self.forget()

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "grams": self.grams, "logp": self.logp}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        """Drops the words that are remembered."""
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.languages)), dtype=np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """The row in ``table`` of each word."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            get, unseen = self.grams.get, len(self.grams)
            ids, at = [], []
            for w in new:
                at.append(len(ids))
                p = f"^{w}$"
                ids.extend([get(p[i : i + ORDER], unseen) for i in range(len(p) - ORDER + 1)])
            first, last = len(known), len(known) + len(new)
            if last > len(self.table):
                self.table = np.concatenate([self.table[:first], np.zeros((2 * last - first, len(self.languages)), dtype=np.float32)])
            self.table[first:last] = np.add.reduceat(self.logp[ids], at, axis=0)
            known.update(zip(new, range(first, last), strict=True))
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows with a language, whose crc32(identifier) mod FOLDS is not HELD_OUT.

    The bounded sample is about ``per_language`` documents of each language; n-gram counts are added up on the
    executors, and the driver gets at most GRAMS_PER_LANGUAGE n-grams of each language, ties by their letters.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS))
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold != HELD_OUT)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    share = labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("share"))
    pick = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    sample = labelled.join(F.broadcast(share), "lang").filter(pick).select("lang", "text")

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[tuple[str, str], int] = defaultdict(int)
        words: dict[tuple[str, str], int] = defaultdict(int)
        for pdf in it:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                for w in words_of(text):
                    words[lang, w] += 1
        for (lang, w), c in words.items():
            p = f"^{w}$"
            for i in range(len(p) - ORDER + 1):
                n[lang, p[i : i + ORDER]] += c
        yield pd.DataFrame([(k[0], k[1], c) for k, c in n.items()], columns=["lang", "gram", "n"])

    counts = sample.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    by_gram = counts.groupBy("gram").agg(F.min("place").alias("place"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    top = sorted(by_gram.filter(F.col("place") <= GRAMS_PER_LANGUAGE).select("gram", "by").toLocalIterator(), key=lambda r: r["gram"])
    languages = sorted({lang for r in top for lang in r["by"]})
    column = {lang: i for i, lang in enumerate(languages)}
    grams = {r["gram"]: i for i, r in enumerate(top)}
    n = np.zeros((len(top) + 1, len(languages)))
    for i, r in enumerate(top):
        for lang, c in r["by"].items():
            n[i, column[lang]] = c
    # P(third letter | first two), backed off to P(third letter), each with additive smoothing
    prefixes: dict[str, int] = {}
    head = np.array([prefixes.setdefault(g[:-1], len(prefixes)) for g in grams] + [len(prefixes)])
    lasts: dict[str, int] = {}
    last = np.array([lasts.setdefault(g[-1], len(lasts)) for g in grams] + [len(lasts)])
    by_head, by_last = np.zeros((len(prefixes) + 1, len(languages))), np.zeros((len(lasts) + 1, len(languages)))
    np.add.at(by_head, head, n)
    np.add.at(by_last, last, n)
    alphabet = len(lasts) + 1
    single = (by_last + ADD) / (by_last.sum(axis=0) + ADD * alphabet)
    weight = 2.0
    logp = np.log((n + weight * single[last]) / (by_head[head] + weight))
    return Model(languages, grams, logp)


def proportions(model: Model, docs: list[list[str]], iterations: int = ITERATIONS, penalty: float = PENALTY) -> np.ndarray:
    """[documents, languages] of documents that have words: proportions under the selected language set."""
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]])
    n = np.array([len(d) for d in docs], dtype=np.float64)
    of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    rows = model.rows([w for d in docs for w in d])
    # equal words of one document are one weighted row
    key, weight = np.unique(of * (len(model.table) + 1) + rows, return_counts=True)
    of, rows = key // (len(model.table) + 1), key % (len(model.table) + 1)
    at = np.searchsorted(of, np.arange(len(docs)))
    weight = weight.astype(np.float32)[:, None]
    ll = model.table[rows]
    base = ll.max(axis=1)
    p = np.exp(ll - base[:, None])
    base = np.add.reduceat(base * weight[:, 0], at)
    k = len(model.languages)
    alive = np.ones((len(docs), k), dtype=bool)
    pi = np.full((len(docs), k), 1 / k, dtype=np.float32)
    best, chosen = np.full(len(docs), -np.inf), pi.copy()
    for left in range(k, 0, -1):
        for _ in range(iterations):
            e = p * pi[of]
            e *= weight / (e.sum(axis=1, keepdims=True) + 1e-30)
            pi = np.add.reduceat(e, at, axis=0) / n[:, None].astype(np.float32)
        fit = np.add.reduceat(np.log((p * pi[of]).sum(axis=1) + 1e-30) * weight[:, 0], at) + base
        score = fit - penalty * np.log(n + 1) * (left - 1)
        better = score > best
        best[better], chosen[better] = score[better], pi[better]
        if left > 1:
            alive[np.arange(len(docs)), np.where(alive, pi, np.inf).argmin(axis=1)] = False
            pi = np.where(alive, np.maximum(pi, 1e-4), 0).astype(np.float32)
            pi /= pi.sum(axis=1, keepdims=True)
    return chosen


def mixture_of(text: Column, model: Model, docs: DataFrame, penalty: float = PENALTY) -> Column:
    """struct<lang_pred, score, mixture> of a text column of docs; nothing but the text is sent to Python workers."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by GRAMS_PER_LANGUAGE for each language

    @F.pandas_udf("lang_pred string, score double, mixture map<string,double>")
    @released
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in chunks((t.to_frame("text") for t in it), "text", CHUNK_CHARS):
            bags = [words_of(t) for t in part["text"]]
            full = [i for i, b in enumerate(bags) if b] if m.languages else []
            lang, score, mix = ["und"] * len(bags), [0.0] * len(bags), [{} for _ in bags]
            if full:
                pi = proportions(m, [bags[i] for i in full], penalty=penalty)
                top = pi.argmax(axis=1)
                for j, i in enumerate(full):
                    lang[i], score[i] = m.languages[top[j]], float(min(1.0, pi[j, top[j]]))
                    mix[i] = {m.languages[x]: float(pi[j, x]) for x in np.flatnonzero(pi[j] > 0.005)}
            yield pd.DataFrame({"lang_pred": lang, "score": score, "mixture": mix})
        m.forget()

    return run.asNondeterministic()(text)  # so that a filter on the outcome isn't a second run


def predict(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Adds lang_pred, score (its estimated share of the words) and mixture (language -> share) to all columns.

    Text is the only input. Null texts and texts without a letter are ``und`` with score 0; letters are those of
    Unicode's category L, with the marks on them. Of languages with equal shares the alphabetically first is named.
    Texts of any length are read whole; each row is judged by itself, so repeated rows come out alike. Columns of
    those names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "mixture")
    made = "_made" + "_" * max(map(len, docs.columns))  # no column's name
    rows = docs.withColumn(made, mixture_of(F.col(text_col), model, docs, penalty))
    return rows.select(*docs.columns, f"{made}.lang_pred", f"{made}.score", f"{made}.mixture")


def language_id(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, mixture. See train() and predict().

    An empty table, or one without labelled rows, gives ``und`` throughout. Without an identifier a document is not held
    out, and its language is never learned from.
    """
    model = train(docs, per_language)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "mixture")
