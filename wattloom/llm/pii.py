"""Personal data by weak supervision.

Emails, IP addresses, card and phone numbers follow fixed patterns and always count. Further candidates (secrets,
numbers of persons and accounts, contacts written otherwise, names after a title) are voted on by labelers: patterns,
gazetteers and context words, each of which says yes, no or nothing. Expectation-maximisation over the votes of all
candidates of the corpus estimates how reliable each labeler is on each kind and how likely each vote pattern is personal
data; a logistic span classifier learns these probabilities from features of the span and decides. Both are fitted on
counts by feature pattern: all candidates count, and what reaches the driver is bounded by the number of patterns. Texts
are searched once: the spans found are written down, and the decision is a filter of them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, released, small_batches, stored

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("secret", "number", "contact", "name")
THRESHOLD = 0.5
CHUNK_CHARS = 2_000_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")  # digits alone are a number, a failed card or none of these, but no secret

_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}={0,2}")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.,-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|[0-9]{9,15})(?![0-9A-Za-z])")
_CONTACT = re.compile(r"(?<![0-9A-Za-z+])(?<![0-9][ ./-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ ./-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[ .-][0-9])|[A-Za-z0-9._-]{2,40} ?[\[(]at[\])] ?[A-Za-z0-9-]{2,40}(?: ?[\[(]dot[\])] ?|\.)[A-Za-z]{2,10}")
_NAME = re.compile(r"\b(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?)\b\.? [A-ZÀ-Þ][\w'-]{1,30}(?: [A-ZÀ-Þ][\w'-]{1,30})?")

#: Fixed values of the labelers.
CUES = {
    "secret": re.compile(r"(?:token|secret|passw(?:or)?d|passwort|api[_ -]?key|key|bearer|credential|contraseña|clé)\W{0,6}$", re.I),
    "number": re.compile(r"(?:ssn|social security|iban|account|konto|cuenta|compte|passport|tax id|id|no|nr|number|nummer|número)\W{0,6}$", re.I),
    "contact": re.compile(r"(?:tel|telefon|teléfono|téléphone|phone|call|fax|mobile|cell|contact|mail|reach)\w{0,6}\W{0,6}$", re.I),
    "name": re.compile(r"(?:name|from|dear|by|signed|von|de|por|par)\W{0,4}$", re.I),
}
ANTI = re.compile(r"(?:isbn|version|commit|sha\d*|md5|checksum|order|total|price|page|figure|http\S*|www\.\S*|[$€£#])\W{0,4}$", re.I)
GIVEN = frozenset("anna ana alice bob carlos carmen claire david elena emma eva felix hans jean john jose juan julia karl laura lea lena louis luis marc maria marie mark max michael miguel paul pedro peter pierre robert sara sophie thomas".split())
PREFIXES = ("sk-", "pk-", "ghp_", "gho_", "xox", "AKIA", "AIza", "eyJ")
IBAN_LANDS = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches of the fixed patterns that pass their checks."""
    out = []
    end = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                end = m.end()
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 2 or len(p.lstrip("0")) == 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


class Taken:
    """Spans that are in use, sorted. Base spans of two kinds can overlap, so they are kept as their union."""

    def __init__(self, spans: list[tuple[str, int, int]]) -> None:
        self.at: list[tuple[int, int]] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.at and a < self.at[-1][1]:
                self.at[-1] = self.at[-1][0], max(b, self.at[-1][1])
            else:
                self.at.append((a, b))

    def free(self, start: int, end: int) -> bool:
        k = bisect_left(self.at, (end, 0))
        return k == 0 or self.at[k - 1][1] <= start

    def add(self, start: int, end: int) -> None:
        insort(self.at, (start, end))


def votes(kind: str, span: str, before: str, after: str) -> tuple[int, int, int, int]:
    """What the labelers say: the shape's pattern, the gazetteers, context words for it, context words against it."""
    digits = sum(c.isdigit() for c in span)
    shape = gazetteer = 0
    if kind == "secret":
        mixed = digits >= 1 and any(c.isalpha() for c in span)
        shape = 1 if mixed and len(set(span)) >= 8 else -1
        gazetteer = 1 if span.startswith(PREFIXES) else 0
    elif kind == "number":
        shape = 1 if "-" in span or span[:2].isalpha() else 0
        gazetteer = (1 if span[:2] in IBAN_LANDS else -1) if span[:2].isalpha() else 0
    elif kind == "contact":
        shape = 1 if 9 <= digits <= 12 or "at" in span else -1
        gazetteer = 1 if span.rsplit(".", 1)[-1].lower() in ("com", "org", "net", "de", "fr", "es") else 0
    else:
        shape = 1
        gazetteer = 1 if span.split()[1].lower() in GIVEN else 0
    return shape, gazetteer, 1 if CUES[kind].search(before) else 0, -1 if ANTI.search(before) or after[:1] in "%°" and after else 0


Candidate = tuple[str, int, int, tuple[int, int, int, int], str]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[Candidate]:
    """(kind, start, end, votes, feature pattern) of spans that no base span or earlier candidate overlaps."""
    out: list[Candidate] = []
    taken = Taken(base)
    has_digit = bool(_DIGIT.search(text))
    for kind, pattern, possible in (("secret", _SECRET, has_digit), ("number", _NUMBER, has_digit), ("contact", _CONTACT, has_digit or "at" in text and ("[" in text or "(" in text)), ("name", _NAME, True)):
        if not possible:
            continue
        for m in pattern.finditer(text):
            if (kind == "secret" and not (_DIGIT.search(m[0]) and _LETTER.search(m[0]))) or not taken.free(m.start(), m.end()):
                continue
            before, after = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 8]
            v = votes(kind, m[0], before, after)
            share = sum(c.isdigit() for c in m[0]) * 4 // len(m[0])
            length = min(6, len(m[0]).bit_length())
            out.append((kind, m.start(), m.end(), v, f"{kind}|{length}|{share}|{'/'.join(map(str, v))}"))
            taken.add(m.start(), m.end())
    return out


def reliabilities(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """EM, for each kind by itself: the share of personal data, and P(vote | personal or not): [labeler, class, vote + 1].

    It begins with labelers that are right a little more often than not, which fixes the classes' meaning.
    """
    share, reliable = {}, {}
    start = np.array([[0.5, 0.3, 0.2], [0.15, 0.35, 0.5]])
    for kind in sorted({k for k, _ in counts}):
        own = sorted((v, n) for (k, v), n in counts.items() if k == kind)
        v, n = np.array([x for x, _ in own], dtype=np.int64).reshape(len(own), 4) + 1, np.array([c for _, c in own], dtype=np.float64)
        p, s = np.repeat(start[None], 4, axis=0), 0.5
        for _ in range(rounds):
            like = np.stack([np.prod([p[j, c, v[:, j]] for j in range(4)], axis=0) for c in (0, 1)]) * np.array([[1 - s], [s]])
            post = like[1] / like.sum(axis=0)
            s = ((n * post).sum() + 1) / (n.sum() + 2)
            for j in range(4):
                for c, w in enumerate((n * (1 - post), n * post)):
                    # the beginning counts as 10 votes, so that a labeler that never speaks keeps its meaning
                    p[j, c] = (np.bincount(v[:, j], w, 3) + 10 * start[c]) / (w.sum() + 10)
        share[kind], reliable[kind] = float(s), p
    return share, reliable


def classifier(patterns: dict[str, int], share: dict[str, float], reliable: dict[str, np.ndarray], rounds: int = 300) -> dict[str, float]:
    """Logistic regression on the parts of feature patterns, fitted to EM's probabilities: pattern -> probability.

    A pattern weighs by the logarithm of its count, so that what is common doesn't decide on what is rare.
    """
    parts = {k: [f"{i}:{x}" for i, x in enumerate(k.split("|")[:3])] + [f"v{j}:{x}" for j, x in enumerate(k.split("|")[3].split("/"))] + [f"{k.split('|')[0]}&v{j}:{x}" for j, x in enumerate(k.split("|")[3].split("/"))] for k in patterns}
    names = sorted({x for v in parts.values() for x in v})
    at = {x: i for i, x in enumerate(names)}
    keys = sorted(patterns)
    x = np.zeros((len(keys), len(names)))
    y, n = np.zeros(len(keys)), np.array([math.log1p(patterns[k]) for k in keys], dtype=np.float64)
    for i, k in enumerate(keys):
        x[i, [at[q] for q in parts[k]]] = 1
        v = [int(q) + 1 for q in k.split("|")[3].split("/")]
        kind = k.split("|")[0]
        yes, no = share[kind] * math.prod(reliable[kind][j, 1, q] for j, q in enumerate(v)), (1 - share[kind]) * math.prod(reliable[kind][j, 0, q] for j, q in enumerate(v))
        y[i] = yes / (yes + no)
    w = np.zeros(len(names))
    n /= max(1.0, n.sum())
    for _ in range(rounds if keys else 0):
        err = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) * n
        w -= 2.0 * (x.T @ err) + 1e-4 * w
    score = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return dict(zip(keys, score.tolist(), strict=True))


def learn(got: dict[str, int]) -> dict[str, float]:
    """Feature pattern -> probability that such a span is personal data, from the counts of all candidates."""
    by_votes: Counter[tuple[str, tuple[int, ...]]] = Counter()
    for k, c in got.items():
        kind, _, _, v = k.split("|")
        by_votes[kind, tuple(map(int, v.split("/")))] += c
    return classifier(got, *reliabilities(by_votes))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def searched(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, base, more) of docs (doc_id, text).

    base is the base spans as text, more an array<struct<span, pattern>> of the candidates by kind, then start.
    """
    order = {k: i for i, k in enumerate(MORE_KINDS)}
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    @released
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(it, "text", CHUNK_CHARS):
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                own = base_spans(text)
                more = sorted(candidates(text, own), key=lambda c: (order[c[0]], c[1]))
                n = Counter(k for k, _, _ in own)
                rows.append((i, *(n[k] for k in BASE_KINDS), sha256(joined(own).encode()).hexdigest(), joined(own), [{"span": joined([c[:3]]), "pattern": c[4]} for c in more]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "more"])

    return docs.mapInPandas(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, more array<struct<span:string,pattern:string>>")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more, n_spans.

    The counts and the digest are of the base spans; spans has these and then those that the method adds, by kind as
    listed in BASE_KINDS and MORE_KINDS, then by start, in code points with the end exclusive; n_more counts what the
    method adds and n_spans all. Of candidates that overlap, the one of the earlier kind
    stands, of one kind the leftmost. Null text counts as empty: counts of 0, no spans, the digest of the empty string.
    Texts of any length are searched whole, in time that grows with their length. Repeated rows come out repeated (and
    count as candidates each), an empty table gives an empty result, extra columns are not read.
    """
    found = stored(searched(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))))
    # at most kinds * lengths * shares * votes patterns
    got = {r["pattern"]: r["n"] for r in found.select(F.explode("more.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    good = F.array(*[F.lit(k) for k, p in sorted(learn(got).items()) if p >= threshold]).cast("array<string>")
    kept = F.transform(F.filter("more", lambda c: F.array_contains(good, c["pattern"])), lambda c: c["span"])
    out = found.withColumn("kept", kept)
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("kept") > 0, F.array_join("kept", ",")))
    n_more = F.size("kept").cast("long")
    n_spans = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + n_more
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), n_more.alias("n_more"), n_spans.alias("n_spans"))
