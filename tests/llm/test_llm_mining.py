"""Collocations, divergence and packing: against brute force on small tables, and on odd and empty ones."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wattloom.llm import collocations, common, divergence, oracle, packing

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n..", "en", "b"), (4, "New York, new york! New\tYork is new; Ä Ö ä", "en", "a"), (4, "New York, new york! New\tYork is new; Ä Ö ä", "en", "a"),
    (5, "new york new york new york", "en", "b"), (6, "x x x x x x x", None, "a"), (7, "x x x x\x0bx x", None, None), (None, "neu ist new york\r\nneu ist das", "de", "c"), (8, "wort " * 3000, "de", "c"),
    (9, "中文 字 中文 字 😀 \x00 中文 字", "zh", "d"), (10, "<|endoftext|> it's 12345", "en", ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with what operators make."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("own") for c in ("id", "n", "hi", "phrase", "words", "term", "a", "b", "v", "rank", "lane", "rest", "ids", "start")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# collocations


def brute_collocations(rows, least, most=5, top=2000):
    n, f = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    inside = Counter()
    for (lang, p), a in found.items():
        for i, j in itertools.combinations(range(len(p) + 1), 2):
            if j - i < len(p):
                inside[lang, p[i:j]] = max(inside[lang, p[i:j]], a)
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if 100 * inside[lang, p] < 100 * a:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top], 1))


@pytest.mark.parametrize(("least", "slots", "bits"), [(2, 4_000_000, 28), (2, 5, 10), (3, 4_000_000, 28)])
def test_collocations_brute_force(odd, monkeypatch, least, slots, bits):
    """Also in many rounds, and with bit maps too small to filter anything."""
    monkeypatch.setattr(collocations, "MOST_BITS", max(bits, collocations.BLOCK_BITS))
    got = sorted(tuple(r) for r in collocations.collocations(odd, least=least, most_slots=slots).collect())
    assert got == brute_collocations(ROWS, least)
    assert len(got) > 3


def test_collocations_sql_and_top(docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(oracle._op11(least=4)).fetchall()  # noqa: SLF001
    got = collocations.collocations(docs.repartition(37), least=4).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    top = collocations.collocations(docs, least=4, most_rank=3).collect()
    assert sorted(tuple(r) for r in top) == sorted(w for w in want if w[1] <= 3)


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, (5000, 2), dtype=np.uint64), axis=0).T.copy()
    table = collocations.PerfectHash.of(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(keys.shape[1]))
    assert (table.keys[:, table.slots(keys)] == keys).all()
    assert (table.slots(rng.integers(0, 1 << 63, (2, 20_000), dtype=np.uint64)) == -1).all()
    near = keys.copy()
    near[1] ^= np.uint64(1)  # same first half
    assert (table.slots(near) == -1).all()
    assert collocations.PerfectHash.of(keys[:, :0]).slots(keys[:, :3]).tolist() == [-1] * 3


def test_tree_sum(spark):
    rng = np.random.default_rng(2)
    size, parts, total = 200_000, [], np.zeros(200_000, dtype=np.int64)
    for lane in range(40):
        tally = collocations.Tally(size if lane % 2 else collocations.MOST_SLOTS + 1)  # by array and by sorting
        at = rng.integers(0, size, 500)
        np.add.at(total, at, 1)
        tally.add(at)
        parts += tally.take(lane).values.tolist()
    out = collocations.tree_sum(spark.createDataFrame([(int(b), int(n), bytes(x), bytes(y)) for b, n, x, y in parts], collocations._COUNTS), 40)  # noqa: SLF001
    got = np.zeros(size, dtype=np.int64)
    for r in out.collect():
        got[(r.block << collocations.BLOCK_BITS) + np.frombuffer(r.at, dtype="<u2").astype(int)] = np.frombuffer(r.n, dtype="<i8")
    assert (got == total).all()


@pytest.mark.parametrize("tokens", [1, 7, 40, 10_000])
def test_runs_end_at_breaks(monkeypatch, tokens):
    """Runs hold every piece whole and in order, long pieces too; lists of words hold every count."""
    monkeypatch.setattr(collocations, "RUN_TOKENS", tokens)
    monkeypatch.setattr(collocations, "LIST_WORDS", 5)
    texts = ["a b c\nd e", "", "\n\n", " ".join(f"w{i % 13}" for i in range(30)), "z", "a b\n" * 20]
    out = pd.concat(collocations._tokenised(iter([pd.DataFrame({"lang": "x", "text": texts})])))  # noqa: SLF001
    name = dict(zip(map(bytes, collocations.word_hashes("x", words := [w for part in out["words"].dropna() for w in part]).T.copy()), words, strict=True))
    pieces, counts = [], Counter(dict(zip(words, (n for part in out["n"].dropna() for n in part), strict=True)))
    for h, c in out[["hashes", "codes"]].dropna().itertuples(index=False):
        hashes, codes = collocations._decoded(h, c)  # noqa: SLF001
        assert codes[-1] == 0
        named = [name.get(bytes(x), "\n") for x in hashes.T.copy()]
        run = [named[k] for k in codes]
        ended = "".join(w if w == "\n" else w + " " for w in run).split("\n")[:-1]
        assert len(run) <= tokens or len(ended) == 1
        pieces += ended
    want = [" ".join(p.split()) for t in texts for p in t.split("\n")]
    assert [p.strip() for p in pieces] == want
    assert counts == Counter(" ".join(want).split())


@pytest.mark.parametrize("numbered", [["a", "b", "c", "d"], ["a", "c"], []])
def test_runs_keep_frequent_words(numbered):
    """Frequent words beside each other stay in order, others are breaks; those without a number stand by their hashes."""
    known = ["a", "b", "c", "d"]
    keys = collocations.word_hashes("x", known)
    top = np.zeros(1 << (collocations.BLOCK_BITS - 3), dtype=np.uint8)
    at = (collocations.phrase_keys(keys, np.arange(4), 1)[0] >> np.uint64(64 - collocations.BLOCK_BITS)).astype(int)
    np.bitwise_or.at(top, at >> 3, (1 << (at & 7)).astype(np.uint8))
    table = collocations.PerfectHash.of(collocations.word_hashes("x", numbered).copy() if numbered else keys[:, :0])
    words = collocations.Words(table, None if len(numbered) == len(known) else (top, collocations.BLOCK_BITS))
    texts = ["a b rare1 c d\na", "rare2", "", "a rare3 b", "b\nc", "d c b a\n"]
    out = pd.concat(collocations._tokenised(iter([pd.DataFrame({"lang": "x", "text": texts})]), False, True, SimpleNamespace(value=words)))  # noqa: SLF001
    assert out["words"].isna().all()
    name = dict(zip(map(bytes, keys.T.copy()), known, strict=True))
    runs = [[name.get(bytes(h.T[c].copy()), "|") for c in codes] for _, h, codes in collocations._opened(iter([out]), SimpleNamespace(value=words))]  # noqa: SLF001
    assert [" ".join(r) for r in runs] == ["a b | c d | d c b a |"]


@pytest.mark.parametrize("kind", ["<u2", "<u4", "<u8", "<i8"])
def test_packed_numbers(kind):
    top = np.iinfo(kind).max
    for values in ([], [0], [top, 0, 1, top], [5] * 1000):
        assert collocations._unpacked(collocations._packed(np.array(values, dtype=kind)), kind).tolist() == values  # noqa: SLF001


def test_counts_are_sent_small():
    """Two bytes for a bucket that is met once or twice; ten stood there."""
    at = np.random.default_rng(3).integers(0, 1 << 23, 300_000)
    tally = collocations.Tally(1 << 23)
    tally.add(at)
    rows = tally.take(0)
    assert sum(map(len, rows["at"])) + sum(map(len, rows["n"])) < 2 * len(np.unique(at))


def test_collocations_disk(spark):
    """What is written on the way is less than the texts; runs with a hash for every word alone were more than these."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    with common.passing(spark) as made:
        assert collocations.collocations(docs, least=20).count() > 0
        written = sum(f.stat().st_size for path in made for f in Path(path.removeprefix("file://")).rglob("*.parquet"))
    assert 0 < written < docs.agg(F.sum(F.octet_length("text"))).first()[0]


def test_collocations_empty(odd):
    assert collocations.collocations(odd.filter("false")).collect() == []
    assert collocations.collocations(odd.filter("text IS NULL"), least=1).collect() == []


# divergence


def brute_divergence(rows, least=3, most=200, scale=10**9):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = re.findall(divergence.TERM, (text or "").translate(LOWER))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in {x for x, _ in counts}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        of = {s: c for (x, s), c in counts.items() if x == lang}
        share = {}
        for s, c in {**of, None: sum(of.values(), Counter())}.items():
            total = sum(c[t] for t in kept) + len(kept)
            share[s] = {t: 1 + scale * (c[t] + 1) // total for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for s in of:
            pairs = [(-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in of if o != s]
            terms = [(-f(share[s][t], share[None][t]), t.encode()) for t in kept if of[s][t] and share[s][t] > share[None][t]]
            for part, found, cut in (("pair", pairs, None), ("term", terms, most)):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(sorted(found)[:cut], 1)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_divergence_brute_force(odd, least):
    got = sorted(tuple(r) for r in divergence.source_divergence(odd, least_docs=least).collect())
    assert got == brute_divergence(ROWS, least)


def test_divergence_small_table(docs):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    got = sorted(tuple(r) for r in divergence.source_divergence(docs, most_terms=7).collect())
    assert got == brute_divergence(rows, most=7)


def test_divergence_empty(odd):
    assert divergence.source_divergence(odd.filter("false")).collect() == []


# packing


def checked(rows, got, window):
    """Every id is in one piece, sequences have no gaps, and only powers of two are shorter than the window."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = Counter()
    for doc, text in rows:
        want[doc, tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])] += 1
    pieces = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, r.doc_tokens, ids))
    made = Counter()
    for doc, found in pieces.items():
        copies = defaultdict(list)
        for start, n, ids in sorted(found, key=lambda p: (p[1], p[0])):
            copies[n, start].append(ids)
        texts = [(n, k) for n, at in copies if at == 0 for k in range(len(copies[n, 0]))]
        for n, k in texts:  # copies of one identifier and length are equal or told apart by order in these tables
            ids = []
            while len(ids) < n:
                ids += copies[n, len(ids)][k]
            made[doc, tuple(ids)] += 1
    assert made == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length, filled in sorted(parts):
            assert offset == at
            at += length
        assert at == filled <= window
        assert at == window or at & (at - 1) == 0
        short += at < window
    assert short <= math.log2(window)


@pytest.mark.parametrize("window", [16, 1024])
def test_pack_round_trip(odd, window):
    """With a small window copies are cut alike, as the same rest has the same plan only where its number allows."""
    rows = [(i, t) for i, t, _, _ in ROWS]
    one = odd.dropDuplicates(["doc_id", "text"])
    checked(list(dict.fromkeys(rows)), packing.pack(one, window=window).collect(), window)
    both = packing.pack(odd, window=window).agg(F.sum("length")).first()[0]
    assert both == sum(len(packing.encoding(packing.default_tokenizer()).encode_ordinary(t or "")) + 1 for _, t in rows)


def test_pack_table(docs):
    got = packing.pack(docs.repartition(7), window=256).collect()
    checked([(r.doc_id, r.text) for r in docs.collect()], got, 256)
    digests = packing.pack_digests(docs, window=256).collect()
    assert {r.ids_crc32 for r in digests if r.doc_tokens == r.length and r.length > 99} == {zlib.crc32(r.ids) for r in got if r.doc_tokens == r.length and r.length > 99}


def test_pack_empty(odd):
    assert packing.pack(odd.filter("false")).collect() == []


def test_combinations_fill_the_window():
    for window in (2, 3, 7, 12):
        want = {tuple(sorted(c)) for k in (2, 3) for c in itertools.product(range(1, window), repeat=k) if sum(c) == window}
        assert {tuple(x for x in c if x) for c in packing.combinations(window).tolist()} == want


def test_nnls_against_all_supports():
    """The least squares over every set of columns, of those without a negative number."""
    columns = packing.combinations(7)
    dense = np.zeros((7, len(columns)))
    for j, c in enumerate(columns):
        np.add.at(dense[:, j], c[c > 0], 1)
    rng = np.random.default_rng(4)
    for _ in range(20):
        counts = rng.integers(0, 2000, 7)
        counts[0] = 0
        chosen, x = packing.nnls(columns, counts)
        best = min(
            (np.linalg.norm(dense[:, s] @ y - counts) for k in range(1, 7) for s in map(list, itertools.combinations(range(len(columns)), k)) if (y := np.linalg.lstsq(dense[:, s], counts, rcond=None)[0]).min() >= -1e-9),
        )
        assert np.linalg.norm(dense[:, chosen] @ x - counts) <= best + 0.5


def test_plan_places_every_rest_once():
    rng = np.random.default_rng(5)
    for counts in (rng.integers(0, 50, 64), np.eye(64, dtype=int)[40] * 1000, np.zeros(64, dtype=int), np.arange(64) * 10**9):
        plan = packing.plan(counts, 64)
        covered, filled = defaultdict(list), Counter()
        for length, lo, hi, start, size, *_ in plan.rows:
            covered[length].append((lo, hi, start, start + size))
        for length in range(1, 64):
            assert sum((hi - lo) * (b - a) for lo, hi, a, b in covered[length]) == length * counts[length]
            for (lo, hi, a, b), (lo2, hi2, a2, b2) in itertools.combinations(covered[length], 2):
                assert hi <= lo2 or hi2 <= lo or b <= a2 or b2 <= a
        for _, lo, hi, _, size, _, _, whole in plan.rows:
            filled[whole] += (hi - lo) * size
        assert all(whole == 64 or n == whole for whole, n in filled.items())
