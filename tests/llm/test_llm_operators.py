"""The dealt operators: against brute force on small fixtures, and on nulls, empty tables, ties and clashing columns."""

import hashlib
import itertools
import math
import os
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F

from wattloom.llm import pipeline as corpus_pipeline
from wattloom.llm import components, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, licenses, oracle, pii, queries, sentencepiece_codec, toxicity, url_filter

SF = "/root/testdata/sf0.001"
LONG = "wort " * 60_000
DOCS = [(1, None, None), (2, "", "en"), (3, "  \n", "en"), (4, "Hello there, General Kenobi speaks", "en"), (5, "hello THERE, General Kenobi speaks", "en"), (5, "hello THERE, General Kenobi speaks", "en"), (6, LONG, "de"), (7, "Ä ö ß 中文 😀 \x00", None), (8, "123 456", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns that clash with what operators make."""
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in DOCS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("own") for c in ("id", "digest", "score", "keep_id", "lang_pred", "mixture", "n", "seed", "rank", "_own_x")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# exact dedup


def test_dedup_brute_force(odd):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = [(i, (t or "").translate(lower)) for i, t, _ in DOCS]
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(odd).collect())
    want = sorted((i, k := max(j for j, u in norm if u == t), sum(u == t for _, u in norm), i == k, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    assert got == want


def test_dedup_many_lanes_and_hot_group(spark):
    df = spark.range(0, 6000, 1, 40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "HOT").otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("text"))
    got = exact_dedup.exact_dedup(df)
    want = df.groupBy(F.lower("text").alias("t")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    assert got.select("keep_id", "group_size").distinct().exceptAll(want.select("keep_id", "group_size")).count() == 0
    assert got.count() == 6000
    assert got.filter("kept").count() == want.count()
    least = exact_dedup.exact_dedup(df, keep="min").filter("group_size = 4000").select("keep_id").distinct().collect()
    assert [r.keep_id for r in least] == [1]


def test_dedup_tree_of_runs(spark):
    """Few entries a run: several runs a lane, pieces, and three binomial rounds; against a plain aggregate."""
    df = spark.range(0, 3000, 1, 20).select(F.col("id"), F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text"))
    rows = df.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("check"), F.length("text").alias("size"))
    for keep, best in (("min", F.min), ("max", F.max)):
        want = rows.groupBy("digest", "check", F.col("size").cast("long").alias("size")).agg(best("id").alias("keep_id"), F.count("*").alias("n"))
        got = exact_dedup.tree_merge(rows, keep, fan_in=2, run_entries=16)
        assert got.count() == want.count()
        assert got.exceptAll(want).count() == 0
    assert exact_dedup.tree_merge(rows, least=500).first().n == 1000


def test_dedup_merge_verifies_every_part():
    pdf = pd.DataFrame({"id": [5, 3, 4, None], "digest": [b"a\0", b"a\0", b"a\0", b"a\0"], "check": [-1, -1, 2, -1], "size": [7, 7, 7, 8]})
    run = exact_dedup.run_of(pdf, "min")
    assert (run.n.tolist(), sorted(run.ids[run.known].tolist())) == ([1, 2, 1], [3, 4])
    both = exact_dedup.merged([run, run], "min")
    assert both.n.tolist() == [2, 4, 2]
    parts = exact_dedup.pieces(both, 3, 4)
    assert set(parts["lane"]) == {3}
    assert sum(len(r.keys) for r in exact_dedup.read_runs(parts)) == 3


# n-gram Jaccard join


def brute_links(texts, n=5, threshold=0.8):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    inverted, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    for v in inverted.values():
        for a in range(len(v)):
            for b in range(a):
                common[v[a], v[b]] += 1
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if c >= threshold * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            links[a] += 1
            links[b] += 1
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("block", [3, 512])
def test_jaccard_brute_force(docs, block):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs, block_texts=block).collect()}
    assert got == brute_links(texts_of(docs))


def test_jaccard_near_copies_and_hot_group(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate([7 + i % 100 for i in range(60)])] + [(100 + i, " ".join(base)) for i in range(50)] + [(200, " ".join(base[:60])), (201, "one two"), (202, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df, block_texts=16).collect()}
    assert got == brute_links(dict(rows))


def test_jaccard_odd(odd, empty):
    got = {r.doc_id: r.class_id for r in jaccard_join.jaccard_join(odd).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_bands():
    bands, rows = jaccard_join.bands_and_rows(0.8, 0.9999, 192)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
    assert bands * rows <= 192


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (7, 7), (400, 400)] + [(1000, 1000 + i) for i in range(200)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(31)} == {0}
    assert (got[300], got[400], got[1199]) == (100, 400, 1000)


@pytest.mark.parametrize("most", [3, 100_000])
def test_hot_keys_are_joined_apart(spark, docs, monkeypatch, most):
    """Hubs and hot bands by the broadcast side, others by the shuffled one, with the same outcome."""
    monkeypatch.setattr(components, "HOT_ROWS", 4)
    monkeypatch.setattr(components, "MOST_HOT", most)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(20)] + [(59, 200), (200, 100)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got.values()) == {0}
    assert len(got) == 82
    rows = spark.createDataFrame([(k, i) for k in range(5) for i in range(k * 3)], "k long, v long")
    keys = spark.createDataFrame([(k, k * 10, k * 3) for k in range(4)], "k long, w long, n long")
    got = sorted(map(tuple, components.join_on_hot_keys(rows, keys, "k", 30).select("k", "v", "w").collect()))
    assert got == [(k, i, k * 10) for k in range(4) for i in range(k * 3)]


@pytest.mark.parametrize("most", [3, 100_000])
def test_components_end_with_stars_and_plans_stay_small(spark, monkeypatch, most):
    """Stars take no round, and no plan of a round repeats the steps before it: the driver keeps the plans of all rounds."""
    plans = []

    def stored(df, write=components.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return write(df)

    monkeypatch.setattr(components, "stored", stored)
    monkeypatch.setattr(components, "HOT_ROWS", 4)
    monkeypatch.setattr(components, "MOST_HOT", most)
    run = lambda edges: {r.id: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert run([(0, i) for i in range(1, 40)] + [(50, 51), (60, 60)]) == {**dict.fromkeys(range(40), 0), 50: 50, 51: 50, 60: 60}
    assert len(plans) == 1
    assert set(run([(i, i + 1) for i in range(30)]).values()) == {0}
    assert max(plans) <= 8


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    got = jaccard_join.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30))


# decontamination


def test_decontaminate(spark, odd, empty):
    item = " ".join(f"b{i}" for i in range(30))
    words = item.split()
    swapped = " ".join(w if i % 7 else "zzz" for i, w in enumerate(words))
    rows = [(1, f"start here {item} and on"), (2, f"more text {swapped} end"), (3, "b1 b5 b9 " * 20), (4, " ".join(f"c{i}" for i in range(40))), (5, " ".join(words[5:20])), (6, None), (7, item[:20]), (8, item.upper().replace(" ", ", "))]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string").withColumn("doc_id", F.lit(9))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("own"))
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench).collect()) == [(1, 1), (2, 1), (5, 1), (8, 1)]
    assert decontaminate.overlaps(empty, bench).count() == 0
    assert decontaminate.overlaps(odd, bench.filter("false")).count() == 0


def test_decontaminate_in_blocks(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.overlaps(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 60)
    monkeypatch.setattr(decontaminate, "PIECE_TOKENS", 16)
    assert decontaminate._blocks(decontaminate.pieces(bench, "item_id", "text")) > 4
    assert sorted(map(tuple, decontaminate.overlaps(docs, bench).collect())) == whole
    assert whole


def test_decontaminate_every_substitution(spark):
    """Aligned overlaps with every choice of substituted tokens, against the best window by brute force."""
    cases = [(n, k) for n in range(1, 15) for k in (0, 1, 2)] + [(14, 3), (15, 3), (16, 3)]
    bench, rows, want = [], [], set()
    for n, k in cases:
        if n < k:
            continue
        item = 100 * n + k
        inner = [f"b{item}x{i}" for i in range(n)]
        long = n >= decontaminate.WINDOW  # then the overlap lies inside a longer item
        bench.append((item, " ".join([f"p{item}", *inner, f"q{item}"] if long else inner)))
        for out in itertools.combinations(range(n), k):
            rows.append((len(rows), " ".join(["one", *("zzz" if i in out else w for i, w in enumerate(inner)), "more", "word"])))
            w = min(n, decontaminate.WINDOW)
            if max(w - sum(s <= i < s + w for i in out) for s in range(n - w + 1)) >= 0.8 * w - 1e-9:
                want.add((len(rows) - 1, item))
    b, d = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(d, b).collect()} == want


def test_decontaminate_very_long_text(spark):
    words = [f"b{i}" for i in range(20)]
    text = "wort " * 100_000 + " ".join(words) + " wort" * 100_000
    df = spark.createDataFrame([(1, text), (2, "wort " * 5)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(f"x{i}" for i in range(5_000)))], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.overlaps(df, bench).collect()] == [(1, 7, 13)]


# licences, urls


def test_licenses(spark, odd, empty):
    mit = licenses.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + mit), (2, mit.upper().replace("SUBLICENSE", "sublicence")), (3, mit + " and more"), (4, None), (5, "Released under the MIT licence"), (6, "© me\n(c) you\nAll rights reserved")]
    got = {r.doc_id: r.license_id for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: "MIT", 6: None}
    assert licenses.license_scan(odd).filter("matched").count() == 0
    assert licenses.license_scan(empty).count() == 0


def canonical(text):
    """By words, in plain Python."""
    lines = [x for x in (text or "").lower().split("\n") if not re.match(r"[ \t*#/;-]*(copyright[ \t]+(\(c\)|©|[0-9])|\(c\)|©|all rights reserved)", x)]
    words = re.findall("[a-z0-9]+", "\n".join(lines))
    for a, b in licenses.EQUIVALENT:
        a, b, out, k = a.split(), b.split(), [], 0
        while k < len(words):
            hit = words[k : k + len(a)] == a
            out += b if hit else [words[k]]
            k += len(a) if hit else 1
        words = out
    return " ".join(words)


def test_licences_planted_against_brute_force(spark):
    rng = np.random.default_rng(4)
    british = {"license": "licence", "favor": "favour", "organization": "organisation", "authorized": "authorised", "sublicense": "sub licence"}
    rows, want = [(0, "favour favour per cent per cent"), (1, "favor favor percent percent")], {0: None, 1: None}
    for i, (name, text) in enumerate(licenses.KNOWN):
        changed = " ".join(british.get(w.lower(), w) for w in re.sub(r"[,.;:]", lambda m: m[0] + rng.choice(["", "-", " * "]), text).split(" "))
        for k, t in enumerate((text.upper(), "Copyright (c) 2001 Somebody\n" + changed, text + " indeed", text[: len(text) // 2])):
            rows.append((10 * i + 10 + k, t))
            want[rows[-1][0]] = name if k < 2 else None
    digest = {hashlib.sha256(canonical(t).encode()).hexdigest(): n for n, t in sorted(licenses.KNOWN, reverse=True)}
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.license_id for i, r in got.items()} == want
    assert all(r.canonical_sha256 == hashlib.sha256(canonical(dict(rows)[i]).encode()).hexdigest() for i, r in got.items())
    assert all(digest.get(r.canonical_sha256) == r.license_id for r in got.values())
    assert got[0].canonical_sha256 == got[1].canonical_sha256  # neighbours are both spelled anew


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="no licence files on this machine")
def test_licences_by_digest(spark):
    rows = [(i, open(f"/usr/share/common-licenses/{n}", encoding="utf-8", errors="replace").read()) for i, n in enumerate(("GPL-3", "Apache-2.0", "MPL-2.0"))]
    got = {r.doc_id: r.license_id for r in licenses.license_scan(spark.createDataFrame(rows + [(9, rows[0][1][:-300])], "doc_id long, text string")).collect()}
    assert got == {0: "GPL-3.0", 1: "Apache-2.0", 2: "MPL-2.0", 9: None}


def test_urls(spark):
    rows = [(1, "https://WWW.Example.COM/en/7?x"), (2, "http://a.com/en/x"), (3, "x://b.example.net/de/81#y"), (4, "x://b.net/de/8"), (5, "no scheme"), (6, None), (7, "x://com/en/"), (8, "x://notcom/en/"), (9, "x://a.org/es/1?://z.com/en/"), (10, "x://y.example.com/en/8"), (11, "x://h.org?q/es/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {
        1: ("www.example.com", "/en/7", "example.com/en/7", "allow"), 2: ("a.com", "/en/x", "com/en/", "block"), 3: ("b.example.net", "/de/81", "example.net/de/8", "block"), 4: ("b.net", "/de/8", "net/de/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("com", "/en/", "com/en/", "block"), 8: ("notcom", "/en/", None, "allow"), 9: ("a.org", "/es/1", "org/es/", "block"), 10: ("y.example.com", "/en/8", "com/en/", "block"), 11: ("h.org", "", None, "allow"),
    }


def test_url_templates_are_rejected_by_purity(spark):
    rows = [(i, f"http://h.io/spam/{i}.html") for i in range(40)] + [(100 + i, f"http://h.io/news/{i}") for i in range(40)] + [(200 + i, f"http://h.io/tag/word{i}x/{i}") for i in range(40)]
    labels = [(i, "block") for i in range(30)] + [(100 + i, "allow") for i in range(30)] + [(200 + i, "block") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("label", F.lit("own"))
    got = {r.page_id: r.verdict for r in url_filter.url_filter(pages, [], spark.createDataFrame(labels, "page_id long, label string")).collect()}
    assert {got[i] for i in range(40)} == {"block"}
    assert {got[i] for i in range(100, 140)} == {"allow"}
    assert {got[i] for i in range(200, 240)} == {"block"}  # words became a wildcard, so unlabelled ones go too


def test_url_templates_of_any_depth(spark):
    rows = [(i, f"http://h.io/a/b/c/d/e/user{i}x/show") for i in range(40)] + [(100 + i, f"http://h.io/a/b/c/d/e/user{i}y/edit") for i in range(30)] + [(200, None), (201, "http://h.io/" + "/".join("s" * 300)), (202, "http://h.io/")]
    labels = [(i, "block") for i in range(30)] + [(100 + i, "allow") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("own") for c in ("host", "segs", "prefix", "template", "rejected")})
    lab = spark.createDataFrame(labels, "page_id long, label string")
    got = {r.page_id: r.verdict for r in url_filter.url_filter(pages, [], lab).collect()}
    assert {got[i] for i in range(40)} == {"block"}  # the sixth level became a wildcard, so unlabelled ones go too
    assert {got[i] for i in (*range(100, 130), 200, 201, 202)} == {"allow"}
    assert url_filter.url_filter(pages.filter("false"), [], lab).count() == 0
    assert url_filter.url_templates(pages.filter("false")).count() == 0


def test_url_templates_are_rejected_on_the_table(spark):
    got = queries.op3_url_templates(spark, "/root/testdata/sf0.1").groupBy("rejected").count().collect()
    assert {r.rejected for r in got} == {True, False}


# html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p>A &amp; b\n  c<p>d<br>e&nbsp;f", "A & b c\nd\ne f"), ("<body><nav>menu</nav><article><h1>T</h1><p>x <b>y</b>z<aside>no</aside></article><footer>f</footer>", "T\nx yz"),
        ("<div class='sidebar'>no</div><div id=content>yes<div class=comments>no</div></div><form>no</form>", "yes"), ("<script>var a='<p>no</p>'</script><style>p{}</style>yes<!-- no -->", "yes"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<ul><li>a<li>b</ul>", "a\nb"), ("<article><p>a<b>bold<p>c</article>", "abold\nc"), ("<main><header>title</header>x</main>", "title\nx"), ("<<p>1 < 2 <3</p>", "<\n1 < 2 <3"),
    ],
)
def test_html_pages(page, text):
    assert html_extract.extract(page) == text


def test_html_templates(spark):
    page = "<html><body><div>Brand</div><div>Home | News</div><div>Imprint</div><p>Story {0} here</p><p>shared line</p><div>{1}</div></body></html>"
    rows = [(i, "http://h.io/x", page.format(i, i * 7)) for i in range(40)] + [(99, None, None), (100, "http://few.io/", page.format(1, 2))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("own"), "text": F.lit("own"), "known": F.lit(1)})
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.html_extract(df).collect()}
    assert got[3] == ("Story 3 here\n21", 15)  # what every page of the host has is its template
    assert got[99] == ("", 0)
    assert got[100][0].startswith("Brand")
    assert html_extract.html_extract(df.filter("false")).count() == 0


def test_html_template_inside_articles(spark):
    page = "<html><body><nav>Home</nav><article><h1>Title {0}</h1><div>Tell your friends</div><p>Story {0} here</p><div>All prices with tax</div></article><footer>Imprint</footer></body></html>"
    rows = [(i, "http://h.io/x", page.format(i)) for i in range(20)] + [(50, "http://few.io/", page.format(50))]
    got = {r.page_id: r.text for r in html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\nStory {i} here" for i in range(20))
    assert got[50] == "Title 50\nTell your friends\nStory 50 here\nAll prices with tax"  # one page has no template


def test_html_classes_against_whole_vectors(spark):
    """The tokens of the template by their vectors over all pages of a host, gathered in plain Python."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        lines = "".join(f"<p>{rng.choice(['one', 'two', 'three', f'own {i}'])}</p>" for _ in range(rng.integers(1, 5)))
        tail = "<div>a</div><div>b</div><div>c</div>" if i % 3 else ""
        rows.append((i, f"h{i % 2}.io", f"<body><div>Brand</div><div>Menu</div>{lines}<div>Imprint</div>{tail}</body>"))
    vectors = defaultdict(dict)
    for i, host, page in rows:
        counts = Counter()
        for key, path, _ in html_extract.blocks_of(page):
            counts[html_extract.token_of(key)] += 1
            counts[html_extract.token_of("/" + path)] += 1
        for t, c in counts.items():
            vectors[host, t][i] = c
    classes = defaultdict(set)
    for (host, t), v in vectors.items():
        if len(v) >= html_extract.MIN_PAGES and len(v) >= html_extract.MIN_SHARE * 30:
            classes[host, tuple(sorted(v.items()))].add(t)
    want = {(host, frozenset(ts)) for (host, _), ts in classes.items() if len(ts) >= html_extract.MIN_TOKENS}
    got = defaultdict(set)
    for r in html_extract.template(spark.createDataFrame(rows, "page_id long, host string, html string")).collect():
        got[r.host, r["class"]].add(r.token)
    assert {(host, frozenset(ts)) for (host, _), ts in got.items()} == want
    assert len(want) >= 4


def test_html_classes_nest():
    blocks = html_extract.blocks_of("<body><div>a</div><article><i>b</i><p>text</p><i>c</i></article><div>d</div></body>")
    known = {html_extract.token_of(k): 1 if t in "ad" else 2 for k, _, t in blocks if t in "abcd"}
    tree = html_extract.nest(blocks, known)
    assert (tree[1][1], tree[2][1]) == (None, 1)
    assert all(t not in "abcd" for _, (_, _, t) in html_extract.slots(blocks, known))


@pytest.mark.parametrize("tag", ['id="page" class="has-sidebar"', 'class="post-header-none no-ads"', 'class="post-reply-allowed"', 'style="overflow: hidden ; color:red"', 'data-id="nav"', 'class="badge add"', 'class="page-with-sidebar"', "title='nav menu'"])
def test_html_layout_words_are_no_region(tag):
    assert html_extract.extract(f"<div {tag}><p>Article text</p></div>") == "Article text"


@pytest.mark.parametrize("tag", ['class="site-header"', "class=sidebar-left", "id='comments'", 'style="color:red; display : none"', "hidden", 'aria-hidden="true"', 'role="navigation"', 'class="x cookie-notice"', 'class="full-width-banner"', 'CLASS=ad'])
def test_html_regions_go(tag):
    assert html_extract.extract(f"<div {tag}><p>no</p></div><p>yes</p>") == "yes"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><div class="social-history"><p>one two</p></div></article>', "one two"),
        ('<article><div id="ad-hoc-methods"><p>one two</p></div></article>', "one two"),
        ('<article><div class="recipe-menu">one two</div><div class="share-buttons">no</div></article>', "one two"),
        ("<article><fieldset>one two</fieldset></article>", "one two"),
        ("<p>x <label>L</label> y</p>", "x L y"),
        ("<form>no <label>L</label><fieldset>no</fieldset></form><p>yes", "yes"),
        ("<body><nav>no</nav><p>This is the lead paragraph here.</p><article><p>body</p></article><p>This is after the article, no.</p>", "This is the lead paragraph here.\nbody"),
        ('<article><p>a</p><div id="feedback"><p>no</p></div><div class="reader-comments">no</div></article>', "a"),
        ("<article>" + "<div>" * 600 + "<nav>no<nav>no</nav>no</nav><p>yes</p>" + "</div>" * 600 + "<p>end</p></article>", "yes\nend"),
        ("<div>" * 600 + "<script>no</script><svg>no</svg><p hidden>no</p>yes", "yes"),
    ],
)
def test_html_fragments(page, text):
    """Nothing of an article is lost by a name that only sounds like a region, and no region stays, however deep."""
    assert html_extract.extract(page) == text


def test_html_time_grows_with_the_length():
    for page in ("<div>" * 60_000 + "x", '<a href="' * 60_000, "<b>x<p>" * 30_000, "<a " * 60_000, "<i>x" * 60_000, "</b>" * 60_000, "<!--" * 60_000):
        began = time.time()
        html_extract.extract(page)
        assert time.time() - began < 20  # seconds where squares would be minutes
    assert html_extract.extract("<div>" * 2_000 + "deep" + "</div>" * 2_000 + "<p>after") == "deep\nafter"


def test_html_repeated_rows_and_long_page(spark):
    rows = [(1, "http://a.io/", "<p>text " * 50_000)] * 2 + [(2, "http://a.io/", "<p>b")]
    got = [(r.page_id, r.n_chars) for r in html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == [(1, 5 * 50_000 - 1)] * 2 + [(2, 1)]


# personal data


def brute_pii(x):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(digits(m[0])) <= 15]


def test_pii_base(docs):
    rng = np.random.default_rng(5)
    cases = [t or "" for t in texts_of(docs).values()] + ["".join(rng.choice(list("0123456789@.+- ()aB%"), rng.integers(0, 60))) for _ in range(3000)] + ["4539578763621486", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "é a@b.cd", "0" * 3000 + ".1.2.3"]
    assert [pii.base_spans(c) for c in cases] == [brute_pii(c) for c in cases]


def test_pii_query(spark, odd, empty):
    rows = [(1, 'mail me a.b@c.de now, token = "8a4e6e1f6463a8c2573135e353846cd2315d3e1e" and Dr. Anna Smith'), (2, None)] + [(10 + i, f"password={hashlib.md5(str(i).encode()).hexdigest()[:18]} is set") for i in range(30)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans.startswith("email:8:16,secret:31:71")
    assert (got[1].n_email, got[1].base_sha256) == (1, hashlib.sha256(b"email:8:16").hexdigest())
    assert (got[2].spans, got[2].base_sha256) == ("", hashlib.sha256(b"").hexdigest())
    assert got[15].spans == "secret:9:27"
    assert pii.find_pii(odd).count() == len(DOCS)
    assert pii.find_pii(empty).count() == 0


def test_reliabilities():
    counts = {("a", (1, 1, 0, 0)): 80, ("a", (-1, -1, 0, 0)): 100, ("a", (1, 0, 0, -1)): 5}
    share, p = pii.reliabilities(counts)
    assert 0.3 < share["a"] < 0.6
    assert p["a"][0, 1, 2] > 0.8 > p["a"][0, 0, 2]
    other = {("b", (-1, 1, 1, 0)): 1000}
    assert np.allclose(pii.reliabilities(counts | other)[1]["a"], p["a"])  # one kind says nothing of another


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 is it", ["number"]), ("his ssn 123-45-6789 now", ["number"]), ("call (030) 555 1234 today", ["contact"]), ("write bob [at] example [dot] com", ["contact"]), ("Dear Dr. Anna Smith, hello", ["name"]),
        ("card 1234 5678 9012 3456 fails", []), ("1234567890123456", []), ("key sk-a8f3k2l9d0s8f7g6h5", ["secret"]),
    ],
)
def test_pii_candidates(text, kinds):
    assert [c[0] for c in pii.candidates(text, pii.base_spans(text))] == kinds


def test_pii_time_grows_with_the_length():
    text = "write a.b@c.de and password=a1b2c3d4e5f6a7b8c9 too; " * 20_000
    began = time.time()
    found = pii.candidates(text, pii.base_spans(text))
    assert time.time() - began < 30  # seconds where squares would be many minutes
    assert len(found) == 20_000


def test_pii_counts_all_spans(docs):
    for r in pii.find_pii(docs).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x]
        n = Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert (r.n_spans, r.n_more) == (len(spans), sum(n[k] for k in pii.MORE_KINDS))
        base = ",".join(":".join(x) for x in spans if x[0] in pii.BASE_KINDS)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        at = [([*pii.BASE_KINDS, *pii.MORE_KINDS].index(k), int(a)) for k, a, _ in spans]
        assert at == sorted(at)


# language, toxicity


def test_language(docs, odd, empty):
    r = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in r.doc_id] == r.held_out.tolist()
    held = r[r.held_out & r.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert r.score.between(0, 1).all()
    got = {x.doc_id: x.lang_pred for x in language_id.language_id(odd).collect()}
    assert (got[1], got[2], got[3], got[8]) == ("und", "und", "und", "und")
    assert got[7] != "und"
    assert language_id.language_id(empty).count() == 0


def plain_mixture(model, words, iterations=language_id.ITERATIONS, penalty=language_id.PENALTY):
    """Expectation-maximisation and backward elimination for one document, word by word."""
    k, n = len(model.languages), len(words)
    like = []
    for w in words:
        p = f"^{w}$"
        rows = [model.grams.get(p[i : i + 3], len(model.grams)) for i in range(len(p) - 2)]
        like.append([sum(model.logp[r][j] for r in rows) for j in range(k)])
    top = [max(x) for x in like]
    p = [[math.exp(x - t) for x in row] for row, t in zip(like, top, strict=True)]
    alive, pi, best = set(range(k)), [1 / k] * k, (-math.inf, None)
    while alive:
        for _ in range(iterations):
            new = [0.0] * k
            for row in p:
                e = [a * b for a, b in zip(row, pi, strict=True)]
                for j in range(k):
                    new[j] += e[j] / (sum(e) + 1e-30)
            pi = [x / n for x in new]
        fit = sum(math.log(sum(a * b for a, b in zip(row, pi, strict=True)) + 1e-30) + t for row, t in zip(p, top, strict=True))
        score = fit - penalty * math.log(n + 1) * (len(alive) - 1)
        if score > best[0]:
            best = score, pi
        alive.discard(min(alive, key=lambda j: (pi[j], j)))
        pi = [max(x, 1e-4) if j in alive else 0.0 for j, x in enumerate(pi)]
        total = sum(pi)
        pi = [x / total for x in pi] if total else pi
    return best[1]


def test_language_brute_force(docs):
    model = language_id.train(docs)
    bags = [b for b in (language_id.words_of(t)[:200] for t in list(texts_of(docs).values())[:40]) if b]
    bags.append(bags[0][:50] + bags[7][:50])
    got = language_id.proportions(model, bags)
    for bag, row in zip(bags, got, strict=True):
        assert np.allclose(row, plain_mixture(model, bag), atol=5e-3)


def test_language_letters():
    assert language_id.words_of("½ ² Ⅷ ① _ 12") == []
    assert language_id.words_of("हिन्दी é") == ["हिन्दी", "é"]  # marks stay with their letters


def test_language_keeps_the_grams_of_small_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "GRAMS_PER_LANGUAGE", 30)
    rows = [(i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + i // 26)}" for k in range(50)), "big") for i in range(300)] + [(1000 + i, "qo qo qo", "small") for i in range(9)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "^qo" in model.grams
    assert len(model.grams) <= 60


def test_language_mixture(docs):
    model = language_id.train(docs)
    t = docs.filter("lang = 'en'").first().text[:3000] + " " + docs.filter("lang = 'fr'").first().text[:3000]
    pi = dict(zip(model.languages, language_id.proportions(model, [language_id.words_of(t)])[0], strict=True))
    assert pi["en"] > 0.15
    assert pi["fr"] > 0.15
    assert pi["en"] + pi["fr"] > 0.9


def test_language_keeps_frequent_languages(spark):
    rows = [(i, "hello there people", "en") for i in range(60)] + [(1000 + i, f"word{chr(97 + i % 26)} other", f"x{i % 230:03}") for i in range(230 * 4)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=10)
    assert "en" in model.languages
    assert len(model.languages) > 200


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(3)
    clean = ["the", "house", "stands", "near", "water", "and", "people", "walk", "there", "often"]
    rows, labels = [], []
    for i in range(1200):
        w = list(rng.choice(clean, 30))
        if i % 4 == 0:
            w[5] = "idiot" if i % 8 else "stupid"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(5000 + k, f"people walk there {w} near the house") for k, w in enumerate(["1d10t", "i d i o t", "i.d.i.o.t", "idiooooot", "IDIOT!!!", "st*pid"])] + [(6000, None), (6001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own"))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("own"))
    r = toxicity.toxicity(df, lab).toPandas().set_index("doc_id")
    assert [zlib.crc32(str(i).encode()) % 3 == 1 for i in r.index] == r.held_out.tolist()
    y = {i: t for i, t in labels}
    assert all(r.predicted[i] == y[i] for i in y)
    assert r.predicted[list(range(5000, 5006))].tolist() == [1] * 6
    assert r.predicted[[6000, 6001]].tolist() == [0, 0]
    assert toxicity.toxicity(odd, lab).count() == len(DOCS)
    assert toxicity.toxicity(odd, lab.filter("false")).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(empty, lab).count() == 0


def test_toxicity_of_repeated_labels_and_documents(spark):
    """Whatever the order of the rows: a document labelled both ways is toxic, the first of its texts is learned from."""
    rows = [(i, f"calm walk number{i} by the river") for i in range(20)] + [(i, f"vile idiot number{i} you fool") for i in range(20, 40)]
    rows += [(21, "a calm walk"), (22, None), (None, "vile idiot")]
    marks = [(i, int(i >= 20)) for i in range(40)] + [(i, 0) for i in range(20, 40)] + [(None, 1), (3, None)]
    models = []
    for turn in (1, -1):
        docs = spark.createDataFrame(rows[::turn], "doc_id long, text string").repartition(3)
        labels = spark.createDataFrame(marks[::turn], "doc_id long, toxic int").repartition(2)
        models.append(toxicity.train(docs, labels))
        out = toxicity.toxicity(docs, labels).toPandas()
        assert not out["held_out"].isna().any()
        assert not out.loc[out["doc_id"].isna(), "held_out"].any()
        assert len(out) == len(rows)
    once = toxicity.train(spark.createDataFrame([r for r in rows[:40] if r[0] not in (21, 22)] + [(21, "a calm walk"), (22, "")], "doc_id long, text string"), spark.createDataFrame(marks[:40], "doc_id long, toxic int"))
    assert models[0].weights == models[1].weights
    assert models[0].weights.keys() == once.weights.keys()


def test_held_out_without_identifier(spark):
    docs = spark.createDataFrame([(None, "ein kleiner Wald", "de"), (1, "a small wood", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.held_out for r in language_id.language_id(docs).collect()} == {None: False, 1: zlib.crc32(b"1") % 5 == 0}


def test_toxicity_letters_of_all_documents(spark):
    docs = spark.createDataFrame([(i, "plain words") for i in range(20)] + [(100, "qxj unlabelled qxj"), (101, None), (102, "aaah")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert "qxj" in toxicity.train(docs, labels).letters.logp
    assert toxicity.corpus_trigrams(docs) == toxicity.trigrams(Counter("plain words".split() * 20 + ["qxj", "unlabelled", "qxj"]))


def test_toxicity_restores_whole_runs():
    lm = toxicity.letters(toxicity.trigrams(Counter("people walk there near the house idiot".split())))
    apart = " ".join("peoplewalkthere" * 20 + "idiot")
    assert toxicity.normalised(apart, lm, {}).split()[-1] == "peoplewalkthere" * 20 + "idiot"
    joined = "people_walk_there_near_the_house_near_the_1d10t"
    assert len(joined) > 40
    assert toxicity.normalised(joined, lm, {}).split()[-1] == "peoplewalktherenearthehousenearthe" + "idiot"
    assert len(lm.restore("a" * 5000 + " b")) >= 1
    apart = " ".join("near" * 125 + "the" * 165 + "idiot")  # 1,000 letters, one sign between each two
    assert len(apart) > 1990
    assert toxicity.normalised(apart, lm, {}).split()[-1].endswith("idiot")
    assert len(toxicity.features("x" * 60)) > 100  # long words have their letter n-grams too


def test_toxicity_viterbi_against_all_paths():
    lm = toxicity.letters(toxicity.trigrams(Counter("people walk there near the house idiot stupid ass bad good water".split() * 3 + ["hat", "as", "at"])))

    def all_paths(token):
        stretched = {i for m in re.finditer(r"(.)\1\1+", token) for i in range(m.start() + 1, m.end())}
        found = [("^^", 0.0, "")]
        for i, ch in enumerate(token):
            own = ([(ch, 0.0)] if ch.isalpha() else []) + [(c, toxicity.CHANNEL) for c in toxicity.LEET.get(ch, "")]
            found = [
                x
                for ctx, cost, out in found
                for x in [(ctx[1:] + c, cost + pay + lm.logp.get(ctx + c, lm.unseen), out + c) for c, pay in own]
                + ([(ctx, cost + toxicity.DROP, out)] if not ch.isalpha() and (ch in " .-_*" or not own) else [])
                + ([(ctx, cost + toxicity.REPEAT, out)] if i in stretched and out else [])
            ]
        done = defaultdict(lambda: -math.inf)
        for ctx, cost, out in found:
            done[out] = max(done[out], cost + lm.logp.get(ctx + "$", lm.unseen))
        return done

    rng = np.random.default_rng(8)
    tokens = ["1d10t", "st*p1d", "i-d-i-0-t", "a$$", "aaassss", "b4d", "@@@", "***"] + ["".join(rng.choice(list("aeidots14$*.-"), rng.integers(2, 7))) for _ in range(200)]
    for t in tokens:
        paths = all_paths(t)
        best = max(paths.values())
        assert math.isclose(paths[lm.restore(t)], best, abs_tol=1e-9), t  # of words with equal costs either stands


def test_toxicity_very_long_text(spark):
    """The insult stands obfuscated at the end of a text too long for the sample; it is scored whole all the same."""
    clean = "the house stands near water and people walk there often".split()
    rows = [(i, " ".join(clean[(i + k) % 10] for k in range(20)) + (" idiot" if i % 2 else "")) for i in range(400)]
    filler = "the house stands near water " * 30_000
    more = [(9001, filler + "1d10t"), (9002, filler), (9003, "i d i o t " + filler)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(9001, 1), (9002, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(spark.createDataFrame(rows + more, "doc_id long, text string"), labels).filter("doc_id > 9000").collect()}
    assert got == {9001: 1, 9002: 0, 9003: 1}


# SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)


def test_pieces_equal_the_library(docs, library):
    with open(sentencepiece_codec.MODEL, "rb") as f:
        coder = sentencepiece_codec.Coder(f.read())
    rng = np.random.default_rng(9)
    parts = ["a", "e", "th", " ", "  ", "the ", "ing", "é", "中", "😀", "\n", "0", "▁", "    ", "er", "<0x0A>", "<s>", "\x00", "un"]
    cases = ["", " ", "a" * 300, " " * 40 + "x", "中文字符测试" * 20, LONG[:9000]] + ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(1000)] + [t or "" for t in texts_of(docs).values()]
    got = coder.encode_batch(cases)
    assert got == [library.encode(c) for c in cases]
    assert [coder.decode(g) for g in got] == [c.replace("▁", " ") for c in cases]


def test_codec_frames(odd, empty, library):
    enc = sentencepiece_codec.encode(odd)
    got = [(r.text, list(r.token_ids), r.decoded) for r in sentencepiece_codec.decode(enc).collect()]
    assert all(ids == library.encode(t or "") and back == (t or "") for t, ids, back in got)
    assert sentencepiece_codec.encode_digests(odd).filter("round_trip").count() == len(DOCS)
    assert sentencepiece_codec.encode(empty).count() == 0


# pipeline and queries


def test_pipeline_brute_force(spark, docs, library):
    """Each stage against plain Python on what the stage before has kept."""
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        have, kept = texts_of(now), {r.doc_id for r in out.collect()}
        assert kept <= set(have)
        if name == "language_id":
            found = {r.doc_id: r for r in language_id.predict(now.select("doc_id", "text"), language_id.train(now)).collect()}
            assert kept == {i for i, r in found.items() if any(c.isalpha() for c in have[i] or "") and max(r.mixture.values(), default=0) >= corpus_pipeline.LEAST_SHARE - 1e-6}
            assert len(kept) > 0.97 * len(have)
        elif name == "exact_dedup":
            last = {}
            for i, t in have.items():
                k = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                last[k] = max(i, last.get(k, i))
            assert kept == set(last.values())
        elif name == "jaccard_join":
            assert kept == {root for root, _ in brute_links(have).values()}
        elif name == "decontaminate":
            con = duckdb.connect()
            con.register("documents", now.toPandas())
            con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
            assert kept == set(have) - {r[0] for r in con.sql(oracle.ORACLE["op9_decontaminate"]).fetchall()}
        elif name == "sentencepiece":
            assert kept == set(have)
            assert all(list(r.token_ids) == library.encode(r.text) for r in out.collect())
        assert out.columns[: len(docs.columns)] == docs.columns
        now = out


def test_exact_stage_judges_rows_by_their_text(spark):
    rows = [(5, "text a"), (5, "text b"), (9, "TEXT a"), (9, "TEXT a"), (None, "text a"), (3, "text b")]
    out = corpus_pipeline.exact_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(map(tuple, out.collect()), key=str) == [(5, "text b"), (9, "TEXT a"), (None, "text a")]


def test_pipeline_without_identifiers(spark):
    """Rows without an identifier pass every stage but the first, which reads the text alone."""
    text = " ".join(f"wort{chr(97 + i % 26)}" for i in range(40))
    rows = [(None, text), (None, text), (1, text), (2, text.upper()), (None, None), (None, "12 34")]
    now = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("x"), "_made": F.lit("own")})
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        want = {"language_id": 4, "exact_dedup": 3}.get(name, now.count())
        assert now.count() == want
    assert sorted((r.doc_id for r in now.collect()), key=str) == [2, None, None]


def test_repeated_identifiers_are_judged_by_text(spark):
    """Id 5 has a near copy of id 3's text and one of its own, which must stay."""
    a = " ".join(f"wort{chr(97 + i % 26)}{i}" for i in range(60))
    own = " ".join(f"other{i}" for i in range(50))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(3, a), (5, a + " more"), (5, own), (7, own + " last"), (7, item), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    joined = sorted((r.doc_id or -1, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df).collect())
    assert joined == [(-1, 3, 2), (3, 3, 2), (5, 3, 2), (5, 5, 1), (7, 5, 1), (7, 7, 0)]
    kept = corpus_pipeline.near_stage(spark, df, SF)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, a), (5, own), (7, item), (None, a)], key=str)
    clean = corpus_pipeline.benchmark_stage(spark, df, SF)
    assert sorted(map(tuple, clean.collect()), key=str) == sorted((r for r in rows if r[1] != item), key=str)


def test_pipeline_odd(spark, odd, empty):
    for df, n in ((odd, 4), (empty, 0)):
        now = df
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        assert now.drop("token_ids").columns == df.columns
        assert now.count() <= n


@pytest.mark.parametrize("name", ["op2_html_extract", "op4_pii", "op6_sentencepiece"])
def test_queries_cover_their_tables(spark, name):
    n = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op2') else 'documents'}.parquet").count()
    assert queries.QUERIES[name](spark, SF).count() == n
