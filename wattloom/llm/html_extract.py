"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: tags, told apart by their path, and text nodes with their path. Per host, tokens with
the same occurrence vector (how often they occur in which page) are an equivalence class. The vectors of all pages of
a host are never gathered: each token keeps the sum of a hash of (page, count) over the pages, which two tokens share
exactly if their vectors do. Such sums add up in any order, so a host with a third of all pages is pre-aggregated like
any other. Classes that occur in enough pages are valid, and their tokens are the host's template. On a page, classes
nest by their paths, and what lies between their tokens are the slots, of any page. A page's text is what its slots
hold; afterwards the slots are checked by region: where some lie in an article or main element, only these count, and
regions whose element or name says that they are not the article never do.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache
from types import MappingProxyType

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, released, small_batches, stored

MIN_PAGES, MIN_SHARE, MIN_TOKENS = 8, 0.3, 3  # a text node is template if its class spans so many pages of the host and such a share
CHUNK_CHARS = 2_000_000
MOST_BROADCAST = 200_000  # tokens of all templates; more are joined by a shuffle

#: Elements of HTML by what they mean for extraction.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe svg math xmp noembed noframes select option datalist".split())
OUTSIDE = frozenset("nav header footer aside form button menu dialog head object canvas audio video search".split())
BLOCK = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open p ends where one of these begins; an open li, dt, dd, tr, td, th or option where its like begins.
ENDS_P = BLOCK - {"html", "body", "tbody", "td", "th", "tr", "thead", "tfoot", "li", "dd", "dt", "legend", "figcaption", "summary"}
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Words that a class, id or role begins or ends with where it marks a region outside the article; and words with
#: which such a name says something about the layout instead ("page-with-sidebar").
NAMES = re.compile(
    r"ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|footer|header|masthead|topbar|toolbar|cookies?|consent|gdpr|"
    r"notice\w*|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|comments?|commentlist|respond|reply|"
    r"replies|disqus|pagination|pager|widget\w*|skip|navigation|contentinfo|complementary|hidden",
    re.I,
)
#: Words for reader comments, which are never part of an article; and words that say nothing about what a region is for.
COMMENTS = re.compile(r"comments?|commentlist|respond|responses|reply|replies|disqus|feedback|discussion", re.I)
NEUTRAL = frozenset("area bar block bottom box button buttons col column container content fixed float floating full global icon icons inner item items left link links list main outer page post primary right row secondary section site slot sticky top unit width wrap wrapper".split())
LAYOUT = frozenset("has no not non with without is show hide hides hiding js can allow allows".split())
LEAD_WORDS = 5  # of a paragraph before an article that belongs to it, at least
MOST_DEPTH = 512  # what is nested deeper is read as if it were not, as browsers do
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!|;|$)", re.I)
_NUMBER = re.compile(r"[0-9]+")
_ARTICLE = re.compile(r"(?:^|/)(?:article|main)(?:[./]|$)")
_SPACE = re.compile(r"\s+")
_CUT = {"script", "style", "textarea", "title", "xmp", "noscript", "iframe", "template", "noembed", "noframes"}


def named_outside(names: str) -> int:
    """2 where a name is of a region outside any article, 1 where only outside an article it can be taken for one, else 0.

    Names that hold nothing but words of NAMES and NEUTRAL, or that begin or end with a word for comments, are of the
    first kind. Of the second are others that begin or end with a word of NAMES, such as "social-history".
    """
    most = 0
    for name in names.split():
        parts = [x for x in re.split(r"[-_]+", name.lower()) if x]
        if not parts or not LAYOUT.isdisjoint(parts):
            continue
        known = [bool(NAMES.fullmatch(x)) for x in parts]
        if COMMENTS.fullmatch(parts[0]) or COMMENTS.fullmatch(parts[-1]):
            return 2
        if known[0] or known[-1]:
            most = max(most, 2 if all(k or x in NEUTRAL or x.isdigit() or x == "#" for k, x in zip(known, parts, strict=True)) else 1)
    return most


def read_attributes(attrs: str) -> tuple[str, int, bool]:
    """(names, whether they mark a region outside the article as named_outside() says, whether the element isn't shown) of a tag's attributes."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))  # of two the first counts, as in browsers
    names = " ".join(found[k] for k in ("class", "id", "role") if k in found)
    unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_NO_DISPLAY.search(found.get("style", "")))
    return _NUMBER.sub("#", names.lower().replace("/", "|")), named_outside(names), unseen


_short_attributes = lru_cache(maxsize=4096)(read_attributes)


def text_nodes(page: str | None) -> Iterator[tuple[str, int, str]]:
    """(path, block, text) of the text nodes that can be shown: block numbers the runs between block boundaries.

    The path has tag names with their class, numbers in it left open, and a '!' before the region that is outside the
    article, if any. Unclosed and stray tags are tolerated as browsers do.
    """
    page = page or ""
    stack: list[tuple[str, str, bool]] = []  # tag, its part of the path, outside
    deeper: Counter[str] = Counter()  # open tags beyond MOST_DEPTH
    block, at, size, raw, path = 0, 0, len(page), 0, None
    find = _MARKUP.search

    def close(k: int) -> None:
        nonlocal block, raw, path
        if any(s[0] in BLOCK or s[2] for s in stack[k:]):
            block += 1
        raw -= sum(s[0] in RAW for s in stack[k:])
        path = None
        del stack[k:]

    def here() -> str:
        nonlocal path
        if path is None:
            path = "/".join(("!" if s[2] else "") + s[1] for s in stack)
        return path

    while at < size:
        m = find(page, at)
        end = m.start() if m else size
        if end > at and not raw:
            yield here(), block, page[at:end]
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                yield here(), block, html.escape(m[0][9:].removesuffix("]]>"), quote=False)
            continue
        if m[1]:
            if deeper[tag]:
                deeper[tag] -= 1
                block += tag in BLOCK
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                block += tag in BLOCK
            continue
        if tag == "br":
            block += 1
            continue
        if tag in VOID:
            block += tag == "hr"
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag in LIKE:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in LIKE[tag]:
                    close(k)
                    if tag != "tr":
                        break
                elif stack[k][0] in STOPS.get(tag, BLOCK):
                    break
        attrs = m[3] or ""
        names, apart, unseen = (_short_attributes if len(attrs) < 500 else read_attributes)(attrs) if attrs else ("", 0, False)
        within = (apart == 1 or tag == "header") and any(s[0] in ("article", "main") for s in stack)
        outside = unseen or (tag in OUTSIDE and not (tag == "header" and within)) or (apart > within and tag not in ("html", "body", "article", "main"))
        if attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in BLOCK or outside:
            block += 1
        if tag in _CUT:  # nothing inside is markup
            e = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = e.end() if e else size
            continue
        if len(stack) >= MOST_DEPTH and (not (outside or tag in RAW) or any(s[2] for s in stack)):  # a region counts at any depth
            deeper[tag] += 1
            continue
        stack.append((tag, f"{tag}.{names}" if names else tag, outside))
        raw += tag in RAW
        path = None


def clean(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text)).strip()


def blocks_of(page: str | None) -> list[tuple[str, str, str]]:
    """(key, path, text) of each block: the text nodes of one block joined, white space one space, empty ones left out.

    The key, path and text hashed, is the token that equivalence classes are built of.
    """
    out: list[tuple[str, str, list[str]]] = []
    number = -1
    for path, block, text in text_nodes(page):
        if block != number:
            out.append((path, "", []))
            number = block
        out[-1][2].append(text)
    done = []
    for path, _, parts in out:
        if text := clean("".join(parts)):
            done.append((path, text))
    return [(xxhash.xxh64_hexdigest(f"{p}\0{t}".encode("utf-8", "surrogatepass")), p, t) for p, t in done]


def occurrence_sums(pages: DataFrame) -> DataFrame:
    """(host, token, pages, vector) of (page_id, host, html): vector is the order-free sum that stands for the vector.

    A batch of pages is folded before it is shuffled. Tokens are the blocks of each page and the paths of them.
    """

    small_batches(pages.sparkSession)

    @released
    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(it, "html", CHUNK_CHARS):
            n: dict[tuple[str, int], list[int]] = {}
            for host, page_id, page in zip(pdf["host"], pdf["page_id"], pdf["html"], strict=True):
                counts: Counter[str] = Counter()
                for key, path, _ in blocks_of(page):
                    counts[key] += 1
                    counts["/" + path] += 1
                for token, c in counts.items():
                    t = (host, token_of(token))
                    v = xxhash.xxh64_intdigest(f"{page_id} {c}".encode()) >> 16  # 48 bits: sums of 32,768 pages stay exact in a long, more wrap as one
                    e = n.setdefault(t, [0, 0])
                    e[0] += 1
                    e[1] = (e[1] + v) & 0xFFFFFFFFFFFF
            yield pd.DataFrame([(h, t, c, v) for (h, t), (c, v) in n.items()], columns=["host", "token", "pages", "vector"])

    sums = pages.mapInPandas(fold, "host string, token long, pages long, vector long")
    return sums.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.expr("sum(CAST(vector AS DECIMAL(20,0))) % 281474976710656").alias("vector"))


def template(pages: DataFrame) -> DataFrame:
    """(host, token, class) of the template: tokens of valid equivalence classes.

    A class is valid if it spans enough pages of the host and has MIN_TOKENS tokens, at least: one line that many
    articles share is no template.
    """
    size = pages.groupBy("host").agg(F.count("*").alias("all"))
    sums = occurrence_sums(pages).filter(F.col("pages") >= MIN_PAGES).join(size, "host")
    sums = stored(sums.filter(F.col("pages") >= MIN_SHARE * F.col("all")).select("host", "token", "pages", "vector"))
    valid = sums.groupBy("host", "pages", "vector").agg(F.count("*").alias("m")).filter(F.col("m") >= MIN_TOKENS)
    return sums.join(valid, ["host", "pages", "vector"], "left_semi").select("host", "token", F.xxhash64("pages", "vector").alias("class"))


def token_of(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass")) - (1 << 63)


def nest(blocks: list[tuple[str, str, str]], known: Mapping[int, int]) -> dict[int, tuple[tuple[str, ...], int | None]]:
    """Of each class on a page: its root, the path that its tokens share, and the class that it is nested in.

    That is the class with the longest root around its own, of equal roots the one that begins before it.
    """
    roots: dict[int, tuple[str, ...]] = {}  # in the order that classes begin on the page
    for key, path, _ in blocks:
        parts = tuple(path.split("/"))
        for c in dict.fromkeys((known.get(token_of("/" + path)), known.get(token_of(key)))):
            if c in roots:  # two elements of one path have their parent in common
                old = roots[c]
                roots[c] = old[: next((i for i, (a, b) in enumerate(zip(old, parts[:-1])) if a != b), min(len(old), len(parts) - 1))]
            elif c is not None:
                roots[c] = parts
    tree: dict[int, tuple[tuple[str, ...], int | None]] = {}
    last: dict[tuple[str, ...], int] = {}
    for c, root in sorted(roots.items(), key=lambda x: len(x[1])):  # stable: outer roots first, then as they begin
        tree[c] = root, next((last[root[:k]] for k in range(len(root), -1, -1) if root[:k] in last), None)
        last[root] = c
    return tree


def slots(blocks: list[tuple[str, str, str]], known: Mapping[int, int]) -> list[tuple[int | None, tuple[str, str, str]]]:
    """(class, block) of the blocks that the template does not hold: the innermost class that the slot is of."""
    if not known:
        return [(None, b) for b in blocks]
    inner = {root: c for c, (root, _) in nest(blocks, known).items()}
    out = []
    for b in blocks:
        if token_of(b[0]) not in known:
            parts = tuple(b[1].split("/"))
            out.append((next((inner[parts[:k]] for k in range(len(parts), -1, -1) if parts[:k] in inner), None), b))
    return out


def extract(page: str | None, known: Mapping[int, int] = MappingProxyType({})) -> str:
    """The text of the slots of one page, given the class of each of the template's tokens.

    The template decides on every page, inside articles too. Regions only check the slots that are left: those outside
    an article or main element go, if the page has one, but for paragraphs right before it.
    """
    blocks = blocks_of(page)
    kept = [b for _, b in slots(blocks, known) if "!" not in b[1]]
    first = next((i for i, b in enumerate(kept) if _ARTICLE.search(b[1])), None)
    if any(_ARTICLE.search(p) for _, p, _ in blocks if "!" not in p):
        lead = len(kept) if first is None else first
        around = "" if first is None else kept[first][1][: _ARTICLE.search(kept[first][1]).start()]
        while first is not None and lead and re.fullmatch(re.escape(around) + r"/?p(\.[^/]*)?", kept[lead - 1][1]) and kept[lead - 1][2].count(" ") >= LEAD_WORDS - 1:
            lead -= 1
        kept = [b for i, b in enumerate(kept) if _ARTICLE.search(b[1]) or (first is not None and lead <= i < first)]
    return "\n".join(text for _, _, text in kept)


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null html counts as empty; pages without an article have an empty text. Null urls share one host. Hosts with few
    pages have no template, and their pages are told apart by regions alone. Repeated rows count as pages each and come out
    each, extra columns are not read, an empty table gives an empty result. Pages of any length are read whole, in time
    that grows with their length. Templates beyond MOST_BROADCAST tokens meet the pages in a join on the host, where
    Spark's skew join splits the pages of a hot host.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    found = stored(template(base.select("page_id", "host", "html")))
    # a token is in MIN_SHARE of its host's pages, so a host has at most the mean number of blocks a page / MIN_SHARE
    by_host = found.groupBy("host").agg(F.map_from_entries(F.collect_set(F.struct("token", "class"))).alias("known"))
    few = found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    with_template = base.join(F.broadcast(by_host) if few else by_host, "host", "left")

    @released
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[str, dict[int, int]] = {}
        for pdf in chunks(it, "html", CHUNK_CHARS):
            texts = []
            for h, page, known in zip(pdf["host"], pdf["html"], pdf["known"], strict=True):
                if h not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[h] = dict(known) if known is not None else {}
                texts.append(extract(page, sets[h]))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    id_type = base.schema["page_id"].dataType.simpleString()
    return with_template.mapInPandas(run, f"page_id {id_type}, url string, text string, n_chars long")
