"""Vector and keyword retrieval: filter, then rank by exact cosine distance.

The query side is the small, stated side: blocks of MOST_QUERIES queries are a matrix that every task multiplies its rows
with, Arrow batch by Arrow batch, keeping the k nearest of each query, so a partition sends k rows a query. A task holds
CELLS distances at a time, whatever the number of rows and queries that it was given. Where rows and queries must share a key (a scope, a keyword, a list of an index), pieces of rows and blocks of queries meet by it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import dot, similarity
from ..schemas import SCOPE_BOOST
from ..sources.scratch import written

#: Tables that may be searched, with their vector and text columns.
SEARCHABLE = {"outage_catalog": ("signature_vec", "root_cause"), "agent_reasoning": ("reasoning_vec", "observation"), "fleet_memory": ("memory_vec", "content"), "charger_windows": ("signature_vec", None)}
MOST_QUERIES = 4_000
BLOCK_ROWS = 2_000
#: Rows of a piece where all rows are one key, and distances that a task holds at a time.
PIECE_ROWS, CELLS = 16_000, 1_000_000
#: Cells of a key, and by how much the rounding of distances may widen their bounds.
MOST_PIVOTS, MARGIN = 32, 1e-6
#: Of a distance that count: copies tie, whatever blocks they fall in.
DIGITS = 12
log = logging.getLogger(__name__)


def check_searchable(table: str, vector: str, text: str | None = None) -> None:
    if table not in SEARCHABLE or SEARCHABLE[table][0] != vector or text not in (None, SEARCHABLE[table][1]):
        raise ValueError(f"not searchable: {table}.{vector}, {text}")


def optional(rows: DataFrame, **equal: object) -> DataFrame:
    """Equality filters; None and 'any' switch one off."""
    for c, v in equal.items():
        if v is not None and v != "any":
            rows = rows.filter(F.col(c) == F.lit(v))
    return rows


def starts_with(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column begins with the prefix, taken as it is written."""
    return rows.filter(F.col(column).startswith(prefix))


def in_scope(rows: DataFrame, scope: str | list[str]) -> DataFrame:
    """Rows of the scope (or scopes) and global ones; 'any' keeps all."""
    scopes = [scope] if isinstance(scope, str) else scope
    return rows if "any" in scopes else rows.filter(F.col("scope").isin(*scopes, "global"))


def has_keyword(text: Column, keywords: Column) -> Column:
    """Any keyword as a whole token, whatever its case."""
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_.-]+")
    tokens = F.concat(tokens, F.transform(tokens, lambda t: F.rtrim(t, F.lit("."))))
    return F.arrays_overlap(tokens, F.transform(keywords, lambda k: F.lower(k)))


def nearest(rows: DataFrame, queries: DataFrame, k: int, vector: str = "vec", id_col: str = "id") -> DataFrame:
    """queries (query_id, query_vec, ...) -> their k nearest rows with distance and rank, nearest first, then by id.

    Rows and queries without a vector are left out. Up to MOST_QUERIES queries are broadcast; more of them meet the rows
    in blocks, each two in a task of its own.
    """
    base = rows.filter(F.exists(vector, lambda x: x != 0))
    q = queries.filter(F.exists("query_vec", lambda x: x != 0))
    if q.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES:
        w = Window.partitionBy("query_id").orderBy("distance", id_col)
        return _by_matrix(base, q, k, vector, id_col).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    one = F.lit(0).alias("_all")
    found = nearest_by_key(base.select(one, id_col, vector), q.select(one, "query_id", "query_vec"), "_all", k, vector, id_col, PIECE_ROWS).withColumnRenamed("id", id_col)
    out = base.join(found, id_col).join(q.drop("query_vec"), "query_id")
    return out.select(*base.columns, *[c for c in q.columns if c != "query_vec"], "distance", "rank")


def _units(vectors: pd.Series) -> np.ndarray:
    v = np.array(vectors.tolist(), dtype=np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _closest(rows: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, distance) of the k nearest rows of each query, all units; of ties those with the smallest ids.

    With ``names``, the queries' ids, no row is its own neighbour. Queries are taken a few at a time.
    """
    order = np.argsort(ids, kind="stable")
    rows, ids, most = rows[order], ids[order], min(k, len(ids))
    step, out = max(1, CELLS // max(1, len(ids))), []
    for at in range(0, len(asked), step):
        far = np.round(1.0 - rows @ asked[at : at + step].T, DIGITS)
        if names is not None:
            far[ids[:, None] == names[None, at : at + step]] = np.inf
        limit = np.partition(far, most - 1, axis=0)[most - 1]
        near, tie = far < limit, far == limit
        near |= tie & (np.cumsum(tie, axis=0, dtype=np.int32) <= most - near.sum(axis=0))
        i, j = np.nonzero(near & np.isfinite(far))
        out.append((order[i], j + at, far[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))


def _by_matrix(base: DataFrame, queries: DataFrame, k: int, vector: str, id_col: str) -> DataFrame:
    """Rows of base with the columns of queries and distance: of each query, the k nearest of every partition."""
    shared = base.sparkSession.sparkContext.broadcast(queries.toPandas())  # MOST_QUERIES rows
    names = base.columns
    fields = [*base.schema.fields, *[f for f in queries.schema.fields if f.name != "query_vec"], T.StructField("distance", T.DoubleType())]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        best: pd.DataFrame | None = None
        if len(q):
            asked = _units(q["query_vec"])
            for pdf in it:
                if not len(pdf):
                    continue
                ids = pdf[id_col].to_numpy()
                row, col, far = _closest(_units(pdf[vector]), ids, asked, k)
                found = pd.DataFrame({"_q": col, "distance": far, "_id": ids[row], "_at": row, "_row": None})
                best = found if best is None else pd.concat([best, found], ignore_index=True)
                best = best.sort_values(["_q", "distance", "_id"]).groupby("_q", sort=False).head(k).reset_index(drop=True)
                new = np.flatnonzero(best["_at"] >= 0)
                # copies, so that the batch can go
                kept = {at: tuple(x.copy() if isinstance(x, np.ndarray) else x for x in pdf.iloc[at]) for at in best["_at"].iloc[new].unique()}
                best["_row"] = [kept[at] if at >= 0 else r for at, r in zip(best["_at"], best["_row"], strict=True)]
                best["_at"] = -1
        if best is not None and len(best):
            rows = pd.DataFrame(best["_row"].tolist(), columns=names, dtype=object)
            more = q.drop(columns="query_vec").iloc[best["_q"].to_numpy()].reset_index(drop=True)
            yield pd.concat([rows, more, best["distance"].reset_index(drop=True)], axis=1)

    return base.mapInPandas(run, T.StructType(fields))


def nearest_by_key(rows: DataFrame, queries: DataFrame, key: str, k: int, vector: str = "vec", id_col: str = "id", block: int = BLOCK_ROWS, not_self: bool = False) -> DataFrame:
    """(query_id, id, distance, rank): of each query (key, query_id, query_vec), the k nearest rows of its keys.

    A query may have several keys and a row too; each row counts once. The rows of a key are dealt into pieces of about
    ``block`` rows and its queries into blocks of MOST_QUERIES; a piece and a block meet in one task as a matrix product,
    which holds CELLS distances at a time and sends k rows a query. A hot key is many tasks, and no pairs are emitted. Keys without rows or without queries
    are left out before anything is dealt.
    """
    base = rows.filter(F.col(key).isNotNull() & F.exists(vector, lambda x: x != 0)).select(key, F.col(id_col).alias("id"), F.col(vector).alias("v"))
    q = queries.filter(F.col(key).isNotNull() & F.exists("query_vec", lambda x: x != 0)).select(key, "query_id", F.col("query_vec").alias("v"))
    pieces = base.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("pieces"))
    blocks = q.groupBy(key).agg(F.ceil(F.count("*") / MOST_QUERIES).cast("int").alias("blocks"))
    both = written(pieces.join(blocks, key))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = base.join(both, key).withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int")).withColumn("block", each("blocks")).select(key, "piece", "block", "id", "v")
    right = q.join(both, key).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("piece", each("pieces")).select(key, "piece", "block", "query_id", "v")

    def top(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(q):
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        ids, asked = r["id"].to_numpy(), q["query_id"].to_numpy()
        i, j, far = _closest(_units(r["v"]), ids, _units(q["v"]), k, asked if not_self else None)
        return pd.DataFrame({"query_id": asked[j], "id": ids[i], "distance": far})

    fields = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("id", base.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    at = [key, "piece", "block"]
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(top, fields)
    found = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def postings(rows: DataFrame, text: str, id_col: str = "id") -> DataFrame:
    """The keyword index: (term, id) of every distinct token of a text, as has_keyword() takes them."""
    tokens = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9_.-]+")
    tokens = F.array_distinct(F.concat(tokens, F.transform(tokens, lambda t: F.rtrim(t, F.lit(".")))))
    return rows.select(F.explode(tokens).alias("term"), F.col(id_col).alias("id")).filter("term != ''")


POSTING_BUCKETS = 256


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(POSTING_BUCKETS)).cast("int")


def write_postings(rows: DataFrame, path: str, text: str, id_col: str = "id") -> None:
    """Writes the keyword index once: folders by a hash of the term, terms sorted in each file."""
    dealt = postings(rows, text, id_col).withColumn("bucket", _bucket(F.col("term")))
    # a frequent term is spread over several files of its folder
    dealt.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").mode("overwrite").parquet(path)


def read_postings(spark: SparkSession, path: str, keywords: DataFrame) -> DataFrame:
    """The postings of the keywords (term): only the folders that they fall in are read."""
    buckets = [r.bucket for r in keywords.select(_bucket(F.col("term")).alias("bucket")).distinct().collect()]  # at most POSTING_BUCKETS
    return spark.read.schema("term string, id long, bucket int").parquet(path).filter(F.col("bucket").isin(buckets)).select("term", "id")


def hybrid(rows: DataFrame, queries: DataFrame, k: int, vector: str = "vec", text: str | None = None, id_col: str = "id", index: str | None = None) -> DataFrame:
    """queries (query_id, query_vec, keywords): where a query has keywords and there is a text column, only rows with one.

    Adds ft_used. A keyword in no row is an answer of no rows. An unknown text column is logged and not used. Queries
    with keywords meet only the postings of their terms, of the index that write_postings() has left at ``index`` or of
    one made here; the others meet all rows. Row columns follow without the vector.
    """
    if text is not None and text not in rows.columns:
        log.warning("FULLTEXT_FALLBACK: no column %s", text)
        text = None
    used = F.coalesce(F.size("keywords") > 0, F.lit(False)) if text else F.lit(False)
    q = queries.withColumn("ft_used", used)
    plain = nearest(rows.select(id_col, vector), q.filter("NOT ft_used").select("query_id", "query_vec"), k, vector, id_col)
    found = plain.select("query_id", F.col(id_col).alias("id"), "distance", "rank", F.lit(False).alias("ft_used"))
    if text:
        asked = q.filter("ft_used").select("query_id", "query_vec", F.explode(F.array_distinct(F.transform("keywords", lambda w: F.lower(w)))).alias("term"))
        terms = asked.select("term").distinct()
        lists = read_postings(rows.sparkSession, index, terms) if index else postings(rows, text, id_col).join(terms, "term", "left_semi")
        with_vectors = lists.join(rows.select(F.col(id_col).alias("id"), F.col(vector).alias("vec")), "id")
        found = found.unionByName(nearest_by_key(with_vectors, asked, "term", k).withColumn("ft_used", F.lit(True)))
    return found.withColumnRenamed("id", id_col).join(rows.drop(vector), id_col)


def boost_scope(found: DataFrame, scope: str) -> DataFrame:
    """After the top-k: a matching scope's distance shrinks, which can reorder but add no rows; then similarity."""
    d = F.when(F.col("scope") == scope, F.col("distance") * SCOPE_BOOST).otherwise(F.col("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "rank")
    return found.withColumn("distance", d).withColumn("rank", F.row_number().over(w)).withColumn("similarity", similarity(F.col("distance")))


def touch(rows: DataFrame, hits: DataFrame, as_of: str, id_col: str = "id") -> DataFrame:
    """Recall's side effect as a transform of its own: hits are counted and dated."""
    h = hits.select(F.col(id_col).alias("_id")).groupBy("_id").count()
    out = rows.join(h, rows[id_col] == h["_id"], "left")
    seen = {"access_count": F.col("access_count") + F.coalesce("count", F.lit(0)).cast("int")}
    if "last_accessed" in rows.columns:
        seen["last_accessed"] = F.when(F.col("_id").isNotNull(), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("last_accessed"))
    return out.withColumns(seen).select(rows.columns)


def cells_of(live: DataFrame, keys: list[str], block: int = BLOCK_ROWS) -> DataFrame:
    """live (keys, a, v, ...) with ``cell``, the nearest of its key's pivots, and ``far``, the distance to each of them.

    A key has one pivot for each block of rows, MOST_PIVOTS at most: the rows that a hash puts first. Pieces of its rows
    meet the pivots in tasks of their own. A key of one block is one cell without pivots. Null keys are left out.
    """
    parts = live.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    sized = live.join(parts, keys)
    small = sized.filter("parts = 1").select(*live.columns, F.lit(0).alias("cell"), F.array().cast("array<double>").alias("far"))
    large = sized.filter("parts > 1")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("a"), "a"))
    pivots = large.withColumn("at", first).filter(F.col("at") <= MOST_PIVOTS).filter("at <= parts")
    pivots = written(pivots.select(*keys, "parts", "at", F.col("v").alias("pivot")))
    pivots = pivots.select(*keys, "at", "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("piece"))
    pieces = large.withColumn("piece", F.pmod(F.xxhash64("a"), "parts").cast("int")).select(*live.columns, "piece")
    names = live.columns

    def assign(r: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(r):
            return pd.DataFrame({c: [] for c in (*names, "cell", "far")})
        far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (_units(r["v"]) @ _units(p.sort_values("at")["pivot"]).T)))
        return r[names].assign(cell=far.argmin(axis=1), far=list(far))

    at = [*keys, "piece"]
    found = pieces.groupBy(*at).cogroup(pivots.groupBy(*at)).applyInPandas(assign, small.schema)
    return small.unionByName(found)


def cell_pairs(cells: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """(keys, cell, other, n, m, met): each two cells of a key with their rows, and whether they can hold a close pair.

    They cannot where, for some pivot, the distances of one cell's rows and those of the other's lie further apart than
    the limit: by the triangle inequality so do the rows. MARGIN covers what rounding can do.
    """
    each = lambda f: F.array(*(f(F.get("far", F.lit(i))) for i in range(MOST_PIVOTS)))
    bounds = written(cells.groupBy(*keys, "cell").agg(F.count("*").alias("n"), each(F.min).alias("lo"), each(F.max).alias("hi")))
    others = bounds.withColumnsRenamed({"cell": "other", "n": "m", "lo": "lo2", "hi": "hi2"})
    reach = float(np.sqrt(2.0 * max(limit, 0.0))) + MARGIN
    apart = F.exists(F.arrays_zip("lo", "hi", "lo2", "hi2"), lambda b: F.coalesce((b["lo"] - b["hi2"] > reach) | (b["lo2"] - b["hi"] > reach), F.lit(False)))
    return bounds.join(others, keys).select(*keys, "cell", "other", "n", "m", (~apart).alias("met"))


def deal_pieces(cells: DataFrame, met: DataFrame, keys: list[str], block: int = BLOCK_ROWS) -> DataFrame:
    """The rows of cells_of() for each two pieces (``left``, ``right``) of the cells that met names; ``part`` is their own."""
    pieces = lambda n: F.ceil(F.col(n) / block).cast("int")
    number = lambda cell, piece: F.shiftleft(F.col(cell).cast("long"), 32) + piece
    sizes = met.select(*keys, "cell", "other", pieces("n").alias("parts"), pieces("m").alias("others"))
    dealt = cells.drop("far").join(sizes, [*keys, "cell"]).withColumn("part", number("cell", F.pmod(F.xxhash64("a"), "parts")))
    dealt = dealt.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("partner", number("other", F.col("piece")))
    return dealt.withColumns({"left": F.least("part", "partner"), "right": F.greatest("part", "partner")}).drop("cell", "other", "parts", "others", "piece", "partner")


def pairs_within(rows: DataFrame, keys: list[str], limit: float, vector: str = "vec", id_col: str = "id", block: int = BLOCK_ROWS, prune: bool = True) -> DataFrame:
    """(a, b, distance) of rows of one key closer than the limit, a before b. Rows without a vector are left out.

    A key's rows are dealt to cells around pivots, a cell into pieces of about ``block`` rows, and each two pieces whose
    cells can hold a pair are one task's matrix product, so a hot key is many tasks. The product is taken and its pairs are
    sent CELLS distances at a time, so memory doesn't follow the number of pairs. ``prune=False`` compares all cells.
    """
    live = rows.filter(F.col(vector).isNotNull()).select(*keys, F.col(id_col).alias("a"), F.col(vector).cast("array<double>").alias("v"))
    cells = written(cells_of(live.filter(F.exists("v", lambda x: x != 0)), keys, block))
    met = cell_pairs(cells, keys, limit)
    dealt = deal_pieces(cells, met.filter("met") if prune else met, keys, block)
    fields = [*[live.schema[k] for k in keys], T.StructField("a", live.schema["a"].dataType), T.StructField("b", live.schema["a"].dataType), T.StructField("distance", T.DoubleType())]

    def near(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(it), ignore_index=True)  # two pieces
        u, ids, part = _units(pdf["v"]), pdf["a"].to_numpy(), pdf["part"].to_numpy()
        one = pdf["left"].iloc[0] == pdf["right"].iloc[0]  # pairs within a piece are another task's
        rows, others = (np.flatnonzero(part == pdf[side].iloc[0]) for side in ("left", "right"))
        step = max(1, CELLS // max(1, len(others)))
        for at in range(0, len(rows), step):
            left = rows[at : at + step]
            far = 1.0 - u[left] @ u[others].T
            close = far < limit
            close &= ids[left][:, None] < ids[others][None, :] if one else ids[left][:, None] != ids[others][None, :]
            i, j = np.nonzero(close)
            a, b = ids[left[i]], ids[others[j]]
            yield pd.DataFrame({**{k: pdf[k].to_numpy()[left[i]] for k in keys}, "a": np.minimum(a, b), "b": np.maximum(a, b), "distance": far[i, j]})

    return dealt.groupBy(*keys, "left", "right").applyInPandas(near, T.StructType(fields))


def embed(texts: Column, provider: Callable[[pd.Series], pd.Series] | None = None, size: int = 384) -> Column:
    """Vectors of texts by a provider; without one, a fixed hash of the tokens, of unit length."""

    def hashed(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            v = np.zeros(size, dtype=np.float32)
            for w in (t or "").lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % size] += 1.0 if h >> 63 else -1.0
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist() if t else None)
        return pd.Series(out)

    hashed.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(provider or hashed, "array<float>")(texts)
