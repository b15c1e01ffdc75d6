"""Queries for vectors and keywords. Thresholds are those that the test vectors can meet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import KEYWORDS, extract_keywords, similarity
from ..operators import ann
from ..operators import retrieval as R
from ..sources.adapters import table
from ..sources.scratch import scratch_dir


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    scope = F.when(F.col("vec_id") % 5 == 0, "global").otherwise(F.concat(F.lit("site:"), (F.col("vec_id") % 3).cast("string")))
    text = F.element_at(F.array(*map(F.lit, ("ground GroundFailure seen", "coastal air", "fan slow", "Firmware 3.1.2 loop"))), (F.col("vec_id") % 4 + 1).cast("int"))
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label", scope.alias("scope"), text.alias("content"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _rows(spark, sf_dir).filter("id % 20 = 0")
    words = F.when(F.col("id") % 40 == 0, F.array(F.lit("GroundFailure"), F.lit("coastal"))).when(F.col("id") % 60 == 0, F.array(F.lit("InternalError"))).otherwise(F.array().cast("array<string>"))
    return q.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), words.alias("keywords"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nearest(_rows(spark, sf_dir), _queries(spark, sf_dir), 5).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"), F.round(similarity(F.col("distance")), 3).alias("similarity"))


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hybrid(_rows(spark, sf_dir), _queries(spark, sf_dir), 5, text="content").select("query_id", "id", "rank", "ft_used", F.round("distance", 6).alias("distance"))


def _ann(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    path = f"{scratch_dir(spark)}/ann-{uuid.uuid4().hex}"
    ann.build_index(_rows(spark, sf_dir), path)
    return ann.search(spark, path, _queries(spark, sf_dir), 10, exact=exact).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ann(spark, sf_dir, exact=False)


def ann_topk_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ann(spark, sf_dir, exact=True)


def scoped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.in_scope(R.optional(_rows(spark, sf_dir), label="any"), "site:1")
    return R.boost_scope(R.nearest(rows, _queries(spark, sf_dir), 5), "site:1").select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def pairs_within_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pairs_within(_rows(spark, sf_dir), ["label"], 0.7).select("label", "a", "b", F.round("distance", 6).alias("distance"))


def nearest_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _rows(spark, sf_dir).filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), "scope")
    return R.nearest_by_key(_rows(spark, sf_dir), q, "scope", 3, not_self=True).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def extract_keywords_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(extract_keywords(F.col("text")), "|").alias("keywords"))


def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.filter(R.has_keyword(F.col("text"), F.array(F.lit("License"), F.lit("idiot")))).select("doc_id")


def vector_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lifecycle import vector_backlog as backlog

    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 3 > 0, F.col("embedding")))
    return backlog(e, "embedding", 40, "vec_id").select("vec_id")


QUERIES = {
    "vector_topk": vector_topk, "ann_topk": ann_topk, "ann_topk_all_lists": ann_topk_all_lists, "hybrid_topk": hybrid_topk, "scope_boost_rank": scoped_topk, "pairs_within_distance": pairs_within_distance, "nearest_in_scope": nearest_in_scope,
    "extract_keywords": extract_keywords_q, "keyword_filter": keyword_filter, "vector_backlog": vector_backlog,
}

_E = """WITH r AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label, CASE WHEN vec_id % 5 = 0 THEN 'global' ELSE 'site:' || (vec_id % 3)::VARCHAR END AS scope,
  (['ground GroundFailure seen', 'coastal air', 'fan slow', 'Firmware 3.1.2 loop'])[(vec_id % 4) + 1] AS content FROM embeddings),
q AS (SELECT id AS query_id, vec AS query_vec, scope AS query_scope FROM r WHERE id % 20 = 0)"""
_D = "1.0::DOUBLE - list_dot_product(vec, query_vec) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(query_vec, query_vec)))"


def _top(where: str, k: int) -> str:
    return f"{_E}, d AS (SELECT query_id, query_scope, id, scope, content, {_D} AS distance FROM r, q), f AS (SELECT * FROM d WHERE {where}), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM f QUALIFY rank <= {k})"


_WORDS = "CASE WHEN query_id % 40 = 0 THEN content LIKE '%GroundFailure%' OR content LIKE 'coastal%' WHEN query_id % 60 = 0 THEN false ELSE true END"
_KEY = " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS w FROM documents" for p in KEYWORDS)
ORACLE = {
    "vector_topk": f"{_top('true', 5)} SELECT query_id, id, rank, round(distance, 6) + 0.0::DOUBLE AS distance, round(round(1.0::DOUBLE - distance, 4), 3) AS similarity FROM t",
    "ann_topk_all_lists": f"{_top('true', 10)} SELECT query_id, id, rank, round(distance, 6) + 0.0::DOUBLE AS distance FROM t",
    "hybrid_topk": f"{_top(_WORDS, 5)} SELECT query_id, id, rank, query_id % 40 = 0 OR query_id % 60 = 0 AS ft_used, round(distance, 6) + 0.0::DOUBLE AS distance FROM t",
    "scope_boost_rank": _top("scope IN ('site:1', 'global')", 5) + ", u AS (SELECT query_id, id, rank, CASE WHEN scope = 'site:1' THEN distance * 0.95::DOUBLE ELSE distance END AS distance FROM t) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, rank)::INTEGER AS rank, round(distance, 6) + 0.0::DOUBLE AS distance FROM u",
    "nearest_in_scope": f"{_top('scope = query_scope AND id <> query_id', 3)} SELECT query_id, id, rank, round(distance, 6) + 0.0::DOUBLE AS distance FROM t",
    "pairs_within_distance": f"{_E}, p AS (SELECT a.label, a.id AS a, b.id AS b, a.vec AS vec, b.vec AS query_vec FROM r a JOIN r b ON a.label = b.label AND a.id < b.id), d AS (SELECT label, a, b, {_D} AS distance FROM p) SELECT label, a, b, round(distance, 6) + 0.0::DOUBLE AS distance FROM d WHERE distance < 0.7",
    "extract_keywords": f"WITH k AS ({_KEY}), j AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT w)), '|') AS keywords FROM k GROUP BY doc_id) SELECT doc_id, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN j USING (doc_id)",
    "keyword_filter": "SELECT doc_id FROM documents WHERE list_has_any(list_transform(regexp_split_to_array(lower(text), '[^a-z0-9_.-]+'), lambda t: rtrim(t, '.')), ['license', 'idiot'])",
    "vector_backlog": "SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0 ORDER BY vec_id LIMIT 40",
}
