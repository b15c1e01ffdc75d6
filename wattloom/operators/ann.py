"""Approximate nearest rows: an inverted file index.

Centroids are learned on a bounded sample; every row is put on the list of its nearest centroid, and lists are folders of
Parquet. A query reads the lists of its nearest centroids only. Distances are exact; what can be missed is a near row on
a list that was not read, and with all lists read the answer is exact. How many lists a query reads is measured when the
index is built: as many as give the target recall for a sample of queries, whose true neighbours are looked up in all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .retrieval import BLOCK_ROWS, CELLS, PIECE_ROWS, nearest, nearest_by_key

_CENTROIDS, _PROBES = "list int, centroid array<double>", "probes int, recall double"

#: Centroids are learned on about so many rows at most, chosen by a hash of their id; there are at most so many lists.
SAMPLE_ROWS, MOST_LISTS = 200_000, 16_384
#: Recall that the number of lists read is chosen for, of this many neighbours of about so many sampled rows.
TARGET, NEIGHBOURS, MOST_SAMPLED = 0.95, 10, 400


def _unit(vector: str):  # noqa: ANN202
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.col(vector), lambda x: x / norm)


def centroids_of(rows: DataFrame, lists: int, vector: str = "vec", id_col: str = "id", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """[lists, dimensions] unit vectors: k-means of the directions of the sample."""
    n = rows.count()
    share = min(1.0, sample_rows / max(1, n))
    sample = _hashed_share(rows, id_col, "centroids", share)
    points = sample.select(array_to_vector(_unit(vector)).alias("features")).repartition(max(1, int(n * share) // 10_000)).cache()
    try:
        found = np.array(KMeans(k=lists, maxIter=10, seed=1).fit(points).clusterCenters())
    finally:
        points.unpersist()
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def _hashed_share(rows: DataFrame, id_col: str, salt: str, share: float) -> DataFrame:
    return rows.filter(F.pmod(F.xxhash64(F.lit(salt), id_col), F.lit(1 << 30)) < share * (1 << 30))


def _to_lists(df: DataFrame, centroids: np.ndarray, vector: str, most: int) -> DataFrame:
    """df with ``list``: one row for each of the ``most`` nearest centroids. Tasks hold CELLS distances at a time and give no repeated rows."""
    shared = df.sparkSession.sparkContext.broadcast(centroids.T.copy())  # MOST_LISTS rows at most

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            step = max(1, CELLS // shared.value.shape[1])
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                near = -(np.array(part[vector].tolist(), dtype=np.float64) @ shared.value)  # the query's length doesn't matter
                first = np.argpartition(near, most - 1, axis=1)[:, :most].astype(np.int32)
                yield part.assign(list=list(first))

    found = df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("list", T.ArrayType(T.IntegerType()))]))
    return found.withColumn("list", F.explode("list"))


def probes_for(lists: DataFrame, centroids: np.ndarray, n: int, target: float, k: int = NEIGHBOURS, most_sampled: int = MOST_SAMPLED) -> tuple[int, float]:
    """(probes, recall): the fewest lists read that reach the target for sampled rows as queries, and what they reach.

    lists (id, vec, list) are all n rows. A neighbour is found if its list is among the query's nearest ones.
    """
    q = _hashed_share(lists, "id", "queries", min(1.0, most_sampled / max(1, n))).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    found = nearest(lists, q, k, "vec", "id").select("query_id", "list").toPandas()  # about NEIGHBOURS * MOST_SAMPLED rows
    asked = q.toPandas()
    if not len(found):
        return len(centroids), 1.0
    order = np.argsort(-(np.array(asked["query_vec"].tolist()) @ centroids.T), axis=1, kind="stable")
    place = dict(zip(asked["query_id"], np.argsort(order, axis=1), strict=True))  # of each list for a query
    ranks = np.sort([place[i][x] for i, x in zip(found["query_id"], found["list"], strict=True)])
    probes = int(ranks[min(len(ranks), max(1, math.ceil(target * len(ranks)))) - 1]) + 1
    return probes, float((ranks < probes).mean())


def build_index(rows: DataFrame, path: str, lists: int | None = None, vector: str = "vec", id_col: str = "id", target: float = TARGET) -> None:
    """Writes the index of (id, vector) to ``path``: lists, centroids, and how many lists a query reads.

    ``lists`` is by default the root of the number of rows. Rows without a vector, or with one of length 0, are on no
    list. A long list is written by several tasks.
    """
    spark = rows.sparkSession
    live = rows.filter(F.exists(vector, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    n = live.count()
    count = min(MOST_LISTS, lists or max(1, round(math.sqrt(n))))
    centroids = centroids_of(live, count) if count > 1 and n else np.zeros((1, len(live.first().vec) if n else 1))
    assigned = _to_lists(live, centroids, "vec", 1)
    assigned.repartition("list", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (len(centroids) * BLOCK_ROWS))))).write.partitionBy("list").mode("overwrite").parquet(f"{path}/lists")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], _CENTROIDS).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([probes_for(read_lists(spark, path), centroids, n, target)], _PROBES).coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")


def read_lists(spark: SparkSession, path: str, lists: list[int] | None = None) -> DataFrame:
    """(id, vec, list) of the lists, by their folders alone; of all lists where None is given."""
    rows = spark.read.schema("id long, vec array<double>, list int").parquet(f"{path}/lists")
    return rows if lists is None else rows.filter(F.col("list").isin(lists))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, not_self: bool = False) -> DataFrame:
    """queries (query_id, query_vec) -> (query_id, id, distance, rank), nearest first, then by id.

    Without ``probes`` a query reads as many lists as the index was measured to need; ``exact`` reads all of them, as one:
    no query is repeated for each list.
    """
    pdf = spark.read.schema(_CENTROIDS).parquet(f"{path}/centroids").toPandas().sort_values("list")
    centroids = np.array(pdf["centroid"].tolist())
    most = len(centroids) if exact else min(len(centroids), max(1, probes or spark.read.schema(_PROBES).parquet(f"{path}/probes").first().probes))
    q = queries.filter(F.exists("query_vec", lambda x: x != 0)).select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec"))
    if most == len(centroids):
        one = F.lit(0).alias("_all")
        return nearest_by_key(read_lists(spark, path).select(one, "id", "vec"), q.select(one, "query_id", "query_vec"), "_all", k, "vec", "id", PIECE_ROWS, not_self)
    asked = _to_lists(q, centroids, "query_vec", most)
    needed = [r.list for r in asked.select("list").distinct().collect()]  # MOST_LISTS numbers at most
    return nearest_by_key(read_lists(spark, path, needed), asked, "list", k, "vec", "id", not_self=not_self)
