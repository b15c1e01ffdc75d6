"""The corpus pipeline: language ID, exact dedup, near-duplicate removal, benchmark decontamination, tokens.

Each stage reads what the one before has kept and returns the columns of its input, rows that it rejects left out; the
last adds token_ids. Rows without an identifier are never taken for copies, near copies or contaminated ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, passing, stored, table
from .decontaminate import overlaps
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_join
from .language_id import mixture_of, train
from .sentencepiece_codec import encode

#: A document stays if its main language has this share of its words, at least.
LEAST_SHARE = 0.34
MOST_BROADCAST_IDS = 1_000_000

#: The language stage learns a model, clusters come from an iteration and tokens from a vocabulary: no single SQL text has them.
ORACLE_SQL = None


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ``dropped`` (doc_id)."""
    ids = stored(dropped.select(F.col("doc_id")).filter("doc_id IS NOT NULL").distinct())
    return docs.join(broadcast_if_small(ids, MOST_BROADCAST_IDS), "doc_id", "left_anti").select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and mixtures without a main language. Only texts go to Python workers."""
    made = "_made" + "_" * max(map(len, docs.columns))  # no column's name
    judged = docs.withColumn(made, mixture_of(docs["text"], train(docs), docs))
    return judged.filter((F.col(f"{made}.lang_pred") != "und") & (F.col(f"{made}.score") >= LEAST_SHARE)).drop(made)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; of rows repeated with one doc_id and text, one.

    Rows with one doc_id and different texts are judged each by its own text.
    """
    gone = exact_dedup(docs).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("gone_id"), F.unhex("text_sha256").alias("gone_digest"))
    gone = broadcast_if_small(stored(gone.distinct()), MOST_BROADCAST_IDS)
    digest = F.unhex(F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256))
    kept = docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (digest == gone["gone_digest"]), "left_anti")
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).union(kept.filter("doc_id IS NULL")) if repeats(docs) else kept


def repeats(docs: DataFrame) -> bool:
    """Whether an identifier is repeated."""
    return docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written down with a number for each row that has an identifier, and the name of that column."""
    row = "_row" + "_" * max(map(len, docs.columns))  # no column's name
    return stored(docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()))), row


def without_rows(docs: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """numbered() docs without the rows in ``dropped`` (row), and without the numbers."""
    gone = stored(dropped.select(F.col("row").alias(row)).filter(F.col(row).isNotNull()).distinct())
    return docs.join(broadcast_if_small(gone, MOST_BROADCAST_IDS), row, "left_anti").drop(row)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id stays.

    Where an identifier is repeated, each of its rows is judged by its own text.
    """
    if not repeats(docs):
        return without(docs, jaccard_join(docs).filter("doc_id != class_id"))
    rows, row = numbered(docs)
    found = stored(jaccard_join(rows, row).select(F.col("doc_id").alias("row"), F.col("class_id").alias("class")).filter("row IS NOT NULL"))
    found = stored(found.join(rows.select(F.col(row).alias("row"), "doc_id"), "row"))
    first = found.groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("class", F.col("first.row").alias("stays"))
    return without_rows(rows, row, found.join(first, "class").filter("row != stays"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; rows that repeat an identifier each by their own text."""
    if not repeats(docs):
        return without(docs, overlaps(docs, table(spark, sf_dir, "benchmark")))
    rows, row = numbered(docs)
    hits = overlaps(rows.drop("doc_id").withColumnRenamed(row, "doc_id"), table(spark, sf_dir, "benchmark"))
    return without_rows(rows, row, hits.select(F.col("doc_id").alias("row")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids to each row by its text; rows may repeat identifiers or lack them."""
    return encode(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_stage),
    ("decontaminate", benchmark_stage),
    ("sentencepiece", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages; what a stage has written on its way is deleted once its result is stored."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with passing(spark) as made:
            docs = stored(stage(spark, docs, sf_dir))
            new = made.pop()
            made += [last] if last else []
            last = new
    return docs
