"""Top-k, first rows per key, running and greedy budgets. Every order is total."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark cuts each partition to n rows a key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_entities(windows: DataFrame, n: int, exact: bool = True) -> DataFrame:
    """The n chargers with the worst window, each with that window.

    Not exact: only the 10 n worst windows are looked at, so that there may be fewer than n.
    """
    order = [F.desc("anomaly_score"), F.asc("charger_id"), F.asc("window_start")]
    rows = windows.filter("anomaly_score > 0")
    if not exact:
        rows = top(rows, order, 10 * n)
    return top(first_per_key(rows, ["charger_id"], order).drop("rank"), order, n)


def prefix_sums(rows: DataFrame, keys: list[str], order: list[Column], value: str, name: str, pieces: int | None = None) -> DataFrame:
    """rows with the running sum of a column in each key's order, in two passes; a null value adds nothing.

    Rows are dealt into ranges of key and order and written down, so a hot key is many pieces. The totals of the pieces
    give each one's offset, and sums run within the pieces only.
    """
    at = [F.col(k) for k in keys]
    dealt = rows.repartitionByRange(pieces, *at, *order) if pieces else rows.repartitionByRange(*at, *order)
    dealt = written(dealt.withColumn("_piece", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "_piece").agg(F.sum(value).alias("_total"))
    offset = F.sum("_total").over(Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumn("_offset", F.coalesce(offset, F.lit(0))).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_own"), "_offset")
    same = F.col("_piece") == F.col("_own")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    w = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(totals, same).withColumn(name, F.col("_offset") + F.coalesce(F.sum(value).over(w), F.lit(0)))
    return out.select(*rows.columns, name)


def running_budget(rows: DataFrame, keys: list[str], order: list[Column], tokens: str, budget: Column, pieces: int | None = None) -> DataFrame:
    """The longest prefix of each key's rows whose tokens fit the budget: it stops at the first that doesn't.

    Tokens are no less than 0; rows get the tokens used up to them. A hot key is many tasks.
    """
    return prefix_sums(rows, keys, order, tokens, "used", pieces).filter(F.col("used") <= budget)


#: Keys with more rows than this left are fitted in rounds of prefix sums.
FIT_ROWS = 10_000


def greedy_fit(rows: DataFrame, keys: list[str], order: list[Column], tokens: str, budget: int, fit_rows: int = FIT_ROWS, pieces: int | None = None) -> DataFrame:
    """Of each key's rows in order, what fits into the rest of its budget; what doesn't is skipped.

    A key with many rows goes in rounds: the longest prefix that fits is taken, then all that is longer than the rest
    goes, the row that ended the prefix among it. A key with at most ``fit_rows`` rows left is ended in one task. Tokens
    are no less than 0, null counts as 0.
    """
    spent, rest = F.coalesce(F.col(tokens), F.lit(0)), F.col("_rest")
    left = rows.filter(spent <= budget).withColumn("_rest", F.lit(budget).cast("long"))
    out = None
    while True:
        left = written(left)
        sizes = left.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > fit_rows)
        hot = written(sizes.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
        few = left.join(hot, same, "left_anti").withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        ended = few.groupBy(*keys).applyInPandas(_fit(tokens, rows.columns), rows.schema)
        out = ended if out is None else out.unionByName(ended)
        if not hot.limit(1).count():
            return out
        sums = written(prefix_sums(left.join(hot, same, "left_semi"), keys, order, tokens, "_used", pieces))
        taken = sums.filter(F.col("_used") <= rest)
        out = out.unionByName(taken.select(rows.columns))
        by = taken.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.max("_used").alias("_taken"))
        left = sums.filter(F.col("_used") > rest).join(by, same, "left").withColumn("_rest", rest - F.coalesce("_taken", F.lit(0))).filter(spent <= rest).select(*rows.columns, "_rest")


def _fit(tokens: str, columns: list[str]):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place", ignore_index=True)
        rest, kept = int(pdf["_rest"].iloc[0]), []
        for i, t in enumerate(pdf[tokens].fillna(0).tolist()):
            if t <= rest:
                kept.append(i)
                rest -= t
        return pdf.loc[kept, columns]

    return run


def greedy_budget(items: Column, budget: Column | int) -> Column:
    """Of an array of struct<tokens, ...> in order: what fits, skipping what doesn't. A fold, not a window frame."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    take = F.aggregate(
        F.transform(items, lambda x: x["tokens"].cast("long")),
        F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("kept")),
        lambda s, t: F.when(s["used"] + t <= budget, F.struct((s["used"] + t).alias("used"), F.array_append(s["kept"], F.lit(True)).alias("kept"))).otherwise(F.struct(s["used"].alias("used"), F.array_append(s["kept"], F.lit(False)).alias("kept"))),
    )
    return F.transform(F.filter(F.arrays_zip(items.alias("item"), take["kept"].alias("kept")), lambda z: z["kept"]), lambda z: z["item"])
