"""Writes. State changes are functions of old and new rows; files are written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _one_a_key(new: DataFrame, keys: list[str], order: list[Column] | None) -> DataFrame:
    """The first row of each key, by ``order`` or else by the text of its columns."""
    by = order or [F.to_json(F.struct(*new.columns), {"ignoreNullFields": "false"})]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return new.withColumn("_first", first).filter("_first = 1").drop("_first")


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """old and those of the new rows whose key it does not have; of new rows with one key, the first in ``order``."""
    return old.unionByName(_one_a_key(new, [key], order).join(old.select(key), key, "left_anti").select(old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of both: where a key is in both, ``columns`` come from the new row and the others from the old one.

    Of new rows with one key, the first in ``order`` counts.
    """
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), _one_a_key(new, keys, order).withColumn("_n", F.lit(True)).alias("n")
    both = o.join(n, keys, "full_outer")
    pick = lambda c: (F.when(F.col("_n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in columns else F.when(F.col("_o"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))).alias(c)
    return both.select(*[F.col(c) if c in keys else pick(c) for c in old.columns])


def write_vectors(rows: DataFrame, vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with the new vectors filled in, where there is one."""
    v = vectors.select(key, F.col(column).alias("_v"))
    return rows.join(v, key, "left").withColumn(column, F.coalesce("_v", column)).select(rows.columns)


def retain(rows: DataFrame, column: str, interval: str, as_of: str) -> DataFrame:
    """Rows not older than the interval at the given time; rows without a time go."""
    return rows.filter(F.col(column) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {interval}"))


def drop_partitions(spark: SparkSession, path: str, column: str, interval: str, as_of: str) -> dict[str, list[str]]:
    """Retention of a table that append() has partitioned by the date of ``column``; which partitions went or were cut.

    Partitions that lie wholly before the limit are removed without being read, and so are rows without a time. Only the
    partition that holds the limit is read and written anew, beside the old one, which it then replaces; later ones stay
    as they are. A run that broke off is mended by the next one.
    """
    limit = spark.sql(f"SELECT timestamp_ntz '{as_of}' - INTERVAL {interval}").first()[0]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done: dict[str, list[str]] = {"dropped": [], "cut": []}
    for left in [s.getPath().getName() for s in fs.listStatus(hadoop(path)) if s.getPath().getName().startswith("_kept-")]:
        day = hadoop(f"{path}/{left.removeprefix('_kept-')}")
        if fs.exists(day):  # it broke off before the old day went
            fs.delete(hadoop(f"{path}/{left}"), True)
        else:
            fs.rename(hadoop(f"{path}/{left}"), day)
    for day in sorted(s.getPath().getName() for s in fs.listStatus(hadoop(path))):
        date = day.removeprefix("dt=")
        if date == day or (date > str(limit.date()) and not date.startswith("__")):  # "__": no time
            continue
        if date == str(limit.date()):
            new = f"{path}/_kept-{day}"
            retain(spark.read.parquet(f"{path}/{day}"), column, interval, as_of).write.parquet(new)
            fs.delete(hadoop(f"{path}/{day}"), True)
            fs.rename(hadoop(new), hadoop(f"{path}/{day}"))
            done["cut"].append(day)
        else:
            fs.delete(hadoop(f"{path}/{day}"), True)
            done["dropped"].append(day)
    return done


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, in which a null is written as None."""
    rows.write.mode("append").csv(path, header=True, nullValue="None")


def append(rows: DataFrame, path: str, by_date_of: str | None = None) -> None:
    """Appends Parquet, partitioned by the date of a column where one is named."""
    if by_date_of:
        rows.withColumn("dt", F.to_date(by_date_of)).write.mode("append").partitionBy("dt").parquet(path)
    else:
        rows.write.mode("append").parquet(path)


def insert_statements(rows: DataFrame, table: str, batch: int = 200) -> DataFrame:
    """(partition, statement): INSERT texts of at most ``batch`` rows each, made where the rows are."""
    value = lambda c: F.when(F.col(c).isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")))
    line = F.concat(F.lit("("), F.concat_ws(", ", *map(value, rows.columns)), F.lit(")"))
    numbered = rows.select(line.alias("line"), F.monotonically_increasing_id().alias("i"))
    part = numbered.withColumns({"partition": F.shiftright("i", 33), "block": F.floor(F.col("i").bitwiseAND(F.lit((1 << 33) - 1)) / batch)})
    head = f"INSERT INTO {table} ({', '.join(rows.columns)}) VALUES "
    return part.groupBy("partition", "block").agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("line")), ", ")).alias("statement")).select("partition", "statement")
