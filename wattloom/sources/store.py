"""Versioned snapshot tables: root/<table>/v=<n>/ Parquet, and one manifest that names every table's version.

A commit writes the next version of all changed tables and then replaces the manifest in one rename, so readers see
all changes of a commit or none. One writer at a time, held by a lock file that names it; a lock older than
``stale_after`` seconds is that of a dead writer and is taken over. Works on any file system that Hadoop has.

A table can be kept in buckets by key. Its manifest entry names the version that holds each bucket, so an update writes
the buckets it touches and no others.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str, keep: int = 5, stale_after: float = 6 * 3600) -> None:
        self.spark, self.root, self.keep, self.stale_after = spark, root.rstrip("/"), keep, stale_after
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def versions(self) -> dict:
        """The current version of every table. A manifest moved aside by a broken commit is taken up again."""
        for name in ("_CURRENT", "_PREVIOUS"):
            if self._fs.exists(self._path(name)):
                return json.loads(self._text(name))
        return {}

    @contextmanager
    def _held(self) -> Iterator[str]:
        """The writer's lock; publishing checks that it is still ours."""
        lock, me = self._path("_LOCK"), uuid.uuid4().hex
        old = lambda p: time.time() - self._fs.getFileStatus(p).getModificationTime() / 1000 > self.stale_after
        if self._fs.exists(lock) and old(lock):
            aside = self._path(f"_LOCK-{me}")
            self._fs.rename(lock, aside)
            if not old(aside):  # another one was quicker: this is its lock
                self._fs.rename(aside, lock)
            self._fs.delete(aside, False)
        if not self._fs.createNewFile(lock):
            raise RuntimeError("another writer holds the store")
        self._put("_LOCK", me)
        try:
            yield me
        finally:
            if self._fs.exists(lock) and self._text("_LOCK") == me:
                self._fs.delete(lock, False)

    def _publish(self, me: str, manifest: dict) -> None:
        if not self._fs.exists(self._path("_LOCK")) or self._text("_LOCK") != me:
            raise RuntimeError("the lock was taken over; nothing was published")
        self._put("_NEXT", json.dumps(manifest))
        current, previous = self._path("_CURRENT"), self._path("_PREVIOUS")
        self._fs.delete(previous, False)
        if self._fs.exists(current):
            self._fs.rename(current, previous)
        self._fs.rename(self._path("_NEXT"), current)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        v = self.versions()[table] if version is None else version
        return self.spark.read.parquet(f"{self.root}/{table}/v={v}")

    def commit(self, changes: dict[str, DataFrame]) -> dict:
        """Writes new versions of the tables and publishes them together."""
        with self._held() as me:
            now = self.versions()
            new = now | {t: now.get(t, 0) + 1 for t in changes}
            for t, df in changes.items():
                df.write.mode("overwrite").parquet(f"{self.root}/{t}/v={new[t]}")
            self._publish(me, new)
            for t in changes:
                self._fs.delete(self._path(f"{t}/v={new[t] - self.keep}"), True)
            return new

    def _names(self, name: str, prefix: str) -> list[str]:
        found = self._fs.listStatus(self._path(name)) if self._fs.exists(self._path(name)) else []
        return [n.removeprefix(prefix) for n in (s.getPath().getName() for s in found) if n.startswith(prefix)]

    def _put_buckets(self, me: str, table: str, entry: dict, rows: DataFrame) -> None:
        v = entry["next"]
        dealt = rows.withColumn("_bucket", _bucket(entry["keys"], entry["buckets"])).repartition("_bucket")
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/{table}/v={v}")
        at = entry["at"] | {b: v for b in self._names(f"{table}/v={v}", "_bucket=")}
        self._publish(me, self.versions() | {table: entry | {"at": at, "next": v + 1}})
        for old in self._names(table, "v="):
            if int(old) <= v - self.keep:
                for b in self._names(f"{table}/v={old}", "_bucket="):
                    if at.get(b) != int(old):
                        self._fs.delete(self._path(f"{table}/v={old}/_bucket={b}"), True)

    def write_buckets(self, table: str, rows: DataFrame, keys: list[str], buckets: int = 256) -> None:
        """The whole table, dealt into buckets by a hash of its keys. Choose their number for buckets of a file or a few."""
        with self._held() as me:
            before = self.versions().get(table, {"next": 1})
            self._put_buckets(me, table, {"keys": keys, "buckets": buckets, "next": before["next"], "at": {}}, rows)

    def read_buckets(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """All of a bucketed table, or the given buckets, of the versions that the manifest names."""
        at = self.versions()[table]["at"]
        wanted = at if buckets is None else [str(b) for b in buckets if str(b) in at]
        some = wanted or list(at)[:1]  # for the columns
        rows = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/v={at[b]}/_bucket={b}" for b in some]).drop("v", "_bucket")
        return rows if wanted else rows.limit(0)

    def upsert(self, table: str, new: DataFrame, columns: list[str], order: list[Column] | None = None) -> list[int]:
        """sinks.upsert() on a bucketed table; returns the buckets that were read and written anew, those of new rows."""
        with self._held() as me:
            entry = self.versions()[table]
            b = _bucket(entry["keys"], entry["buckets"])
            hit = sorted(r.b for r in new.select(b.alias("b")).distinct().collect())  # at most the number of buckets
            if hit:
                self._put_buckets(me, table, entry, sinks.upsert(self.read_buckets(table, hit), new, entry["keys"], columns, order))
            return hit
