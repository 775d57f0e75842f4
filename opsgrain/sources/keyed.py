"""Tables with keys: writes, deletes and expiry that touch only the folders concerned.

Rows lie in folders by day, bucket of the key and version. An upsert or a delete adds a version to the folders of its rows;
readers take the last write of each key. A compaction replaces a folder's versions by one. A version counts from the moment its
commit file is there, so readers see it whole or not at all; what it replaced is deleted later, by :meth:`KeyedTable.vacuum`.
One writer at a time.
"""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedTable:
    """``keys`` hold the time ``ts`` or fix its day; ``written_at`` orders the writes of a key (then the version does)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], ts: str, written_at: str, buckets: int = 16) -> None:
        self.spark, self.path, self.schema, self.keys, self.ts, self.written_at, self.buckets = spark, path.rstrip("/"), schema, keys, ts, written_at, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ folders

    def _names(self, path: str) -> list[str]:
        at = self._path(path)
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def commits(self) -> list[dict]:
        """The commits, in order: version, kind, and for compactions and expiry the folders or the day concerned."""
        names = sorted(n for n in self._names(f"{self.path}/_commits") if n.endswith(".json"))
        files = [self._fs.open(self._path(f"{self.path}/_commits/{n}")) for n in names]
        out = []
        for f in files:
            out.append(json.loads(bytes(f.readAllBytes()).decode()))
            f.close()
        return sorted(out, key=lambda c: c["version"])

    def _commit(self, version: int, kind: str, **more) -> None:
        at = self._path(f"{self.path}/_commits/.{version:012d}.json")
        out = self._fs.create(at, True)
        out.write(json.dumps({"version": version, "kind": kind, **more}).encode())
        out.close()
        self._fs.rename(at, self._path(f"{self.path}/_commits/{version:012d}.json"))

    def _next(self) -> int:
        """A number that no write has begun with, whether or not it came to its end."""
        version = max((int(n.split(".")[0]) for n in self._names(f"{self.path}/_commits") if n[0].isdigit()), default=0) + 1
        self._fs.create(self._path(f"{self.path}/_commits/{version:012d}.begun"), True).close()
        return version

    def _live(self, days: tuple[date, date] | None = None) -> dict[tuple[str, str], list[int]]:
        """The versions that count of each folder (day, bucket), of a range of days, ends included."""
        commits = self.commits()
        good = {c["version"] for c in commits}
        gone = max((c["before"] for c in commits if c["kind"] == "expire"), default="")
        base: dict[tuple[str, str], int] = {}
        for c in commits:
            for day, bucket in c.get("folders", []):
                base[day, bucket] = c["version"]
        out = {}
        for name in self._names(self.path):
            day = name.removeprefix("day=")
            if name.startswith("day=") and day >= gone and (days is None or str(days[0]) <= day <= str(days[1])):
                for b in self._names(f"{self.path}/{name}"):
                    bucket = b.removeprefix("bucket=")
                    versions = sorted(int(v.removeprefix("version=")) for v in self._names(f"{self.path}/{name}/{b}") if v.startswith("version="))
                    if live := [v for v in versions if v in good and v >= base.get((day, bucket), 0)]:
                        out[day, bucket] = live
        return out

    def _files(self, live: dict[tuple[str, str], list[int]]) -> DataFrame:
        kinds = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType()), T.StructField("day", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType())])
        paths = [f"{self.path}/day={d}/bucket={b}/version={v}" for (d, b), versions in live.items() for v in versions]
        return self.spark.read.option("basePath", self.path).schema(kinds).parquet(*paths) if paths else self.spark.createDataFrame([], kinds)

    def _resolved(self, rows: DataFrame) -> DataFrame:
        """The last write of each key that no later version deleted."""
        w = Window.partitionBy("day", "bucket", *self.keys)
        deleted = F.coalesce(F.max(F.when(F.col("_gone"), F.col("version"))).over(w), F.lit(-1))
        rest = [F.desc(f.name) for f in self.schema if f.name not in (*self.keys, self.written_at) and not isinstance(f.dataType, T.MapType)]
        last = F.row_number().over(w.orderBy(F.desc(self.written_at), F.desc("version"), *rest))
        puts = rows.withColumn("_deleted", deleted).where("NOT _gone AND version > _deleted")
        return puts.withColumn("_r", last).where("_r = 1").drop("_r", "_deleted", "_gone")

    def _put(self, rows: DataFrame, version: int, gone: bool) -> None:
        at = rows.withColumns({"_gone": F.lit(gone), "day": F.date_format(self.ts, "yyyy-MM-dd"), "bucket": F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"), "version": F.lit(version).cast("long")})
        at.hint("rebalance", F.col("day"), F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "bucket", "version").parquet(self.path)

    # ------------------------------------------------------------ reading and writing

    def read(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """The rows of the days from ``start`` to ``end``, ends included; folders of other days are not listed."""
        days = None if start is None and end is None else (start or date.min, end or date.max)
        return self._resolved(self._files(self._live(days))).select(self.schema.names)

    def upsert(self, rows: DataFrame) -> int:
        """Adds a version with these rows; returns its number. Only folders of their days and buckets are written."""
        version = self._next()
        self._put(rows.select(self.schema.names), version, False)
        self._commit(version, "put")
        return version

    def delete(self, condition: Column, start: date | None = None, end: date | None = None) -> int:
        """Deletes the rows that fit, of the days from ``start`` to ``end``; later writes of their keys count again. Rows of which
        it is unknown whether they fit stay."""
        version = self._next()
        self._put(self.read(start, end).where(F.coalesce(condition, F.lit(False))), version, True)
        self._commit(version, "delete")
        return version

    def compact(self, start: date | None = None, end: date | None = None, more_than: int = 1) -> int | None:
        """Rewrites folders with over ``more_than`` versions as one; others are left alone."""
        days = None if start is None and end is None else (start or date.min, end or date.max)
        many = {folder: versions for folder, versions in self._live(days).items() if len(versions) > more_than}
        if not many:
            return None
        version = self._next()
        self._put(self._resolved(self._files(many)).select(self.schema.names), version, False)
        self._commit(version, "compact", folders=[list(f) for f in many])
        return version

    def expire(self, before: date) -> int:
        """Rows of days before this one are gone, as a whole: their folders are dropped, nothing is read."""
        version = self._next()
        self._commit(version, "expire", before=str(before))
        for name in self._names(self.path):
            if name.startswith("day=") and name.removeprefix("day=") < str(before):
                self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return version

    def vacuum(self) -> list[str]:
        """Deletes versions that no reader takes any more, half-written ones included; returns their folders."""
        live, out = self._live(), []
        for name in [n for n in self._names(self.path) if n.startswith("day=")]:
            for b in self._names(f"{self.path}/{name}"):
                counts = live.get((name.removeprefix("day="), b.removeprefix("bucket=")), [])
                for v in self._names(f"{self.path}/{name}/{b}"):
                    if v.startswith("version=") and int(v.removeprefix("version=")) not in counts:
                        self._fs.delete(self._path(f"{self.path}/{name}/{b}/{v}"), True)
                        out.append(f"{name}/{b}/{v}")
        return out
