"""Tables in folders by hour and batch, in the session's time zone, which should be UTC."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utc(seconds: int) -> datetime:
    """A time in seconds since 1970, without a zone."""
    return datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None)


def hour_of(at: Column) -> Column:
    """The folder of a time."""
    return F.date_format(F.date_trunc("hour", at), "yyyyMMddHH")


def write_hours(df: DataFrame, path: str, at: str, batch: int) -> None:
    """Writes rows to the folders of their hours and this batch; only those are replaced."""
    out = df.withColumns({"hour": hour_of(F.col(at)), "batch": F.lit(batch).cast("long")})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(path)


def read_hours(spark: SparkSession, path: str, low: datetime, high: datetime) -> DataFrame | None:
    """Rows in the folders of the hours from ``low`` to ``high``, no others are listed; None without any.

    ``low`` and ``high`` are in the session's time zone.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    first = low.replace(minute=0, second=0, microsecond=0)
    hours = [first + timedelta(hours=i) for i in range(int((high - first).total_seconds() // 3600) + 1)]
    found = [f"{path}/hour={h:%Y%m%d%H}" for h in hours]
    found = [p for p in found if fs.exists(fs_path(p))]
    kinds = {"hour": T.StringType(), "batch": T.LongType()}  # folders' names would be read as numbers
    return spark.read.option("basePath", path).parquet(*found).withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}) if found else None


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last batch's row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))).where("_r = 1").drop("_r")
