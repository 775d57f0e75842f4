"""Shared folder, written intermediate tables, and connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The letters that lower-casing by these operators' contracts touches.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set if all runs on one machine (as in tests); on a cluster
    this raises, since a folder of the driver's is not the executors'.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes a table in the shared folder and reads it again: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.opsgrain_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from :func:`written` that nothing reads any more."""
    delete(df.sparkSession, df.opsgrain_path)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose tables are written and whose plans are dropped."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """For the jobs that run meanwhile: at most so many bytes, or one row, in each Arrow batch that a Python task is sent."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lower_az(column):
    """Lower-cases A-Z alone."""
    return F.translate(column, UPPER, LOWER)


def row_key():
    """A key of a row of ``doc_id, text``, never null; a null text counts as empty."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(" "), F.coalesce("text", F.lit(""))))


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of an undirected graph, by alternating large-star and small-star steps.

    ``edges`` has two columns, of one orderable type; self-loops, repeated and reversed edges and nulls
    are allowed (rows with a null link nothing). Returns ``node, component``: each node that has an edge
    to another, with the smallest node of its component. No node's neighbours are ever gathered in one
    place: each step is a minimum for each node (combined before the shuffle) and a join. An empty input
    gives an empty result. Each round is written in the shared folder.
    """
    a, b = (F.col(c) for c in edges.columns)
    current = written(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )

    def sign(df: DataFrame):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        return row["n"], row["h"]

    before = sign(current)
    for _ in range(rounds):
        if not before[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = sign(after)
        discard(current)
        current = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def has(schema: T.StructType, *names: str) -> None:
    """Raises if columns are missing."""
    if missing := [n for n in names if n not in schema.names]:
        raise ValueError(f"missing columns: {missing}")
