"""Keyed tables, retention, catalogs, deletes, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], written_at: str) -> DataFrame:
    """The rows of both with the last write for each key; of several at one time, one, by all columns."""
    both = old.unionByName(new)
    rest = [F.desc(c) for c in both.columns if c not in keys and c != written_at and not both.schema[c].dataType.typeName() == "map"]
    w = Window.partitionBy(*keys).orderBy(F.desc(written_at), *rest)
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_by_day(df: DataFrame, path: str, ts: str, mode: str = "append") -> None:
    """Writes a table in folders by day, so that time ranges read only theirs.

    Rows are rebalanced by day: small days share a task, and a day of more than the advisory size of a partition is
    dealt to several, each of which writes a file of its own.
    """
    days = df.withColumn("day", F.to_date(ts)).hint("rebalance", F.col("day"))
    days.sortWithinPartitions("day", ts).write.mode(mode).partitionBy("day").parquet(path)


def partitions_in_range(partitions: DataFrame, low: str, high: str, start: str | None = None, end: str | None = None, descending: bool = False) -> DataFrame:
    """The partitions whose ``[low, high]`` meets ``[start, end]``, in the order of their times; open ends are None."""
    meets = F.lit(True)
    if end is not None:
        meets = meets & (F.col(low) <= F.lit(end).cast("timestamp"))
    if start is not None:
        meets = meets & (F.col(high) >= F.lit(start).cast("timestamp"))
    order = [F.col(high).desc(), F.col(low).desc()] if descending else [F.col(low).asc(), F.col(high).asc()]
    return partitions.where(meets).orderBy(*order)


def interval_names(spark: SparkSession, prefix: str, pattern: str, unit: str, start: str, end: str) -> DataFrame:
    """``name, low, high`` of the partitions that are named by their interval, like ``logs-2024.01.05`` with the pattern
    ``yyyy.MM.dd``: those of each ``unit`` that meets ``[start, end]``."""
    first = f"date_trunc('{unit}', timestamp'{start}')"
    low = spark.range(1).select(F.explode(F.expr(f"sequence({first}, timestamp'{end}', interval 1 {unit})")).alias("low"))
    high = F.col("low") + F.expr(f"interval 1 {unit}") - F.expr("interval 1 microsecond")
    return low.select(F.concat(F.lit(prefix), F.date_format("low", pattern)).alias("name"), "low", high.alias("high"))


def read_days(spark: SparkSession, path: str, ts: str, start: str, end: str) -> DataFrame:
    """Rows of ``[start, end)``; folders of other days are not read."""
    at = F.col(ts)
    return spark.read.parquet(path).where((F.col("day") >= F.lit(start).cast("date")) & (F.col("day") <= F.lit(end).cast("date")) & (at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp"))).drop("day")


def retained(df: DataFrame, written_at: str, ttl: Column | int, as_of: str) -> DataFrame:
    """Rows that are not older than their time to live, in seconds."""
    ttl = F.lit(ttl) if isinstance(ttl, int) else ttl
    return df.where(F.unix_seconds(written_at) + ttl > F.unix_seconds(F.lit(as_of).cast("timestamp")))


def catalog(df: DataFrame, metric: str, tags: str) -> DataFrame:
    """``kind, name``: the distinct metric names, tag names and tag values."""
    pairs = df.select(F.explode(tags).alias("k", "v"))
    names = df.select(F.lit("metric").alias("kind"), F.col(metric).alias("name"))
    return names.unionByName(pairs.select(F.lit("tag").alias("kind"), F.col("k").alias("name"))).unionByName(pairs.select(F.lit("value").alias("kind"), F.col("v").alias("name"))).distinct()


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that do not fit, those with an unknown answer included."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def topology_message(nodes: DataFrame, services: DataFrame, most: int = 10_000) -> DataFrame:
    """JSON documents for each deployment: host to ids, and its services; ``part`` counts them from 0.

    A document has at most ``most`` hosts and as many services, so that no list grows with the deployment.
    """
    part = lambda order: F.expr(f"(row_number() over (partition by deployment_id order by {order}) - 1) div {most}")
    hosts = nodes.groupBy("deployment_id", "host_name").agg(F.max(F.struct("customer_id", "cluster_id")).alias("ids")).withColumn("part", part("host_name"))
    hosts = hosts.groupBy("deployment_id", "part").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("host_name", "ids")))).alias("hosts"))
    listed = services.select("deployment_id", "cluster_id", "service").distinct().withColumn("part", part("cluster_id, service"))
    listed = listed.groupBy("deployment_id", "part").agg(F.sort_array(F.collect_list(F.struct("cluster_id", "service"))).alias("services"))
    return hosts.join(listed, ["deployment_id", "part"], "full").select("deployment_id", "part", F.to_json(F.struct("hosts", "services")).alias("message"))


def write_csv(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header; fields are quoted where they need it, quotes doubled."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def kafka_source(spark: SparkSession, servers: str, topic: str = "log", **options) -> DataFrame:
    """A stream of text lines from a topic (the connector is a package of the cluster's)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.options(**options).load().select(F.col("value").cast("string").alias("line"), F.col("timestamp").alias("received"))


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """A writer of ``key, value`` records to a topic."""
    return df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)


def tail_source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of lines of log files, with the file's name as a tag."""
    return spark.readStream.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))
