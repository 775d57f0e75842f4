"""Joins: versions as of a time, enrichment, absent entities, address ranges, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_versions(versions: DataFrame, keys: list[str], ts: str, as_of: str, active: str, tie: Sequence[str] = ()) -> DataFrame:
    """The latest version of each key at or before ``as_of``, if it is active (an inactive latest one hides older ones)."""
    rest = [c for c in versions.columns if c not in keys]
    seen = versions.where(F.col(ts) <= F.lit(as_of).cast("timestamp"))
    latest = seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, *tie)).alias("_v"))
    return latest.select(*keys, "_v.*").where(F.col(active))


def enrich(samples: DataFrame, dim: DataFrame, key: str, columns: Sequence[str], unknown: str = "unknown") -> DataFrame:
    """Adds a dimension's columns; ``unknown`` where the key is not found. Spark broadcasts the dimension where it is small."""
    out = samples.join(dim.select(key, *columns), key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(unknown)) for c in columns})


def resolve_edges(edges: DataFrame, nodes: DataFrame, services: DataFrame) -> DataFrame:
    """Edges ``from_ip, to_ip, port`` with the clusters of their ends (unknown ones ``*``) and their service.

    ``nodes`` has ip, cluster; ``services`` cluster, port, service. Edges without a service are left out; of several
    services of one port the smallest counts.
    """
    side = lambda s: nodes.groupBy(F.col("ip").alias(f"{s}_ip")).agg(F.min("cluster").alias(f"{s}_cluster"))
    out = edges.join(side("from"), "from_ip", "left").join(side("to"), "to_ip", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit("*")) for c in ("from_cluster", "to_cluster")})
    known = services.groupBy(F.col("cluster").alias("to_cluster"), "port").agg(F.min("service").alias("service"))
    return out.join(known, ["to_cluster", "port"])


def absent(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Expected entities of which nothing was seen."""
    return expected.select(*keys).distinct().join(seen.select(*keys).distinct(), keys, "left_anti")


def service_observations(services: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """Services with a map of their anomalies by subtype, empty where there are none."""
    counts = observations.groupBy(*keys, "sub_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sub_type", "n")))).alias("observations"))
    return services.join(maps, keys, "left").withColumn("observations", F.coalesce("observations", F.create_map().cast("map<string,bigint>")))


def ip_range_join(rows: DataFrame, value: Column, ranges: DataFrame, prefix: int = 16) -> DataFrame:
    """Rows with the range ``low, high`` of numbers that holds their address; rows in none stay with nulls.

    Each range is listed under every address prefix that it touches, so the join is on equal prefixes; the narrowest
    range counts, of several the first.
    """
    shift = 32 - prefix
    listed = ranges.withColumn("_p", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright("high", shift))))
    keyed = rows.withColumn("_v", value)
    # one answer for each distinct address, then back to the rows
    distinct = keyed.select("_v").where("_v is not null").distinct().withColumn("_p", F.shiftright("_v", shift))
    hit = distinct.join(listed, "_p").where("_v between low and high")
    best = hit.groupBy("_v").agg(F.min_by(F.struct(*ranges.columns), F.struct(F.col("high") - F.col("low"), F.col("low"))).alias("_r"))
    return keyed.join(best, "_v", "left").select(*rows.columns, "_r.*")


def snapshot_rate(df: DataFrame, keys: list[str], ts: str, values: Sequence[str]) -> DataFrame:
    """Per-second change of each value since the snapshot before; the first of a key has nulls."""
    w = Window.partitionBy(*keys).orderBy(ts)
    seconds = F.unix_seconds(ts) - F.lag(F.unix_seconds(ts)).over(w)
    return df.select(*keys, ts, *(F.try_divide(F.col(v) - F.lag(v).over(w), seconds).alias(f"{v}_per_sec") for v in values))


def ratio_counters(df: DataFrame, keys: list[str], name: str, kind: str, value: str) -> DataFrame:
    """Counters by kind: ``ratio`` and ``average`` are divided by the counter ``<name> base``, others stay; a zero base gives null."""
    base = df.where(F.col(kind) == "base").select(*keys, F.regexp_replace(name, " base$", "").alias(name), F.col(value).alias("_b"))
    top = df.where(F.col(kind) != "base").join(base, [*keys, name], "left")
    return top.select(*keys, name, kind, F.when(F.col(kind) == "ratio", 100 * F.try_divide(value, "_b")).when(F.col(kind) == "average", F.try_divide(value, "_b")).otherwise(F.col(value)).alias("value"))


def io_latency(stats: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Reads, writes and stalls of files with their names; latencies are null without operations."""
    return stats.join(files, keys, "inner").withColumns({
        "read_latency": F.try_divide("read_stall", "reads"), "write_latency": F.try_divide("write_stall", "writes"),
        "latency": F.try_divide(F.col("read_stall") + F.col("write_stall"), F.col("reads") + F.col("writes")),
    })
