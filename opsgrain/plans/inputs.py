"""The tables at hand, projected onto the shapes of the operators; each with the same projection in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400
START, END, DAYS = "2024-01-01 00:00:00", "2024-01-31 00:00:00", 30
HOST = ["customer_id", "deployment_id", "cluster_id", "host_name", "plugin", "classification", "target"]
CLUSTER = ["customer_id", "deployment_id", "cluster_id", "plugin", "classification", "target"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with instants for its timestamps without a zone (the session's zone is UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(F.col(c).cast("timestamp") if kind == "timestamp_ntz" else F.col(c) for c, kind in df.dtypes))


def metrics(spark: SparkSession, sf_dir: str, three_modes: bool = False) -> DataFrame:
    """Metric rows from events; ``three_modes`` spreads the values so that an outer bin is often the fullest."""
    e = table(spark, sf_dir, "events")
    value = 50.0 * (F.col("event_id") % 3) + F.col("value") / 100 if three_modes else F.col("value")
    k = F.get_json_object("props", "$.k")
    error = F.when(F.col("event_type") == "error", F.create_map(F.lit("key_type"), F.lit("error"))).otherwise(F.create_map().cast("map<string,string>"))
    return e.select(
        "event_id", "user_id", F.lit("c1").alias("customer_id"), F.concat(F.lit("d"), F.col("user_id") % 2).alias("deployment_id"),
        F.concat(F.lit("cl"), F.col("user_id") % 4).alias("cluster_id"), F.concat(F.lit("h"), F.col("user_id") % 8).alias("host_name"),
        F.lit("app").alias("plugin"), F.col("event_type").alias("classification"), F.lit("*").alias("target"), value.alias("value"),
        "ts", F.date_trunc("day", "ts").alias("slot"), k.cast("long").alias("k"),
        F.map_concat(F.create_map(F.lit("k"), k, F.lit("high_water_mark"), F.lit("100")), error).alias("tags"), F.lit(100.0).alias("high_water_mark"),
    )


def metrics_sql(three_modes: bool = False) -> str:
    value = "50.0 * (event_id % 3) + value / 100" if three_modes else "value"
    return f"""metrics AS (
  SELECT event_id, user_id, 'c1' AS customer_id, 'd' || user_id % 2 AS deployment_id, 'cl' || user_id % 4 AS cluster_id,
         'h' || user_id % 8 AS host_name, 'app' AS plugin, event_type AS classification, '*' AS target, {value} AS value, ts,
         CAST(date_trunc('day', ts) AS TIMESTAMP) AS slot, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 100.0 AS high_water_mark FROM events)"""


def minutes(spark: SparkSession, sf_dir: str, three_modes: bool = False) -> DataFrame:
    """The rows of :func:`metrics` with each day pressed into a minute, so that thirty minutes are as full as thirty days."""
    start = F.unix_micros(F.lit(START).cast("timestamp"))
    pressed = metrics(spark, sf_dir, three_modes).withColumn("_since", F.unix_micros("ts") - start)
    pressed = pressed.withColumn("ts", F.timestamp_micros(start + F.expr("_since div 1440"))).drop("_since")
    return pressed.withColumn("slot", F.date_trunc("minute", "ts"))


def minutes_sql(three_modes: bool = False) -> str:
    pressed = f"make_timestamp(epoch_us(TIMESTAMP '{START}') + (epoch_us(ts) - epoch_us(TIMESTAMP '{START}')) // 1440)"
    return f"""{metrics_sql(three_modes).replace('metrics AS', 'days AS', 1)},
metrics AS (SELECT * REPLACE ({pressed} AS ts, CAST(date_trunc('minute', {pressed}) AS TIMESTAMP) AS slot) FROM days)"""


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for what a query writes on its way, in the folder of ``spark.checkpoint.dir``, which all executors share.

    Without that setting a temporary folder is taken if all runs on one machine; on a cluster this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{base.rstrip('/')}/queries/{name}-{uuid.uuid4().hex}"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service calls from line items: customer's nation calls supplier's nation on a port."""
    t = lambda n: table(spark, sf_dir, n)
    # orders meet their customers first, so that line items, the largest table, are dealt once
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        F.concat(F.lit("n"), "c_nationkey").alias("from_cluster"), F.concat(F.lit("n"), "s_nationkey").alias("to_cluster"),
        F.concat(F.lit("u"), F.col("c_custkey") % 40).alias("from_host"), F.concat(F.lit("s"), F.col("s_suppkey") % 40).alias("to_host"),
        F.col("l_linenumber").alias("port"), F.date_trunc("month", "l_shipdate").alias("ts"),
        F.round(F.col("l_extendedprice") / 100).cast("long").alias("avg_rsp_size"), F.round(F.col("l_discount") * 1000).cast("long").alias("avg_ttfb"),
        F.round(F.col("l_discount") * 1000 + F.col("l_tax") * 1000).cast("long").alias("avg_ttlb"), F.round(F.col("l_discount") * 2000).cast("long").alias("max_ttfb"),
        F.round(F.col("l_discount") * 2000 + F.col("l_tax") * 2000).cast("long").alias("max_ttlb"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("long").alias("error_count"),
        F.col("l_quantity").cast("long").alias("request_count"), F.round(F.col("l_extendedprice")).cast("long").alias("sent_bytes"),
        F.round(F.col("o_totalprice") / 10).cast("long").alias("recv_bytes"), F.col("l_quantity").cast("long").alias("duration"),
        F.col("l_orderkey").alias("call_id"), "l_partkey",
    )


FLOWS_SQL = """flows AS (
  SELECT 'n' || c_nationkey AS from_cluster, 'n' || s_nationkey AS to_cluster, 'u' || c_custkey % 40 AS from_host, 's' || s_suppkey % 40 AS to_host,
         l_linenumber AS port, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts, CAST(round(l_extendedprice / 100) AS BIGINT) AS avg_rsp_size,
         CAST(round(l_discount * 1000) AS BIGINT) AS avg_ttfb, CAST(round(l_discount * 1000 + l_tax * 1000) AS BIGINT) AS avg_ttlb,
         CAST(round(l_discount * 2000) AS BIGINT) AS max_ttfb, CAST(round(l_discount * 2000 + l_tax * 2000) AS BIGINT) AS max_ttlb,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS error_count, CAST(l_quantity AS BIGINT) AS request_count,
         CAST(round(l_extendedprice) AS BIGINT) AS sent_bytes, CAST(round(o_totalprice / 10) AS BIGINT) AS recv_bytes, CAST(l_quantity AS BIGINT) AS duration,
         l_orderkey AS call_id, l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(*(F.round(F.col(c) + NUDGE, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


#: Added before rounding, so that halves of the last digit fall to one side whatever the order of additions.
NUDGE = 3e-9


def nudged(sql: str) -> str:
    """SQL with :data:`NUDGE` added in each ``round(x, digits)``, as :func:`rounded` does."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, comma, j = 1, -1, i + 6
        while depth:
            c = sql[j]
            depth += (c == "(") - (c == ")")
            comma = j if c == "," and depth == 1 else comma
            j += 1
        inner = sql[i + 6 : comma if comma >= 0 else j - 1]
        out += sql[at:i] + "round(" + nudged(inner) + (f" + {NUDGE}{sql[comma:j]}" if comma >= 0 else ")")
        at = j
    return out + sql[at:]
