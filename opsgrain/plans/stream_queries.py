"""Queries that run as streams, and queries of minutes, with SQL.

A stream's rows come in parts, one after the other in time. After each part the stream runs until it has read all there is,
and ends; with the next part it goes on from its checkpoint. What it has written by then is the query's result.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from opsgrain.operators import detect as D
from opsgrain.operators import stats as S
from opsgrain.plans.anomaly_queries import CK, DELTA_SQL, DIST, DIST_SQL, FLAGGED, HK, INSTANCE_SQL, PEERS, SERIES, detect_sql, extra, fit_sql, graded_sql
from opsgrain.plans.inputs import CLUSTER, DAYS, HOST, START, metrics_sql, minutes, minutes_sql, nudged, rounded, scratch
from opsgrain.sources import tables
from opsgrain.streaming import detectors, jobs
from opsgrain.streaming.hours import latest, read_hours

MINUTE, PARTS = 60, 3
#: The first and the last minute, as the session's zone (UTC) has them.
FIRST = datetime.fromisoformat(START)
LAST = FIRST + timedelta(minutes=DAYS - 1)

# ---------------------------------------------------------------- minutes


def minute_cluster_stats(spark, sf):
    out = S.distribution(minutes(spark, sf, True), PEERS, "value", True, extra())
    return rounded(out.select(*PEERS, *DIST, "last_event", F.greatest("score", "share").alias("final_score")))


def _relative(spark, sf) -> DataFrame:
    rows = minutes(spark, sf, True)
    return S.relative_to_peers(S.distribution(rows, SERIES, "value", False, extra()), S.distribution(rows, PEERS, "value", True), PEERS)


def minute_instance_stats(spark, sf):
    return rounded(_relative(spark, sf).select(*SERIES, *DIST, "peer_score", "relative", F.greatest("relative", "share").alias("final_score")))


def minute_detect_threshold(spark, sf):
    flags = minutes(spark, sf).groupBy(*SERIES).agg(F.max(F.col("value") >= F.col("high_water_mark")).alias("flag"))
    return D.detect(flags, HOST, "slot", "threshold", MINUTE, DAYS)


def minute_detect_peer(spark, sf):
    return D.detect(_relative(spark, sf).select(*SERIES, D.peer_flag(F.col("relative")).alias("flag")), HOST, "slot", "peer", MINUTE, DAYS)


# ---------------------------------------------------------------- streams


def _parts(rows: DataFrame):
    """The rows of each part: whole minutes."""
    minute = F.floor((F.unix_seconds("ts") - F.unix_seconds(F.lit(START).cast("timestamp"))) / MINUTE)
    return [rows.where((minute >= DAYS * i // PARTS) & (minute < DAYS * (i + 1) // PARTS)) for i in range(PARTS)]


def stream(rows: DataFrame, path: str, writer: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Runs the stream that ``writer`` makes over ``rows``, once for each part, under ``path``."""
    spark = rows.sparkSession
    for part in _parts(rows):
        part.write.mode("append").parquet(f"{path}/in")
        read = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        writer(read).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stream_slot_stats(spark, sf):
    path, rows = scratch(spark, "slots"), minutes(spark, sf).select("ts", "host_name", "classification", "value")
    stream(rows, path, lambda s: jobs.slot_stats(s, ["host_name", "classification"], "ts", "value", nearest=True).writeStream.foreachBatch(jobs.idempotent(f"{path}/out")))
    return rounded(spark.read.parquet(f"{path}/out").drop("batch"))


def stream_deltas(spark, sf):
    path = scratch(spark, "deltas")
    rows = minutes(spark, sf).select("event_id", "ts", F.concat_ws(":", *HOST).alias("series"), "value")
    stream(rows, path, lambda s: s.writeStream.foreachBatch(jobs.delta_sink(path, "series", "event_id", "ts", "value")))
    return rounded(spark.read.parquet(f"{path}/deltas").select("event_id", "delta", "elapsed_ms"))


def stream_keyed_deltas(spark, sf):
    """The same by the form that keeps each key's last record as the stream's state."""
    path = scratch(spark, "deltas")
    rows = minutes(spark, sf).select("event_id", "ts", F.concat_ws(":", *HOST).alias("series"), "value")
    stream(rows, path, lambda s: jobs.deltas(s, "series", "event_id", "ts", "value").writeStream.foreachBatch(jobs.idempotent(f"{path}/out")))
    return rounded(spark.read.parquet(f"{path}/out").select("event_id", "delta", "elapsed_ms"))


def stream_running_variance(spark, sf):
    """All keys after the last batch."""
    path, rows = scratch(spark, "variance"), minutes(spark, sf).select("ts", "host_name", "classification", "value")
    stream(rows, path, lambda s: jobs.running_variance(s, ["host_name", "classification"], "value").writeStream.outputMode("complete").foreachBatch(jobs.idempotent(f"{path}/out")))
    out = spark.read.parquet(f"{path}/out")
    return rounded(out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch"), 5)


def stream_once(spark, sf):
    """Events that both ends report, the second up to a minute and a half later, so at times in the next part."""
    path, rows = scratch(spark, "once"), minutes(spark, sf).select("event_id", "ts")
    other = rows.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") % 90 * 1_000_000))
    # second reports after the last minute are not in any part
    stream(rows.unionByName(other), path, lambda s: jobs.once(s, ["event_id"], "ts").select("event_id").writeStream.foreachBatch(jobs.idempotent(f"{path}/out")))
    return spark.read.parquet(f"{path}/out").select("event_id")


def stream_fan_out(spark, sf):
    """A table and lines of text from one reading of each batch."""
    path, rows = scratch(spark, "fan"), minutes(spark, sf).select("event_id", "ts", "classification")
    sinks = jobs.fan_out(jobs.idempotent(f"{path}/table"), jobs.text_sink(f"{path}/text", F.concat_ws(" ", "classification", "event_id")))
    stream(rows, path, lambda s: s.writeStream.foreachBatch(sinks))
    table = spark.read.parquet(f"{path}/table").select(F.lit("table").alias("kind"), F.concat_ws(" ", "classification", "event_id").alias("line"))
    return table.unionByName(spark.read.text(f"{path}/text").select(F.lit("text").alias("kind"), F.col("value").alias("line")))


def _watched(spark, sf, detector: detectors.Detector, three_modes: bool = False) -> DataFrame:
    """Grades of the finished minutes by a detector that goes on from batch to batch."""
    path = scratch(spark, detector.name)
    rows = minutes(spark, sf, three_modes).select("event_id", "ts", *HOST, "value", "high_water_mark")
    job = jobs.minute_job(path, HOST, value=None, detectors=[detector], mend_seconds=300, window_seconds=600)
    stream(rows, path, lambda s: s.writeStream.foreachBatch(job))
    start = int((FIRST - datetime(1970, 1, 1)).total_seconds())
    out = detectors.graded_between(spark, f"{path}/{detector.name}/graded", HOST, start, start + DAYS * MINUTE, PARTS)
    return rounded(out.select(*SERIES, "score", "severity"))


def stream_threshold(spark, sf):
    return _watched(spark, sf, detectors.threshold(HOST))


def stream_peer(spark, sf):
    return _watched(spark, sf, detectors.peer(HOST, CLUSTER, few=True), True)  # eight hosts


def stream_wire_stats(spark, sf):
    """From log files of wire lines, as they grow, to the statistics of finished minutes."""
    path, rows = scratch(spark, "wire"), minutes(spark, sf, True)
    pairs = {"plugin": F.concat_ws(".", "plugin", "classification"), "host": F.concat("host_name", F.lit(":10.0.0.1")), "cluster_id": "cluster_id", "deployment_id": "deployment_id", "customer_id": "customer_id", "ts": F.unix_millis("ts"), "value": F.col("value").cast("string")}
    line = F.concat_ws(",", *(F.concat(F.lit(f"{k}="), v) for k, v in pairs.items()))
    job = jobs.minute_job(path, CLUSTER, mend_seconds=300)
    for part in _parts(rows):
        part.select(line.alias("value")).write.mode("append").text(f"{path}/in")
        jobs.run_minutes(tables.tail_source(spark, f"{path}/in"), path, job, None).awaitTermination()
    out = latest(read_hours(spark, f"{path}/stats", FIRST, LAST), PEERS)
    return rounded(out.select(*PEERS, *(c for c in DIST if c != "share")))


def _minute(sql: str) -> str:
    return sql.replace(metrics_sql(True), minutes_sql(True)).replace(metrics_sql(), minutes_sql())


#: Slots before this second were finished when the streams ended.
END_SQL = f"(SELECT (epoch_us(max(ts)) // 1000000 - 120) // {MINUTE} * {MINUTE} FROM metrics)"
FLAGS = FLAGGED + ", flags AS (SELECT * FROM flagged)"
PEER_FLAGS = INSTANCE_SQL.removeprefix("WITH ") + f", flags AS (SELECT {HK}, slot, relative <> 0 AS flag FROM scored)"
_watch = lambda flags: f"WITH {flags}, {graded_sql('flags', HK)} SELECT {HK}, slot, round(score, 6) AS score, severity FROM graded WHERE epoch(slot) < {END_SQL}"
_deltas = f"WITH {DELTA_SQL} SELECT event_id, round(delta, 6) AS delta, round(elapsed_ms, 6) AS elapsed_ms FROM deltas"

SQL = {
    "minute_cluster_stats": f"WITH {metrics_sql(True)}, {fit_sql('metrics', f'{CK}, slot', 'p', True)} SELECT {CK}, slot, {DIST_SQL}, last_event, round(greatest(score, share), 6) AS final_score FROM p",
    "minute_instance_stats": f"{INSTANCE_SQL} SELECT {HK}, slot, {DIST_SQL}, round(peer_score, 6) AS peer_score, round(relative, 6) AS relative, round(greatest(relative, share), 6) AS final_score FROM scored",
    "minute_detect_threshold": detect_sql(FLAGS, HK, "threshold", grain=MINUTE),
    "minute_detect_peer": detect_sql(PEER_FLAGS, HK, "peer", grain=MINUTE),
    "stream_slot_stats": f"WITH {metrics_sql()} SELECT slot, host_name, classification, count(value) AS size, round(min(value), 6) AS min_val, round(max(value), 6) AS max_val, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stddev FROM metrics WHERE epoch_ms(slot) + 60000 <= (SELECT epoch_ms(max(ts)) FROM metrics) - 120000 GROUP BY 1, 2, 3",
    "stream_deltas": _deltas,
    "stream_keyed_deltas": _deltas,
    "stream_running_variance": f"WITH {metrics_sql()} SELECT host_name, classification, count(value) AS n, round(avg(value), 5) AS mean, round(var_pop(value), 5) AS var_pop FROM metrics GROUP BY 1, 2",
    "stream_once": "SELECT DISTINCT event_id FROM events",
    "stream_fan_out": "SELECT kind, event_type || ' ' || event_id AS line FROM events, (VALUES ('table'), ('text')) AS k(kind)",
    "stream_threshold": _watch(FLAGS),
    "stream_peer": _watch(PEER_FLAGS),
    "stream_wire_stats": f"WITH {metrics_sql(True)}, {fit_sql('metrics', f'{CK}, slot', 'p', True)} SELECT {CK}, slot, {DIST_SQL.removesuffix(', round(share, 6) AS share')} FROM p WHERE epoch(slot) < {END_SQL}",
}
SQL = {name: nudged(_minute(sql)) for name, sql in SQL.items()}
QUERIES = {name: globals()[name] for name in SQL}
