"""Anomaly detectors: a flag for each slot of a series, then one pipeline from flags to quantised severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgrain.operators.severity import CRITICAL, HEALTHY, WARN, decayed_score, gap_fill, quantized_severity, severity_grade

#: Shares of the range for one run and in all, by detector.
MAJORITIES = {
    "peer": (0.25, 0.5), "threshold": (0.25, 0.5), "error": (0.25, 0.5), "exhaustion": (0.25, 0.5),
    "heartbeat": (0.08, 0.2), "service": (0.03, 0.1), "non_participation": (0.5, 0.75), "network": (0.25, 0.5),
}
#: Minutes ahead that exhaustion looks.
HORIZON = 1440


def graded(flags: DataFrame, series: list[str], ts: str, soften: bool = False) -> DataFrame:
    """Flags to scores and grades; ``soften`` turns critical into warn."""
    out = decayed_score(flags, series, ts, "flag").withColumn("severity", severity_grade(F.col("score")))
    return out.withColumn("severity", F.when(F.col("severity") == CRITICAL, WARN).otherwise(F.col("severity"))) if soften else out


def detect(flags: DataFrame, series: list[str], ts: str, kind: str, grain: int, slots: int, replicated: bool = False) -> DataFrame:
    """Non-healthy series of ``series, ts, flag`` rows (one for each slot that counts): quantised severity and kind."""
    single, majority = MAJORITIES[kind]
    found = quantized_severity(graded(flags, series, ts, kind == "non_participation"), series, ts, grain, slots, single, majority, replicated)
    return found.where(F.col("severity") < HEALTHY).withColumn("class_type", F.lit(kind))


def peer_flag(relative: Column) -> Column:
    """A finite relative score other than 0."""
    return F.coalesce((relative != 0) & ~F.isnan(relative) & (F.abs(relative) != float("inf")), F.lit(False))


def absent_flags(present: DataFrame, entities: DataFrame, keys: list[str], ts: str, start: str, end: str, grain: int) -> DataFrame:
    """One row for each slot of each expected entity; the flag says that nothing was seen of it in the slot."""
    seen = present.select(*keys, ts).distinct()
    return gap_fill(seen, entities, keys, ts, start, end, grain, {}).withColumn("flag", ~F.col("present"))


def exhaustion_minutes(velocity: Column, acceleration: Column, room: Column, horizon: int = HORIZON) -> Column:
    """The first whole minute t up to ``horizon`` with velocity / 60 * t + acceleration / 3600 * t^2 / 2 >= room, t in seconds.

    Null where the mark is not reached; 0 where there is no room left. The growth first reaches the room at the
    smaller positive root of the parabola.
    """
    v, a = velocity / 60, acceleration / 7200
    under = v * v + 4 * a * room
    root = F.when(a == 0, F.when(v > 0, room / v)).when(under >= 0, 2 * room / (v + F.sqrt(under)))
    minutes = F.ceil(root / 60 - F.lit(1e-9))
    return F.when(room <= 0, 0).when((root > 0) & (minutes <= horizon), minutes).cast("long")


def exhaustion(df: DataFrame, series: list[str], ts: str) -> DataFrame:
    """Adds ``eta`` and ``min_eta`` (over the last five rows) to rows of ``mean, high_water_mark`` in a series.

    Velocity is the change of the mean per minute since the row before, acceleration that of the velocity.
    """
    w = Window.partitionBy(*series).orderBy(ts)
    minutes = (F.unix_seconds(ts) - F.lag(F.unix_seconds(ts)).over(w)) / 60
    out = df.withColumn("velocity", (F.col("mean") - F.lag("mean").over(w)) / minutes).withColumn("_minutes", minutes)
    out = out.withColumn("acceleration", F.coalesce((F.col("velocity") - F.lag("velocity").over(w)) / F.col("_minutes"), F.lit(0.0)))
    out = out.withColumn("eta", exhaustion_minutes(F.col("velocity"), F.col("acceleration"), F.col("high_water_mark") - F.col("mean")))
    return out.withColumn("min_eta", F.min("eta").over(w.rowsBetween(-4, 0))).drop("_minutes")


#: Measures of flows, their modes (high: over the peers' band, low: under it), and what a hit is called.
NETWORK = [
    ("avg_rsp_size", "high", "whale"), ("avg_rsp_size", "low", "chatty"),
    ("avg_ttfb", "high", "poor_performance"), ("avg_ttfb", "low", "high_performance"),
    ("avg_ttlb", "high", "poor_performance"), ("avg_ttlb", "low", "high_performance"),
    ("max_ttfb", "high", "poor_performance"), ("max_ttfb", "low", "high_performance"),
    ("max_ttlb", "high", "poor_performance"), ("max_ttlb", "low", "high_performance"),
    ("recv_bytes", "high", "hotspot"), ("recv_bytes", "low", "under_utilized"),
    ("sent_bytes", "high", "hotspot"), ("sent_bytes", "low", "under_utilized"),
    ("request_count", "high", "hotspot"), ("request_count", "low", "under_utilized"),
    ("duration", "high", "hotspot"), ("duration", "low", "under_utilized"),
    ("error_count", "high", "errors_over_peers"), ("error_count", "any", "errors"),
]


def network_flags(flows: DataFrame, peers: list[str], series: list[str], ts: str, table: list[tuple[str, str, str]] = NETWORK) -> DataFrame:
    """Flags of all measures and modes at once: ``series, ts, measure, mode, sub_type, flag``.

    Each flow is compared with mean and two sample deviations of its measure over ``peers`` in the slot; mode
    ``both`` flags either side, ``any`` every positive value. One unpivot, one aggregate and one join.
    Flows without a peer group or a time meet no band; they are left out before, so that both sides of the join
    read the same flows, which are then shuffled and summed once.
    """
    for key in (*peers, ts):
        flows = flows.where(F.col(key).isNotNull())
    measures = list(dict.fromkeys(m for m, _, _ in table))
    keys = list(dict.fromkeys([*series, *peers, ts]))
    long = flows.select(*keys, *(F.col(m).cast("double") for m in measures)).unpivot(keys, measures, "measure", "value")
    band = long.groupBy(*peers, ts, "measure").agg(F.avg("value").alias("_m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("_s"))
    modes = F.array(*(F.struct(F.lit(m).alias("measure"), F.lit(k).alias("mode"), F.lit(t).alias("sub_type")) for m, k, t in table))
    each = long.join(band, [*peers, ts, "measure"]).withColumn("_t", F.explode(F.filter(modes, lambda t: t["measure"] == F.col("measure"))))
    x, high, low = F.col("value"), F.col("_m") + 2 * F.col("_s"), F.col("_m") - 2 * F.col("_s")
    mode = F.col("_t.mode")
    flag = F.when(mode == "high", x > high).when(mode == "low", x < low).when(mode == "both", (x > high) | (x < low)).otherwise(x > 0)
    return each.select(*keys, "measure", mode.alias("mode"), F.col("_t.sub_type").alias("sub_type"), flag.alias("flag"))


def anomaly_message(severity: Column, sub_type: Column, total: Column, longest: Column, duration: Column, replicated: Column) -> Column:
    """A sentence that says how bad, what, for how long, and whether others can take over."""
    word = F.when(severity == CRITICAL, "Critical").when(severity == WARN, "Warning").when(severity < HEALTHY, "Notice").otherwise("Healthy")
    how = F.when(total == duration, F.lit("throughout")).when(longest == total, F.format_string("once, for %d of %d slots", total, duration)).otherwise(
        F.format_string("for %d of %d slots, at most %d in a row", total, duration, longest)
    )
    return F.when(severity == HEALTHY, F.lit("Healthy")).otherwise(F.concat(word, F.lit(": "), sub_type, F.lit(" "), how, F.when(replicated, F.lit(" (redundant)")).otherwise(F.lit(""))))
