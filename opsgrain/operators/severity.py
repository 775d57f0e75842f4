"""Severity: decayed scores, grades, runs of equal grade, merges, and quantised severity. Lower grades are worse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grades and the scores above which they hold, worst first.
CRITICAL, WARN, INFO, HEALTHY = 1, 20, 30, 100
BOUNDS = ((CRITICAL, 0.5), (WARN, 0.3), (INFO, 0.1))
#: Rows that a decayed score looks back on, and the divisor of a series' first row (twice its only weight).
TRAILING, FIRST_DIVISOR = 5, 2


def severity_grade(score: Column) -> Column:
    """The grade of a score; scores that are null, over 1 or not positive are healthy."""
    out = F.lit(HEALTHY)
    for (grade, low), high in reversed([*zip(BOUNDS, (1.0, *(b for _, b in BOUNDS)), strict=False)]):
        out = F.when((score > low) & (score <= high), grade).otherwise(out)
    return out


def decayed_score(df: DataFrame, series: list[str], order: str, flag: str) -> DataFrame:
    """Adds ``score``: the weighted share of flagged rows among the last five of the series, the newest heaviest."""
    w = Window.partitionBy(*series).orderBy(order)
    k = F.least(F.row_number().over(w), F.lit(TRAILING))
    hits = sum(F.greatest(k - i, F.lit(0)) * F.coalesce(F.lag(F.col(flag).cast("int"), i).over(w), F.lit(0)) for i in range(TRAILING))
    return df.withColumn("score", hits / F.when(k == 1, FIRST_DIVISOR).otherwise(k * (k + 1) / 2))


def severity_runs(df: DataFrame, series: list[str], ts: str, grain: int, how: str = "min") -> DataFrame:
    """Runs of slots, ``grain`` seconds apart, of one severity: ``series, severity, start, duration, score``.

    ``duration`` counts slots; ``how`` is ``min``, or ``avg`` for the mean score, or ``weighted`` where the rows
    are runs themselves, with a ``duration``, and join end to start.
    """
    w = Window.partitionBy(*series).orderBy(ts)
    at = F.unix_seconds(F.col(ts))
    length = F.col("duration") if how == "weighted" else F.lit(1)
    after = F.lag(at + length * grain).over(w)
    new = F.when((F.lag("severity").over(w) == F.col("severity")) & (after == at), 0).otherwise(1)
    numbered = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    score = {"min": F.min("score"), "avg": F.avg("score"), "weighted": F.sum(F.col("score") * length) / F.sum(length)}[how]
    return numbered.groupBy(*series, "severity", "_run").agg(F.min(ts).alias("start"), F.sum(length).alias("duration"), score.alias("score")).drop("_run")


def unfold_runs(runs: DataFrame, grain: int) -> DataFrame:
    """One row per slot of each run, ``slot`` instead of start and duration."""
    slots = F.expr(f"sequence(0, cast(duration as int) - 1)")
    return runs.withColumn("_i", F.explode(slots)).withColumn("slot", F.timestamp_seconds(F.unix_seconds("start") + F.col("_i") * grain)).drop("_i", "start", "duration")


def gap_fill(df: DataFrame, entities: DataFrame, keys: list[str], ts: str, start: str, end: str, grain: int, defaults: dict) -> DataFrame:
    """All slots of ``[start, end)`` for each entity, with ``defaults`` where a slot has no row, and ``present``.

    The slots are built for each entity, not for each row.
    """
    spine = entities.select(*keys).distinct().withColumn(
        ts, F.explode(F.expr(f"sequence(timestamp'{start}', timestamp'{end}' - interval {grain} seconds, interval {grain} seconds)"))
    )
    out = spine.join(df.withColumn("present", F.lit(True)), [*keys, ts], "left")
    for name, value in ({"present": False} | defaults).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def worst_of_merge(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Per slot the worst grade over all series and the mean score at that grade."""
    by = df.groupBy(*keys, ts, "severity").agg(F.sum("score").alias("_s"), F.count("*").alias("_n"))
    worst = by.groupBy(*keys, ts).agg(F.min_by(F.struct("severity", (F.col("_s") / F.col("_n")).alias("score")), F.col("severity")).alias("_w"))
    return worst.select(*keys, ts, F.col("_w.severity").alias("severity"), F.col("_w.score").alias("score"))


def quantized_severity(df: DataFrame, series: list[str], ts: str, grain: int, slots: int, single: float = 0.25, majority: float = 0.5, replicated: bool = True) -> DataFrame:
    """One severity for each series over a range of ``slots`` slots, from graded slots.

    The worst grade that occurs and, where the entity is replicated, holds for more than ``majority`` of the
    range in all or for at least ``single`` of it in one run; else healthy. Returns series, severity,
    total_severity_duration, single_max_severity_duration, total_duration.
    """
    runs = severity_runs(df, series, ts, grain)
    by = runs.groupBy(*series, "severity").agg(F.sum("duration").alias("total"), F.max("duration").alias("longest"))
    enough = F.lit(True) if not replicated else (F.col("total") > majority * slots) | (F.col("longest") >= single * slots)
    holds = (F.col("severity") < HEALTHY) & enough
    out = by.groupBy(*series).agg(F.min_by(F.when(holds, F.struct("severity", "total", "longest")), F.when(holds, F.col("severity"))).alias("_q"))
    return out.select(
        *series, F.coalesce("_q.severity", F.lit(HEALTHY)).alias("severity"), F.coalesce("_q.total", F.lit(0)).cast("long").alias("total_severity_duration"),
        F.coalesce("_q.longest", F.lit(0)).cast("long").alias("single_max_severity_duration"), F.lit(slots).cast("long").alias("total_duration"),
    )


def quantize_thermals(df: DataFrame, keys: list[str], severity: str, replicated: bool = False) -> DataFrame:
    """One grade for a set of slots: the worst that occurs, or, where replicated, that over half of the slots have."""
    n = F.count("*")
    out = F.lit(HEALTHY)
    for grade in (INFO, WARN, CRITICAL):
        c = F.count_if(F.col(severity) == grade)
        out = F.when(c > 0.5 * n if replicated else c > 0, grade).otherwise(out)
    return df.groupBy(*keys).agg(out.alias("thermal"), n.alias("slots"))


def severity_counts(df: DataFrame, keys: list[str], severity: str = "severity") -> DataFrame:
    """Rows of each grade, as four columns."""
    return df.groupBy(*keys).agg(*(F.count_if(F.col(severity) == g).alias(f"n_{g}") for g in (CRITICAL, WARN, INFO, HEALTHY)))


def requantize(df: DataFrame, keys: list[str], ts: str, grain: int, coarse: int, **majorities) -> DataFrame:
    """Quantised severity of each coarse slot (``coarse`` fine slots), healthy ones left out."""
    wide = grain * coarse
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(ts) / wide) * wide)
    merged = worst_of_merge(df.withColumn("_wide", slot), [*keys, "_wide"], ts)
    found = quantized_severity(merged, [*keys, "_wide"], ts, grain, coarse, **majorities)
    return found.where(F.col("severity") < HEALTHY).withColumnRenamed("_wide", "slot")


def severity_grid(df: DataFrame, top: int = 4) -> Column:
    """The heat of a slot: its grade's level (0 healthy to 3 critical) plus the rounded share of what is above it."""
    level = F.when(F.col("severity") == CRITICAL, 3).when(F.col("severity") == WARN, 2).when(F.col("severity") == INFO, 1).otherwise(0)
    return (level + F.round((top - level) * F.col("score"))).cast("int")
