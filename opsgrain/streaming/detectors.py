"""Detectors that go on from batch to batch: flags of finished slots, scores over a series' last rows, runs of grades.

A detector keeps, under its own folder, what the next batch needs and no more:

* ``tail``: the rows of each series that late samples may still change, and the few before them that scores look back on;
* ``open``: the run of grades that each series is in where its settled rows end.

A batch joins the flags of its slots to the tail, grades what may have changed with the functions that a batch run uses,
and writes those slots to ``graded``, and the quantised severity of the windows that they are in to ``anomalies``. Rows that are settled by now are added to the open runs; runs that end there go to
``runs``. Both states are rewritten as a whole by each batch, in a folder of its own; only the batch before is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsgrain.operators import detect as D
from opsgrain.operators.rollup import quantized, series_summaries
from opsgrain.operators.severity import HEALTHY, TRAILING, severity_runs
from opsgrain.operators.stats import distribution, relative_to_peers
from opsgrain.streaming.hours import latest, read_hours, utc, write_hours

#: Tables of which only the last batch's rows are read.
STATE = ("tail", "open")


@dataclass
class Detector:
    """``rows`` makes the rows of ``series, slot`` and what the flag needs from all samples of some slots and those slots
    (a row each, ``slot``); ``flags`` adds ``flag`` from a series' rows in order. ``back`` rows before one decide its flag."""

    name: str
    series: list[str]
    rows: Callable[[DataFrame, DataFrame], DataFrame]
    flags: Callable[[DataFrame], DataFrame] = field(default=lambda rows: rows)
    back: int = 0
    soften: bool = False

    def graded(self, rows: DataFrame) -> DataFrame:
        """Scores and grades of a series' rows, all that there are or a stretch of them."""
        return D.graded(self.flags(rows), self.series, "slot", self.soften)


def threshold(series: list[str], value: str = "value", mark: str = "high_water_mark") -> Detector:
    """A value that reaches its high-water mark."""
    rows = lambda samples, _: samples.groupBy(*series, "slot").agg(F.coalesce(F.max(F.col(value) >= F.col(mark)), F.lit(False)).alias("flag"))
    return Detector("threshold", series, rows)


def peer(series: list[str], peers: list[str], value: str = "value", few: bool = False) -> Detector:
    """A series whose values spread otherwise than those of all its peers; ``few``: series are few, however many the samples."""

    def rows(samples: DataFrame, _: DataFrame) -> DataFrame:
        own, all_ = distribution(samples, [*series, "slot"], value, few=few), distribution(samples, [*peers, "slot"], value, True, few=few)
        return relative_to_peers(own, all_, [*peers, "slot"]).select(*series, "slot", D.peer_flag(F.col("relative")).alias("flag"))

    return Detector("peer", series, rows)


def error(series: list[str], is_error: Column, value: str = "value") -> Detector:
    """Errors on average."""
    rows = lambda samples, _: samples.where(is_error).groupBy(*series, "slot").agg(F.coalesce(F.avg(value) > 0, F.lit(False)).alias("flag"))
    return Detector("error", series, rows)


def exhaustion(series: list[str], value: str = "value", mark: str = "high_water_mark") -> Detector:
    """A mean that is to reach its mark within the horizon, by its change and that of the change."""
    rows = lambda samples, _: samples.groupBy(*series, "slot").agg(F.avg(value).alias("mean"), F.max(mark).alias("high_water_mark"))
    flags = lambda rows: D.exhaustion(rows, series, "slot").withColumn("flag", F.col("eta").isNotNull())
    return Detector("exhaustion", series, rows, flags, back=2)


def absent(name: str, entity: list[str], expected: DataFrame, soften: bool = False) -> Detector:
    """Expected entities of which a slot has nothing: heartbeat, service, non_participation."""

    def rows(samples: DataFrame, slots: DataFrame) -> DataFrame:
        spine = expected.select(*entity).distinct().crossJoin(F.broadcast(slots))  # slots: the list of those that a batch finishes
        seen = samples.select(*entity, "slot").distinct().withColumn("_seen", F.lit(True))
        return spine.join(seen, [*entity, "slot"], "left").select(*entity, "slot", F.col("_seen").isNull().alias("flag"))

    return Detector(name, entity, rows, soften=soften)


def network(peers: list[str], entity: list[str], table: list[tuple[str, str, str]] = D.NETWORK) -> Detector:
    """Measures of flows outside the band of their peers."""

    def rows(samples: DataFrame, _: DataFrame) -> DataFrame:
        measures = list(dict.fromkeys(m for m, _, _ in table))
        keys = list(dict.fromkeys([*entity, *peers]))
        flows = samples.groupBy(*keys, "slot").agg(*(F.avg(m).alias(m) for m in measures))
        return D.network_flags(flows, peers, keys, "slot", table).withColumn("flag", F.coalesce("flag", F.lit(False)))

    return Detector("network", [*dict.fromkeys([*entity, *peers]), "measure", "mode", "sub_type"], rows)


def _state(spark: SparkSession, path: str, name: str, batch: int | None) -> DataFrame | None:
    return None if batch is None or not _exists(spark, f"{path}/{name}/batch={batch}") else spark.read.parquet(f"{path}/{name}/batch={batch}")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def keep_state(spark: SparkSession, path: str, batch: int, before: int | None) -> None:
    """Passes the state on where a batch finishes nothing."""
    for name in STATE:
        if (state := _state(spark, path, name, before)) is not None:
            state.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def carry_on(detector: Detector, samples: DataFrame, slots: list[int], path: str, batch: int, before: int | None, settled: int, grain: int, window: int = 3600) -> None:
    """Grades these slots (seconds since 1970), and what comes after them, from the state that ``before`` left.

    Rows of slots before ``settled`` are not changed by later batches. Of a series' rows this reads the tail and the new
    ones; then the graded slots of the windows of ``window`` seconds that it changed, whose quantised severity goes to
    ``anomalies``.
    """
    spark, series, at = samples.sparkSession, detector.series, F.unix_seconds("slot")
    spine = spark.createDataFrame([(t,) for t in slots], "t long").select(F.timestamp_seconds("t").alias("slot"))
    fresh = detector.rows(samples, spine).withColumn("_settled", F.lit(False))
    if (old := _state(spark, path, "tail", before)) is not None:  # slots that are done again are new as a whole
        fresh = fresh.unionByName(old.where(~at.isin(slots)))
    payload = [c for c in fresh.columns if c != "_settled"]
    later = Window.partitionBy(*series).orderBy(F.desc("slot"))
    # how many rows of the series are settled from this one on: scores look back on TRAILING - 1 rows, whose flags on ``back`` more
    settled_after = F.count_if(at < settled).over(later.rowsBetween(Window.unboundedPreceding, 0))
    kept = (at >= settled) | (settled_after <= TRAILING - 1 + detector.back)
    rows = detector.graded(fresh).select(*payload, "score", "severity", "_settled", kept.alias("_kept")).persist()
    try:
        write_hours(rows.where(at >= slots[0]).select(*series, "slot", "score", "severity"), f"{path}/graded", "slot", batch)
        # rows that were settled before are in the runs already
        ended = _single(rows.where((at < settled) & ~F.col("_settled")), series)
        open_ = _state(spark, path, "open", before)
        runs = severity_runs(ended if open_ is None else ended.unionByName(open_.select(ended.columns)), series, "start", grain, "weighted")
        last = Window.partitionBy(*series).orderBy(F.desc("start"))
        runs = runs.withColumn("_n", F.row_number().over(last)).persist()
        try:
            runs.where("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{path}/open/batch={batch}")
            write_hours(runs.where("_n > 1").drop("_n"), f"{path}/runs", "start", batch)
        finally:
            runs.unpersist()
        rows.where("_kept").select(*payload, (at < settled).alias("_settled")).write.mode("overwrite").parquet(f"{path}/tail/batch={batch}")
        changed = rows.where(at >= slots[0]).agg(F.max(at).alias("t")).first()["t"]
    finally:
        rows.unpersist()
    if changed is not None:
        low, high = slots[0] - slots[0] % window, changed - changed % window + window
        found = graded_between(spark, f"{path}/graded", series, low, high, batch)
        single, majority = D.MAJORITIES[detector.name]
        each = series_summaries(found, series, "slot", grain, window)
        state = quantized(F.col("s"), window // grain, single, majority, False)
        each = each.select(*series, "window", state["severity"].alias("severity"), state["total"].alias("total_severity_duration"), state["longest"].alias("single_max_severity_duration"))
        write_hours(each, f"{path}/anomalies", "window", batch)


def _single(graded: DataFrame, series: list[str]) -> DataFrame:
    """Each slot as a run."""
    return graded.select(*series, "severity", F.col("slot").alias("start"), F.lit(1).cast("long").alias("duration"), "score")


def graded_between(spark: SparkSession, path: str, series: list[str], low: int, high: int, batch: int) -> DataFrame:
    """Graded slots of ``[low, high)``, each by its last batch up to ``batch``; of the folders of those hours alone."""
    found = read_hours(spark, path, utc(low), utc(high - 1)).where((F.col("batch") <= batch) & (F.unix_seconds("slot") >= low) & (F.unix_seconds("slot") < high))
    return latest(found, [*series, "slot"]).drop("hour", "batch")


def anomalies(spark: SparkSession, path: str, detector: Detector, low: int, high: int, batch: int) -> DataFrame:
    """Series that are not healthy in windows that start in ``[low, high)``, as of ``batch``."""
    found = read_hours(spark, f"{path}/{detector.name}/anomalies", utc(low), utc(high - 1))
    found = found.where((F.col("batch") <= batch) & (F.unix_seconds("window") >= low) & (F.unix_seconds("window") < high))
    return latest(found, [*detector.series, "window"]).drop("hour", "batch").where(F.col("severity") < HEALTHY).withColumn("class_type", F.lit(detector.name))


def all_runs(spark: SparkSession, path: str, detector: Detector, batch: int, grain: int) -> DataFrame:
    """The runs of grades as of ``batch``: those that ended, and the open ones with the rows that are not settled yet."""
    at = f"{path}/{detector.name}"
    open_, tail = _state(spark, at, "open", batch), _state(spark, at, "tail", batch)
    rest = _single(detector.graded(tail).where("NOT _settled"), detector.series)
    found = severity_runs(rest.unionByName(open_.select(rest.columns)), detector.series, "start", grain, "weighted")
    ended = spark.read.parquet(f"{at}/runs") if _exists(spark, f"{at}/runs") else None
    return found if ended is None else found.unionByName(ended.where(F.col("batch") <= batch).select(found.columns))
