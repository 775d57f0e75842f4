"""Which series contributed to a state: transition matrices of severity, contributions, ranks; snapshots and slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsgrain.operators.rollup import at_levels, entity_summaries, series_summaries, summary_view, window_of
from opsgrain.operators.severity import HEALTHY, quantize_thermals, severity_counts


def transition_matrix(runs: DataFrame, series: list[str], slots: int) -> DataFrame:
    """``series, from, to, n, probability``: slots stayed in a grade, moves between runs, and the rest of the range as healthy.

    ``runs`` has severity, start, duration (in slots). Divided by the total of a series the entries are probabilities.
    """
    w = Window.partitionBy(*series).orderBy("start")
    moved = runs.withColumn("from", F.lag("severity").over(w)).where(F.col("from").isNotNull() & (F.col("from") != F.col("severity")))
    stay = runs.groupBy(*series, F.col("severity").alias("from"), F.col("severity").alias("to")).agg(F.sum("duration").alias("n"))
    move = moved.groupBy(*series, "from", F.col("severity").alias("to")).agg(F.count("*").alias("n"))
    rest = runs.groupBy(*series).agg(F.lit(HEALTHY).alias("from"), F.lit(HEALTHY).alias("to"), F.greatest(F.lit(slots) - F.sum("duration"), F.lit(0)).alias("n")).where("n > 0")
    cells = stay.unionByName(move).unionByName(rest).groupBy(*series, "from", "to").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*series))
    return cells.withColumn("probability", F.col("n") / total)


def mean_scores(runs: DataFrame, series: list[str]) -> DataFrame:
    """The mean score of a series in each grade, weighted by duration."""
    return runs.groupBy(*series, "severity").agg((F.sum(F.col("score") * F.col("duration")) / F.sum("duration")).alias("coefficient"))


def contributions(runs: DataFrame, series: list[str], entity: list[str], overall: DataFrame, slots: int) -> DataFrame:
    """What each series adds to the state (``severity``) of its entity: its mean score in that grade times the probability
    of staying in it; those above zero, ranked, with their share. Ties go by series."""
    stay = transition_matrix(runs, series, slots).where("`from` = `to`").select(*series, F.col("from").alias("severity"), "probability")
    each = mean_scores(runs, series).join(stay, [*series, "severity"]).withColumn("contribution", F.col("coefficient") * F.col("probability"))
    mine = each.join(overall.select(*entity, "severity"), [*entity, "severity"]).where("contribution > 0")
    w = Window.partitionBy(*entity)
    others = [c for c in series if c not in entity]
    return mine.select(*series, "severity", "contribution", F.row_number().over(w.orderBy(F.desc(F.round("contribution", 9)), *others)).alias("rank"), (F.col("contribution") / F.sum("contribution").over(w)).alias("share"))


def contribution_residual(ranked: DataFrame, final: DataFrame, entity: list[str]) -> DataFrame:
    """What the contributions leave of an entity's own score, and as a share of it (null where it is 0)."""
    parts = ranked.groupBy(*entity).agg(F.sum("contribution").alias("explained"))
    out = final.join(parts, entity, "left").withColumn("explained", F.coalesce("explained", F.lit(0.0)))
    return out.withColumn("residual", F.col("score") - F.col("explained")).withColumn("residual_share", F.try_divide(F.col("score") - F.col("explained"), F.col("score")))


def timeline_markers(minute: DataFrame, hourly: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Markers start, end, thermal of both grains."""
    one = lambda df, seconds: df.select(*keys, F.col(ts).alias("start"), F.timestamp_seconds(F.unix_seconds(ts) + seconds).alias("end"), "thermal")
    return one(minute, 60).unionByName(one(hourly, 3600)).orderBy(*keys, "start", "end")


def entity_snapshot(slots: DataFrame, levels: list[list[str]], ts: str) -> DataFrame:
    """Severity counts and the worst grade of each entity of each level and slot, in one pass over all entities."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    level_sets = F.array(*(F.struct(F.lit(i).alias("level"), *(F.col(c) if c in level else F.lit("*").alias(c) for c in columns)) for i, level in enumerate(levels)))
    each = slots.select(ts, "severity", F.explode(level_sets).alias("_e")).select(ts, "severity", "_e.*")
    keys = ["level", *columns, ts]
    return severity_counts(each, keys).join(quantize_thermals(each, keys, "severity").drop("slots"), keys)


def slot_summaries(
    graded: DataFrame, levels: list[list[str]], series: list[str], ts: str, grain: int, coarse: int, single: float = 0.25, majority: float = 0.5,
    replicated: bool = False, services: DataFrame | None = None, connections: DataFrame | None = None, most: int | None = None,
) -> DataFrame:
    """One row for each entity of each level and ``window`` of ``coarse`` slots of ``grain`` seconds, all in one plan.

    ``graded`` has a severity and score for each slot of each series. A row has the number of series in each quantised
    grade (``n_1`` and so on), the entity's own quantised severity from its worst slots, its ``heat`` as runs of equal
    level, and its contributors as ``stats``, all or the ``most`` largest. ``services`` has the entities' columns, ``at`` and
    sub_type: counts by sub-type. ``connections`` has the columns of the entities called, ``at``, ``caller``, service,
    request_count and error_count: all or the ``most`` busiest. Runs are found once for each series and once for each
    entity, as summaries that merge (see :mod:`opsgrain.operators.rollup`).
    """
    seconds, names = grain * coarse, list(dict.fromkeys(c for level in levels for c in level))
    keys = ["level", *names, "window"]
    of_series = series_summaries(graded, series, ts, grain, seconds)
    out = summary_view(of_series, entity_summaries(graded, levels, ts, grain, seconds), levels, series, coarse, single, majority, replicated, most)
    return with_calls(out, keys, levels, seconds, services, connections, most)


def with_calls(out: DataFrame, keys: list[str], levels: list[list[str]], seconds: int, services: DataFrame | None = None, connections: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Adds what the entities' services and connections did in each window to rows of :func:`~opsgrain.operators.rollup.summary_view`."""
    if services is not None:
        seen = at_levels(services, levels, window_of(F.col("at"), seconds).alias("window"), "sub_type").groupBy(*keys, "sub_type").agg(F.count("*").alias("n"))
        out = out.join(seen.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("sub_type", "n"))).alias("services")), keys, "left")
    if connections is not None:
        calls = at_levels(connections, levels, window_of(F.col("at"), seconds).alias("window"), "caller", "service", "request_count", "error_count")
        calls = calls.groupBy(*keys, "caller", "service").agg(F.sum("request_count").alias("requests"), F.sum("error_count").alias("errors"))
        calls = calls.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("requests"), "caller", "service")))
        calls = calls.where(F.col("_r") <= most) if most is not None else calls
        calls = calls.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_r").alias("rank"), "caller", "service", "requests", "errors"))).alias("connections"))
        out = out.join(calls, keys, "left")
    return out


def missing_slots(done: DataFrame, ts: str, start: str, end: str, seconds: int, most_days: int = 14) -> DataFrame:
    """Slots of ``[start, end)``, at most ``most_days`` back, that are not done yet."""
    spine = done.sparkSession.range(1).select(F.explode(F.expr(f"sequence(timestamp'{start}', timestamp'{end}' - interval {seconds} seconds, interval {seconds} seconds)")).alias(ts))
    return spine.where(F.col(ts) >= F.lit(end).cast("timestamp") - F.expr(f"interval {most_days} days")).join(done.select(ts).distinct(), ts, "left_anti")


def pending_summaries(graded: DataFrame, done: DataFrame, start: str, end: str, levels: list[list[str]], series: list[str], ts: str, grain: int, coarse: int, most_days: int = 3660, **more) -> DataFrame:
    """:func:`slot_summaries` of the windows of ``[start, end)`` that ``done`` (``slot``) lacks, all in one job."""
    todo = missing_slots(done, "slot", start, end, grain * coarse, most_days)  # at most a row for each window of the range
    rows = graded.withColumn("_window", window_of(F.col(ts), grain * coarse)).join(todo, F.col("_window") == todo["slot"], "left_semi").drop("_window")
    return slot_summaries(rows, levels, series, ts, grain, coarse, **more)


def roll_up(graded: DataFrame, path: str, start: str, end: str, levels: list[list[str]], series: list[str], ts: str, grain: int, coarse: int, **more) -> None:
    """Adds to the table at ``path``, in folders by day, the summaries of the windows that it lacks: minute, N-minute and hourly
    rollups and the catching up after a stop are this one step. A job that fails leaves the table as it was. Windows that are there
    stay as they are; :func:`opsgrain.operators.rollup.refresh` mends them and makes coarser grains from finer ones."""
    spark = graded.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        done = spark.read.parquet(path).select(F.col("window").alias("slot"))
    else:
        done = spark.range(0).select(F.lit(None).cast("timestamp").alias("slot"))
    found = pending_summaries(graded, done, start, end, levels, series, ts, grain, coarse, **more)
    found.withColumn("day", F.to_date("window")).write.mode("append").partitionBy("day").parquet(path)


def entity_details(slots: DataFrame, entity: list[str], child: str, ts: str, start: str, end: str) -> DataFrame:
    """State and severity counts of each entity over a range, with those of its children as an array."""
    rows = slots.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))
    of = lambda keys: severity_counts(rows, keys).join(quantize_thermals(rows, keys, "severity").drop("slots"), keys)
    children = of([*entity, child]).groupBy(*entity).agg(F.sort_array(F.collect_list(F.struct(child, "thermal"))).alias("children"))
    return of(entity).join(children, entity)


def snapshot(ranked: DataFrame, grid: DataFrame, reason: DataFrame, entity: list[str], ts: str) -> DataFrame:
    """One row for each entity: its ranked series, its latest heat, and the reason of its state."""
    stats = ranked.groupBy(*entity).agg(F.sort_array(F.collect_list(F.struct("rank", "classification", "contribution", "share"))).alias("stats"))
    heat = grid.groupBy(*entity).agg(F.max_by("severity", ts).alias("latest"), F.max(ts).alias("at"))
    return heat.join(stats, entity, "left").join(reason, entity, "left")


def connection_query(rollups: DataFrame, entity: list[str], services: str) -> DataFrame:
    """One row for each connection of entities whose connections are nested in an array."""
    return rollups.select(*entity, F.inline(services))
