"""Summaries of graded slots that merge: an hour is the merge of its minutes, a day of its hours.

A summary of a series (or of an entity's worst slots) over a window holds, in ``s``, its first and last run, the slots, sum
of scores and longest run of each grade, and the moves between runs; for entities also the runs of equal heat. Merging two
neighbouring summaries stitches the runs at their border, so that any way of cutting a range gives the same summary.

Stored rollups (:func:`refresh`) are tables by grain, in folders by the next coarser window and batch. A batch writes whole
windows; the last batch of a window counts. Late rows replace the windows they fall in and those above them, and each
table but the finest is made from the one below, from the folders of its own windows alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsgrain.operators.severity import CRITICAL, HEALTHY, INFO, WARN, severity_grid, worst_of_merge

#: Grades by their place in a summary, worst first.
GRADES = (CRITICAL, WARN, INFO, HEALTHY)
#: Windows that one step of a refresh takes together; more are taken in turn.
STEP = 5_000


def window_of(at: Column, seconds: int) -> Column:
    """The start of the window of ``seconds`` that a time falls in."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(at) / seconds) * seconds)


def at_levels(df: DataFrame, levels: list[list[str]], *columns) -> DataFrame:
    """Each row once for each level: ``level``, the entity's columns (``*`` where the level has none) and ``columns``."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    sets = F.array(*(F.struct(F.lit(i).alias("level"), *(F.col(c) if c in level else F.lit("*").alias(c) for c in names)) for i, level in enumerate(levels)))
    return df.select(F.explode(sets).alias("_e"), *columns).select("_e.*", *df.select(*columns).columns)


def _slot(ts: str, grain: int, heat: bool) -> Column:
    """The summary of one slot."""
    at, grade = F.unix_seconds(ts), F.coalesce(*(F.when(F.col("severity") == g, F.lit(i)) for i, g in enumerate(GRADES)), F.lit(len(GRADES) - 1))
    one = lambda x, zero: F.array(*(F.when(grade == i, x).otherwise(F.lit(zero)) for i in range(len(GRADES))))
    length, score = F.lit(1).cast("long"), F.coalesce(F.col("score"), F.lit(0.0))
    runs = [F.array(F.struct(F.col(ts).alias("start"), severity_grid(F.struct(F.col("severity").alias("severity"), score.alias("score"))).alias("level"), length.alias("duration"))).alias("heat")] if heat else []
    return F.struct(
        at.alias("first_at"), grade.alias("first"), length.alias("head"), (at + grain).alias("last_at"), grade.alias("last"), length.alias("tail"), length.alias("runs"),
        one(length, 0).cast("array<bigint>").alias("total"), one(score, 0.0).alias("score"), one(length, 0).cast("array<bigint>").alias("longest"),
        F.array_repeat(F.lit(0).cast("long"), len(GRADES) ** 2).alias("moves"), *runs,
    )


def merged(a: Column, b: Column, heat: bool) -> Column:
    """The summary of two windows, the earlier one first; associative."""
    joins = (a["last"] == b["first"]) & (a["last_at"] == b["first_at"])
    border = a["tail"] + b["head"]
    add = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
    longest = F.transform(F.zip_with(a["longest"], b["longest"], lambda p, q: F.greatest(p, q)), lambda x, i: F.when(joins & (i == a["last"]), F.greatest(x, border)).otherwise(x))
    step = a["last"] * len(GRADES) + b["first"]
    moves = F.transform(add(a["moves"], b["moves"]), lambda x, i: F.when((a["last"] != b["first"]) & (i == step), x + 1).otherwise(x))
    runs = []
    if heat:
        end, begin = F.element_at(a["heat"], -1), F.element_at(b["heat"], 1)
        meets = (end["level"] == begin["level"]) & (a["last_at"] == b["first_at"])
        one = F.array(F.struct(end["start"].alias("start"), end["level"].alias("level"), (end["duration"] + begin["duration"]).alias("duration")))
        rest = F.slice(b["heat"], F.lit(2), F.size(b["heat"]))
        runs = [F.when(meets, F.concat(F.slice(a["heat"], F.lit(1), F.size(a["heat"]) - 1), one, rest)).otherwise(F.concat(a["heat"], b["heat"])).alias("heat")]
    return F.struct(
        a["first_at"].alias("first_at"), a["first"].alias("first"), F.when(joins & (a["runs"] == 1), border).otherwise(a["head"]).alias("head"),
        b["last_at"].alias("last_at"), b["last"].alias("last"), F.when(joins & (b["runs"] == 1), border).otherwise(b["tail"]).alias("tail"),
        (a["runs"] + b["runs"] - joins.cast("long")).alias("runs"), add(a["total"], b["total"]).alias("total"), add(a["score"], b["score"]).alias("score"),
        longest.alias("longest"), moves.alias("moves"), *runs,
    )


def rolled(summaries: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Summaries (``keys, window, s``) merged to windows of ``seconds``.

    A group holds the finer summaries of one series in one window, whose number is the ratio of the two grains.
    """
    heat = "heat" in summaries.schema["s"].dataType.names
    groups = summaries.groupBy(*keys, window_of(F.col("window"), seconds).alias("window")).agg(F.array_sort(F.collect_list("s")).alias("_all"))
    fold = F.aggregate(F.slice("_all", F.lit(2), F.size("_all")), F.col("_all")[0], lambda a, b: merged(a, b, heat))
    return groups.select(*keys, "window", fold.alias("s"))


def series_summaries(graded: DataFrame, series: list[str], ts: str, grain: int, seconds: int) -> DataFrame:
    """Summaries of each series over windows of ``seconds``, from a row for each slot (``severity, score``)."""
    slots = graded.select(*series, F.col(ts).alias("window"), _slot(ts, grain, False).alias("s"))
    return rolled(slots, series, seconds)


def entity_summaries(graded: DataFrame, levels: list[list[str]], ts: str, grain: int, seconds: int) -> DataFrame:
    """Summaries of the worst of each entity's series in each slot, with runs of heat; keys are ``level`` and the names of the levels."""
    keys = ["level", *dict.fromkeys(c for level in levels for c in level)]
    worst = worst_of_merge(at_levels(graded, levels, F.col(ts).alias("window"), "severity", "score"), keys, "window")
    return rolled(worst.select(*keys, "window", _slot("window", grain, True).alias("s")), keys, seconds)


def quantized(s: Column, slots: int, single: float = 0.25, majority: float = 0.5, replicated: bool = True) -> Column:
    """The quantised severity of a summary, as a struct: the worst grade that holds, how long in all and in one run."""
    out = F.struct(F.lit(HEALTHY).alias("severity"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("longest"), F.lit(len(GRADES) - 1).alias("place"))
    for i in reversed(range(len(GRADES) - 1)):
        total, longest = s["total"][i], s["longest"][i]
        holds = (total > 0) & ((total > majority * slots) | (longest >= single * slots) if replicated else F.lit(True))
        out = F.when(holds, F.struct(F.lit(GRADES[i]).alias("severity"), total.alias("total"), longest.alias("longest"), F.lit(i).alias("place"))).otherwise(out)
    return out


def transitions(summaries: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """``keys, window, from, to, n, probability``: the transition matrix of each summary; slots without a row stay healthy."""
    place = F.sequence(F.lit(0), F.lit(len(GRADES) ** 2 - 1))
    last, side = len(GRADES) - 1, len(GRADES)
    rest = F.greatest(F.lit(slots) - _sum(F.col("s.total")), F.lit(0))
    n = lambda i: F.get("s.moves", i) + F.when(F.floor(i / side) == i % side, F.get("s.total", i % side) + F.when(i % side == last, rest).otherwise(0)).otherwise(0)
    cells = summaries.select(*keys, "window", F.transform(place, lambda i: F.struct(i.alias("i"), n(i).alias("n"))).alias("c"))
    cells = cells.withColumn("_all", _sum(F.transform("c", lambda c: c["n"]))).select(*keys, "window", F.explode("c").alias("c"), "_all").where("c.n > 0")
    grade = lambda i: F.get(F.array(*map(F.lit, GRADES)), i.cast("int"))
    return cells.select(*keys, "window", grade(F.floor(F.col("c.i") / side)).alias("from"), grade(F.col("c.i") % side).alias("to"), F.col("c.n").alias("n"), (F.col("c.n") / F.col("_all")).alias("probability"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def summary_view(
    of_series: DataFrame, of_entities: DataFrame, levels: list[list[str]], series: list[str], slots: int,
    single: float = 0.25, majority: float = 0.5, replicated: bool = False, most: int | None = None,
) -> DataFrame:
    """One row for each entity of each level and window: the number of its series in each quantised grade (``n_1`` and so on),
    its own quantised severity, its ``heat``, and its contributors, ranked, as ``stats`` (all, or the ``most`` largest).

    A series adds its mean score in the entity's grade times the probability of staying in it.
    """
    keys = ["level", *dict.fromkeys(c for level in levels for c in level), "window"]
    rest = F.greatest(F.lit(slots) - _sum(F.col("s.total")), F.lit(0))
    cells = _sum(F.col("s.total")) + _sum(F.col("s.moves")) + rest
    share = F.transform("s.total", lambda n, i: F.when(n > 0, F.get("s.score", i) / n * (n + F.when(i == len(GRADES) - 1, rest).otherwise(0)) / cells).otherwise(F.lit(0.0)))
    one = of_series.select(*series, "window", quantized(F.col("s"), slots, single, majority, replicated)["severity"].alias("own"), share.alias("adds"))
    each = at_levels(one, levels, F.struct(*series).alias("series"), "window", "own", "adds")
    state = of_entities.select(*keys, quantized(F.col("s"), slots, single, majority, replicated).alias("q"), F.col("s.heat").alias("heat"))
    counts = each.groupBy(*keys).agg(*(F.count_if(F.col("own") == g).alias(f"n_{g}") for g in GRADES))
    out = state.join(counts, keys)
    mine = each.join(state.select(*keys, F.col("q.place").alias("_p")), keys).withColumn("contribution", F.get("adds", F.col("_p"))).where("contribution > 0")
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.desc(F.round("contribution", 9)), *(F.col("series")[c] for c in series)))
    causes = mine.select(*keys, "series", "contribution", rank.alias("rank"), (F.col("contribution") / F.sum("contribution").over(w)).alias("share"))
    causes = causes.where(F.col("rank") <= most) if most is not None else causes
    causes = causes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "series", "contribution", "share"))).alias("stats"))
    out = out.join(causes, keys, "left").withColumn("stats", F.coalesce("stats", F.array().cast(causes.schema["stats"].dataType)))
    return out.select(
        *keys, "q.severity", F.col("q.total").alias("total_severity_duration"), F.col("q.longest").alias("single_max_severity_duration"), F.lit(slots).cast("long").alias("total_duration"),
        *(f"n_{g}" for g in GRADES), "heat", "stats",
    )


# ---------------------------------------------------------------- stored rollups


def _folder(seconds: list[int], i: int) -> int:
    """Seconds of the windows that the folders of a grain are named by: the next coarser ones."""
    return seconds[i + 1] if i + 1 < len(seconds) else seconds[i]


def _write(df: DataFrame, path: str, folder: int, batch: int) -> None:
    part = F.date_format(window_of(F.col("window"), folder), "yyyyMMddHHmmss")
    out = df.withColumns({"part": part, "batch": F.lit(batch).cast("long")})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(path)


def _name(window: int) -> str:
    return f"part={datetime.fromtimestamp(window, timezone.utc):%Y%m%d%H%M%S}"


def stored(spark: SparkSession, path: str, seconds: list[int], i: int, windows: Iterable[int] | None = None) -> DataFrame | None:
    """The rows of a grain, each window by its last batch; of the folders of the given coarser ``windows`` alone, if any are
    given. None without any. The last batches are a row for each window read, which is broadcast."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [path] if windows is None else [f"{path}/{_name(w)}" for w in sorted({w - w % _folder(seconds, i) for w in windows})]
    found = [p for p in found if fs.exists(fs_path(p))]
    if not found:
        return None
    rows = spark.read.option("basePath", path).parquet(*found)
    last = rows.groupBy("window").agg(F.max("batch").alias("_last"))
    return rows.join(F.broadcast(last) if windows is not None else last, "window").where("batch = _last").drop("_last", "part", "batch")


def refresh(
    path: str, graded: Callable[[int, int], DataFrame], touched: Iterable[int], levels: list[list[str]], series: list[str],
    ts: str, grain: int, seconds: list[int], batch: int,
) -> None:
    """Makes the summaries of the windows of ``seconds[0]`` that start at ``touched`` again, and those above them, under ``path``.

    ``graded`` gives the graded slots of a range of time, all of them; times are seconds since 1970, and each of ``seconds`` is
    a multiple of the one before. The session's time zone should be UTC, by which folders are named. A batch that is run
    again replaces what it wrote; one that fails leaves windows of which some are new, and each of them whole.
    """
    spark = graded(0, 0).sparkSession
    entity = ["level", *dict.fromkeys(c for level in levels for c in level)]
    todo = sorted({t - t % seconds[0] for t in touched})
    for lo in range(0, len(todo), STEP):
        some = todo[lo : lo + STEP]
        at = F.floor(F.unix_seconds(ts) / seconds[0]) * seconds[0]
        rows = graded(some[0], some[-1] + seconds[0]).where(at.isin(some))
        _write(series_summaries(rows, series, ts, grain, seconds[0]), f"{path}/series-{seconds[0]}", _folder(seconds, 0), batch)
        _write(entity_summaries(rows, levels, ts, grain, seconds[0]), f"{path}/entities-{seconds[0]}", _folder(seconds, 0), batch)
    for i in range(1, len(seconds)):
        todo = sorted({t - t % seconds[i] for t in todo})
        for lo in range(0, len(todo), STEP):
            some = todo[lo : lo + STEP]
            for kind, keys in (("series", series), ("entities", entity)):
                finer = stored(spark, f"{path}/{kind}-{seconds[i - 1]}", seconds, i - 1, some)
                if finer is not None:
                    _write(rolled(finer, keys, seconds[i]), f"{path}/{kind}-{seconds[i]}", _folder(seconds, i), batch)


def view(spark: SparkSession, path: str, levels: list[list[str]], series: list[str], grain: int, seconds: list[int], i: int, **more) -> DataFrame | None:
    """:func:`summary_view` of the stored summaries of a grain; ``windows`` limits the folders read."""
    windows = more.pop("windows", None)
    tables = [stored(spark, f"{path}/{kind}-{seconds[i]}", seconds, i, windows) for kind in ("series", "entities")]
    return None if None in tables else summary_view(*tables, levels, series, seconds[i] // grain, **more)
