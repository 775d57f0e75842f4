"""Summaries that merge, and rollups stored from them, against summaries of all fine rows."""

import random

import pytest
from pyspark.sql import functions as F

from opsgrain.operators import rank, rollup
from opsgrain.operators.severity import severity_runs

LEVELS = [["d"], ["d", "host"]]
SERIES = ["d", "host", "name"]
MINUTE, HOUR, DAY = 60, 3600, 86400
GRAINS = [10 * MINUTE, HOUR, DAY]


def graded(spark, seed=1, hours=50, gaps=0.1):
    """Minutes of four series over two days, in runs of grades, some minutes missing."""
    rng, rows = random.Random(seed), []
    for d, host, name in (("d0", "a", "x"), ("d0", "a", "y"), ("d0", "b", "x"), ("d1", "c", "x")):
        grade, score = 100, 0.0
        for m in range(hours * 60):
            if rng.random() < 0.05:
                grade = rng.choice([1, 20, 30, 100])
                score = {1: 0.75, 20: 0.5, 30: 0.25, 100: 0.0625}[grade]
            if rng.random() > gaps:
                rows.append((d, host, name, m * 60, grade, score))
    return spark.createDataFrame(rows, "d string, host string, name string, s long, severity int, score double").select(*SERIES, F.timestamp_seconds("s").alias("slot"), "severity", "score")


def listed(df):
    names = sorted(c for c in df.columns if c != "stats")
    stats = F.transform("stats", lambda x: F.struct(x["rank"], x["series"], F.round(x["contribution"], 9), F.round(x["share"], 9)))
    return sorted(map(repr, df.select(*names, stats.alias("stats")).collect()))


@pytest.fixture(scope="module")
def rows(spark):
    return graded(spark).persist()


@pytest.mark.parametrize("steps", [[DAY], [HOUR, DAY], [7 * MINUTE, 28 * MINUTE, 28 * HOUR], [MINUTE, 6 * HOUR, DAY]])
def test_any_way_of_cutting_gives_the_same(spark, rows, steps):
    whole = rollup.series_summaries(rows, SERIES, "slot", MINUTE, steps[-1])
    parts = rollup.series_summaries(rows, SERIES, "slot", MINUTE, steps[0])
    for seconds in steps[1:]:
        parts = rollup.rolled(parts, SERIES, seconds)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, parts.collect()))
    ends = rollup.entity_summaries(rows, LEVELS, "slot", MINUTE, steps[-1])
    cut = rollup.entity_summaries(rows, LEVELS, "slot", MINUTE, steps[0])
    for seconds in steps[1:]:
        cut = rollup.rolled(cut, ["level", "d", "host"], seconds)
    rounded = lambda df: sorted(repr(r) for r in df.withColumn("s", F.col("s").withField("score", F.transform("s.score", lambda x: F.round(x, 9)))).collect())
    assert rounded(ends) == rounded(cut)


def test_summary_against_runs(spark, rows):
    """Longest runs, totals, first and last runs and moves, from runs by windows."""
    day = rows.withColumn("window", rollup.window_of(F.col("slot"), DAY))
    runs = {}
    for r in severity_runs(day, [*SERIES, "window"], "slot", MINUTE).orderBy("start").collect():
        runs.setdefault((r.d, r.host, r.name, r.window), []).append(r)
    got = rollup.series_summaries(rows, SERIES, "slot", MINUTE, DAY).collect()
    assert len(got) == len(runs) == 12
    for r in got:
        own, s = runs[(r.d, r.host, r.name, r.window)], r.s
        assert (s.runs, s.head, s.tail, s.first_at) == (len(own), own[0].duration, own[-1].duration, int(own[0].start.timestamp()))
        for i, g in enumerate(rollup.GRADES):
            lengths = [x.duration for x in own if x.severity == g]
            assert (s.total[i], s.longest[i]) == (sum(lengths), max(lengths, default=0))
        pairs = [(a.severity, b.severity) for a, b in zip(own, own[1:]) if a.severity != b.severity]
        assert sum(s.moves) == len(pairs)
        for a in range(4):
            for b in range(4):
                assert s.moves[a * 4 + b] == pairs.count((rollup.GRADES[a], rollup.GRADES[b]))


def reader(rows):
    return lambda lo, hi: rows.where((F.unix_seconds("slot") >= lo) & (F.unix_seconds("slot") < hi))


def windows(rows):
    return [r.t for r in rows.select((F.floor(F.unix_seconds("slot") / GRAINS[0]) * GRAINS[0]).alias("t")).distinct().collect()]


def test_stored_rollups_and_late_minutes(spark, rows, tmp_path):
    """Three batches, the last with late minutes; every grain equals a run over all fine rows, batches run again add nothing."""
    path, at = str(tmp_path / "r"), F.unix_seconds("slot")
    late = (at % 7200 == 0) & (F.col("name") == "x")
    step = lambda seen, new, batch: rollup.refresh(path, reader(seen), windows(new), LEVELS, SERIES, "slot", MINUTE, GRAINS, batch)
    early, later = rows.where((at < 30 * HOUR) & ~late), rows.where((at >= 30 * HOUR) & ~late)
    step(early, early, 0)
    step(rows.where(~late), later, 1)
    step(rows.where(~late), later, 1)
    before = {i: listed(rollup.view(spark, path, LEVELS, SERIES, MINUTE, GRAINS, i)) for i in range(3)}
    step(rows, rows.where(late), 2)
    for i, seconds in enumerate(GRAINS):
        want = rank.slot_summaries(rows, LEVELS, SERIES, "slot", MINUTE, seconds // MINUTE)
        got = listed(rollup.view(spark, path, LEVELS, SERIES, MINUTE, GRAINS, i))
        assert got == listed(want) and got != before[i]
    touched = spark.read.parquet(f"{path}/series-{GRAINS[0]}").where("batch = 2").select(F.unix_seconds("window").alias("w")).distinct().collect()
    assert {r.w for r in touched} == {w for w in windows(rows.where(late))}


def test_coarser_grains_read_finer_tables_alone(spark, rows, tmp_path):
    path = str(tmp_path / "r")
    rollup.refresh(path, reader(rows), windows(rows), LEVELS, SERIES, "slot", MINUTE, GRAINS, 0)
    hours = rollup.rolled(rollup.stored(spark, f"{path}/series-{GRAINS[0]}", GRAINS, 0, [5 * HOUR, 6 * HOUR]), SERIES, HOUR)
    files = hours.inputFiles()
    assert files and all(f"series-{GRAINS[0]}/part=19700101050000" in f or f"series-{GRAINS[0]}/part=19700101060000" in f for f in files)
    assert sorted(r.window.hour for r in hours.select("window").distinct().collect()) == [5, 6]
    plan = hours._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 * 2  # the last batches, and the merge
    assert rollup.stored(spark, f"{path}/none", GRAINS, 0) is None


def test_empty_and_null(spark, rows):
    none = rows.limit(0)
    assert rank.slot_summaries(none, LEVELS, SERIES, "slot", MINUTE, 60).count() == 0
    odd = spark.createDataFrame([("d", "h", "n", 0, None, None), ("d", "h", None, 60, 1, None)], "d string, host string, name string, s long, severity int, score double")
    odd = odd.select(*SERIES, F.timestamp_seconds("s").alias("slot"), "severity", "score")
    got = {r.name: r.s.total for r in rollup.series_summaries(odd, SERIES, "slot", MINUTE, HOUR).collect()}
    assert got == {"n": [0, 0, 0, 1], None: [1, 0, 0, 0]}
