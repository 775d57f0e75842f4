"""Streams against their batch twins."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opsgrain.operators.stats import distribution, merge_moments, moments, relative_delta, velocity
from opsgrain.plans.inputs import NUDGE, metrics
from opsgrain.sources import lines as L
from opsgrain.sources import tables
from opsgrain.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """The metrics in four files, in the order of time."""
    path = str(tmp_path_factory.mktemp("stream") / "in")
    rows = metrics(spark, SF).select("event_id", "ts", "host_name", "classification", "value").withColumn("series", F.concat_ws(":", "host_name", "classification"))
    for i in range(4):
        rows.where(F.col("event_id").between(i * 250, i * 250 + 249)).coalesce(1).write.mode("append").parquet(path)
    return rows, path


def stream(spark, source):
    return spark.readStream.schema(source[0].schema).option("maxFilesPerTrigger", 1).parquet(source[1])


def run(df, path, mode="append", sink=None):
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(path / "ck"))
    q = (writer.foreachBatch(sink) if sink else writer.format("memory").queryName(f"q{abs(hash(str(path)))}")).start()
    q.awaitTermination()
    return None if sink else df.sparkSession.table(f"q{abs(hash(str(path)))}")


def test_slot_stats(spark, source, tmp_path):
    got = run(jobs.slot_stats(stream(spark, source), ["series"], "ts", "value", "1 day", "1 hour"), tmp_path)
    last = got.agg(F.max("slot")).first()[0]
    want = source[0].groupBy(F.date_trunc("day", "ts").alias("slot"), "series").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("m")).where(F.col("slot") <= F.lit(last))
    assert sorted(got.select("slot", "series", "size", F.round("mean", 6)).collect()) == sorted(want.collect())


def test_deltas(spark, source, tmp_path):
    got = run(jobs.deltas(stream(spark, source), "series", "event_id", "ts", "value", 1000), tmp_path)
    want = relative_delta(source[0], ["series"], ["ts", "event_id"], "value", "ts")
    columns = ["event_id", F.round("delta", 6), F.round("elapsed_ms", 3)]
    assert sorted(got.select(*columns).collect(), key=repr) == sorted(want.select(*columns).collect(), key=repr)


def test_running_variance(spark, source, tmp_path):
    got = run(jobs.running_variance(stream(spark, source), ["series"], "value"), tmp_path, "complete")
    want = merge_moments(moments(source[0], ["series"], "value"), ["series"])
    columns = ["series", "n", F.round(F.col("mean") + NUDGE, 5), F.round(F.col("var_pop") + NUDGE, 5)]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())


def minutes(spark, path, rows, schema="k int, s long"):
    """One file for each batch, with ``ts`` from seconds."""
    for batch in rows:
        spark.createDataFrame(batch, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)


def test_once_within_the_watermark(spark, tmp_path):
    df = minutes(spark, str(tmp_path / "in"), [[(1, 0), (2, 10)], [(1, 30), (3, 1000)], [(4, 2000)]])
    assert sorted(r.k for r in run(jobs.once(df, ["k"], "ts", "2 minutes"), tmp_path).collect()) == [1, 2, 3, 4]


def test_late_rows_are_left_out_of_windows(spark, tmp_path):
    """A row that comes once its minute was given out does not count (Spark lets it in for one more batch); one before does."""
    df = minutes(spark, str(tmp_path / "in"), [[(1, 0)], [(1, 130)], [(1, 30)], [(1, 1000)], [(1, 1010)], [(1, 20)], [(1, 2000)]])
    got = run(jobs.slot_stats(df, ["k"], "ts", "s", "1 minute", "2 minutes"), tmp_path)
    assert [(r.slot.minute, r.size) for r in got.orderBy("slot").collect()] == [(0, 2), (2, 1), (16, 2)]


def test_restart_goes_on(spark, source, tmp_path):
    sink = jobs.fan_out(jobs.idempotent(str(tmp_path / "a")), jobs.idempotent(str(tmp_path / "b"), lambda d: d.select("event_id")))
    run(stream(spark, source), tmp_path, sink=sink)
    run(stream(spark, source), tmp_path, sink=sink)
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == source[0].count()


def test_failing_sink(spark):
    seen = []

    def bad(df, batch):
        raise OSError("no")

    with pytest.raises(OSError):
        jobs.fan_out(bad, lambda df, batch: seen.append(df.count()))(spark.range(3), 0)
    assert seen == [3]


KEYS = ["host_name", "classification"]


def wire(samples):
    return [(f"plugin=app.{c},host={h}:10.0.0.1,cluster_id=c,deployment_id=d,customer_id=u,ts={s * 1000 + 7},value={v}",) for h, c, s, v in samples]


@pytest.fixture(scope="module")
def samples():
    """Twenty minutes of two series in five batches; the third brings late samples, of a minute that is done and of one that
    is not, and the last closes all minutes."""
    rng = random.Random(5)
    of = lambda lo, hi: [(h, c, 60 * m + rng.randrange(60), round(rng.choice([rng.gauss(5, 1), rng.gauss(50, 1)]), 3)) for m in range(lo, hi) for h in ("a", "b") for c in ("x", "y") for _ in range(7)]
    late = [("a", "x", 65, 99.0), ("b", "y", 9 * 60 + 5, 98.0)]
    return [of(0, 6), of(6, 12), [*of(12, 15), *late], of(15, 20), [("a", "x", 60 * 60, 1.0)]]


def high(stats):
    return stats.where("max_val > 51.5").select(*KEYS, "slot", "max_val")


def started(spark, path, batches, again=False):
    for i, batch in enumerate(batches):
        spark.createDataFrame(wire(batch), "line string").coalesce(1).write.mode("append").text(f"{path}/in")
        lines = spark.readStream.text(f"{path}/in").withColumnRenamed("value", "line")
        put = L.put_line(F.col("classification"), F.col("ts"), F.col("value"), F.create_map(F.lit("host"), "host_name"))
        job = jobs.minute_job(path, KEYS, high)
        jobs.run_minutes(lines, path, job, None, put).awaitTermination()  # each start goes on where the last one ended
        if again and i == 2:
            job(L.parse_wire(spark.createDataFrame(wire(batch), "line string")), 2)  # a batch that is run again
    return path


def test_whole_job_equals_the_batch_run(spark, samples, tmp_path):
    path = started(spark, str(tmp_path / "job"), samples, True)
    everything = L.parse_wire(spark.createDataFrame(wire([s for b in samples[:4] for s in b]), "line string"))
    want = distribution(everything, [*KEYS, "slot"], "value", True)
    columns = [*KEYS, "slot", "size", *(F.round(F.col(c) + NUDGE, 5) for c in ("mean", "stddev", "score")), *(f"f{i}" for i in range(6))]
    got = jobs.latest(spark.read.parquet(f"{path}/stats"), [*KEYS, "slot"])
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())
    assert want.where("f0 + f1 + f4 + f5 > 0").count() > 0
    found = jobs.latest(spark.read.parquet(f"{path}/found"), [*KEYS, "slot"])
    assert sorted(found.select(*KEYS, "slot", "max_val").collect()) == sorted(high(want).collect())
    times = spark.read.parquet(f"{path}/found").groupBy(*KEYS, "slot").count().where("count > 1").collect()
    assert {r.slot.minute for r in times} <= {1}  # only the minute that had a late sample is written twice
    lines = [r.value for r in spark.read.text(f"{path}/text").collect()]
    assert len(lines) == sum(map(len, samples)) and all(x.startswith("put ") for x in lines)


def test_hours_are_pruned(spark, tmp_path):
    df = spark.range(10).withColumn("slot", F.timestamp_seconds(F.col("id") * 1800))
    path = str(tmp_path / "t")
    jobs.write_hours(df, path, "slot", 0)
    jobs.write_hours(df.where("id < 4"), path, "slot", 1)
    jobs.write_hours(df.where("id < 2"), path, "slot", 1)
    got = jobs.read_hours(spark, path, datetime(1970, 1, 1, 0, 30), datetime(1970, 1, 1, 1, 10))
    assert sorted((r.id, r.batch) for r in got.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1)]
    assert jobs.read_hours(spark, path, datetime(1980, 1, 1), datetime(1980, 1, 1)) is None


def test_dead_series_are_forgotten(spark, tmp_path):
    df = minutes(spark, str(tmp_path / "in"), [[(1, 10_000), (2, 10_000)], [(1, 10_010)], [(2, 30_000)], [(1, 30_010), (2, 30_020)]])
    got = run(jobs.deltas(df.withColumn("v", F.col("s") * 1.0), "k", "s", "ts", "v", 1), tmp_path).orderBy("s", "k").collect()
    assert [(r.k, r.s, r.delta and round(r.delta, 6)) for r in got] == [(1, 10_000, None), (2, 10_000, None), (1, 10_010, 0.001), (2, 30_000, None), (1, 30_010, None), (2, 30_020, round(20 / 30_000, 6))]


def test_kafka_options(spark):
    """The connector is the cluster's; the options that would reach it are looked at here."""
    class Builder(dict):
        def format(self, name):
            return self.option("format", name)

        def option(self, key, value):
            self[key] = value
            return self

        def options(self, **more):
            self.update(more)
            return self

        def load(self):
            return spark.createDataFrame([(b"a line", None, "x")], "value binary, timestamp timestamp, key string")

    class Session:
        readStream = Builder()  # noqa: N815

    got = tables.kafka_source(Session(), "host:9092", "log", startingOffsets="earliest")
    assert Session.readStream == {"format": "kafka", "kafka.bootstrap.servers": "host:9092", "subscribe": "log", "startingOffsets": "earliest"}
    assert got.columns == ["line", "received"] and got.first()["line"] == "a line"

    class Frame:
        writeStream = Builder()  # noqa: N815

    assert tables.kafka_sink(Frame(), "host:9092", "out", "/c") == {"format": "kafka", "kafka.bootstrap.servers": "host:9092", "topic": "out", "checkpointLocation": "/c"}


def test_tailed_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "web.log").write_text("one\ntwo\n")
    got = run(tables.tail_source(spark, str(tmp_path / "in")), tmp_path).collect()
    assert sorted(r.line for r in got) == ["one", "two"] and all(r.file.endswith("web.log") for r in got)


def test_velocities(spark, source, tmp_path):
    got = run(jobs.velocities(stream(spark, source), "series", "event_id", "ts", "value", 1000), tmp_path)
    want = velocity(relative_delta(source[0], ["series"], ["ts", "event_id"], "value", "ts"))
    columns = ["event_id", F.round(F.col("velocity") * 1e6, 4)]
    assert sorted(got.select(*columns).collect(), key=repr) == sorted(want.select(*columns).collect(), key=repr)


def test_delta_sink(spark, source, tmp_path):
    """Equal to the batch form over four batches, two starts, and a batch that is run again."""
    sink = jobs.delta_sink(str(tmp_path / "d"), "series", "event_id", "ts", "value", 1000)
    run(stream(spark, source), tmp_path, sink=sink)
    run(stream(spark, source), tmp_path, sink=sink)
    sink(source[0].where("event_id >= 750"), 3)
    want = relative_delta(source[0], ["series"], ["ts", "event_id"], "value", "ts")
    columns = ["event_id", F.round("delta", 6), F.round("elapsed_ms", 3)]
    got = spark.read.parquet(str(tmp_path / "d" / "deltas"))
    assert sorted(got.select(*columns).collect(), key=repr) == sorted(want.select(*columns).collect(), key=repr)
    kept = {p.name for p in (tmp_path / "d" / "state").iterdir()}
    assert kept == {"batch=2", "batch=3"}


def test_delta_sink_forgets(spark, tmp_path):
    """The same records as for the stateful form, a hot key in one batch, and an empty batch."""
    sink = jobs.delta_sink(str(tmp_path / "d"), "k", "s", "ts", "v", 1)
    batches = [[(1, 10_000), (2, 10_000)], [(1, 10_010)], [(2, 30_000)], [(1, 30_010), (2, 30_020)], [], [(3, 40_000 + i) for i in range(2000)]]
    for i, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, "k int, s long").select("k", "s", F.timestamp_seconds("s").alias("ts"), (F.col("s") * 1.0).alias("v")), i)
    got = spark.read.parquet(str(tmp_path / "d" / "deltas")).orderBy("s", "k").collect()
    assert [(r.k, r.s, r.delta and round(r.delta, 6)) for r in got[:6]] == [(1, 10_000, None), (2, 10_000, None), (1, 10_010, 0.001), (2, 30_000, None), (1, 30_010, None), (2, 30_020, round(20 / 30_000, 6))]
    assert len(got) == 2006 and sum(r.elapsed_ms == 1000 for r in got) == 1999
    assert [r.k for r in spark.read.parquet(str(tmp_path / "d" / "state" / "batch=5")).collect()] == [3]
