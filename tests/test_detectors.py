"""All detectors on a stream, over restarts, late samples and batches that are run again, against batch runs."""

import random

import pytest
from pyspark.sql import functions as F

from opsgrain.operators import detect as D
from opsgrain.operators.severity import severity_runs
from opsgrain.operators.stats import distribution, relative_to_peers
from opsgrain.sources import lines as L
from opsgrain.streaming import detectors, jobs

HOST, SERIES = ["cluster_id", "host_name"], ["cluster_id", "host_name", "classification"]
MINUTE, WINDOW, LAST = 60, 600, 40 * 60
MEASURES = list(dict.fromkeys(m for m, _, _ in D.NETWORK))


def wire(samples):
    return [(f"plugin=app.{c},host={h}:10.0.0.1,cluster_id=c,deployment_id=d,customer_id=u,ts={s * 1000 + 7},value={v}",) for h, c, s, v in samples]


def shaped(lines):
    """Samples with a mark, a tag and measures of flows."""
    rows = L.parse_wire(lines).where("error is null").withColumns({"high_water_mark": F.lit(60.0), "slot": jobs.slot_of(F.col("ts"), MINUTE)})
    return rows.withColumns({m: F.col("value") * (i + 1) - F.lit(3.0 * i) for i, m in enumerate(MEASURES)}).drop("slot")


@pytest.fixture(scope="module")
def samples():
    """Forty minutes in five batches. A host is silent for a while, nothing at all comes for two minutes, values climb; the
    third and fourth batches bring late samples of minutes that are done, and the last closes all minutes."""
    rng = random.Random(8)

    def of(lo, hi):
        out = []
        for m in range(lo, hi):
            for h in ("a", "b", "c"):
                for c in ("x", "error"):
                    if (h == "b" and 9 <= m < 21) or m in (14, 15) or rng.random() < 0.1 or (c == "error" and rng.random() < 0.5):
                        continue
                    level = {"a": 5 + m, "b": 30, "c": 40 if m % 9 < 6 else 75}[h]
                    out += [(h, c, 60 * m + rng.randrange(60), round(rng.choice([rng.gauss(level, 2), rng.gauss(level + 12, 2)]), 3)) for _ in range(rng.randint(1, 7))]
        return out

    late = [("a", "x", 60 * 6 + 5, 99.0), ("b", "x", 60 * 14 + 5, 98.0), ("c", "x", 60 * 7, 1.0)]
    later = [("b", "x", 60 * 18 + 1, 97.0), ("a", "error", 60 * 20, 90.0)]
    return [of(0, 10), of(10, 18), [*of(18, 27), *late], [*of(27, 40), *later], [("a", "x", 60 * 50, 1.0)]]


def made(spark):
    entities = spark.createDataFrame([("c", h) for h in "abcz"], "cluster_id string, host_name string")
    services = spark.createDataFrame([("c", h, k) for h in "ab" for k in ("x", "error")], "cluster_id string, host_name string, classification string")
    return [
        detectors.threshold(SERIES), detectors.peer(SERIES, ["cluster_id", "classification"]), detectors.error(SERIES, F.col("classification") == "error"), detectors.exhaustion(SERIES),
        detectors.absent("heartbeat", HOST, entities), detectors.absent("service", SERIES, services), detectors.absent("non_participation", ["cluster_id", "classification"], services, True),
        detectors.network(["classification"], HOST),
    ]


def batch_flags(spark, rows, name):
    """Flags of all slots at once, by the detectors of batch runs."""
    slots = ("1970-01-01 00:00:00", f"1970-01-01 00:{LAST // 60}:00")
    services = spark.createDataFrame([("c", h, k) for h in "ab" for k in ("x", "error")], "cluster_id string, host_name string, classification string")
    if name == "threshold":
        return SERIES, rows.groupBy(*SERIES, "slot").agg((F.max("value") >= 60).alias("flag"))
    if name == "peer":
        peers = ["cluster_id", "classification", "slot"]
        out = relative_to_peers(distribution(rows, [*SERIES, "slot"], "value"), distribution(rows, peers, "value", True), peers)
        return SERIES, out.select(*SERIES, "slot", D.peer_flag(F.col("relative")).alias("flag"))
    if name == "error":
        return SERIES, rows.where("classification = 'error'").groupBy(*SERIES, "slot").agg((F.avg("value") > 0).alias("flag"))
    if name == "exhaustion":
        means = rows.groupBy(*SERIES, "slot").agg(F.avg("value").alias("mean"), F.lit(60.0).alias("high_water_mark"))
        return SERIES, D.exhaustion(means, SERIES, "slot").select(*SERIES, "slot", F.col("eta").isNotNull().alias("flag"))
    if name == "network":
        keys = [*HOST, "classification"]
        flows = rows.groupBy(*keys, "slot").agg(*(F.avg(m).alias(m) for m in MEASURES))
        return [*keys, "measure", "mode", "sub_type"], D.network_flags(flows, ["classification"], keys, "slot")
    if name == "heartbeat":
        return HOST, D.absent_flags(rows, spark.createDataFrame([("c", h) for h in "abcz"], "cluster_id string, host_name string"), HOST, "slot", *slots, MINUTE)
    keys = SERIES if name == "service" else ["cluster_id", "classification"]
    return keys, D.absent_flags(rows, services, keys, "slot", *slots, MINUTE)


def listed(df, *columns):
    return sorted((tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("names", [("threshold", "peer", "exhaustion", "heartbeat"), ("error", "service", "non_participation", "network")], ids=["again", "plain"])
def test_detectors_on_a_stream_equal_batch_runs(spark, samples, tmp_path, monkeypatch, names):
    path, read, again = str(tmp_path / "job"), [], names[0] == "threshold"
    if not again:  # the same samples in fewer batches
        samples = [[*samples[0], *samples[1]], [*samples[2], *samples[3]], samples[4]]
    chosen = [d for d in made(spark) if d.name in names]
    plain = jobs.read_slots
    monkeypatch.setattr(jobs, "read_slots", lambda s, p, slots, *more: (read.append(slots), plain(s, p, slots, *more))[1])
    for i, batch in enumerate(samples):
        spark.createDataFrame(wire(batch), "line string").coalesce(1).write.mode("append").text(f"{path}/in")
        lines = spark.readStream.text(f"{path}/in").withColumnRenamed("value", "line")
        job = jobs.minute_job(path, SERIES, detectors=chosen, mend_seconds=900, window_seconds=WINDOW)
        shaped(lines).writeStream.option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).foreachBatch(job).start().awaitTermination()
        if i == 2 and again:
            job(shaped(spark.createDataFrame(wire(batch), "line string")), 2)  # a batch that is run again
    # each batch reads the slots that it finishes, and those it has late samples for; the third is run twice
    if again:
        assert read[2] == read.pop(3)
    first, late = set(), {60 * m for m in (6, 7, 14, 18, 20)}
    for slots in read:
        assert set(slots) & first <= late
        first |= set(slots)
    assert first == set(range(0, 48 * 60, 60))
    rows = shaped(spark.createDataFrame(wire([s for b in samples for s in b]), "line string")).withColumn("slot", jobs.slot_of(F.col("ts"), MINUTE)).where(F.unix_seconds("slot") < LAST).persist()
    for detector in chosen:
        name, last = detector.name, len(samples) - 1
        series, flags = batch_flags(spark, rows, name)
        assert sorted(series) == sorted(detector.series)
        want = D.graded(flags, series, "slot", detector.soften).persist()
        inside = F.unix_seconds("slot") < LAST
        got = detectors.graded_between(spark, f"{path}/{name}/graded", series, 0, 3600, last)
        assert listed(got.where(inside), *series, "slot", "score", "severity") == listed(want, *series, "slot", "score", "severity"), name
        assert want.where("severity < 100").count() > 0, name
        # runs: cut at the end of the forty minutes on both sides
        runs = detectors.all_runs(spark, path, detector, last, MINUTE)
        cut = runs.where(F.unix_seconds("start") < LAST).withColumn("duration", F.least("duration", (F.lit(LAST) - F.unix_seconds("start")) / MINUTE).cast("long"))
        columns = [*series, "severity", "start", "duration"]
        assert listed(cut, *columns) == listed(severity_runs(want, series, "slot", MINUTE, "avg"), *columns), name
        for low in range(0, LAST, WINDOW):
            at = F.unix_seconds("slot").between(low, low + WINDOW - 1)
            single, majority = D.MAJORITIES[name]
            found = D.quantized_severity(want.where(at), series, "slot", MINUTE, WINDOW // MINUTE, single, majority, False).where("severity < 100")
            told = detectors.anomalies(spark, path, detector, low, low + WINDOW, last)
            columns = [*series, "severity", "total_severity_duration", "single_max_severity_duration"]
            assert listed(told, *columns) == listed(found, *columns), (name, low)
        want.unpersist()


def test_wrong_clocks_and_very_late_samples(spark, tmp_path):
    """Samples from the future hold nothing up; very late ones are told and mended by a batch run."""
    path = str(tmp_path / "job")
    make = lambda rows: spark.createDataFrame(rows, "k string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    job = jobs.minute_job(path, ["k"], mend_seconds=120, lead_seconds=60, clock=lambda: 10_000)
    job(make([("a", 0, 1.0), ("a", 10**9, 5.0), ("a", 1000, 2.0)]), 0)
    job(make([("a", 30, 3.0), ("a", 2000, 2.0), ("b", 900, 1.0)]), 1)
    job(make([("a", 2000, 2.0)]).limit(0), 2)
    stats = lambda: {(r.k, int(r.slot.timestamp())): r.size for r in jobs.latest(spark.read.parquet(f"{path}/stats"), ["k", "slot"]).collect()}
    assert stats() == {("a", 0): 1, ("a", 960): 1, ("b", 900): 1}
    assert spark.read.parquet(f"{path}/ahead").count() == 1
    schema = make([("a", 0, 1.0)]).withColumn("slot", F.col("ts")).schema
    assert jobs.mend(spark, path, ["k"], 3, schema) == [0]
    assert stats()[("a", 0)] == 2
    assert jobs.mend(spark, str(tmp_path / "none"), ["k"], 3, schema) == []


def test_an_interrupted_batch_is_done_again(spark, tmp_path):
    """A batch that fails before its ledger is written starts again from the state before it."""
    path = str(tmp_path / "job")
    make = lambda rows: spark.createDataFrame(rows, "k string, s long, value double, high_water_mark double").withColumn("ts", F.timestamp_seconds("s"))
    batches = [[("a", 60 * m, 1.0 + m, 5.0) for m in range(lo, lo + 6)] for lo in range(0, 24, 6)]

    def broken(rows):
        raise OSError("lost")

    watch = detectors.threshold(["k"])
    for i, rows in enumerate(batches):
        if i == 2:
            bad = detectors.Detector("threshold_2", ["k"], watch.rows, broken)
            with pytest.raises(OSError):
                jobs.minute_job(path, ["k"], detectors=[watch, bad], mend_seconds=300)(make(rows), i)
        jobs.minute_job(path, ["k"], detectors=[watch], mend_seconds=300)(make(rows), i)
    got = detectors.graded_between(spark, f"{path}/threshold/graded", ["k"], 0, 3600, 3)
    whole = make([r for b in batches for r in b]).withColumn("slot", jobs.slot_of(F.col("ts"), 60)).where("s < 21 * 60")
    want = watch.graded(watch.rows(whole, whole.select("slot").distinct()))
    assert listed(got, "k", "slot", "score", "severity") == listed(want, "k", "slot", "score", "severity")
    runs = detectors.all_runs(spark, path, watch, 3, 60)
    assert listed(runs, "severity", "start", "duration") == listed(severity_runs(want, ["k"], "slot", 60, "avg"), "severity", "start", "duration")
    kept = {p.name for p in (tmp_path / "job" / "threshold" / "tail").iterdir() if p.name.startswith("batch=")}
    assert kept == {"batch=2", "batch=3"}
