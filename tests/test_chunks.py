"""Long series in pieces against one window over each series."""

import random

import pytest
from pyspark.sql import functions as F

from opsgrain.operators import chunks, detect, flows, severity, stats


@pytest.fixture(scope="module")
def rows(spark):
    """One series with nearly all rows, one with gaps of several pieces, and short ones."""
    rng, out = random.Random(2), []
    for name, n, gap in (("hot", 6000, 0.02), ("sparse", 300, 0.97), ("one", 1, 0), ("three", 3, 0)):
        at, level = 0, 0.0
        for _ in range(n):
            at += 60 if rng.random() >= gap else 60 * rng.randint(2, 900)
            level += rng.gauss(0.01, 1)
            out.append((name, at, rng.random() < 0.3, level, rng.choice([1, 20, 20, 100, 100, 100])))
    df = spark.createDataFrame(out, "name string, s long, flag boolean, mean double, severity int")
    return df.select("name", F.timestamp_seconds("s").alias("slot"), "flag", "mean", "severity", F.lit(60.0).alias("high_water_mark"), (F.col("s") % 7 / 10).alias("score")).persist()


def listed(df, *columns):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("seconds", [60, 420, 86400])
def test_rows_before_a_border(spark, rows, seconds):
    plain = rows.drop("score", "severity")
    for make, back, names in (
        (lambda df, keys: severity.decayed_score(df, keys, "slot", "flag"), severity.TRAILING - 1, ["score"]),
        (lambda df, keys: stats.relative_delta(df, keys, ["slot"], "mean", "slot"), 1, ["delta", "elapsed_ms"]),
        (lambda df, keys: detect.exhaustion(df, keys, "slot"), 6, ["velocity", "acceleration", "eta", "min_eta"]),
    ):
        got = chunks.look_back(plain, ["name"], ["slot"], "slot", seconds, back, make)
        assert listed(got, "name", "slot", *names) == listed(make(plain, ["name"]), "name", "slot", *names)
    assert chunks.look_back(plain.limit(0), ["name"], ["slot"], "slot", seconds, back, make).count() == 0


@pytest.mark.parametrize("seconds", [60, 420, 86400])
@pytest.mark.parametrize("how", ["min", "avg"])
def test_runs_across_borders(spark, rows, seconds, how):
    for df in (rows, rows.withColumn("severity", F.when(F.col("name") == "hot", 20).otherwise(F.col("severity")))):  # a run over many pieces
        got = chunks.chunked_runs(df, ["name"], "slot", 60, seconds, how)
        want = severity.severity_runs(df, ["name"], "slot", 60, how)
        assert listed(got, "name", "severity", "start", "duration", "score") == listed(want, "name", "severity", "start", "duration", "score")
    got = chunks.chunked_quantized(rows, ["name"], "slot", 60, 600, seconds)
    want = severity.quantized_severity(rows, ["name"], "slot", 60, 600)
    assert listed(got, *want.columns) == listed(want, *want.columns)


def test_a_hot_series_is_spread(spark, rows):
    """No window task sees more rows than a piece has, and its border."""
    seen = lambda df, keys: df.withColumn("_task", F.count("*").over(chunks.Window.partitionBy(*keys)))
    most = chunks.look_back(rows, ["name"], ["slot"], "slot", 6000, 4, seen).agg(F.max("_task")).first()[0]
    assert most <= 104 < rows.where("name = 'hot'").count() / 20


@pytest.fixture(scope="module")
def packets(spark):
    """A connection with nearly all packets and silences of many pieces, one that starts with responses, one with requests alone."""
    rng, out, seq = random.Random(5), [], 0
    for link, n, share in (("busy", 5000, 0.1), ("late", 200, 0.02), ("asks", 60, 1.0), ("answers", 40, 0.0), (None, 50, 0.3)):
        at = 1_000.0
        for i in range(n):
            at += rng.choice([0, 0, 0.01, 0.4, 3, 900 if rng.random() < 0.05 else 1])
            seq += 1
            kind = "response" if link == "late" and i < 9 else "request" if rng.random() < share else rng.choice(["response"] * 9 + [None])
            out.append((link, f"c{len(link or '') % 2}", rng.choice("ab"), seq, int(at * 1000), kind, f"GET /{rng.randrange(9)}", rng.choice([None, 1, 50, 700]), rng.random() < 0.1))
    return spark.createDataFrame(out, "link string, client string, side string, seq long, ms long, kind string, request string, size long, error boolean").withColumn("ts", F.timestamp_millis("ms")).persist()


@pytest.mark.parametrize("seconds", [1, 60, 86400])
@pytest.mark.parametrize("keys", [["client"], ["link", "side"]])
def test_pairing_across_borders(packets, seconds, keys):
    got = chunks.chunked_flow_summary(packets, ["link"], keys, "ts", seconds)
    want = flows.flow_summary(packets, ["link"], keys, "ts")
    assert got.columns == want.columns
    assert listed(got, *want.columns) == listed(want, *want.columns)
    assert chunks.chunked_flow_summary(packets.limit(0), ["link"], keys, "ts", seconds).count() == 0


def test_a_busy_connection_is_spread(packets):
    """A window task sees a piece's packets, or two rows at most of each piece."""
    busy = packets.where("link = 'busy'")
    pieces, most = busy.groupBy(chunks.window_of(F.col("ts"), 60)).count().agg(F.count("*"), F.max("count")).first()
    borders = chunks.paired_pieces(busy, ["link"], ["link"], "ts", 60).where("_border").count()
    assert most < busy.count() / 20 and borders <= 2 * pieces < busy.count() / 5
