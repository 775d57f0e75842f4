"""Keyed tables by folders; exact percentiles by selection; sketches of distinct values."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from opsgrain.operators import quantiles
from opsgrain.plans.inputs import metrics
from opsgrain.sources.keyed import KeyedTable
from opsgrain.sources.tables import delete_where, upsert

SF = "/root/testdata/sf0.001"
KEYS = ["host_name", "classification", "slot"]


@pytest.fixture
def table(spark, tmp_path):
    rows = metrics(spark, SF).groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("ts").alias("written_at"))
    out = KeyedTable(spark, str(tmp_path / "t"), rows.schema, KEYS, "slot", "written_at", 4)
    out.upsert(rows)
    return out, rows, tmp_path / "t"


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def folders(path, version):
    return {str(p.relative_to(path).parent) for p in path.glob(f"day=*/bucket=*/version={version}")}


def test_last_write_wins_in_touched_folders_alone(spark, table):
    t, rows, path = table
    assert same(t.read(), rows)
    late = metrics(spark, SF).where("k > 50 AND slot = timestamp'2024-01-05'").groupBy(*KEYS).agg(F.count("*").alias("n"), (F.max("ts") + F.expr("interval 1 second")).alias("written_at"))
    older = rows.where("slot = timestamp'2024-01-06'").withColumns({"n": F.lit(-1).cast("long"), "written_at": F.col("written_at") - F.expr("interval 1 hour")})
    v = t.upsert(late.unionByName(older))
    assert {f.split("/")[0] for f in folders(path, v)} == {"day=2024-01-05", "day=2024-01-06"}
    assert same(t.read(), upsert(rows, late, KEYS, "written_at"))  # an older write does not count
    day = t.read(date(2024, 1, 5), date(2024, 1, 5))
    assert day.count() and all("day=2024-01-05" in f for f in day.inputFiles())


def test_deletes_touch_their_range(spark, table):
    t, rows, path = table
    gone = F.col("classification") == "view"
    v = t.delete(gone, date(2024, 1, 10), date(2024, 1, 12))
    assert {f.split("/")[0] for f in folders(path, v)} <= {f"day=2024-01-{d}" for d in (10, 11, 12)}
    inside = F.col("slot").between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))
    want = delete_where(rows, gone & inside)
    assert 0 < want.count() < rows.count() and same(t.read(), want)
    again = rows.where(gone & (F.col("slot") == F.lit("2024-01-10").cast("timestamp")))
    t.upsert(again)  # written again after the delete
    assert same(t.read(), want.unionByName(again))
    before = t.read().collect()
    c = t.compact()
    assert sorted(map(tuple, t.read().collect())) == sorted(map(tuple, before))
    assert {f.split("/")[0] for f in folders(path, c)} <= {f"day=2024-01-{d}" for d in (10, 11, 12)} and t.compact() is None
    assert t.vacuum() and not t.vacuum()
    assert sorted(map(tuple, t.read().collect())) == sorted(map(tuple, before))


def test_half_written_versions_are_not_seen(spark, table, monkeypatch):
    t, rows, path = table
    monkeypatch.setattr(KeyedTable, "_commit", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.upsert(rows.withColumns({"n": F.lit(0).cast("long"), "written_at": F.col("written_at") + F.expr("interval 1 day")}))
    monkeypatch.undo()
    assert same(t.read(), rows)
    assert t.upsert(rows.limit(0)) == 3  # a number is not taken twice, so what is left of the second stays unseen
    assert same(t.read(), rows) and folders(path, 2)
    t.vacuum()
    assert same(t.read(), rows) and not folders(path, 2)


def test_expired_days_are_dropped(spark, table):
    t, rows, path = table
    t.expire(date(2024, 1, 20))
    assert min(p.name for p in path.glob("day=*")) >= "day=2024-01-20"
    assert same(t.read(), rows.where("slot >= timestamp'2024-01-20'"))
    t.upsert(rows.where("slot < timestamp'2024-01-20'"))  # too old by now
    assert same(t.read(), rows.where("slot >= timestamp'2024-01-20'"))
    t.vacuum()
    assert min(p.name for p in path.glob("day=*/bucket=*/version=*")) and not list(path.glob("day=2024-01-0*/bucket=*/version=*"))


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_percentiles_by_selection(spark, accuracy):
    """Ties, a value that most rows have, nulls, single rows, null keys and groups without values, against the built-in one."""
    rng = random.Random(accuracy)
    rows = [("hot", 7.0 if rng.random() < 0.7 else rng.gauss(7, 3)) for _ in range(3000)] + [("even", float(i)) for i in range(1000)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None), (None, 3.0), (None, 8.0), ("same", 4.0), ("same", 4.0), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    at = [0.0, 0.01, 0.25, 0.5, 0.753, 0.99, 1.0]
    got = {r.k: r.q for r in quantiles.percentiles(df, ["k"], "v", at, accuracy).collect()}
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, at))).alias("q")).collect()}
    assert set(got) == set(want)
    for k, q in want.items():
        assert got[k] == ([None] * len(at) if q is None else pytest.approx(q, abs=1e-12)), k
    assert quantiles.percentiles(df.limit(0), ["k"], "v", at).count() == 0


def test_distinct_counts_from_stored_sketches(spark, tmp_path):
    """Days' counts from hours' sketches, whose values overlap, within four standard errors."""
    df = spark.range(300_000).select((F.col("id") % 24).alias("hour"), (F.col("id") * 7919 % 40_000).alias("user"), (F.col("id") % 3).alias("k"))
    quantiles.distinct_sketches(df, ["k", "hour"], "user").write.parquet(str(tmp_path / "s"))
    got = {r.k: r.estimate for r in quantiles.merged_distinct(spark.read.parquet(str(tmp_path / "s")), ["k"]).collect()}
    want = {r.k: r.n for r in df.groupBy("k").agg(F.countDistinct("user").alias("n")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - n) <= 4 * 0.8 / 64 * n for k, n in want.items())
