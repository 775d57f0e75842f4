"""Stored baselines against the distribution of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from opsgrain.operators.baselines import Baselines, baseline, distribution_of, merge_baselines
from opsgrain.operators.stats import distribution

COLUMNS = ["k", "size", "min_val", "max_val", "mean", "stddev", "score", *(f"f{i}" for i in range(6))]


def rows(spark):
    """Groups of one mode, of three far apart (fitted again), of one value, of negative ones, and nulls; whole numbers."""
    rng, out = random.Random(4), []
    for k, modes, n in (("a", [50], 400), ("b", [0, 500, 900], 900), ("c", [7], 1), ("d", [-300, -20], 500)):
        out += [(k, float(round(rng.gauss(rng.choice(modes), 3)))) for _ in range(n)]
    return spark.createDataFrame([*out, ("e", 5.0), ("e", 5.0), ("e", None), ("f", None)], "k string, v double").repartition(4)


def listed(df):
    return sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.select(*COLUMNS).collect())


def test_stream_and_batch_agree(spark, tmp_path):
    """Four batches on a stream, one of them run again and one that fails half-way."""
    df = rows(spark).withColumn("batch", F.pmod(F.xxhash64("k", "v"), F.lit(4)))
    store = Baselines(spark, str(tmp_path / "s"), ["k"], "v")
    for i in range(4):
        df.where(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, v double").parquet(str(tmp_path / "in"))
        stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(store.add).start().awaitTermination()
    want = listed(distribution(df.where("v IS NOT NULL"), ["k"], "v", True))
    assert listed(distribution_of(store.state(), ["k"])) == want
    store.add(df.where("batch = 3").drop("batch"), 3)  # again
    (tmp_path / "s" / "batch=9").mkdir()  # begun, not ended
    assert listed(distribution_of(store.state(), ["k"])) == want and store.batches() == [2, 3]
    plain = listed(distribution(df.where("v IS NOT NULL"), ["k"], "v"))
    assert listed(distribution_of(store.state(), ["k"], refit=False)) == plain != want


def test_states_merge_in_any_order(spark):
    df = rows(spark)
    parts = [baseline(df.where(F.pmod(F.xxhash64("k", "v"), F.lit(3)) == i), ["k"], "v") for i in range(3)]
    left = merge_baselines(merge_baselines(parts[0].unionByName(parts[1]), ["k"]).unionByName(parts[2]), ["k"])
    right = merge_baselines(parts[0].unionByName(merge_baselines(parts[2].unionByName(parts[1]), ["k"])), ["k"])
    assert listed(distribution_of(left, ["k"])) == listed(distribution_of(right, ["k"]))
    assert merge_baselines(parts[0].limit(0), ["k"]).count() == 0 and distribution_of(parts[0].limit(0), ["k"]).count() == 0


def test_buckets_do_not_grow_with_rows(spark):
    """Values that fill the line: few buckets, and a distribution within a bucket's width."""
    df = spark.range(200_000).select(F.lit("a").alias("k"), (F.lit(100.0) + F.randn(3)).alias("v")).persist()
    state = baseline(df, ["k"], "v")
    assert state.count() < 200
    got, want = distribution_of(state, ["k"]).first(), distribution(df, ["k"], "v", True).first()
    assert got.mean == pytest.approx(want.mean) and got.stddev == pytest.approx(want.stddev)
    assert all(abs(got[f"f{i}"] - want[f"f{i}"]) < 0.05 * 200_000 for i in range(6))
    odd = spark.createDataFrame([("x", float("inf")), ("x", float("-inf")), ("x", float("nan")), ("x", 5e-324), ("x", -0.0)], "k string, v double")
    assert baseline(odd, ["k"], "v").count() == 4
