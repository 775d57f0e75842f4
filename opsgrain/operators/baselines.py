"""Baselines that grow with each batch: a group's values as moments by bucket, merged with what is stored.

A bucket is a range of values about 0.1 % wide, the same for all groups, so states of any batches merge by adding buckets. A
group's distribution (fit, refit, sigma histogram, score) follows from its buckets, whose number does not grow with its
rows: exactly where each bucket holds one value, else with a bucket's values counted where their mean lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsgrain.operators.stats import BINS, CENTRAL, merge_moments, sigma_bin, spread_score

#: Parts of a factor of e that values are counted in, and the number of the bucket of 1.
RESOLUTION, ONE = 1024, 1_000_000
CELL = ["n", "mean", "m2", "min_val", "max_val"]


def bucket(x: Column) -> Column:
    """The bucket of a value, growing with it: 0 for 0, else by the sign and the logarithm."""
    size = F.floor(F.ln(F.abs(x)) * RESOLUTION) + ONE
    size = F.when(F.isnan(x) | (F.abs(x) == float("inf")), 2 * ONE).otherwise(size)
    return F.when(x == 0, 0).when(x < 0, -size).otherwise(size).cast("long")


def baseline(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The state of rows: ``keys, bucket, n, mean, m2, min_val, max_val``. Nulls do not count."""
    x = F.col(value).cast("double")
    rows = df.select(*keys, x.alias("_x")).where("_x IS NOT NULL").withColumn("bucket", bucket(F.col("_x")))
    by = [*keys, "bucket"]
    ends = rows.groupBy(*by).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), (F.var_pop("_x") * F.count("_x")).alias("m2"), F.min("_x").alias("min_val"), F.max("_x").alias("max_val"))
    return ends.select(*by, *CELL)


def merge_baselines(states: DataFrame, keys: list[str]) -> DataFrame:
    """One state of several; any order and grouping of merges gives the same, but for the last digits."""
    by = [*keys, "bucket"]
    w = Window.partitionBy(*by)
    merged = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    apart = F.col("mean") - F.col("_mean")
    out = states.withColumn("_mean", merged).groupBy(*by).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"), F.min("min_val").alias("min_val"), F.max("max_val").alias("max_val")
    )
    return out.select(*by, *CELL)


def distribution_of(state: DataFrame, keys: list[str], refit: bool = True, integer: bool = True) -> DataFrame:
    """Size, minimum, maximum, mean, deviation, six-bin histogram and score of each group of a state, as
    :func:`~opsgrain.operators.stats.distribution` has them of rows."""
    parts = state.select(*keys, *CELL)
    sd = F.coalesce(F.sqrt("var_samp"), F.lit(0.0)).alias("stddev")
    ends = parts.groupBy(*keys).agg(F.min("min_val").alias("min_val"), F.max("max_val").alias("max_val"))
    first = merge_moments(parts, keys).select(*keys, F.col("n").alias("size"), "mean", sd)
    binned = parts.withColumnsRenamed({"mean": "_m"}).join(first.select(*keys, F.col("mean").alias("_a"), F.col("stddev").alias("_b")), keys)
    binned = binned.withColumn("_bin", sigma_bin(F.col("_m"), F.col("_a"), F.col("_b"))).withColumnsRenamed({"_m": "mean"})
    out = first
    if refit:
        own = merge_moments(binned.select(*keys, "_bin", *CELL), [*keys, "_bin"]).select(*keys, "_bin", "n", F.struct("_bin", "mean", sd).alias("_fit"))
        best = own.groupBy(*keys).agg(F.max_by("_fit", F.struct("n", -F.col("_bin"))).alias("_f"))
        outer = ~F.col("_f._bin").isin(*CENTRAL)
        out = first.join(best, keys).select(*keys, "size", *(F.when(outer, F.col(f"_f.{c}")).otherwise(F.col(c)).alias(c) for c in ("mean", "stddev")))
        again = parts.withColumnsRenamed({"mean": "_m"}).join(out.select(*keys, F.col("mean").alias("_a"), F.col("stddev").alias("_b")), keys)
        binned = again.withColumn("_bin", sigma_bin(F.col("_m"), F.col("_a"), F.col("_b")))
    counts = binned.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("_bin") == i, F.col("n"))), F.lit(0)).alias(f"f{i}") for i in range(BINS)))
    names = [f"f{i}" for i in range(BINS)]
    out = out.join(ends, keys).join(counts, keys)
    return out.select(*keys, "size", "min_val", "max_val", "mean", "stddev", *names, spread_score([F.col(n) for n in names], F.col("size"), integer).alias("score"))


class Baselines:
    """A stored state, in a folder for each batch; a batch adds its rows to the state of the last one before it, so one that is
    run again adds nothing more, and one that failed leaves the state before it."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], value: str) -> None:
        self.spark, self.path, self.keys, self.value = spark, path, keys, value
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Batches whose state is whole."""
        at = self._path(self.path)
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def state(self, batch: int | None = None) -> DataFrame | None:
        """The state after ``batch``, or the last one."""
        known = [b for b in self.batches() if batch is None or b <= batch]
        return self.spark.read.parquet(f"{self.path}/batch={known[-1]}") if known else None

    def add(self, rows: DataFrame, batch: int) -> None:
        """Adds a batch's rows; a sink for ``foreachBatch``. States before the last one are deleted."""
        new, before = baseline(rows, self.keys, self.value), [b for b in self.batches() if b < batch]
        if before:
            new = merge_baselines(self.state(before[-1]).unionByName(new), self.keys)
        new.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        for b in before[:-1]:
            self._fs.delete(self._path(f"{self.path}/batch={b}"), True)
