"""Counters: shares and rates of growing values, category pivots with totals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter_share(df: DataFrame, keys: list[str], ts: str, parts: Sequence[str]) -> DataFrame:
    """Each part's share of all growth since the row before, in percent; ``error`` where the sum shrank. Rows that are
    first, or saw no growth, go."""
    w = Window.partitionBy(*keys).orderBy(ts)
    deltas = {f"_{p}": F.col(p) - F.lag(p).over(w) for p in parts}
    out = df.withColumns(deltas).withColumn("_total", reduce(lambda a, b: a + b, [F.col(f"_{p}") for p in parts])).where("_total is not null and _total != 0")
    ok = F.col("_total") > 0
    return out.select(*keys, ts, *(F.when(ok, 100 * F.col(f"_{p}") / F.col("_total")).alias(f"usage_{p}") for p in parts), (~ok).alias("error"))


def counter_rate(df: DataFrame, keys: list[str], ts: str, value: str, whole: bool = True) -> DataFrame:
    """Growth per second since the row before; a counter that fell was reset and grew by its new value."""
    w = Window.partitionBy(*keys).orderBy(ts)
    seconds = F.unix_seconds(ts) - F.lag(F.unix_seconds(ts)).over(w)
    delta = F.when(F.col(value) < F.lag(value).over(w), F.col(value)).otherwise(F.col(value) - F.lag(value).over(w))
    rate = F.try_divide(delta, seconds)
    return df.withColumn("rate", F.floor(rate) if whole else rate).withColumn("_s", seconds).where("_s > 0").drop("_s")


def guarded_percent(part: Column, rest: Column) -> Column:
    """part / (part + rest) in percent, 0 where both are 0: hit rates and the like."""
    return F.coalesce(100 * F.try_divide(part, part + rest), F.lit(0.0))


def category_pivot(df: DataFrame, keys: list[str], category: Column, categories: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums of each value by category, one row for each value (``measure``), with a total; absent categories are 0."""
    long = df.withColumn("_c", category).select(*keys, "_c", *(F.col(v).cast("double") for v in values)).unpivot([*keys, "_c"], list(values), "measure", "v")
    out = long.groupBy(*keys, "measure").agg(*(F.coalesce(F.sum(F.when(F.col("_c") == c, F.col("v"))), F.lit(0.0)).alias(c) for c in categories), F.sum("v").alias("total"))
    return out
