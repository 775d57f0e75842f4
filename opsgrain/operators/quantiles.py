"""Exact percentiles by distributed selection, and distinct counts from sketches that merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, keys: list[str], value: str, at: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """``keys, q``: the values at the shares ``at`` (0 to 1) of each group, between neighbours where a share falls between two;
    nulls do not count, a group without values has none (null elements).

    1. A sketch of bounded size gives each group's bounds around each wanted rank, about 8 / ``accuracy`` of the group apart (a
       group of at most ``accuracy`` values is taken whole).
    2. The values under the lower bound are counted, those between the bounds are counted by value; both are partial sums.
    3. The wanted ranks are found among the values between the bounds, which are all that comes together of a group.

    The answers equal those of ``percentile``, but no state holds the distinct values of a group.
    """
    x = F.col(value).cast("double")
    slack = 4.0 / accuracy  # the sketch's error on either side, and the two neighbours of a share
    shares = [s for p in at for s in (max(p - slack, 0.0), min(p + slack, 1.0))]
    rows = df.select(*keys, x.alias("_x"))
    bounds = rows.groupBy(*keys).agg(F.count("_x").alias("_n"), F.percentile_approx("_x", shares, accuracy).alias("_q"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    wanted = F.array(*(
        F.struct(
            F.lit(i).alias("i"), F.lit(float(p)).alias("p"),
            F.when((F.col("_n") <= accuracy) | F.lit(p - slack <= 0), F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("lo"),
            F.when((F.col("_n") <= accuracy) | F.lit(p + slack >= 1), F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("hi"),
        ) for i, p in enumerate(at)
    ))
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    told = bounds.select(*keys, "_n", wanted.alias("_w")).withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    met = rows.where("_x IS NOT NULL").join(told, same).drop(*names.values()).withColumn("_e", F.explode("_w"))
    # one key for all that is under a bound, one for each value between
    cell = F.when(F.col("_x") >= F.col("_e.lo"), F.col("_x"))
    cells = met.where(F.col("_x") <= F.col("_e.hi")).groupBy(*keys, F.col("_e.i").alias("_i"), F.col("_e.p").alias("_p"), cell.alias("_v")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    w = Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first())
    upto = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    place = F.col("_p") * (F.col("_n") - 1)
    low, high = F.floor(place), F.ceil(place)
    ranked = cells.withColumn("_upto", upto).where("_v IS NOT NULL")
    holds = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))  # noqa: E731  the first value with more than r at or under it
    found = ranked.groupBy(*keys, "_i").agg(holds(low).alias("_a"), holds(high).alias("_b"), F.first(place - low).alias("_f"))
    found = found.select(*keys, "_i", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((1 - F.col("_f")) * F.col("_a") + F.col("_f") * F.col("_b")).alias("_v"))
    listed = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_m")).withColumnsRenamed(names)
    out = bounds.select(*keys).join(listed, same, "left")
    return out.select(*keys, F.array(*(F.try_element_at("_m", F.lit(i)) for i in range(len(at)))).alias("q"))


def distinct_sketches(df: DataFrame, keys: list[str], value: str, lg_size: int = 12) -> DataFrame:
    """``keys, sketch``: a sketch of each group's distinct values, to be stored by slot and merged.

    A sketch has at most 2^``lg_size`` cells; an estimate's standard error is about 0.8 / sqrt(2^``lg_size``), 1.3 % by default.
    """
    text = F.col(value).cast("string")
    return df.groupBy(*keys).agg(F.hll_sketch_agg(text, lg_size).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, sketch, estimate``: the distinct values in all sketches of each group, those in several counted once."""
    merged = sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.withColumn("estimate", F.hll_sketch_estimate("sketch"))
