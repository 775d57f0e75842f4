"""Time-series queries: range, tags, group-by, and a chain of aggregators, as one DataFrame plan.

Series are long rows ``metric, <group columns>, ts, value``. An aggregator takes ``(df, by, params)`` and returns
such rows again, so that they chain; :func:`register_aggregator` and :func:`register_grouper` add more by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Aggregator = Callable[[DataFrame, list[str], dict], DataFrame]
AGGREGATORS: dict[str, Aggregator] = {}
GROUPERS: dict[str, Callable[[dict], Column]] = {}


def register_aggregator(name: str, make: Aggregator) -> None:
    """Adds a named aggregator."""
    AGGREGATORS[name] = make


def register_grouper(name: str, make: Callable[[dict], Column]) -> None:
    """Adds a named grouper: parameters to a column."""
    GROUPERS[name] = make


def sample_start(ts: Column, seconds: int, origin: str | None = None) -> Column:
    """The start of a value's sample: whole widths since ``origin`` (the epoch without one)."""
    shift = F.unix_seconds(F.lit(origin).cast("timestamp")) if origin else F.lit(0)
    return F.timestamp_seconds(F.floor((F.unix_seconds(ts) - shift) / seconds) * seconds + shift)


BASIC = {
    "min": F.min, "max": F.max, "avg": F.avg, "sum": F.sum, "count": lambda x: F.count(x).cast("double"),
    "dev": lambda x: F.coalesce(F.stddev_samp(x), F.lit(0.0)),
}


def _sampled(agg: Callable[[dict], Column]) -> Aggregator:
    def run(df: DataFrame, by: list[str], p: dict) -> DataFrame:
        return df.withColumn("_s", sample_start(F.col("ts"), p["seconds"], p.get("origin"))).groupBy(*by, "_s").agg(agg(p).alias("value")).withColumnRenamed("_s", "ts")

    return run


for _name, _f in BASIC.items():
    register_aggregator(_name, _sampled(lambda p, f=_f: f(F.col("value"))))
register_aggregator("first", _sampled(lambda p: F.min_by("value", F.struct("ts", "value"))))
register_aggregator("last", _sampled(lambda p: F.max_by("value", F.struct("ts", "value"))))
register_aggregator(
    "percentile",
    _sampled(lambda p: F.percentile_approx("value", p["percentile"], 10_000).cast("double") if p.get("approximate") else F.percentile("value", F.lit(float(p["percentile"])))),
)


def gaps(df: DataFrame, by: list[str], p: dict) -> DataFrame:
    """A null point for each sample of the range ``start, end`` that has none; the points that are there stay."""
    seconds = p["seconds"]
    spine = df.select(*by).distinct().withColumn("_s", F.explode(F.expr(f"sequence(timestamp'{p['start']}', timestamp'{p['end']}' - interval {seconds} seconds, interval {seconds} seconds)")))
    points = df.withColumn("_s", sample_start(F.col("ts"), seconds, p.get("origin")))
    return spine.join(points, [*by, "_s"], "left").select(*by, F.coalesce("ts", "_s").alias("ts"), "value")


def least_squares(df: DataFrame, by: list[str], p: dict) -> DataFrame:
    """The line through each sample's points at its first and its last point (one point: that point)."""
    x = F.unix_micros("ts") / 1e6
    base = df.withColumn("_s", sample_start(F.col("ts"), p["seconds"], p.get("origin"))).withColumn("_x", x - F.unix_seconds("_s"))
    line = base.groupBy(*by, "_s").agg(F.regr_slope("value", "_x").alias("a"), F.regr_intercept("value", "_x").alias("b"), F.avg("value").alias("m"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    at = lambda t: F.coalesce(F.col("a") * (F.unix_micros(t) / 1e6 - F.unix_seconds("_s")) + F.col("b"), F.col("m"))
    ends = F.array_distinct(F.array(F.struct(F.col("lo").alias("ts"), at("lo").alias("value")), F.struct(F.col("hi").alias("ts"), at("hi").alias("value"))))
    return line.select(*by, F.explode(ends).alias("e")).select(*by, "e.ts", "e.value")


def scaled(factor: float) -> Aggregator:
    return lambda df, by, p: df.withColumn("value", F.col("value") * factor)


def divide(df: DataFrame, by: list[str], p: dict) -> DataFrame:
    if not p["divisor"]:
        raise ValueError("the divisor is zero")
    return df.withColumn("value", F.col("value") / p["divisor"])


def _series(by: list[str]):
    return Window.partitionBy(*by).orderBy("ts", "value")


def diff(df: DataFrame, by: list[str], p: dict) -> DataFrame:
    """The change since the point before; the first point goes."""
    return df.withColumn("_p", F.lag("value").over(_series(by))).where("_p is not null").withColumn("value", F.col("value") - F.col("_p")).drop("_p")


def rate(df: DataFrame, by: list[str], p: dict) -> DataFrame:
    """The change since the point before for each ``unit`` seconds; points at one time as the one before go, and the first."""
    w = _series(by)
    out = df.withColumn("_p", F.lag("value").over(w)).withColumn("_t", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6)
    return out.where("_t > 0").withColumn("value", (F.col("value") - F.col("_p")) / (F.col("_t") / p.get("unit", 1))).drop("_p", "_t")


def trim(df: DataFrame, by: list[str], p: dict) -> DataFrame:
    """Takes off the first, the last, or both points of each series."""
    w = Window.partitionBy(*by)
    first, last = F.row_number().over(w.orderBy("ts", "value")), F.row_number().over(w.orderBy(F.desc("ts"), F.desc("value")))
    out = df.withColumn("_f", first).withColumn("_l", last)
    keep = {"first": F.col("_f") > 1, "last": F.col("_l") > 1, "both": (F.col("_f") > 1) & (F.col("_l") > 1)}[p["which"]]
    return out.where(keep).drop("_f", "_l")


def save_as(df: DataFrame, by: list[str], p: dict) -> DataFrame:
    """The points under another metric name, to append to a table."""
    return df.withColumn("metric", F.lit(p["name"]))


for _name, _f in {"gaps": gaps, "least_squares": least_squares, "scale": lambda d, b, p: scaled(p["factor"])(d, b, p), "div": divide, "diff": diff, "rate": rate, "sampler": rate, "trim": trim, "save_as": save_as}.items():
    register_aggregator(_name, _f)

register_grouper("tag", lambda p: F.col("tags")[p["tag"]])
register_grouper("value", lambda p: F.floor(F.col("value") / p["size"]))
register_grouper("time", lambda p: F.pmod(F.floor((F.unix_seconds("ts") - F.unix_seconds(F.lit(p["start"]).cast("timestamp"))) / p["seconds"]), F.lit(p["count"])))


def query(points: DataFrame, spec: dict) -> DataFrame:
    """Runs a query of several metrics over ``metric, tags, ts, value``.

    ``spec``: start, end, and metrics: a list of name, tags (tag to a list of values, any of which fits),
    group_by (name and parameters of groupers), aggregators (in order), limit and order ("asc" or "desc") of
    each series. The result has metric, g0, g1, ... (groups as text), ts, value.
    """
    wide = max((len(m.get("group_by", [])) for m in spec["metrics"]), default=0)
    out = None
    for m in spec["metrics"]:
        df = points.where((F.col("metric") == m["name"]) & (F.col("ts") >= F.lit(spec["start"]).cast("timestamp")) & (F.col("ts") < F.lit(spec["end"]).cast("timestamp")))
        for tag, values in m.get("tags", {}).items():
            df = df.where(F.col("tags")[tag].isin(values))
        groups = [GROUPERS[g["name"]](g).cast("string").alias(f"g{i}") for i, g in enumerate(m.get("group_by", []))]
        groups += [F.lit(None).cast("string").alias(f"g{i}") for i in range(len(groups), wide)]
        by = ["metric", *(f"g{i}" for i in range(wide))]
        df = df.select("metric", *groups, "ts", F.col("value").cast("double").alias("value"))
        for a in m.get("aggregators", []):
            df = AGGREGATORS[a["name"]](df, by, a)
        if m.get("limit"):
            order = [F.desc("ts"), F.desc("value")] if m.get("order") == "desc" else ["ts", "value"]
            df = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= m["limit"]).drop("_n")
        df = df.select(*by, "ts", "value")
        out = df if out is None else out.unionByName(df)
    return out
