"""Search-style aggregations: buckets that nest, metrics at the leaves, and reshaping of the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND, MINUTE, HOUR, DAY = 1000, 60_000, 3_600_000, 86_400_000
#: Nice widths in ms, each with the bound of targets under which it is the nearest (a month has 30 days).
NICE = (
    (500, 100), (5 * SECOND, SECOND), (7.5 * SECOND, 5 * SECOND), (15 * SECOND, 10 * SECOND), (45 * SECOND, 30 * SECOND), (3 * MINUTE, MINUTE),
    (9 * MINUTE, 5 * MINUTE), (20 * MINUTE, 10 * MINUTE), (45 * MINUTE, 30 * MINUTE), (2 * HOUR, HOUR), (6 * HOUR, 3 * HOUR), (24 * HOUR, 12 * HOUR),
    (7 * DAY, DAY), (21 * DAY, 7 * DAY), (365 * DAY, 30 * DAY), (float("inf"), 365 * DAY),
)
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def nearest_width(target: float) -> int:
    """The nice width, in ms, for a target in ms."""
    return min(bound_width for bound_width in NICE if bound_width[0] > target)[1]


def widened(width: float, span: float, most: int = 100) -> tuple[int, float]:
    """The width to use, in ms, and what counts and sums are multiplied by, so that they speak of the asked width.

    A width that needs more than ``most`` bars for the span gives way to the largest nice one below a ``most``-th of it.
    """
    if span / width <= most:
        return int(width), 1.0
    target = span / most
    wide = max((w for _, w in NICE if w < target), default=max(int(target), 1))
    return wide, width / wide


def time_span(df: DataFrame, ts: str) -> float:
    """Milliseconds from the first to the last time. Two scalars come to the driver."""
    row = df.agg(F.min(F.unix_micros(ts)).alias("lo"), F.max(F.unix_micros(ts)).alias("hi")).first()
    return ((row["hi"] or 0) - (row["lo"] or 0)) / 1e3


def auto_interval(df: DataFrame, ts: str, bars: int = 50, most: int = 100) -> tuple[int, float]:
    """Width in ms and scale: the nice width nearest to a ``bars``-th of the span, widened if it needs over ``most`` bars."""
    span = time_span(df, ts)
    return widened(nearest_width(span / bars), span, most)


def date_histogram(
    df: DataFrame, ts: str, seconds: float | None = None, unit: str | None = None, zone: str = "UTC", fill: tuple[str, str] | None = None,
    least: int = 1, sums: Sequence[str] = (), scale: float = 1.0,
) -> DataFrame:
    """Counts ``n``, and sums of columns, for each interval of ``seconds``, or calendar ``unit`` in a time zone.

    Buckets of fewer than ``least`` rows are left out. ``fill`` has the bounds within which empty intervals count zero,
    which asks for a ``least`` of 0. With a ``scale`` other than 1 (see :func:`widened`) counts and sums are multiplied by it.
    """
    at = F.from_utc_timestamp(ts, zone)
    ms = None if unit else int(seconds * 1000)
    key = F.date_trunc(unit, at) if unit else F.timestamp_millis((F.floor(F.unix_millis(at) / ms) * ms).cast("long"))
    out = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))
    if fill:
        step = f"interval 1 {unit}" if unit else f"interval {ms / 1000} seconds"
        spine = df.sparkSession.range(1).select(F.explode(F.expr(f"sequence(timestamp'{fill[0]}', timestamp'{fill[1]}', {step})")).alias("key"))
        out = spine.join(out, "key", "full").select("key", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", *sums)))
    out = out.where(F.col("n") >= least) if least > 0 and not fill else out
    return out if scale == 1.0 else out.select("key", *((F.col(c) * scale).alias(c) for c in ("n", *sums)))


def histogram(df: DataFrame, value: str, interval: float, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Counts for each numeric interval; with ``bounds``, zero for empty ones within."""
    out = df.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / interval) * interval).cast("double").alias("key")).agg(F.count("*").alias("n"))
    if not bounds:
        return out
    lo, hi = int(bounds[0] // interval), int(bounds[1] // interval)
    spine = df.sparkSession.range(lo, hi + 1).select((F.col("id") * interval).cast("double").alias("key"))
    return spine.join(out, "key", "full").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def range_buckets(df: DataFrame, value: Column, ranges: Sequence[tuple], by: Sequence[str] = ()) -> DataFrame:
    """Counts for each range ``(label, low, high)``, low included, high not; None is open; ranges may overlap."""
    x = F.col("_x")
    fits = [F.when((F.lit(True) if lo is None else x >= F.lit(lo)) & (F.lit(True) if hi is None else x < F.lit(hi)) & x.isNotNull(), F.lit(label)) for label, lo, hi in ranges]
    counts = df.select(*by, value.alias("_x")).select(*by, F.explode(F.array_compact(F.array(*fits))).alias("range")).groupBy(*by, "range").agg(F.count("*").alias("n"))
    if by:
        return counts
    every = df.sparkSession.createDataFrame([(label,) for label, _, _ in ranges], "range string")
    return every.join(counts, "range", "left").select("range", F.coalesce("n", F.lit(0)).alias("n"))


def filters_buckets(df: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """One bucket for each named predicate; they may overlap. One pass."""
    one = df.agg(*(F.count_if(p).alias(name) for name, p in filters.items()))
    return one.unpivot([], list(filters), "filter", "n")


def terms(df: DataFrame, field: str, n: int, metric: Column | None = None, descending: bool = True, parents: Sequence[str] = (), include: str | None = None, exclude: str | None = None) -> DataFrame:
    """The first ``n`` terms by count, or by a metric, ties by term; with ``parents``, of each parent bucket."""
    df = df.where(F.col(field).isNotNull())
    if include:
        df = df.where(F.col(field).rlike(f"^(?:{include})$"))
    if exclude:
        df = df.where(~F.col(field).rlike(f"^(?:{exclude})$"))
    out = df.groupBy(*parents, field).agg(F.count("*").alias("n"), (metric if metric is not None else F.count("*").cast("double")).alias("metric"))
    order = [F.col("metric").desc() if descending else F.col("metric").asc(), F.col(field).asc()]
    if not parents:
        return out.orderBy(*order).limit(n)
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(*parents).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def significant_terms(df: DataFrame, field: str, within: Column, n: int) -> DataFrame:
    """Terms more frequent within a filter than in all rows, by (share within - share) * (share within / share)."""
    total = df.agg(F.count_if(within & F.col(field).isNotNull()).alias("_fg"), F.count(field).alias("_bg"))
    by = df.where(F.col(field).isNotNull()).groupBy(field).agg(F.count_if(within).alias("n"), F.count("*").alias("bg"))
    fg, bg = total.select("_fg").scalar(), total.select("_bg").scalar()
    out = by.withColumn("fs", F.try_divide("n", fg)).withColumn("bs", F.col("bg") / bg)
    out = out.where("fs > bs").withColumn("score", (F.col("fs") - F.col("bs")) * (F.col("fs") / F.col("bs")))
    return out.select(field, "n", "bg", "score").orderBy(F.desc("score"), field).limit(n)


def geohash(lat: Column, lon: Column, precision: int = 2) -> Column:
    """The geohash cell of a point: longitude and latitude bits in turn, five to a letter."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * (1 << nx)), F.lit((1 << nx) - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * (1 << ny)), F.lit((1 << ny) - 1)).cast("long")
    code = F.lit(0).cast("long")
    for i in range(bits):  # from the highest bit on
        source, shift = (x, nx - 1 - i // 2) if i % 2 == 0 else (y, ny - 1 - i // 2)
        code = F.shiftleft(code, 1).bitwiseOR(F.shiftright(source, shift).bitwiseAND(F.lit(1)))
    letters = [F.substring(F.lit(GEOHASH), (F.shiftright(code, bits - 5 * (k + 1)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(precision)]
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*letters))


def geohash_bounds(cell: Column, precision: int) -> list[Column]:
    """South, north, west and east of a geohash cell."""
    bits = 5 * precision
    x, y = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i in range(bits):
        value = (F.call_function("position", F.substring(cell, i // 5 + 1, 1), F.lit(GEOHASH)) - 1).cast("long")
        bit = F.shiftright(value, 4 - i % 5).bitwiseAND(F.lit(1))
        if i % 2 == 0:
            x = F.shiftleft(x, 1).bitwiseOR(bit)
        else:
            y = F.shiftleft(y, 1).bitwiseOR(bit)
    w, h = 360 / (1 << (bits + 1) // 2), 180 / (1 << bits // 2)
    return [y * h - 90, (y + 1) * h - 90, x * w - 180, (x + 1) * w - 180]


def geohash_grid(df: DataFrame, lat: str, lon: str, precision: int = 2) -> DataFrame:
    """Counts for each cell with its corners and centre."""
    out = df.groupBy(geohash(F.col(lat), F.col(lon), precision).alias("cell")).agg(F.count("*").alias("n")).where("cell is not null")
    south, north, west, east = geohash_bounds(F.col("cell"), precision)
    return out.select("cell", "n", south.alias("south"), north.alias("north"), west.alias("west"), east.alias("east"), ((south + north) / 2).alias("lat"), ((west + east) / 2).alias("lon"))


def percentile_ranks(value: Column, at: Sequence[float]) -> list[Column]:
    """The share of values at or below each given one, in percent."""
    return [(F.avg(F.when(value <= x, 1.0).when(value.isNotNull(), 0.0)) * 100).alias(f"rank_{i}") for i, x in enumerate(at)]


def std_bands(value: Column, sigmas: float = 2.0) -> list[Column]:
    """Mean less and plus ``sigmas`` population deviations, and the mean."""
    return [(F.avg(value) - sigmas * F.stddev_pop(value)).alias("lower"), F.avg(value).alias("mean"), (F.avg(value) + sigmas * F.stddev_pop(value)).alias("upper")]


def nested_buckets(df: DataFrame, levels: Sequence[str], metrics: Sequence[Column], hierarchical: bool = False) -> DataFrame:
    """A flat table of nested buckets; hierarchical, with a row for each bucket of every level (``level`` counts)."""
    if not hierarchical:
        return df.groupBy(*levels).agg(*metrics).withColumn("level", F.lit(len(levels)))
    out = df.rollup(*levels).agg(*metrics, F.grouping_id().alias("_g"))
    return out.withColumn("level", len(levels) - F.length(F.replace(F.bin("_g"), F.lit("0"), F.lit("")))).drop("_g")


def point_series(df: DataFrame, x: str, ys: Sequence[str], series: str | None = None) -> DataFrame:
    """Long rows x, series, y of several y columns, split by another column where one is given."""
    ids = [x, *([series] if series else [])]
    out = df.select(*ids, *(F.col(y).cast("double") for y in ys)).unpivot(ids, list(ys), "y_name", "y")
    name = F.concat_ws(": ", F.col(series), "y_name") if series else F.col("y_name")
    return out.select(F.col(x).alias("x"), name.alias("series"), "y")


def field_summary(df: DataFrame, fields: Sequence[str], top: int = 5) -> DataFrame:
    """The ``top`` values of each field with count and percent of the documents that have it, and how many lack it.

    Each element of an array counts as a value; a document has the field unless it is null. Null elements do not count.
    """
    many = [f for f in fields if isinstance(df.schema[f].dataType, T.ArrayType)]
    values = [(F.col(f).cast("array<string>") if f in many else F.array(F.col(f).cast("string"))).alias(f) for f in fields]
    has = df.select(*values).agg(*(F.count_if(F.col(f).isNotNull() if f in many else F.col(f)[0].isNotNull()).alias(f) for f in fields), F.count("*").alias("_all"))
    per = has.unpivot(["_all"], list(fields), "field", "has").select("field", "has", (F.col("_all") - F.col("has")).alias("missing"))
    long = df.select(*values).unpivot([], list(fields), "field", "vs").select("field", F.explode("vs").alias("v")).where("v is not null")
    counts = long.groupBy("field", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "v")  # only the first of each task's are sent
    best = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.join(per, "field").select("field", "rank", F.col("v").alias("value"), "n", (100.0 * F.col("n") / F.col("has")).alias("percent"), "missing", "has")


def percent_stack(df: DataFrame, x: str, series: str, y: str) -> DataFrame:
    """Adds each series' share of its x in percent, and the running total over series in order."""
    w = Window.partitionBy(x)
    return df.withColumn("percent", 100 * F.try_divide(F.col(y), F.sum(y).over(w))).withColumn("stacked", F.sum(y).over(w.orderBy(series).rowsBetween(Window.unboundedPreceding, 0)))
