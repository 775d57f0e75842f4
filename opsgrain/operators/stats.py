"""Distribution statistics of samples: robust fits, sigma histograms, spread scores, running moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins around the mean that do not call for a second fit.
CENTRAL = (2, 3)
BINS = 6


#: What counts as equal to a bin's bound, as a share of the mean and the deviation: sums differ with the order of additions.
TOLERANCE = 1e-11


def sigma_bin(x: Column, mean: Column, sd: Column) -> Column:
    """The sigma bin of a value: 0 below mean - 2 sd, up to 5 from mean + 2 sd on; the mean itself with sd 0 is bin 2.

    A value within :data:`TOLERANCE` of a bound stands on it, so that the bin does not depend on the order of rows.
    """
    d, near = x - mean, (F.abs(mean) + sd) * TOLERANCE
    return (
        F.when(d < -2 * sd - near, 0).when(d < -sd - near, 1).when((d < -near) | ((d <= near) & (sd <= near)), 2)
        .when(d < sd - near, 3).when(d < 2 * sd - near, 4).otherwise(5)
    )


def spread_score(bins: list[Column], n: Column, integer: bool = True) -> Column:
    """How far a histogram spreads: inner bins count once, the next twice, the outer four times; per sample."""
    total = sum(w * b for w, b in zip((4, 2, 1, 1, 2, 4), bins, strict=True))
    share = F.try_divide(total, n)
    return F.floor(share).cast("double") if integer else share


def _moments(df: DataFrame, keys: list[str], x: Column, *more: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(x).alias("fit_mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("fit_sd"), F.count(x).alias("size"), *more
    )


def _fits(fits: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(fits) if few else fits


def _fitted(df: DataFrame, keys: list[str], x: Column, first: DataFrame, few: bool = False) -> DataFrame:
    """``keys``, the six counts of bins around the first fit, and the fullest bin with its own moments, as ``_b``."""
    known = df.join(_fits(first.select(*keys, "fit_mean", "fit_sd"), few), keys)
    binned = known.withColumn("_bin", sigma_bin(x, F.col("fit_mean"), F.col("fit_sd"))).drop("fit_mean", "fit_sd")
    bins = _moments(binned.where(x.isNotNull()), [*keys, "_bin"], x)
    counts = [F.coalesce(F.sum(F.when(F.col("_bin") == i, F.col("size"))), F.lit(0)).alias(f"f{i}") for i in range(BINS)]
    best = F.max_by(F.struct("_bin", "fit_mean", "fit_sd"), F.struct("size", -F.col("_bin"))).alias("_b")
    return bins.groupBy(*keys).agg(*counts, best)


def fit(df: DataFrame, keys: list[str], value: str, refit: bool = False) -> DataFrame:
    """Mean and sample deviation (0 for one value) of each group: ``keys, fit_mean, fit_sd, refitted``.

    With ``refit``, a group whose fullest bin (the lowest of several) is an outer one is fitted again to that
    bin's values. Nothing but partial aggregates and joins on the keys; null values do not count.
    """
    x = F.col(value)
    first = _moments(df, keys, x).drop("size")
    if not refit:
        return first.withColumn("refitted", F.lit(False))
    outer = F.coalesce(~F.col("_b._bin").isin(*CENTRAL), F.lit(False))
    return first.join(_fitted(df, keys, x, first), keys, "left").select(
        *keys, F.when(outer, F.col("_b.fit_mean")).otherwise(F.col("fit_mean")).alias("fit_mean"),
        F.when(outer, F.col("_b.fit_sd")).otherwise(F.col("fit_sd")).alias("fit_sd"), outer.alias("refitted"),
    )


def distribution(df: DataFrame, keys: list[str], value: str, refit: bool = False, extra: list[Column] | None = None, integer: bool = True, few: bool = False) -> DataFrame:
    """Size, minimum, maximum, mean, deviation, six-bin histogram and spread score of each group.

    ``extra`` are further aggregates over the same rows. The rows are read twice, for the moments and for the bins
    around them; a third time only the rows of groups that are fitted again. Each is a partial aggregate, so a
    group of any size is summed in pieces. Rows meet their group's fit in a join; with ``few`` the fits go to every task and
    no row is dealt, for groups whose number does not grow with the rows.
    """
    x = F.col(value)
    first = _moments(df, keys, x, F.min(x).alias("min_val"), F.max(x).alias("max_val"), *(extra or []))
    found = _fitted(df, keys, x, first, few)
    names = [f"f{i}" for i in range(BINS)]
    out = first.join(found, keys, "left")
    if refit:
        again = found.where(~F.col("_b._bin").isin(*CENTRAL)).select(*keys, "_b.fit_mean", "_b.fit_sd")
        binned = df.join(_fits(again, few), keys).withColumn("_bin", sigma_bin(x, F.col("fit_mean"), F.col("fit_sd")))
        counts = binned.groupBy(*keys).agg(*(F.count_if(F.col("_bin") == i).alias(f"_f{i}") for i in range(BINS)))
        out = out.join(counts, keys, "left")
        outer = F.col("_f0").isNotNull()
        out = out.withColumns(
            {n: F.coalesce(f"_{n}", n) for n in names}
            | {m: F.when(outer, F.col(f"_b.{m}")).otherwise(F.col(m)) for m in ("fit_mean", "fit_sd")}
        ).drop(*(f"_{n}" for n in names))
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in names}).drop("_b")
    out = out.withColumnsRenamed({"fit_mean": "mean", "fit_sd": "stddev"})
    more = [c for c in out.columns if c not in (*keys, "size", "min_val", "max_val", "mean", "stddev", *names)]
    return out.select(
        *keys, "size", "min_val", "max_val", "mean", "stddev", *names, *more,
        spread_score([F.col(n) for n in names], F.col("size"), integer).alias("score"),
    )


def watermark_share(value: Column, mark: Column) -> Column:
    """The share of a group's values that reach their high-water mark, an aggregate."""
    return F.try_divide(F.count_if(value >= mark), F.count(value))


def relative_to_peers(hosts: DataFrame, peers: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """Adds ``peer_score`` and ``relative``: (score - peer) / peer, 0 where the peers' score is 0 or it is within ``tolerance``."""
    joined = hosts.join(peers.select(*keys, F.col("score").alias("peer_score")), keys, "left")
    ratio = F.when(F.col("peer_score") != 0, (F.col("score") - F.col("peer_score")) / F.col("peer_score")).otherwise(0.0)
    return joined.withColumn("relative", F.when(F.abs(ratio) > tolerance, ratio).otherwise(0.0))


def tag_average(df: DataFrame, keys: list[str], tags: str, order: list[str]) -> DataFrame:
    """``keys, tag, avg_value, last_text``: numeric tags as a mean over all rows of the group, a missing one as 0;
    others by their last text in ``order``."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    each = df.select(*keys, *order, F.explode(tags).alias("tag", "_text"))
    number = F.col("_text").try_cast("double")
    by = each.groupBy(*keys, "tag").agg(F.sum(number).alias("_sum"), F.max_by("_text", F.struct(*order)).alias("_last"), F.count_if(number.isNull()).alias("_texts"))
    plain = F.col("_texts") == 0
    return by.join(sizes, keys).select(*keys, "tag", F.when(plain, F.col("_sum") / F.col("_n")).alias("avg_value"), F.when(~plain, F.col("_last")).alias("last_text"))


def relative_delta(df: DataFrame, series: list[str], order: list[str], value: str, ts: str) -> DataFrame:
    """Adds ``delta`` and ``elapsed_ms`` against the row before in the series.

    The delta is relative, and 0 unless the value rises from a value other than 0. The first row has neither.
    """
    w = Window.partitionBy(*series).orderBy(*order)
    prev, x = F.lag(value).over(w), F.col(value)
    elapsed = (F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w))) / 1000
    return df.withColumn("delta", F.when(prev.isNotNull(), F.when((prev != 0) & (x > prev), (x - prev) / prev).otherwise(0.0))).withColumn("elapsed_ms", elapsed)


def velocity(df: DataFrame) -> DataFrame:
    """Adds ``velocity``: delta per ms, an elapsed time of 0 as 0.001, to rows of :func:`relative_delta`."""
    return df.withColumn("velocity", F.col("delta") / F.when(F.col("elapsed_ms") == 0, 0.001).otherwise(F.col("elapsed_ms")))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and sum of squared deviations of each group: partial states that :func:`merge_moments` adds up."""
    x = F.col(value)
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def merge_moments(states: DataFrame, keys: list[str]) -> DataFrame:
    """Merges states of :func:`moments`; adds population and sample variance and deviation.

    Each state adds its squares around the merged mean, ``m2 + n * (mean - merged)^2``, so that nothing large is
    taken from something large. States without values add nothing.
    """
    w = Window.partitionBy(*keys)
    merged = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    apart = F.col("mean") - F.col("_mean")
    total = states.withColumn("_mean", merged).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("_m2")
    )
    m2 = F.col("_m2")
    return total.select(
        *keys, "n", "mean", (m2 / F.nullif("n", F.lit(0))).alias("var_pop"), F.when(F.col("n") > 1, m2 / (F.col("n") - 1)).alias("var_samp"),
        F.sqrt(m2 / F.nullif("n", F.lit(0))).alias("stddev_pop"),
    )


def cluster_scores(df: DataFrame, score: str, k: int = 3, rounds: int = 1) -> DataFrame:
    """Adds ``cluster`` (0 to k - 1, by rising centre): k-means on a column, ``rounds`` times.

    The first centres stand at equal steps from the least to the greatest score. A value goes to the nearest centre,
    the lower of two; a centre without values stays. Only the k centres come to the driver. Null scores have none.
    """
    x = F.col(score)
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = ends["lo"] or 0.0, ends["hi"] or 0.0
    centres = [lo + (hi - lo) * i / max(k - 1, 1) for i in range(k)]

    def nearest(centres: list[float]) -> Column:
        return F.when(x.isNotNull(), F.array_min(F.array(*(F.struct(F.abs(x - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))["i"])

    for _ in range(rounds):
        means = {r["i"]: r["m"] for r in df.groupBy(nearest(centres).alias("i")).agg(F.avg(x).alias("m")).where("i is not null").collect()}
        centres = sorted(means.get(i, c) for i, c in enumerate(centres))
    return df.withColumn("cluster", nearest(centres))
