"""The most frequent of very many terms, exactly, by counting few of them one by one.

Two summaries of bounded size, both of which merge (by slot into day, by file into table), speak about all rows: a sketch
of frequent items names terms that are surely frequent, and counts by hash bucket bound every term's count from above. The
exact counts of the named terms give a cutoff that the wanted ranks can't be under; only terms in buckets that reach it
are then counted one by one. Where a group has no frequent terms, all its buckets reach the cutoff, and all is counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a group, and items that its sketch tracks.
BUCKETS, TRACKED = 16_384, 4_096


def bucket_of(term: str, buckets: int = BUCKETS) -> Column:
    """The bucket that a term's rows are counted in."""
    return F.pmod(F.xxhash64(F.col(term)), F.lit(buckets)).cast("int")


def _same(keys: list[str], other: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``other`` with its keys renamed, and the conditions that join on them, nulls included."""
    return other.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]


def frequent_sketches(df: DataFrame, keys: list[str], term: str, tracked: int = TRACKED) -> DataFrame:
    """``keys, sketch``: a sketch of each group's frequent terms, to be stored and merged; null terms do not count.

    A term it names is under-counted by at most about 3.5 / ``tracked`` of the group, so every term with over twice that share is named.
    """
    return df.where(F.col(term).isNotNull()).groupBy(*keys).agg(F.expr(f"approx_top_k_accumulate(`{term}`, {tracked})").alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str], tracked: int = TRACKED) -> DataFrame:
    """``keys, sketch``: one sketch of all rows of the group's sketches."""
    return sketches.groupBy(*keys).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))


def bucket_counts(df: DataFrame, keys: list[str], term: str, buckets: int = BUCKETS) -> DataFrame:
    """``keys, bucket, n``: rows with a term, by its bucket; partial sums, at most ``buckets`` rows of a group."""
    return df.where(F.col(term).isNotNull()).groupBy(*keys, bucket_of(term, buckets).alias("bucket")).agg(F.count("*").alias("n"))


def merged_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, bucket, n``: the sums of the group's counts."""
    return counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def open_buckets(df: DataFrame, keys: list[str], term: str, n: int, sketches: DataFrame, counts: DataFrame) -> DataFrame:
    """``keys, bucket, cutoff``: the buckets that can hold one of the group's first ``n`` terms.

    ``cutoff`` is the exact count of the ``n``-th of the terms that the group's sketch names, and 1 where it names fewer.
    ``sketches`` and ``counts`` are of all rows of ``df``, each group in one row, or one for each bucket.
    """
    named = sketches.select(*keys, F.explode(F.expr(f"approx_top_k_estimate(sketch, {2 * n})")).alias("_e")).select(*keys, F.col("_e.item").alias("_item"))
    other, same = _same(keys, named)
    counted = df.join(other, [*same, F.col(term) == F.col("_item")], "left_semi").groupBy(*keys, term).agg(F.count("*").alias("_n"))
    # of each group 2 n terms at most
    place = F.row_number().over(Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy(F.desc("_n")))
    cutoffs = counted.withColumn("_r", place).where(F.col("_r") == n).select(*keys, F.col("_n").alias("_cutoff"))
    other, same = _same(keys, cutoffs)
    met = counts.join(other, same, "left") if keys else counts.join(F.broadcast(other), how="left")  # one row at most
    cutoff = F.coalesce("_cutoff", F.lit(1))
    return met.where(F.col("n") >= cutoff).select(*keys, "bucket", cutoff.alias("cutoff"))


def top_terms(df: DataFrame, keys: list[str], term: str, n: int, buckets: int = BUCKETS, tracked: int = TRACKED, stored: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """``keys, term, n, rank``: the ``n`` most frequent terms of each group, ties to the smaller term; null terms do not count.

    The answer is that of counting every term. ``stored`` gives the merged sketches and counts of ``df``'s rows where they
    are kept (with the same ``buckets`` and ``tracked``), else they are made here. A group of null keys is a group.
    """
    rows = df.where(F.col(term).isNotNull()).select(*keys, term)
    sketches, counts = stored(rows) if stored else (frequent_sketches(rows, keys, term, tracked), bucket_counts(rows, keys, term, buckets))
    other, same = _same(keys, open_buckets(rows, keys, term, n, sketches, counts).withColumnRenamed("bucket", "_open"))
    other = other if keys else F.broadcast(other)  # at most ``buckets`` rows; with keys their number decides
    few = rows.join(other, [*same, bucket_of(term, buckets) == F.col("_open")], "left_semi")
    exact = few.groupBy(*keys, term).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy(F.desc("n"), term)
    return exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
