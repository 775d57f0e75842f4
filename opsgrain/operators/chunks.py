"""Sequences of any length in pieces: a series is cut by time, each piece is one window task, and only what crosses a border
is looked at by series.

Functions that look a bounded number of rows back (scores, deltas, exhaustion) get those rows from the pieces before.
Runs are found in each piece, and the first and last runs of the pieces are joined end to start. Requests are paired in
each piece, and what a piece has before its first request goes to the last request of the pieces before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsgrain.operators.flows import exchanges, numbered_requests, summed_exchanges
from opsgrain.operators.rollup import quantized, rolled, series_summaries, window_of
from opsgrain.operators.severity import severity_runs


def look_back(df: DataFrame, series: list[str], order: list[str], ts: str, seconds: int, rows: int, make: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``make(df, series)`` for a function of each row and of at most ``rows`` rows before it in the series (by ``order``, whose
    first column is ``ts``), with the series cut into pieces of ``seconds``.

    Each piece is given the last ``rows`` rows before it, which pieces report as lists of at most so many; ``make`` gets the
    piece as a further key, and must keep the rows' columns. A series' lists, one for each of its pieces, are all that
    comes together.
    """
    piece = df.withColumn("_piece", window_of(F.col(ts), seconds))
    whole = F.struct(*df.columns)
    place = F.row_number().over(Window.partitionBy(*series, "_piece").orderBy(*[F.desc(c) for c in order]))
    ends = piece.withColumn("_n", place).where(F.col("_n") <= rows).groupBy(*series, "_piece").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], whole.alias("row")))).alias("_end"))
    # every piece has a row at least, so so many pieces before hold all rows that are wanted
    before = F.flatten(F.collect_list("_end").over(Window.partitionBy(*series).orderBy("_piece").rowsBetween(-rows, -1)))
    borders = ends.withColumn("_before", before).select("_piece", F.explode(F.slice("_before", F.greatest(F.size("_before") - rows, F.lit(0)) + 1, F.lit(rows))).alias("_b")).select("_b.row.*", "_piece")
    both = piece.withColumn("_border", F.lit(False)).unionByName(borders.withColumn("_border", F.lit(True)))
    return make(both, [*series, "_piece"]).where("NOT _border").drop("_border", "_piece")


def chunked_runs(df: DataFrame, series: list[str], ts: str, grain: int, seconds: int, how: str = "min") -> DataFrame:
    """:func:`~opsgrain.operators.severity.severity_runs` (``min`` or ``avg``) with series cut into pieces of ``seconds``.

    Of each piece the first and the last run go on to be joined with those of its neighbours; others are done.
    """
    keys = [*series, "_piece"]
    runs = severity_runs(df.withColumn("_piece", window_of(F.col(ts), seconds)), keys, ts, grain, how)
    w = Window.partitionBy(*keys).orderBy("start")
    runs = runs.withColumn("_inner", F.lag("start").over(w).isNotNull() & F.lead("start").over(w).isNotNull())
    names = [*series, "severity", "start", "duration", "score"]
    borders = runs.where("NOT _inner").select(*names)
    if how == "min":  # the least score of the joined runs
        s = Window.partitionBy(*series).orderBy("start")
        end = F.unix_seconds("start") + F.col("duration") * grain
        new = F.when((F.lag("severity").over(s) == F.col("severity")) & (F.lag(end).over(s) == F.unix_seconds("start")), 0).otherwise(1)
        numbered = borders.withColumn("_new", new).withColumn("_run", F.sum("_new").over(s.rowsBetween(Window.unboundedPreceding, 0)))
        joined = numbered.groupBy(*series, "severity", "_run").agg(F.min("start").alias("start"), F.sum("duration").alias("duration"), F.min("score").alias("score")).drop("_run")
    else:
        joined = severity_runs(borders, series, "start", grain, "weighted")
    return runs.where("_inner").select(*names).unionByName(joined.select(*names))


#: A window that all times fall in.
EVER = 1 << 40


def chunked_quantized(df: DataFrame, series: list[str], ts: str, grain: int, slots: int, seconds: int, single: float = 0.25, majority: float = 0.5, replicated: bool = True) -> DataFrame:
    """:func:`~opsgrain.operators.severity.quantized_severity` from summaries of pieces of ``seconds``, merged by series, so that
    what comes together of a series is a summary for each piece (times from 1970 on)."""
    whole = rolled(series_summaries(df, series, ts, grain, seconds), series, EVER)
    q = quantized(F.col("s"), slots, single, majority, replicated)
    return whole.select(
        *series, q["severity"].alias("severity"), q["total"].alias("total_severity_duration"), q["longest"].alias("single_max_severity_duration"), F.lit(slots).cast("long").alias("total_duration")
    )


def paired_pieces(packets: DataFrame, connection: Sequence[str], by: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """Requests with their responses, paired within pieces of ``seconds``. The last request of a piece, and what stands before its
    first one (number 0), are marked as ``_border``."""
    piece = [*connection, "_piece"]
    numbered = numbered_requests(packets.withColumn("_piece", window_of(F.col(ts), seconds)), piece, ts)
    parts = exchanges(numbered, [*by, "_piece", "_q"], ts)
    return parts.withColumn("_border", (F.col("_q") == 0) | (F.col("_q") == F.max("_q").over(Window.partitionBy(*piece))))


def chunked_flow_summary(packets: DataFrame, connection: Sequence[str], keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """:func:`~opsgrain.operators.flows.flow_summary` with connections cut into pieces of ``seconds``.

    A piece's last request may have responses in later pieces, and its packets before its first request belong to a request of
    an earlier one. These two of each piece, summed up already, are all that comes together of a connection, where they
    are numbered and added up once more. Packets before a connection's first request do not count.
    """
    by = list(dict.fromkeys([*keys, *connection]))
    parts = paired_pieces(packets, connection, by, ts, seconds)
    # a request whose packets differ in their keys has several rows of one number, and counts once
    first = F.row_number().over(Window.partitionBy(*connection, "_piece", "_q").orderBy(*by)) == 1
    borders = parts.where("_border").withColumn("_new", F.when((F.col("_q") > 0) & first, 1).otherwise(0))
    upto = Window.partitionBy(*connection).orderBy("_piece", "_q").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = borders.withColumn("_at", F.sum("_new").over(upto)).where("_at > 0").groupBy(*by, "_at").agg(
        F.min("_t").alias("_t"), F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("size").alias("size"), F.sum("sent").alias("sent"), F.max("request").alias("request"), F.max("error").alias("error")
    )
    return summed_exchanges(parts.where("NOT _border").drop("_piece", "_q", "_border").unionByName(joined.drop("_at")), keys)
