"""Service-call flows: pivots, duplicates, rollups, request pairing, top requests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgrain.functions.scalars import request_template


def pivot_flows(df: DataFrame, keys: list[str], name: str, value: str, order: Sequence[str], names: Sequence[str], complete: bool = True, defaults: dict | None = None) -> DataFrame:
    """One row for each binding with its last value of each name; incomplete bindings go, or get defaults."""
    last = df.where(F.col(name).isin(list(names))).groupBy(*keys).pivot(name, list(names)).agg(F.max_by(value, F.struct(*order)))
    return last.dropna(subset=list(names)) if complete else last.fillna(defaults or {})


def dedup_edges(df: DataFrame, keys: list[str], order: Sequence[Column]) -> DataFrame:
    """One row for each edge and minute, the first in a total order (both ends may report it)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


#: Measures that are weighted by duration, added up, or taken at their greatest.
WEIGHTED, ADDED, GREATEST = ("avg_rsp_size", "avg_ttfb", "avg_ttlb"), ("error_count", "request_count", "sent_bytes", "recv_bytes", "duration"), ("max_ttfb", "max_ttlb")


def _level(levels: Sequence[Sequence[str]], columns: Sequence[str]) -> Column:
    """The number of the grouping set that a row belongs to, from its ``_g_`` columns."""
    out = F.lit(None).cast("int")
    for i, one in enumerate(levels):
        match = F.lit(True)
        for c in columns:
            match = match & (F.col(f"_g_{c}") == (0 if c in one else 1))
        out = F.when(match, i).otherwise(out)
    return out


def connection_rollup(df: DataFrame, levels: Sequence[Sequence[str]], service: Sequence[str], requests: str | None = None, errors: str | None = None, top: int = 3) -> DataFrame:
    """Flows by each level (a set of columns) and service, in one pass; columns of other levels are null.

    Averages are weighted by duration; a group whose durations sum to zero has none. ``level`` numbers the levels.
    ``requests`` and ``errors`` name columns of arrays of ``req, count, ttfb, ttlb``: each group then has the ``top``
    costliest templates (see :func:`top_requests`) as ``costliest`` and ``top_errors``, and its greatest times are those
    of its costliest single request, where there is one.
    """
    columns = list(dict.fromkeys(c for level in levels for c in level))
    sets = [[F.col(c) for c in [*level, *service]] for level in levels]
    marks = [F.grouping(c).alias(f"_g_{c}") for c in columns]
    d = F.col("duration")
    lists = {name: source for name, source in (("costliest", requests), ("top_errors", errors)) if source and requests}
    if not lists:
        aggs = [F.try_divide(F.sum(F.col(m) * d), F.sum(d)).alias(m) for m in WEIGHTED] + [F.sum(m).alias(m) for m in ADDED] + [F.max(m).alias(m) for m in GREATEST]
        out = df.groupingSets(sets, *columns, *service).agg(*aggs, *marks)
        return out.withColumn("level", _level(levels, columns)).drop(*(f"_g_{c}" for c in columns))
    # a flow's own row and one for each of its requests and errors, so that the flows are read once: what they are is part of the key
    own = F.array_max(F.transform(requests, lambda r: F.struct(r["ttfb"].alias("ttfb"), r["ttlb"].alias("ttlb"))))
    entry = lambda kind, r: F.struct(F.lit(kind).alias("_kind"), *((F.lit(None) if r is None else r[x]).alias(x) for x in ("req", "count", "ttfb", "ttlb")))
    each = [F.coalesce(F.transform(source, partial(entry, kind)), F.array()) for kind, source in enumerate(lists.values(), 1)]
    measures = [*WEIGHTED, *ADDED]
    rows = df.select(*columns, *service, *measures, own.alias("_worst"), F.inline(F.concat(F.array(entry(0, None)), *each)))
    rows = rows.where("_kind = 0 or (count > 0 and req <> '')").withColumn("template", F.when(F.col("_kind") > 0, request_template(F.col("req"))))
    rows = rows.withColumns({m: F.when(F.col("_kind") == 0, F.col(m)) for m in [*measures, "_worst"]})
    # sums of the finest groups, of which those of the levels are made
    c, weighed = F.col("count"), {f"_w_{m}": F.col(m) * w for w, of in ((d, WEIGHTED), (F.col("count"), ("ttfb", "ttlb"))) for m in of}
    fine = rows.groupBy(*columns, *service, "_kind", "template").agg(*(F.sum(x).alias(n) for n, x in weighed.items()), *(F.sum(m).alias(m) for m in (*ADDED, "count")), F.max("_worst").alias("_worst"))
    mean = lambda m, w: F.try_divide(F.sum(f"_w_{m}"), F.sum(w)).alias(m)
    sums = fine.groupingSets([[*s, F.col("_kind"), F.col("template")] for s in sets], *columns, *service, "_kind", "template").agg(
        *(mean(m, d) for m in WEIGHTED), *(F.sum(m).alias(m) for m in ADDED), F.max("_worst").alias("_worst"), F.sum(c).alias("count"), mean("ttfb", c), mean("ttlb", c), *marks
    )
    keys = ["level", *columns, *service]
    ranked = sums.withColumn("level", _level(levels, columns)).withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "_kind").orderBy(F.desc("ttfb"), "template")))
    top_of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("_kind") == kind, F.struct("rank", "template", "count", "ttfb", "ttlb"))))
    whole = F.first(F.when(F.col("_kind") == 0, F.struct(*measures, F.col("_worst.ttfb").alias("max_ttfb"), F.col("_worst.ttlb").alias("max_ttlb"))), ignorenulls=True)
    out = ranked.where((F.col("_kind") == 0) | (F.col("rank") <= top)).groupBy(*keys).agg(whole.alias("_whole"), *(top_of(k).alias(name) for k, name in enumerate(lists, 1)))
    return out.select(*columns, *service, "_whole.*", "level", *(F.when(F.size(name) > 0, F.col(name)).alias(name) for name in lists))


def flow_series(df: DataFrame, keys: list[str], host: str, measures: Sequence[str]) -> DataFrame:
    """Long rows of each measure for each host, and the mean over hosts as host ``*``."""
    mean = df.groupBy(*keys).agg(F.lit("*").alias(host), *(F.avg(m).alias(m) for m in measures))
    rows = df.groupBy(*keys, host).agg(*(F.avg(m).alias(m) for m in measures))
    return rows.unionByName(mean).unpivot([*keys, host], list(measures), "measure", "value")


def observation_counts(df: DataFrame, levels: Sequence[Sequence[str]]) -> DataFrame:
    """Anomalies by subtype for each level, as a map."""
    out = None
    for i, level in enumerate(levels):
        by = df.groupBy(*level, "sub_type").agg(F.count("*").alias("n"))
        one = by.groupBy(*level).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sub_type", "n")))).alias("counts")).withColumn("level", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def numbered_requests(packets: DataFrame, within: Sequence[str], ts: str) -> DataFrame:
    """Packets with the number ``_q`` of the last request up to them, in the order of ``ts, seq``; 0 before the first one."""
    w = Window.partitionBy(*within).orderBy(ts, "seq")
    return packets.withColumn("_q", F.sum(F.when(F.col("kind") == "request", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def exchanges(numbered: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """One row for each request number: the request, and what its response packets add up to."""
    reply = F.col("kind") == "response"
    return numbered.groupBy(*by).agg(
        F.min(F.when(~reply, F.col(ts))).alias("_t"), F.min(F.when(reply, F.col(ts))).alias("_first"), F.max(F.when(reply, F.col(ts))).alias("_last"),
        F.coalesce(F.sum(F.when(reply, F.col("size"))), F.lit(0)).alias("size"), F.sum(F.when(~reply, F.col("size"))).alias("sent"), F.max(F.when(~reply, F.col("request"))).alias("request"),
        F.coalesce(F.max(F.when(reply, F.col("error"))), F.lit(False)).alias("error"),
    )


def summed_exchanges(one: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests with their responses, summed up by ``keys``."""
    ms = F.unix_millis
    one = one.withColumn("ttfb", ms("_first") - ms("_t")).withColumn("ttlb", ms("_last") - ms("_t"))
    return one.groupBy(*keys).agg(
        F.count("*").alias("request_count"), F.avg("ttfb").alias("avg_ttfb"), F.max("ttfb").alias("max_ttfb"), F.avg("ttlb").alias("avg_ttlb"), F.max("ttlb").alias("max_ttlb"),
        F.avg("size").alias("avg_rsp_size"), F.sum("size").alias("recv_bytes"), F.sum("sent").alias("sent_bytes"), F.count_if("error").alias("error_count"),
        F.max_by("request", F.struct(F.coalesce("ttlb", F.lit(-1)), "request")).alias("costliest"), F.max_by("request", F.struct("error", "request")).alias("_e"), F.max("error").alias("_any"),
    ).withColumn("top_error", F.when(F.col("_any"), F.col("_e"))).drop("_e", "_any")


def flow_summary(packets: DataFrame, connection: Sequence[str], keys: Sequence[str], ts: str) -> DataFrame:
    """Requests paired with the response packets that follow them on their connection, summed up by ``keys``.

    ``packets`` has kind (request or response), request text, size, error. A request's first and last response before
    the next request give the times to first and last byte (ms); one without a response counts without times.
    A connection is one window; :func:`~opsgrain.operators.chunks.chunked_flow_summary` cuts busy ones by time.
    """
    by = [*dict.fromkeys([*keys, *connection]), "_q"]
    return summed_exchanges(exchanges(numbered_requests(packets, connection, ts).where("_q > 0"), by, ts), keys)


def top_requests(df: DataFrame, keys: list[str], request: str, n: int = 3) -> DataFrame:
    """The costliest request templates of each edge: counts, and times weighted by them; then by time to first byte, then text."""
    c = F.col("count")
    merged = df.groupBy(*keys, request_template(F.col(request)).alias("template")).agg(F.sum(c).alias("count"), F.try_divide(F.sum(F.col("ttfb") * c), F.sum(c)).alias("ttfb"), F.try_divide(F.sum(F.col("ttlb") * c), F.sum(c)).alias("ttlb"))
    w = Window.partitionBy(*keys).orderBy(F.desc("ttfb"), "template")
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def state_counts(df: DataFrame, keys: list[str], state: str, states: Sequence[str]) -> DataFrame:
    """Rows in each state, zero for states that do not occur."""
    return df.groupBy(*keys).agg(*(F.count_if(F.col(state) == s).alias(s) for s in states))


def scoreboard(df: DataFrame, keys: list[str], board: str, names: dict[str, str]) -> DataFrame:
    """How often each letter stands on a scoreboard, by its name."""
    return df.select(*keys, *((F.length(board) - F.length(F.replace(F.col(board), F.lit(c), F.lit("")))).alias(n) for c, n in names.items()))
