"""Queries of statistics, severity and detectors, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsgrain.operators import baselines as N
from opsgrain.operators import chunks as K
from opsgrain.operators import detect as D
from opsgrain.operators import severity as V
from opsgrain.operators import stats as S
from opsgrain.plans.inputs import CLUSTER, DAY, DAYS, END, FLOWS_SQL, HOST, NUDGE, START, flows, metrics, metrics_sql, nudged, rounded

CK, HK = ", ".join(CLUSTER), ", ".join(HOST)
PEERS, SERIES = [*CLUSTER, "slot"], [*HOST, "slot"]
BINS = [f"f{i}" for i in range(6)]

# ---------------------------------------------------------------- statistics


def fit_sql(rows: str, keys: str, name: str, refit: bool, value: str = "value") -> str:
    """CTEs ``{name}_fit`` (fit_mean, fit_sd, refitted) and ``{name}`` (the distribution) of rows by keys."""
    k = [x.strip() for x in keys.split(",")]
    using = f"USING ({keys})"
    near = lambda m, s: f"((abs({m}) + {s}) * {S.TOLERANCE})"
    bin_ = lambda m, s: (
        f"CASE WHEN {value} - {m} < -2 * {s} - {near(m, s)} THEN 0 WHEN {value} - {m} < -{s} - {near(m, s)} THEN 1 "
        f"WHEN {value} - {m} < -{near(m, s)} OR ({value} - {m} <= {near(m, s)} AND {s} <= {near(m, s)}) THEN 2 "
        f"WHEN {value} - {m} < {s} - {near(m, s)} THEN 3 WHEN {value} - {m} < 2 * {s} - {near(m, s)} THEN 4 ELSE 5 END"
    )
    first = f"{name}_1 AS (SELECT {keys}, avg({value}) AS m, coalesce(stddev_samp({value}), 0) AS s FROM {rows} GROUP BY {keys})"
    if refit:
        second = f"""{name}_2 AS (SELECT {keys}, {bin_('m', 's')} AS b, avg({value}) AS bm, coalesce(stddev_samp({value}), 0) AS bs, count(*) AS n
          FROM {rows} JOIN {name}_1 {using} GROUP BY {keys}, b),
        {name}_3 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, b) AS rn FROM {name}_2),
        {name}_fit AS (SELECT {', '.join(f'{name}_1.{x} AS {x}' for x in k)}, CASE WHEN b IN (2, 3) THEN m ELSE bm END AS fit_mean, CASE WHEN b IN (2, 3) THEN s ELSE bs END AS fit_sd, b NOT IN (2, 3) AS refitted
          FROM {name}_1 JOIN {name}_3 {using} WHERE rn = 1)"""
    else:
        second = f"{name}_fit AS (SELECT {keys}, m AS fit_mean, s AS fit_sd, false AS refitted FROM {name}_1)"
    counts = ", ".join(f"count(*) FILTER (WHERE b = {i}) AS f{i}" for i in range(6))
    return f"""{first}, {second},
    {name}_4 AS (SELECT r.*, fit_mean, fit_sd, {bin_('fit_mean', 'fit_sd')} AS b FROM {rows} r JOIN {name}_fit {using}),
    {name}_5 AS (SELECT {keys}, count({value}) AS size, min({value}) AS min_val, max({value}) AS max_val, any_value(fit_mean) AS mean, any_value(fit_sd) AS stddev, {counts},
      count(*) FILTER (WHERE {value} >= high_water_mark) / count({value}) AS share, arg_max(event_id, (ts, event_id)) AS last_event FROM {name}_4 GROUP BY {keys}),
    {name} AS (SELECT *, floor((4 * f0 + 2 * f1 + f2 + f3 + 2 * f4 + 4 * f5) / size) AS score FROM {name}_5)"""


def extra():
    return [S.watermark_share(F.col("value"), F.col("high_water_mark")).alias("share"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event")]


DIST = ["size", "min_val", "max_val", "mean", "stddev", *BINS, "score", "share"]
DIST_SQL = "size, round(min_val, 6) AS min_val, round(max_val, 6) AS max_val, round(mean, 6) AS mean, round(stddev, 6) AS stddev, " + ", ".join(BINS) + ", round(score, 6) AS score, round(share, 6) AS share"


def cluster_minute_stats(spark, sf):
    out = S.distribution(metrics(spark, sf, True), PEERS, "value", True, extra())
    return rounded(out.select(*PEERS, *DIST, "last_event", F.greatest("score", "share").alias("final_score")))


def instance_minute_stats(spark, sf):
    rows = metrics(spark, sf, True)
    hosts = S.distribution(rows, SERIES, "value", False, extra())
    peers = S.distribution(rows, PEERS, "value", True)
    out = S.relative_to_peers(hosts, peers, PEERS)
    return rounded(out.select(*SERIES, *DIST, "peer_score", "relative", F.greatest("relative", "share").alias("final_score")))


INSTANCE_SQL = f"WITH {metrics_sql(True)}, {fit_sql('metrics', f'{HK}, slot', 'h', False)}, {fit_sql('metrics', f'{CK}, slot', 'p', True)}, scored AS (SELECT h.*, p.score AS peer_score, CASE WHEN p.score <> 0 THEN (h.score - p.score) / p.score ELSE 0.0 END AS relative FROM h JOIN p USING ({CK}, slot))"


def peer_mean(spark, sf):
    return rounded(S.fit(metrics(spark, sf, True), PEERS, "value", True))


def sigma_histogram(spark, sf):
    return S.distribution(metrics(spark, sf), ["cluster_id", "classification"], "value").select("cluster_id", "classification", "size", *BINS)


def spread_score(spark, sf):
    out = S.distribution(metrics(spark, sf, True), PEERS, "value", True)
    return rounded(out.select(*PEERS, "score", S.spread_score([F.col(b) for b in BINS], F.col("size"), False).alias("ratio")))


def watermark_share(spark, sf):
    return rounded(metrics(spark, sf).groupBy(*SERIES).agg(extra()[0]))


def tag_average(spark, sf):
    return rounded(S.tag_average(metrics(spark, sf), ["cluster_id", "slot"], "tags", ["ts", "event_id"]))


def service_peer_stats(spark, sf):
    names = [m for m in dict.fromkeys(m for m, _, _ in D.NETWORK)]
    long = flows(spark, sf).withColumn("ts", F.date_trunc("year", "ts")).select("to_cluster", "port", "ts", *((F.col(m) + F.col("l_partkey") % 97 / 97.0).alias(m) for m in names)).unpivot(["to_cluster", "port", "ts"], names, "measure", "value")
    out = S.distribution(long, ["to_cluster", "port", "ts", "measure"], "value", True, few=True)  # nations, ports, years and measures
    return rounded(out.select("to_cluster", "port", "ts", "measure", "size", "mean", "stddev", *BINS, "score"), 4)


MEASURES = ", ".join(dict.fromkeys(m for m, _, _ in D.NETWORK))
LONG_SQL = f"long AS (SELECT to_cluster, port, ts, measure, CAST(v AS DOUBLE) AS value, 0.0 AS high_water_mark, 0 AS event_id FROM (SELECT to_cluster, port, CAST(date_trunc('year', ts) AS TIMESTAMP) AS ts, {', '.join(f'{m} + l_partkey % 97 / 97.0 AS {m}' for m in MEASURES.split(', '))} FROM flows) UNPIVOT (v FOR measure IN ({MEASURES})))"


def service_baseline(spark, sf):
    f = flows(spark, sf)
    old = S.moments(f.where("ts < '2000-01-01'"), ["to_cluster", "port"], "avg_rsp_size")
    new = S.moments(f.where("ts >= '2000-01-01'"), ["to_cluster", "port"], "avg_rsp_size")
    return rounded(S.merge_moments(old.unionByName(new), ["to_cluster", "port"]), 3)


def merged_baseline(spark, sf):
    """The distribution of the merged states of three spans of time."""
    f = flows(spark, sf)
    spans = [f.where(c) for c in ("ts < '1996-01-01'", "ts >= '1996-01-01' AND ts < '1998-01-01'", "ts >= '1998-01-01'")]
    states = [N.baseline(df, ["to_cluster", "port"], "avg_ttfb") for df in spans]
    whole = N.merge_baselines(states[0].unionByName(N.merge_baselines(states[1].unionByName(states[2]), ["to_cluster", "port"])), ["to_cluster", "port"])
    return rounded(N.distribution_of(whole, ["to_cluster", "port"]), 4)


TTFB_SQL = "ttfb AS (SELECT to_cluster, port, CAST(avg_ttfb AS DOUBLE) AS value, 0.0 AS high_water_mark, 0 AS event_id, ts FROM flows)"


def running_variance(spark, sf):
    batches = S.moments(metrics(spark, sf), ["host_name", "classification", "slot"], "value")
    return rounded(S.merge_moments(batches, ["host_name", "classification"]), 5)


def relative_delta(spark, sf):
    out = S.relative_delta(metrics(spark, sf), HOST, ["ts", "event_id"], "value", "ts")
    return rounded(out.select("event_id", "delta", "elapsed_ms"))


DELTA_SQL = f"""{metrics_sql()}, lagged AS (SELECT *, lag(value) OVER w AS prev, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000 AS elapsed_ms FROM metrics WINDOW w AS (PARTITION BY {HK} ORDER BY ts, event_id)),
deltas AS (SELECT *, CASE WHEN prev IS NOT NULL THEN CASE WHEN prev <> 0 AND value > prev THEN (value - prev) / prev ELSE 0.0 END END AS delta FROM lagged)"""


def velocity_stats(spark, sf):
    out = S.velocity(S.relative_delta(metrics(spark, sf), HOST, ["ts", "event_id"], "value", "ts"))
    return rounded(out.groupBy("host_name", "classification").agg(F.count("velocity").alias("size"), (F.avg("velocity") * 1e6).alias("mean"), (F.stddev_samp("velocity") * 1e6).alias("stddev"), (F.max("velocity") * 1e6).alias("max_val")), 5)


# ---------------------------------------------------------------- severity


def flagged(spark, sf) -> DataFrame:
    """Series of days with a flag: a value over its mark on that day."""
    return metrics(spark, sf).groupBy(*SERIES).agg(F.max(F.col("value") >= F.col("high_water_mark")).alias("flag"))


FLAGGED = f"{metrics_sql()}, flagged AS (SELECT {HK}, slot, bool_or(value >= high_water_mark) AS flag FROM metrics GROUP BY {HK}, slot)"
GRADE = "CASE WHEN score > 0.5 AND score <= 1 THEN 1 WHEN score > 0.3 AND score <= 0.5 THEN 20 WHEN score > 0.1 AND score <= 0.3 THEN 30 ELSE 100 END"


def graded_sql(rows: str, keys: str, ts: str = "slot", name: str = "graded", soften: bool = False) -> str:
    grade = GRADE.replace("THEN 1 ", "THEN 20 ") if soften else GRADE
    lags = " + ".join(f"greatest(least(rn, 5) - {i}, 0) * coalesce(lag(f, {i}) OVER w, 0)" for i in range(5))
    return f"""{name}_1 AS (SELECT *, CAST(flag AS INTEGER) AS f, row_number() OVER (PARTITION BY {keys} ORDER BY {ts}) AS rn FROM {rows}),
    {name}_2 AS (SELECT *, ({lags}) / CASE WHEN rn = 1 THEN 2 ELSE least(rn, 5) * (least(rn, 5) + 1) / 2 END AS score FROM {name}_1 WINDOW w AS (PARTITION BY {keys} ORDER BY {ts})),
    {name} AS (SELECT *, {grade} AS severity FROM {name}_2)"""


def runs_sql(rows: str, keys: str, ts: str = "slot", name: str = "runs", grain: int = DAY) -> str:
    return f"""{name}_1 AS (SELECT *, CASE WHEN lag(severity) OVER w = severity AND epoch({ts}) - epoch(lag({ts}) OVER w) = {grain} THEN 0 ELSE 1 END AS fresh FROM {rows} WINDOW w AS (PARTITION BY {keys} ORDER BY {ts})),
    {name}_2 AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY {ts}) AS run FROM {name}_1),
    {name} AS (SELECT {keys}, severity, min({ts}) AS start, count(*) AS duration, min(score) AS min_score, avg(score) AS avg_score FROM {name}_2 GROUP BY {keys}, severity, run)"""


def quantized_sql(rows: str, keys: str, single: float, majority: float, replicated: bool, slots: int = DAYS, ts: str = "slot", name: str = "q", grain: int = DAY) -> str:
    enough = f"(total > {majority} * {slots} OR longest >= {single} * {slots})" if replicated else "true"
    return f"""{runs_sql(rows, keys, ts, name + '_r', grain)},
    {name}_3 AS (SELECT {keys}, severity, sum(duration) AS total, max(duration) AS longest FROM {name}_r GROUP BY {keys}, severity),
    {name}_4 AS (SELECT *, severity < 100 AND {enough} AS holds FROM {name}_3),
    {name} AS (SELECT {keys}, coalesce(min(severity) FILTER (WHERE holds), 100) AS severity, CAST(coalesce(arg_min(total, severity) FILTER (WHERE holds), 0) AS BIGINT) AS total_severity_duration,
      CAST(coalesce(arg_min(longest, severity) FILTER (WHERE holds), 0) AS BIGINT) AS single_max_severity_duration, CAST({slots} AS BIGINT) AS total_duration FROM {name}_4 GROUP BY {keys})"""


def graded(spark, sf):
    return D.graded(flagged(spark, sf), HOST, "slot")


def decayed_score(spark, sf):
    return rounded(V.decayed_score(flagged(spark, sf), HOST, "slot", "flag").select(*SERIES, "flag", "score"))


def severity_grade(spark, sf):
    return graded(spark, sf).groupBy("classification", "severity").count().withColumnRenamed("count", "n")


def severity_runs(spark, sf):
    return rounded(V.severity_runs(graded(spark, sf), HOST, "slot", DAY))


def severity_runs_weighted(spark, sf):
    runs = V.severity_runs(graded(spark, sf), HOST, "slot", DAY, "avg")
    # neighbouring runs of one severity arise once warn and info count as one
    joined = runs.withColumn("severity", F.when(F.col("severity").isin(20, 30), 20).otherwise(F.col("severity")))
    return rounded(V.severity_runs(joined, HOST, "start", DAY, "weighted").select(*HOST, "severity", F.col("start"), "duration", "score"))


#: Seconds of the pieces that long series are cut into.
PIECE = 6 * DAY


def chunked_scores(spark, sf):
    make = lambda rows, keys: V.decayed_score(rows, keys, "slot", "flag")
    out = K.look_back(flagged(spark, sf), HOST, ["slot"], "slot", PIECE, V.TRAILING - 1, make)
    return rounded(out.select(*SERIES, "flag", "score"))


def chunked_runs(spark, sf):
    return rounded(K.chunked_runs(graded(spark, sf), HOST, "slot", DAY, PIECE))


def chunked_quantized(spark, sf):
    return K.chunked_quantized(graded(spark, sf), HOST, "slot", DAY, DAYS, PIECE, 0.1, 0.2, True)


def chunked_delta(spark, sf):
    make = lambda rows, keys: S.relative_delta(rows, keys, ["ts", "event_id"], "value", "ts")
    rows = metrics(spark, sf).select("event_id", "ts", "value", *HOST)
    return rounded(K.look_back(rows, HOST, ["ts", "event_id"], "ts", PIECE, 1, make).select("event_id", "delta", "elapsed_ms"))


def unfold_runs(spark, sf):
    return rounded(V.unfold_runs(V.severity_runs(graded(spark, sf), HOST, "slot", DAY), DAY).select(*HOST, "slot", "severity", "score"))


def filled(spark, sf):
    rows = graded(spark, sf).select(*SERIES, "score", "severity")
    return V.gap_fill(rows, metrics(spark, sf), HOST, "slot", START, END, DAY, {"score": 0.0, "severity": 100})


def gap_fill(spark, sf):
    return rounded(filled(spark, sf).select(*SERIES, "score", "severity", "present"))


SPINE = f"spine AS (SELECT * FROM (SELECT DISTINCT {HK} FROM metrics), (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS slot))"
FILLED = f"{FLAGGED}, {graded_sql('flagged', HK)}, {SPINE}, filled AS (SELECT s.*, coalesce(g.score, 0.0) AS score, coalesce(g.severity, 100) AS severity, g.score IS NOT NULL AS present FROM spine s LEFT JOIN graded g USING ({HK}, slot))"


def worst_of_merge(spark, sf):
    return rounded(V.worst_of_merge(filled(spark, sf), ["deployment_id", "cluster_id"], "slot"))


MERGED = f"{FILLED}, merged AS (SELECT deployment_id, cluster_id, slot, min(severity) AS severity, avg(score) FILTER (WHERE severity = w) AS score FROM (SELECT *, min(severity) OVER (PARTITION BY deployment_id, cluster_id, slot) AS w FROM filled) GROUP BY deployment_id, cluster_id, slot)"


def quantized_severity(spark, sf):
    return V.quantized_severity(graded(spark, sf), HOST, "slot", DAY, DAYS, 0.1, 0.2, True)


def requantize_grain(spark, sf):
    return V.requantize(graded(spark, sf), HOST, "slot", DAY, 7, single=0.25, majority=0.5, replicated=False).select(*HOST, "slot", "severity", "total_severity_duration", "single_max_severity_duration")


def severity_grid(spark, sf):
    return filled(spark, sf).select(*SERIES, V.severity_grid(F.col("severity")).alias("heat"))


def quantize_thermals(spark, sf):
    rows = filled(spark, sf)
    a = V.quantize_thermals(rows, ["cluster_id"], "severity").withColumn("replicated", F.lit(False))
    return a.unionByName(V.quantize_thermals(rows, ["cluster_id"], "severity", True).withColumn("replicated", F.lit(True)))


def severity_counts(spark, sf):
    return V.severity_counts(filled(spark, sf), ["deployment_id", "cluster_id", "slot"])


# ---------------------------------------------------------------- detectors

FOUND = ["severity", "total_severity_duration", "single_max_severity_duration", "total_duration", "class_type"]


def detect_sql(ctes: str, keys: str, kind: str, ts: str = "slot", grain: int = DAY, slots: int = DAYS) -> str:
    single, majority = D.MAJORITIES[kind]
    return f"WITH {ctes}, {graded_sql('flags', keys, ts, 'graded', kind == 'non_participation')}, {quantized_sql('graded', keys, single, majority, False, slots, ts, 'q', grain)} SELECT *, '{kind}' AS class_type FROM q WHERE severity < 100"


def detect_threshold(spark, sf):
    return D.detect(flagged(spark, sf), HOST, "slot", "threshold", DAY, DAYS)


def detect_peer(spark, sf):
    rows = metrics(spark, sf, True)
    out = S.relative_to_peers(S.distribution(rows, SERIES, "value"), S.distribution(rows, PEERS, "value", True), PEERS)
    return D.detect(out.select(*SERIES, D.peer_flag(F.col("relative")).alias("flag")), HOST, "slot", "peer", DAY, DAYS)


def detect_error(spark, sf):
    rows = metrics(spark, sf).where(F.col("tags")["key_type"] == "error")
    return D.detect(rows.groupBy(*SERIES).agg((F.avg("value") > 0).alias("flag")), HOST, "slot", "error", DAY, DAYS)


def day_means(spark, sf):
    return metrics(spark, sf).groupBy(*SERIES).agg(F.round(F.avg("value") + NUDGE, 3).alias("mean"), F.max("high_water_mark").alias("high_water_mark"))


DAY_MEANS = f"{metrics_sql()}, means AS (SELECT {HK}, slot, round(avg(value), 3) AS mean, max(high_water_mark) AS high_water_mark FROM metrics GROUP BY {HK}, slot)"
ETA = f"""{DAY_MEANS}, v AS (SELECT *, (epoch(slot) - epoch(lag(slot) OVER w)) / 60 AS minutes, (mean - lag(mean) OVER w) / ((epoch(slot) - epoch(lag(slot) OVER w)) / 60) AS velocity FROM means WINDOW w AS (PARTITION BY {HK} ORDER BY slot)),
a AS (SELECT *, coalesce((velocity - lag(velocity) OVER (PARTITION BY {HK} ORDER BY slot)) / minutes, 0.0) AS acceleration, high_water_mark - mean AS room FROM v),
r AS (SELECT *, velocity / 60 AS vs, acceleration / 7200 AS ac, velocity / 60 * (velocity / 60) + 4 * (acceleration / 7200) * room AS under FROM a),
s AS (SELECT *, CASE WHEN ac = 0 THEN CASE WHEN vs > 0 THEN room / vs END WHEN under >= 0 AND vs + sqrt(greatest(under, 0)) <> 0 THEN 2 * room / (vs + sqrt(greatest(under, 0))) END AS root FROM r),
etas AS (SELECT *, CAST(CASE WHEN room <= 0 THEN 0 WHEN root > 0 AND ceil(root / 60 - 1e-9) <= 43200 THEN ceil(root / 60 - 1e-9) END AS BIGINT) AS eta FROM s)"""


def etas(spark, sf):
    """A horizon of thirty days, since the grain is a day."""
    rows = day_means(spark, sf)
    w = Window.partitionBy(*HOST).orderBy("slot")
    out = D.exhaustion(rows, HOST, "slot")
    out = out.withColumn("eta", D.exhaustion_minutes(F.col("velocity"), F.col("acceleration"), F.col("high_water_mark") - F.col("mean"), 43200))
    return out.withColumn("min_eta", F.min("eta").over(w.rowsBetween(-4, 0)))


def exhaustion_eta(spark, sf):
    return rounded(etas(spark, sf).select(*SERIES, "mean", "eta", "min_eta"))


def detect_exhaustion(spark, sf):
    return D.detect(etas(spark, sf).select(*SERIES, F.col("eta").isNotNull().alias("flag")), HOST, "slot", "exhaustion", DAY, DAYS)


HOSTS = ["customer_id", "deployment_id", "cluster_id", "host_name"]


def hourly(spark, sf):
    return metrics(spark, sf).withColumn("slot", F.date_trunc("hour", "ts"))


#: Entities that are expected and of which nothing is ever seen.
ABSENT = {"customer_id": "c1", "deployment_id": "d0", "cluster_id": "cl0", "host_name": "h99", "classification": "audit"}


def hours_sql(keys: str) -> str:
    """Flags of hours without a row, for entities seen at any time and one that never is."""
    absent = ", ".join(f"'{ABSENT[k]}' AS {k}" for k in keys.split(", "))
    return f"{metrics_sql()}, seen AS (SELECT DISTINCT {keys}, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS slot FROM metrics), expected AS (SELECT * FROM (SELECT DISTINCT {keys} FROM metrics UNION SELECT {absent}), (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS slot)), flags AS (SELECT e.*, s.slot IS NULL AS flag FROM expected e LEFT JOIN seen s USING ({keys}, slot))"


def presence(spark, sf, keys, kind):
    rows = hourly(spark, sf)
    expected = rows.select(*keys).unionByName(spark.range(1).select(*(F.lit(ABSENT[k]).alias(k) for k in keys))).distinct()
    flags = D.absent_flags(rows, expected, keys, "slot", START, END, 3600).select(*keys, "slot", "flag")
    return D.detect(flags, keys, "slot", kind, 3600, DAYS * 24)


def detect_heartbeat(spark, sf):
    return presence(spark, sf, HOSTS, "heartbeat")


def detect_service(spark, sf):
    return presence(spark, sf, [*HOSTS, "classification"], "service")


def detect_non_participation(spark, sf):
    return presence(spark, sf, ["cluster_id", "classification"], "non_participation")


NET_KEYS = ["to_cluster", "port", "measure", "mode", "sub_type"]


def detect_network(spark, sf):
    f = flows(spark, sf).groupBy("to_cluster", "port", "ts").agg(*(F.avg(m).alias(m) for m in dict.fromkeys(m for m, _, _ in D.NETWORK)))
    flags = D.network_flags(f, ["port"], ["to_cluster", "port"], "ts")
    # months are slots: the nth month is the nth day
    month = F.timestamp_seconds((F.year("ts") * 12 + F.month("ts")).cast("long") * DAY)
    return D.detect(flags.withColumn("ts", month), NET_KEYS, "ts", "network", DAY, 120)


_modes = ", ".join(f"('{m}', '{k}', '{t}')" for m, k, t in D.NETWORK)
NETWORK_SQL = f"""{FLOWS_SQL}, g AS (SELECT to_cluster, port, ts, {', '.join(f'avg({m}) AS {m}' for m in MEASURES.split(', '))} FROM flows GROUP BY to_cluster, port, ts),
long AS (SELECT * FROM g UNPIVOT (value FOR measure IN ({MEASURES}))), band AS (SELECT port, ts, measure, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM long GROUP BY port, ts, measure),
modes(measure, mode, sub_type) AS (VALUES {_modes}),
flags AS (SELECT to_cluster, port, make_timestamp(CAST(year(ts) * 12 + month(ts) AS BIGINT) * 86400000000) AS ts, measure, mode, sub_type, CASE mode WHEN 'high' THEN value > m + 2 * s WHEN 'low' THEN value < m - 2 * s ELSE value > 0 END AS flag FROM long JOIN band USING (port, ts, measure) JOIN modes USING (measure))"""


def anomaly_message(spark, sf):
    q = V.quantized_severity(graded(spark, sf), HOST, "slot", DAY, DAYS, replicated=False)
    text = D.anomaly_message(F.col("severity"), F.col("classification"), F.col("total_severity_duration"), F.col("single_max_severity_duration"), F.col("total_duration"), F.lit(True))
    return q.select(*HOST, text.alias("message"))


QUERIES = {f.__name__: f for f in (
    cluster_minute_stats, instance_minute_stats, peer_mean, sigma_histogram, spread_score, watermark_share, tag_average, service_peer_stats, service_baseline, merged_baseline,
    running_variance, relative_delta, velocity_stats, decayed_score, severity_grade, severity_runs, severity_runs_weighted, chunked_scores, chunked_runs, chunked_quantized, chunked_delta, unfold_runs, gap_fill, worst_of_merge,
    quantized_severity, requantize_grain, severity_grid, quantize_thermals, severity_counts, detect_threshold, detect_peer, detect_error, exhaustion_eta,
    detect_exhaustion, detect_heartbeat, detect_service, detect_non_participation, detect_network, anomaly_message,
)}

_moments = lambda rows, keys, x, d: f"SELECT {keys}, count({x}) AS n, round(avg({x}), {d}) AS mean, round(var_pop({x}), {d}) AS var_pop, round(var_samp({x}), {d}) AS var_samp, round(stddev_pop({x}), {d}) AS stddev_pop FROM {rows} GROUP BY {keys}"
GRADED = f"{FLAGGED}, {graded_sql('flagged', HK)}"
SQL = {
    "cluster_minute_stats": f"WITH {metrics_sql(True)}, {fit_sql('metrics', f'{CK}, slot', 'p', True)} SELECT {CK}, slot, {DIST_SQL}, last_event, round(greatest(score, share), 6) AS final_score FROM p",
    "instance_minute_stats": f"{INSTANCE_SQL} SELECT {HK}, slot, {DIST_SQL}, peer_score, round(relative, 6) AS relative, round(greatest(relative, share), 6) AS final_score FROM scored",
    "peer_mean": f"WITH {metrics_sql(True)}, {fit_sql('metrics', f'{CK}, slot', 'p', True)} SELECT {CK}, slot, round(fit_mean, 6) AS fit_mean, round(fit_sd, 6) AS fit_sd, refitted FROM p_fit",
    "sigma_histogram": f"WITH {metrics_sql()}, {fit_sql('metrics', 'cluster_id, classification', 'p', False)} SELECT cluster_id, classification, size, {', '.join(BINS)} FROM p",
    "spread_score": f"WITH {metrics_sql(True)}, {fit_sql('metrics', f'{CK}, slot', 'p', True)} SELECT {CK}, slot, round(score, 6) AS score, round((4 * f0 + 2 * f1 + f2 + f3 + 2 * f4 + 4 * f5) / size, 6) AS ratio FROM p",
    "watermark_share": f"WITH {metrics_sql()} SELECT {HK}, slot, round(count(*) FILTER (WHERE value >= high_water_mark) / count(value), 6) AS share FROM metrics GROUP BY {HK}, slot",
    "tag_average": f"""WITH {metrics_sql()}, n AS (SELECT cluster_id, slot, count(*) AS n, sum(k) AS k, count(*) FILTER (WHERE classification = 'error') AS e FROM metrics GROUP BY cluster_id, slot)
      SELECT cluster_id, slot, 'k' AS tag, round(k / n, 6) AS avg_value, CAST(NULL AS VARCHAR) AS last_text FROM n UNION ALL SELECT cluster_id, slot, 'high_water_mark', 100.0, NULL FROM n UNION ALL SELECT cluster_id, slot, 'key_type', NULL, 'error' FROM n WHERE e > 0""",
    "service_peer_stats": f"WITH {FLOWS_SQL}, {LONG_SQL}, {fit_sql('long', 'to_cluster, port, ts, measure', 'p', True)} SELECT to_cluster, port, ts, measure, size, round(mean, 4) AS mean, round(stddev, 4) AS stddev, {', '.join(BINS)}, round(score, 4) AS score FROM p",
    "service_baseline": f"WITH {FLOWS_SQL} {_moments('flows', 'to_cluster, port', 'avg_rsp_size', 3)}",
    "merged_baseline": f"WITH {FLOWS_SQL}, {TTFB_SQL}, {fit_sql('ttfb', 'to_cluster, port', 'p', True)} SELECT to_cluster, port, size, round(min_val, 4) AS min_val, round(max_val, 4) AS max_val, round(mean, 4) AS mean, round(stddev, 4) AS stddev, {', '.join(BINS)}, round(score, 4) AS score FROM p",
    "running_variance": f"WITH {metrics_sql()} {_moments('metrics', 'host_name, classification', 'value', 5)}",
    "relative_delta": f"WITH {DELTA_SQL} SELECT event_id, round(delta, 6) AS delta, round(elapsed_ms, 6) AS elapsed_ms FROM deltas",
    "velocity_stats": f"WITH {DELTA_SQL}, v AS (SELECT *, delta / CASE WHEN elapsed_ms = 0 THEN 0.001 ELSE elapsed_ms END AS velocity FROM deltas) SELECT host_name, classification, count(velocity) AS size, round(avg(velocity) * 1e6, 5) AS mean, round(stddev_samp(velocity) * 1e6, 5) AS stddev, round(max(velocity) * 1e6, 5) AS max_val FROM v GROUP BY 1, 2",
    "decayed_score": f"WITH {GRADED} SELECT {HK}, slot, flag, round(score, 6) AS score FROM graded",
    "severity_grade": f"WITH {GRADED} SELECT classification, severity, count(*) AS n FROM graded GROUP BY 1, 2",
    "severity_runs": f"WITH {GRADED}, {runs_sql('graded', HK)} SELECT {HK}, severity, start, duration, round(min_score, 6) AS score FROM runs",
    "severity_runs_weighted": f"""WITH {GRADED}, {runs_sql('graded', HK)}, j AS (SELECT * REPLACE (CASE WHEN severity IN (20, 30) THEN 20 ELSE severity END AS severity) FROM runs),
      j1 AS (SELECT *, CASE WHEN lag(severity) OVER w = severity AND lag(epoch(start) + duration * {DAY}) OVER w = epoch(start) THEN 0 ELSE 1 END AS fresh FROM j WINDOW w AS (PARTITION BY {HK} ORDER BY start)),
      j2 AS (SELECT *, sum(fresh) OVER (PARTITION BY {HK} ORDER BY start) AS run FROM j1)
      SELECT {HK}, severity, min(start) AS start, CAST(sum(duration) AS BIGINT) AS duration, round(sum(avg_score * duration) / sum(duration), 6) AS score FROM j2 GROUP BY {HK}, severity, run""",
    "unfold_runs": f"WITH {GRADED}, {runs_sql('graded', HK)} SELECT {HK}, start + CAST(i AS INTEGER) * INTERVAL 1 DAY AS slot, severity, round(min_score, 6) AS score FROM (SELECT *, unnest(range(duration)) AS i FROM runs)",
    "gap_fill": f"WITH {FILLED} SELECT {HK}, slot, round(score, 6) AS score, severity, present FROM filled",
    "worst_of_merge": f"WITH {MERGED} SELECT deployment_id, cluster_id, slot, severity, round(score, 6) AS score FROM merged",
    "quantized_severity": f"WITH {GRADED}, {quantized_sql('graded', HK, 0.1, 0.2, True)} SELECT * FROM q",
    "requantize_grain": f"WITH {GRADED}, c AS (SELECT * EXCLUDE (slot), slot AS d, make_timestamp(CAST(floor(epoch(slot) / {7 * DAY}) * {7 * DAY} AS BIGINT) * 1000000) AS wide FROM graded), {quantized_sql('c', f'{HK}, wide', 0.25, 0.5, False, 7, 'd')} SELECT {HK}, wide AS slot, severity, total_severity_duration, single_max_severity_duration FROM q WHERE severity < 100",
    "severity_grid": f"WITH {FILLED}, l AS (SELECT *, CASE severity WHEN 1 THEN 3 WHEN 20 THEN 2 WHEN 30 THEN 1 ELSE 0 END AS level FROM filled) SELECT {HK}, slot, CAST(level + round((4 - level) * score) AS INTEGER) AS heat FROM l",
    "quantize_thermals": f"""WITH {FILLED}, c AS (SELECT cluster_id, count(*) AS n, count(*) FILTER (WHERE severity = 1) AS a, count(*) FILTER (WHERE severity = 20) AS b, count(*) FILTER (WHERE severity = 30) AS c FROM filled GROUP BY 1)
      SELECT cluster_id, CASE WHEN a > t THEN 1 WHEN b > t THEN 20 WHEN c > t THEN 30 ELSE 100 END AS thermal, n AS slots, replicated FROM (SELECT *, 0.0 AS t, false AS replicated FROM c UNION ALL SELECT *, 0.5 * n, true FROM c)""",
    "severity_counts": f"WITH {FILLED} SELECT deployment_id, cluster_id, slot, " + ", ".join(f"count(*) FILTER (WHERE severity = {g}) AS n_{g}" for g in (1, 20, 30, 100)) + " FROM filled GROUP BY 1, 2, 3",
    "detect_threshold": detect_sql(FLAGGED + ", flags AS (SELECT * FROM flagged)", HK, "threshold"),
    "detect_peer": detect_sql(INSTANCE_SQL.removeprefix("WITH ") + f", flags AS (SELECT {HK}, slot, relative <> 0 AS flag FROM scored)", HK, "peer"),
    "detect_error": detect_sql(f"{metrics_sql()}, flags AS (SELECT {HK}, slot, avg(value) > 0 AS flag FROM metrics WHERE classification = 'error' GROUP BY {HK}, slot)", HK, "error"),
    "exhaustion_eta": f"WITH {ETA} SELECT {HK}, slot, round(mean, 6) AS mean, eta, min(eta) OVER (PARTITION BY {HK} ORDER BY slot ROWS 4 PRECEDING) AS min_eta FROM etas",
    "detect_exhaustion": detect_sql(f"{ETA}, flags AS (SELECT {HK}, slot, eta IS NOT NULL AS flag FROM etas)", HK, "exhaustion"),
    "detect_heartbeat": detect_sql(hours_sql(", ".join(HOSTS)), ", ".join(HOSTS), "heartbeat", grain=3600, slots=720),
    "detect_service": detect_sql(hours_sql(", ".join([*HOSTS, "classification"])), ", ".join([*HOSTS, "classification"]), "service", grain=3600, slots=720),
    "detect_non_participation": detect_sql(hours_sql("cluster_id, classification"), "cluster_id, classification", "non_participation", grain=3600, slots=720),
    "detect_network": detect_sql(NETWORK_SQL, ", ".join(NET_KEYS), "network", "ts", DAY, 120),
    "anomaly_message": f"""WITH {GRADED}, {quantized_sql('graded', HK, 0.25, 0.5, False)} SELECT {HK}, CASE WHEN severity = 100 THEN 'Healthy' ELSE
      CASE severity WHEN 1 THEN 'Critical' WHEN 20 THEN 'Warning' ELSE 'Notice' END || ': ' || classification || ' ' || CASE WHEN total_severity_duration = total_duration THEN 'throughout'
      WHEN single_max_severity_duration = total_severity_duration THEN 'once, for ' || total_severity_duration || ' of ' || total_duration || ' slots'
      ELSE 'for ' || total_severity_duration || ' of ' || total_duration || ' slots, at most ' || single_max_severity_duration || ' in a row' END || ' (redundant)' END AS message FROM q""",
}
SQL |= {"chunked_scores": SQL["decayed_score"], "chunked_runs": SQL["severity_runs"], "chunked_quantized": SQL["quantized_severity"], "chunked_delta": SQL["relative_delta"]}
SQL = {name: nudged(sql) for name, sql in SQL.items()}
