"""Queries against their SQL on rows that the given tables have only at larger sizes."""

import os

import duckdb
import pytest
from pairs import TABLES, same

from opsgrain.functions import scalars as X
from opsgrain.operators import detect, flows
from opsgrain.plans import anomaly_queries, data_queries, search_queries, stream_queries
from opsgrain.streaming import detectors

SF = "/root/testdata/sf0.001"


def tables_with(path, name, sql):
    """The smallest tables, with one of them replaced by the rows of some SQL over it."""
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", f"{path}/{t}.parquet") if t != name else None
    duckdb.connect().execute(f"COPY ({sql.format(table=f"'{SF}/{name}.parquet'")}) TO '{path}/{name}.parquet' (FORMAT parquet)")
    return str(path)


#: Users on both sides of 10.255.255.255 and of 255.255.255.255 by either numbering, one below 10.0.0.0, and one without a number.
USERS = "SELECT * REPLACE ([1499, 62975, 62976, 65535, 65536, 89999, 16121855, 16121856, 16200000, -1, -4000, NULL][event_id % 12 + 1]::BIGINT AS user_id) FROM {table}"


def test_addresses_of_many_users(spark, tmp_path):
    same(spark, search_queries.ip_range_buckets, search_queries.SQL["ip_range_buckets"], tables_with(tmp_path, "events", USERS))


def test_numbers_past_the_last_address(spark, tmp_path):
    same(spark, data_queries.ipv4_functions, data_queries.SQL["ipv4_functions"], tables_with(tmp_path, "events", USERS.replace("NULL", "7")))  # pandas has no boolean column with nulls


def test_dotted_numbers(spark):
    df = spark.createDataFrame([(0,), (4294967295,), (4294967296,), (-1,), (None,)], "v long")
    assert [tuple(r) for r in df.select(X.dotted(df.v), X.long_to_ip(df.v)).collect()] == [
        ("0.0.0.0",) * 2, ("255.255.255.255",) * 2, ("256.0.0.0", None), ("-1.255.255.255", None), (None, None)
    ]


@pytest.mark.parametrize("last", ["23:59:59.2", "23:59:59.3"])
def test_slots_finished_by_the_nearest_millisecond(spark, tmp_path, last):
    # pressed into a minute, the newest event is 556 or 486 microseconds before the end of the last slot, which is 1 or 0 milliseconds
    sql = f"SELECT * REPLACE (CASE WHEN event_id = (SELECT max_by(event_id, ts) FROM {{table}}) THEN TIMESTAMP '2024-01-30 {last}' ELSE ts END AS ts) FROM {{table}}"
    same(spark, stream_queries.stream_slot_stats, stream_queries.SQL["stream_slot_stats"], tables_with(tmp_path, "events", sql))


def test_requests_of_connections_read_the_flows_once(spark):
    plan = data_queries.connection_requests(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and sum("Relation" in line and "l_orderkey#" in line for line in plan.splitlines()) == 1


def test_a_flow_without_requests_counts_for_its_connection(spark):
    kind = "array<struct<req:string,count:long,ttfb:long,ttlb:long>>"
    schema = f"a string, port int, {', '.join(f'{m} long' for m in (*flows.WEIGHTED, *flows.ADDED, *flows.GREATEST))}, requests {kind}, failed {kind}"
    numbers = (10, 20, 30, 1, 2, 3, 4, 5, 6, 7)
    rows = [("x", 1, *numbers, [("GET /1", 3, 5, 9), ("", 1, 90, 90), None], None), ("x", 1, *numbers, None, []), (None, 1, *numbers, None, [("GET /2", 0, 1, 1)])]
    got = {r.a: r for r in flows.connection_rollup(spark.createDataFrame(rows, schema), [["a"]], ["port"], "requests", "failed").collect()}
    assert (got["x"].request_count, got["x"].avg_ttfb, got["x"].max_ttfb, [tuple(r) for r in got["x"].costliest], got["x"].top_errors) == (4, 20.0, 90, [(1, "GET /_", 3, 5.0, 9.0)], None)
    assert (got[None].sent_bytes, got[None].max_ttfb, got[None].costliest, got[None].top_errors) == (3, None, None, None)


def test_flows_do_not_travel_to_the_fits_of_few_groups(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = anomaly_queries.service_peer_stats(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastHashJoin [to_cluster") >= 2


def test_network_measures_sum_the_flows_once(spark):
    df = anomaly_queries.detect_network(spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet [l_orderkey") == 1


def test_network_flags_leave_out_flows_without_a_peer_group_or_time(spark):
    rows = [("a", 1, "t", 1.0), ("b", 1, "t", 1.0), ("c", 1, "t", 9.0), ("a", None, "t", 5.0), ("a", 1, None, 5.0), (None, 1, "t", None)]
    got = detect.network_flags(spark.createDataFrame(rows, "s string, p int, t string, m double"), ["p"], ["s", "p"], "t", [("m", "any", "x")])
    assert sorted(((r.s, r.flag) for r in got.collect()), key=repr) == [("a", True), ("b", True), ("c", True), (None, None)]


def test_samples_do_not_travel_to_the_fits_of_few_series(spark):
    samples = spark.createDataFrame([("c", "a", 1, 1.0), ("c", "a", 1, 2.0), ("c", "b", 1, 40.0)], "c string, h string, slot int, value double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {few: detectors.peer(["c", "h"], ["c"], few=few).rows(samples, samples) for few in (True, False)}
        plans = {few: df._jdf.queryExecution().executedPlan().toString() for few, df in found.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans[True].count("BroadcastHashJoin") >= 2 and not plans[False].count("BroadcastHashJoin")
    assert sorted(map(tuple, found[True].collect())) == sorted(map(tuple, found[False].collect()))
