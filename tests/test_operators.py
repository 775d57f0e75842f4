"""Small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from opsgrain.functions import predicates as P
from opsgrain.functions import scalars as X
from opsgrain.operators import detect, search, severity, stats, timeseries
from opsgrain.operators.joins import asof_versions
from opsgrain.sources import lines, tables


def test_sigma_bins_and_refit(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (0, 0, 0, 0, 10, 11, 12)], "k string, v double")
    fit = stats.fit(df, ["k"], "v", True).first()
    assert (fit.fit_mean, fit.fit_sd, fit.refitted) == (pytest.approx(33 / 7), pytest.approx(5.9080, abs=1e-3), False)
    one = stats.distribution(spark.createDataFrame([("a", 5.0)], "k string, v double"), ["k"], "v").first()
    assert (one.stddev, one.f2, one.score) == (0.0, 1, 1.0)
    empty = stats.distribution(df.limit(0), ["k"], "v", True)
    assert empty.count() == 0


def test_first_row_has_at_most_half(spark):
    df = spark.createDataFrame([("s", i, f) for i, f in enumerate([True, True, False, True, True, True])], "s string, t int, flag boolean")
    scores = [r.score for r in severity.decayed_score(df, ["s"], "t", "flag").orderBy("t").collect()]
    assert scores == pytest.approx([0.5, 1.0, 3 / 6, 7 / 10, 12 / 15, 13 / 15])


def test_severity_bounds(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.3, 0.5, 0.51, 1.0, 1.1, None)], "x double")
    assert [r[0] for r in df.select(severity.severity_grade(F.col("x"))).collect()] == [100, 100, 30, 20, 1, 1, 100, 100]


def test_exhaustion(spark):
    df = spark.createDataFrame([(1.0, 0.0, 10.0), (1.0, 0.0, 5000.0), (0.0, 0.0, 1.0), (-1.0, 0.0, 1.0), (1.0, 0.0, -1.0), (0.0, 2.0, 9.0)], "v double, a double, room double")
    assert [r[0] for r in df.select(detect.exhaustion_minutes(F.col("v"), F.col("a"), F.col("room"))).collect()] == [10, None, None, None, 0, 3]


def test_line_protocol(spark):
    rows = ["cpu,host=serverA value=1i 1000000000", "# comment", "", 'a\\ b,t=x\\=y f="q \\" r",g=true,h=-2.5e3', "cpu value=", "cpu,host value=1", 'cpu v="open', "m v=9223372036854775808i 1"]
    out = lines.parse_lines(spark.createDataFrame([(r,) for r in rows], "line string")).collect()
    assert len(out) == 6
    assert (out[0].measurement, out[0].tags, out[0].fields["value"].l, out[0].ts.second) == ("cpu", {"host": "serverA"}, 1, 1)
    assert (out[1].measurement, out[1].tags, out[1].fields["f"].s, out[1].fields["g"].b, out[1].fields["h"].d) == ("a b", {"t": "x=y"}, 'q " r', True, -2500.0)
    assert [r.error for r in out[2:]] == ["no line", "no line", "no line", "no value"]


def test_filters_truth_table(spark):
    df = spark.createDataFrame([("foobar",), ("bar",)], "n string")
    flags = lambda c: [r[0] for r in df.select(c).collect()]
    assert flags(P.name_filter(F.col("n"), ["foo*"])) == [True, False]
    assert flags(P.name_filter(F.col("n"), ["foo"], ["foobar"])) == [True, False]
    assert flags(P.name_filter(F.col("n"), (), ["b?r"])) == [True, False]


def test_asof_hides_older_versions(spark):
    df = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, True), (3, 9, True)], "k int, d int, active boolean").withColumn("ts", F.timestamp_seconds("d"))
    assert [r.k for r in asof_versions(df, ["k"], "ts", "1970-01-01 00:00:05", "active").collect()] == [2]


def test_geohash(spark):
    df = spark.createDataFrame([(57.64911, 10.40744)], "lat double, lon double")
    assert df.select(search.geohash(F.col("lat"), F.col("lon"), 7)).first()[0] == "u4pruyd"
    row = search.geohash_grid(df, "lat", "lon", 5).first()
    assert row.south <= 57.64911 < row.north and row.west <= 10.40744 < row.east


def test_sizes_and_addresses(spark):
    df = spark.createDataFrame([("1.2 GB",), ("12",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(X.parse_size(F.col("s"))).collect()] == [1_200_000_000, 12, None, None]
    assert X.cidr_range("10.0.16.77/20") == (167776256, 167780351)
    pair = spark.createDataFrame([("get a b", "get x b"), ("a", "b"), ("a b", "a"), ("u v get  w", "get w"), ("b a", "a c b"), ("x x", "x"), ("", ""), (None, "a")], "x string, y string")
    assert [r[0] for r in pair.select(X.pair_template(F.col("x"), F.col("y"))).collect()] == ["get _ b", None, "a _", "_ get w", "b a", None, None, None]


def test_registry(spark):
    timeseries.register_aggregator("double", lambda df, by, p: df.withColumn("value", F.col("value") * 2))
    points = spark.createDataFrame([("m", {"h": "a"}, 1.5, 10)], "metric string, tags map<string,string>, value double, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = timeseries.query(points, {"start": "1970-01-01", "end": "1970-01-02", "metrics": [{"name": "m", "group_by": [{"name": "tag", "tag": "h"}], "aggregators": [{"name": "double"}]}]})
    assert [(r.g0, r.value) for r in out.collect()] == [("a", 3.0)]
    with pytest.raises(ValueError):
        timeseries.divide(out, ["metric"], {"divisor": 0})


def test_partition_pruning_and_csv(spark, tmp_path):
    df = spark.range(100).withColumn("ts", F.timestamp_seconds(F.col("id") * 7200)).withColumn("text", F.lit('a "q", b'))
    tables.write_by_day(df, str(tmp_path / "t"), "ts")
    got = tables.read_days(spark, str(tmp_path / "t"), "ts", "1970-01-03 00:00:00", "1970-01-04 00:00:00")
    assert got.count() == 12
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().toString()
    tables.write_csv(df.select("text"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, quote='"', escape='"').first()[0] == 'a "q", b'


def test_json_points_and_ids(spark):
    df = spark.createDataFrame([("m", {"b": "2"}, 3, 1.5), ("m", {"b": "2"}, 3, 1.5)], "m string, tags map<string,string>, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    assert df.select(lines.json_datapoint(F.col("m"), F.col("ts"), F.col("v"), F.col("tags"))).first()[0] == '{"name":"m","timestamp":3000,"value":1.5,"tags":{"b":"2"}}'
    assert df.select(X.series_id("m", "s")).distinct().count() == 1 and df.select(X.series_key("m", F.lit(None))).first()[0] == "m:"


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None), (None, 1.0), ("a", 2.0), ("a", 2.0)], "k string, v double")
    by = {r.k: r for r in stats.distribution(df.where("k is not null"), ["k"], "v").collect()}
    assert (by["a"].size, by["a"].mean, by["a"].stddev, by["a"].f2) == (2, 2.0, 0.0, 2)
    assert [r[0] for r in search.terms(df, "k", 5).collect()] == ["a"]
    assert search.histogram(df, "v", 1.0).count() == 2
    assert {r.field: r.missing for r in search.field_summary(df, ["k", "v"]).collect()} == {"k": 1, "v": 1}
    grades = spark.createDataFrame([], "s string, t timestamp, severity int, score double")
    assert severity.quantized_severity(grades, ["s"], "t", 60, 10).count() == 0
    assert severity.severity_runs(grades, ["s"], "t", 60).count() == 0
    assert P.text_query(df, "*").count() == 4 and P.text_query(df, "A").count() == 3


def test_moments_of_large_values(spark):
    df = spark.range(1200).select((F.col("id") / 300).cast("int").alias("batch"), (F.lit(1e9) + F.col("id") % 3).alias("v"), F.lit(None).cast("string").alias("k"))
    row = stats.merge_moments(stats.moments(df, ["k", "batch"], "v"), ["k"]).first()
    assert (row.n, row.var_pop, row.mean) == (1200, pytest.approx(2 / 3, rel=1e-6), 1e9 + 1)
    assert stats.merge_moments(stats.moments(df.limit(0), ["k"], "v"), ["k"]).count() == 0


def test_bins_do_not_depend_on_the_order(spark):
    thirds = [1 / 3 + i / 97 for i in range(9)] * 3
    for values in (thirds, thirds[::-1], sorted(thirds)):
        df = spark.createDataFrame([("a", v) for v in [*values, sum(values) / len(values)]], "k string, v double").coalesce(1)
        row = stats.distribution(df, ["k"], "v", True).first()
        assert [row[f"f{i}"] for i in range(6)] == [0, 6, 6, 10, 6, 0]
    empty = stats.distribution(spark.createDataFrame([("a", None)], "k string, v double"), ["k"], "v", True).first()
    assert (empty.size, empty.f0, empty.mean) == (0, 0, None)


def test_long_and_odd_lines(spark):
    big, quoted = "x" * 1_000_000, '\\"\\\\' * 300_000
    rows = [f'm,t={big} f="{big}" 1', f'm f="{quoted}"', "m a=" + "1i,b=" * 3 + "2", "a\\\\,b=c d=1", "m f=1,f=2i", 'm f="a\\,b"', "m f=1d", "m f=1.5i", "m\\q f=1"]
    out = lines.parse_lines(spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "line string, tags_ int")).orderBy("tags_").collect()
    assert [r.error for r in out] == [None] * 6 + ["no value"] * 2 + [None]
    assert (out[0].tags["t"], out[0].fields["f"].s) == (big, big) and out[1].fields["f"].s == '"\\' * 300_000
    assert (out[2].fields["a"].l, out[2].fields["b"].d) == (1, 2.0)
    assert (out[3].measurement, out[3].tags, out[4].fields["f"].l, out[5].fields["f"].s, out[8].measurement) == ("a\\\\", {"b": "c"}, 2, "a\\,b", "m\\q")


def test_flatten_keeps_longer_arrays(spark):
    df = spark.sql("select struct(array(1) as a, array(1, 2) as b, cast(array() as array<int>) as c, cast(null as array<int>) as d) as s")
    assert P.flatten(df).first().asDict() == {"s.a": 1, "s.a[]": None, "s.b": None, "s.b[]": [1, 2], "s.c": None, "s.c[]": [], "s.d": None, "s.d[]": None}


def test_intervals():
    assert [search.nearest_width(t) for t in (12_000, 400, 14_999, 15_000, 8 * 86_400_000, 1e12)] == [10_000, 100, 10_000, 30_000, 7 * 86_400_000, 365 * 86_400_000]
    assert search.widened(60_000, 3_600_000) == (60_000, 1.0)
    wide, scale = search.widened(1000, 86_400_000)
    assert (wide, scale) == (600_000, 1000 / 600_000)


def test_arrays_count_by_element(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", None],), ([],), (None,)], "t array<string>")
    assert {(r.value, r.n, r.percent, r.missing, r.has) for r in search.field_summary(df, ["t"]).collect()} == {("a", 2, 200 / 3, 1, 3), ("b", 1, 100 / 3, 1, 3)}


def test_days_are_dealt_to_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(200_000, numPartitions=8).select("id", F.timestamp_seconds(F.when(F.col("id") < 190_000, 5).otherwise(F.col("id"))).alias("ts"))
        tables.write_by_day(df, str(tmp_path / "t"), "ts")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t" / "day=1970-01-01").glob("*.parquet"))) > 3
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200_000


def test_rollup_in_steps_equals_one(spark, tmp_path):
    from opsgrain.operators import rank
    from opsgrain.plans import anomaly_queries as Q
    from opsgrain.plans.data_queries import LEVELS
    from opsgrain.plans.inputs import DAY

    rows = Q.filled(spark, "/root/testdata/sf0.001").where("cluster_id < 'cl2'").persist()
    for path, ends in (("one", ["2024-02-01"]), ("steps", ["2024-01-11", "2024-01-18", "2024-02-01", "2024-02-01"])):
        for end in ends:
            rank.roll_up(rows, str(tmp_path / path), "2023-12-28 00:00:00", f"{end} 00:00:00", LEVELS, Q.HOST, "slot", DAY, 7)
    one, steps = (spark.read.parquet(str(tmp_path / p)) for p in ("one", "steps"))
    assert one.count() == steps.count() > 0 and one.exceptAll(steps.select(one.columns)).count() == 0


def test_query_objects(spark):
    """Kinds of query objects on a small table, as text and as objects; unknown fields fit nothing, unknown kinds raise."""
    df = spark.createDataFrame([(1, "red fox", 5.0, None), (2, "Red hen", 7.5, "x"), (3, None, None, "xy"), (4, "blue fox", 9.0, "z")], "id int, text string, n double, tag string")
    fits = lambda q: [r.id for r in P.text_query(df, q).orderBy("id").collect()]
    assert fits({}) == fits("") == fits(" * ") == fits("{}") == fits('{"match_all": {}}') == [1, 2, 3, 4]
    assert fits('{"term": {"tag": "x"}}') == fits({"term": {"tag": {"value": "x"}}}) == [2]
    assert fits({"match": {"text": "hen BLUE"}}) == [2, 4] and fits({"match_phrase": {"text": {"query": "red fox"}}}) == [1]
    assert fits({"range": {"n": {"gt": 5, "lte": 9}}}) == [2, 4] and fits({"prefix": {"tag": "x"}}) == [2, 3] and fits({"wildcard": {"tag": "?y"}}) == [3]
    assert fits({"exists": {"field": "n"}}) == [1, 2, 4] and fits({"missing": {"field": "n"}}) == [3] and fits({"missing": {"field": "no"}}) == [1, 2, 3, 4]
    assert fits({"bool": {"should": [{"term": {"tag": "z"}}, {"term": {"no": 1}}]}}) == [4] and fits({"not": {"term": {"tag": "z"}}}) == [1, 2, 3]
    assert fits({"bool": {"must": {"match": {"text": "fox"}}, "should": [{"term": {"tag": "z"}}], "must_not": [{"range": {"n": {"lt": 1}}}]}}) == [1, 4]
    assert fits({"query_string": {"query": "hen"}}) == fits("HEN") == [2] and fits("{red") == []
    for bad in ({"fuzzy": {"text": "a"}}, {"term": {"a": 1}, "match": {"b": 2}}):
        with pytest.raises(ValueError):
            fits(bad)
