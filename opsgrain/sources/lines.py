"""Text formats of points, status pages and logs, parsed and written by column functions alone.

The line protocol: ``name,tag=v,... field=1i,f=2.0,s="text" time``. A backslash escapes comma, equals and space in
names, tags and keys, and quote and backslash in quoted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsgrain.functions.scalars import escape

#: Microseconds, as a fraction, of a unit of time.
PRECISION = {"n": 1e-3, "u": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}
SIGNS = ",= "
#: Code points that no text holds: they stand for a backslash and one of these signs while a line is taken apart, and
#: the last between the line's parts.
_PAIRED, _HELD, _CUT = ',= "\\', "﷐﷑﷒﷓﷔", "﷕"
# no alternation within a repeat and nothing to go back to, so that a field of any length takes no stack
_KEY = "[^,= ]++"
_VALUE = '(?:"[^"]*+"|[^,= "]++)'
_LINE = rf"^([^, ]++)((?:,{_KEY}={_KEY})*+) ++({_KEY}={_VALUE}(?:,{_KEY}={_VALUE})*+)(?: ++(-?[0-9]++))?+\s*+$"


def _hold(text: Column) -> Column:
    """The text with each backslash and the sign it escapes as one code point."""
    out = F.replace(text, F.lit("\\\\"), F.lit(_HELD[4]))  # from the left, as pairs are read
    for sign, held in zip(_PAIRED[:4], _HELD, strict=False):
        out = F.replace(out, F.lit("\\" + sign), F.lit(held))
    return F.when(F.contains(text, F.lit("\\")), out).otherwise(text)


def _let_go(text: Column, escaped: Column, signs: str) -> Column:
    """Held pairs as what they mean: the sign alone for ``signs``, else both as they stood."""
    own = "".join(h for s, h in zip(_PAIRED, _HELD, strict=True) if s in signs)
    out = F.translate(text, own, "".join(s for s in _PAIRED if s in signs))
    for sign, held in zip(_PAIRED, _HELD, strict=True):
        if sign not in signs:
            out = F.replace(out, F.lit(held), F.lit("\\" + sign))
    return F.when(escaped, out).otherwise(text)


def _pairs(text: Column, value: str) -> Column:
    """Keys and values of a part, still held, one match for each pair."""
    key = lambda p: F.substring_index(p, "=", 1)
    found = F.regexp_extract_all(text, F.lit(f"{_KEY}={value}"), F.lit(0))
    return F.transform(found, lambda p: F.struct(key(p).alias("k"), F.substring(p, F.length(key(p)) + 2, F.length(p)).alias("v")))


def _field(v: Column, escaped: Column) -> Column:
    quoted = v.startswith('"')
    whole = ~quoted & v.endswith("i")
    word = F.when(v.isin("t", "T", "true", "True", "TRUE"), True).when(v.isin("f", "F", "false", "False", "FALSE"), False)
    number = F.when(~v.endswith("d") & ~v.endswith("D") & ~v.endswith("f") & ~v.endswith("F"), v.try_cast("double"))
    return F.struct(
        F.when(~quoted & ~whole & word.isNull(), number).alias("d"), F.when(whole, F.substring(v, F.lit(1), F.length(v) - 1).try_cast("long")).alias("l"),
        F.when(~quoted, word).alias("b"), F.when(quoted, _let_go(F.substring(v, F.lit(2), F.length(v) - 2), escaped, '"\\')).alias("s"),
    )


def _last(pairs: Column) -> Column:
    """A map of pairs; of repeated keys the last counts."""
    keys = F.transform(pairs, lambda p: p["key"])
    once = F.aggregate(pairs, F.slice(pairs, 1, 0), lambda acc, p: F.concat(F.filter(acc, lambda q: q["key"] != p["key"]), F.array(p)))
    return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), pairs).otherwise(once))


def parse_lines(df: DataFrame, line: str = "line", precision: str = "n", default_time: Column | None = None) -> DataFrame:
    """Points of line-protocol rows: measurement, tags, fields, ts, error and the columns of ``df``.

    Blank lines and comments go. A line that is none, or with a field that is no value, has an error and nulls, and
    the others are not touched. Of repeated keys the last counts. A line is matched once, whatever its length. A
    backslash before another sign than comma, equals, space, quote and backslash is itself.
    """
    text = F.trim(F.col(line))
    out = df.where((text != "") & ~text.startswith("#")).withColumn("_text", _hold(text)).withColumn("_esc", F.contains(F.col(line), F.lit("\\")))
    out = out.withColumn("_part", F.split(F.regexp_replace("_text", _LINE, _CUT.join(f"${i}" for i in range(1, 5))), _CUT)).drop("_text")
    ok, escaped, part = F.size("_part") == 4, F.col("_esc"), lambda i: F.get("_part", F.lit(i))
    name = lambda c: _let_go(c, escaped, SIGNS)
    fields = F.transform(_pairs(part(2), _VALUE), lambda p: F.struct(name(p["k"]).alias("key"), _field(p["v"], escaped).alias("value")))
    tags = F.transform(_pairs(part(1), _KEY), lambda p: F.struct(name(p["k"]).alias("key"), name(p["v"]).alias("value")))
    time = F.when(part(3) != "", F.timestamp_micros((part(3).cast("decimal(20,0)") * F.lit(PRECISION[precision]).cast("decimal(20,3)")).cast("long")))
    empty = lambda v: v["d"].isNull() & v["l"].isNull() & v["b"].isNull() & v["s"].isNull()
    out = out.withColumns({"_fields": F.when(ok, fields), "_tags": F.when(ok, tags), "_ok": ok})
    good = F.col("_ok") & ~F.coalesce(F.exists("_fields", lambda p: empty(p["value"])), F.lit(True))
    out = out.withColumn("_good", good)
    good = F.col("_good")
    return out.select(
        *df.columns, F.when(good, name(part(0))).alias("measurement"), F.when(good, _last(F.col("_tags"))).alias("tags"),
        F.when(good, _last(F.col("_fields"))).alias("fields"), F.when(good, F.coalesce(time, default_time if default_time is not None else F.lit(None).cast("timestamp"))).alias("ts"),
        F.when(~F.col("_ok"), "no line").when(~good, "no value").alias("error"),
    )


def format_lines(measurement: Column, tags: Column, fields: Column, ts: Column, precision: str = "n") -> Column:
    """Line-protocol text of a point, tags and fields sorted by key, empty tags left out, times cut to the precision."""
    pair = lambda e: F.concat(escape(e["key"], SIGNS), F.lit("="), escape(e["value"], SIGNS))

    def value(v: Column) -> Column:
        text = F.concat(F.lit('"'), escape(v["s"], '"\\'), F.lit('"'))
        return F.coalesce(F.concat(v["l"].cast("string"), F.lit("i")), v["d"].cast("string"), v["b"].cast("string"), text)

    tag = F.transform(F.array_sort(F.filter(F.map_entries(tags), lambda e: e["value"] != "")), pair)
    field = F.transform(F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("key"), value(e["value"]).alias("text")))), lambda e: F.concat(escape(e["key"], SIGNS), F.lit("="), e["text"]))
    time = F.unix_micros(ts) * 1000 if precision == "n" else F.floor(F.unix_micros(ts) / F.lit(PRECISION[precision])).cast("long")
    return F.concat_ws(" ", F.concat_ws(",", escape(measurement, ", "), tag), F.array_join(field, ","), time.cast("string"))


#: Keys of wire lines that are columns, not tags.
WIRE = ("plugin", "host", "cluster_id", "deployment_id", "customer_id", "ts", "replace_ts", "svc_name", "binding")


def parse_wire(df: DataFrame, line: str = "line") -> DataFrame:
    """Samples of wire lines ``plugin=cpu.usage,host=name:ip,...,ts=ms,value=...``; the value comes last and may hold commas.

    The part of plugin after the first dot is the classification; the target is the binding of network graphs, the
    service name of processes, else ``*``. Other keys are tags. Lines without plugin, ts or value have an error.
    """
    at = F.instr(line, "value=")
    heads = F.str_to_map(F.when(at > 1, F.substring(F.col(line), F.lit(1), at - 2)).otherwise(""), F.lit(","), F.lit("="))
    raw = F.when(at > 0, F.substring(F.col(line), at + 6, F.length(line)))
    number = F.regexp_replace(raw, r"^([-+]?[0-9]+)i$", "$1").try_cast("double")
    out = df.withColumn("_h", heads).withColumn("_raw", raw)
    plugin, host = F.split("_h.plugin", r"\.", 2), F.split("_h.host", ":")
    ms = F.col("_h.ts").try_cast("long")
    ts = F.timestamp_millis(ms)
    kind = F.get(plugin, F.lit(0))
    good = kind.isNotNull() & ms.isNotNull() & F.col("_raw").isNotNull()
    return out.select(
        *df.columns, F.when(kind == "log", "LOG").otherwise("SYSTEM").alias("rectype"), kind.alias("plugin"), F.get(plugin, F.lit(1)).alias("classification"),
        F.when(kind == "nwgraph", F.col("_h.binding")).when(kind == "procstat", F.col("_h.svc_name")).otherwise("*").alias("target"),
        F.get(host, F.lit(0)).alias("host_name"), F.get(host, F.lit(1)).alias("host_ip"), *(F.col(f"_h.{k}").alias(k) for k in ("cluster_id", "deployment_id", "customer_id")),
        F.coalesce(number, F.lit(0.0)).alias("value"), F.regexp_replace("_raw", r'^"(.*)"$', "$1").alias("value_str"), number.isNull().alias("is_non_numeric"),
        F.date_trunc("minute", F.coalesce(F.timestamp_millis(F.col("_h.replace_ts").try_cast("long")), ts)).alias("slot"), ts.alias("ts"),
        F.map_filter("_h", lambda k, v: ~k.isin(*WIRE)).alias("tags"), F.when(~good, "no sample").alias("error"),
    )


def put_line(metric: Column, ts: Column, value: Column, tags: Column) -> Column:
    """``put metric ms value k=v ...``, tags sorted."""
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws(" ", F.lit("put"), metric, F.unix_millis(ts).cast("string"), value.cast("string"), F.array_join(pairs, " "))


def json_datapoint(metric: Column, ts: Column, value: Column, tags: Column) -> Column:
    """The same as a JSON object."""
    return F.to_json(F.struct(metric.alias("name"), F.unix_millis(ts).alias("timestamp"), value.alias("value"), tags.alias("tags")))


def routed(df: DataFrame, tags: Column, line: Column, key: str = "host") -> DataFrame:
    """``key, value`` records for a keyed sink: routed by a tag."""
    return df.select(tags[key].alias("key"), line.alias("value"))


def csv_status(df: DataFrame, ids: list[str], text: str, names: list[str]) -> DataFrame:
    """Metrics of comma-separated status rows: ids, metric, value; what is no number is left out."""
    parts = F.split(F.col(text), ",")
    wide = df.select(*ids, *(F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)))
    return wide.unpivot(ids, names, "metric", "value").where("value is not null")


def json_metrics(df: DataFrame, ids: list[str], text: str, schema: T.StructType) -> DataFrame:
    """Numeric leaves of a JSON status as metrics with joined names; arrays, texts and nulls are left out."""

    def leaves(s: T.StructType, path: str, name: str):
        for f in s:
            full = f"{name}_{f.name}" if name else f.name
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, f"{path}.`{f.name}`", full)
            elif isinstance(f.dataType, T.NumericType):
                yield F.col(f"{path}.`{f.name}`").cast("double").alias(full)

    wide = df.select(*ids, F.from_json(text, schema).alias("_j"))
    columns = list(leaves(schema, "_j", ""))
    flat = wide.select(*ids, *columns)
    return flat.unpivot(ids, [c for c in flat.columns if c not in ids], "metric", "value").where("value is not null")


def key_value_text(df: DataFrame, ids: list[str], text: str, separator: str = ":") -> DataFrame:
    """Metrics of ``key: value`` lines; a value like ``a=1,b=2`` gives ``key.a`` and ``key.b``; comments go."""
    lines = df.select(*ids, F.explode(F.split(text, r"\r?\n")).alias("_l")).where(~F.col("_l").startswith("#") & F.contains("_l", F.lit(separator)))
    pair = F.split("_l", separator, 2)
    rows = lines.select(*ids, F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("_v"))
    inner = F.transform(F.split("_v", ","), lambda p: F.struct(F.concat("key", F.lit("."), F.trim(F.split_part(p, F.lit("="), F.lit(1)))).alias("k"), F.split_part(p, F.lit("="), F.lit(2)).alias("v")))
    each = F.when(F.contains("_v", F.lit("=")), inner).otherwise(F.array(F.struct(F.col("key").alias("k"), F.col("_v").alias("v"))))
    return rows.select(*ids, F.explode(each).alias("_e")).select(*ids, F.col("_e.k").alias("metric"), F.col("_e.v").try_cast("double").alias("value"), F.when(F.col("_e.v").try_cast("double").isNull(), F.col("_e.v")).alias("text"))


_ACCESS = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "(?:(\S+) (\S+)(?: HTTP/([0-9.]+))?|[^"]*)" ([0-9]{3}) (?:([0-9]+)|-)(?: "([^"]*)" "([^"]*)")?'
_ERROR = r"^\[(?:\w{3} )?([^\]]+)\] \[(?:\w*:)?(\w+)\](?: \[pid [^\]]*\])?(?: \[client ([^\]]+)\])? (.*)$"


def parse_access_log(df: DataFrame, line: str = "line", kind: str = "type") -> DataFrame:
    """Access and error logs, told apart by ``kind``: fields, time, and whether the line matched."""
    access, error = F.col(kind) == "access", F.col(kind) == "error"
    a = lambda i: F.when(access, F.nullif(F.regexp_extract(line, _ACCESS, i), F.lit("")))
    e = lambda i: F.when(error, F.nullif(F.regexp_extract(line, _ERROR, i), F.lit("")))
    return df.select(
        *df.columns, F.coalesce(a(1), F.regexp_replace(e(3), ":[0-9]+$", "")).alias("client"), a(3).alias("user"), a(5).alias("verb"), a(6).alias("request"), a(7).alias("http"),
        a(8).cast("int").alias("response"), a(9).cast("long").alias("bytes"), a(10).alias("referrer"), a(11).alias("agent"), e(2).alias("level"), e(4).alias("message"),
        F.coalesce(F.try_to_timestamp(a(4), F.lit("dd/MMM/yyyy:HH:mm:ss Z")), F.try_to_timestamp(e(1), F.lit("MMM dd HH:mm:ss yyyy"))).alias("ts"),
        F.when(access, F.col(line).rlike(_ACCESS)).when(error, F.col(line).rlike(_ERROR)).otherwise(False).alias("matched"),
    )
