"""Filters and projections: names, tags, search predicates, time ranges, sanitising, formatting."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def glob_regex(pattern: str) -> str:
    """A glob with ``*`` and ``?`` as a regular expression for the whole text."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def name_filter(name: Column, passing: Sequence[str] = (), dropping: Sequence[str] = ()) -> Column:
    """Whether a measurement passes: by prefix or glob; where ``passing`` is given it alone decides."""
    hit = lambda ps: _any([name.startswith(p) | name.rlike(glob_regex(p)) for p in ps])
    return hit(passing) if passing else ~hit(dropping)


def tag_filter(tags: Column, passing: dict[str, Sequence[str]] | None = None, dropping: dict[str, Sequence[str]] | None = None) -> Column:
    """Whether a point's tags pass, by globs on their values; where ``passing`` is given it alone decides."""
    hit = lambda spec: _any([F.coalesce(tags[k].rlike(glob_regex(p)), F.lit(False)) for k, ps in spec.items() for p in ps])
    return hit(passing) if passing else ~hit(dropping or {})


def sanitize(df: DataFrame, name: str, value: str, ts: str, tags: str, prefix: str = "", defaults: dict[str, str] | None = None) -> DataFrame:
    """Drops points with NaN or infinite values, clamps to a signed long, cuts times to ms, prefixes names, and adds
    default tags that a point lacks."""
    out = df.where(F.col(value).isNull() | ~(F.isnan(value) | (F.abs(value) == float("inf"))))
    default = F.create_map(*[F.lit(x) for kv in (defaults or {}).items() for x in kv]).cast("map<string,string>") if defaults else F.create_map().cast("map<string,string>")
    merged = F.map_zip_with(default, F.col(tags), lambda k, a, b: F.coalesce(b, a))
    return out.withColumns({
        value: F.least(F.col(value), F.lit(float(2**63 - 1))), ts: F.date_trunc("millisecond", F.col(ts)), name: F.concat(F.lit(prefix), F.col(name)), tags: merged,
    })


def minute_slot(ts: Column, replace: Column | None = None) -> Column:
    """The minute of a time, or of what replaces it."""
    return F.date_trunc("minute", F.coalesce(replace, ts) if replace is not None else ts)


def typed_value(text: Column) -> tuple[Column, Column, Column]:
    """Number (0 where it is none), unquoted text, and whether the value is not a number; ``12i`` is one."""
    number = F.regexp_replace(text, r"^([-+]?[0-9]+)i$", "$1").try_cast("double")
    return F.coalesce(number, F.lit(0.0)), F.regexp_replace(text, r'^"(.*)"$', "$1"), number.isNull()


# search predicates; each is false, not null, where a field is missing


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def phrase(field: Column, value) -> Column:
    return _sure(field == F.lit(value))


def in_range(field: Column, gt=None, gte=None, lt=None, lte=None) -> Column:
    """Within bounds; infinite ones do not count, and without any every row fits."""
    sides = [(gt, lambda v: field > v), (gte, lambda v: field >= v), (lt, lambda v: field < v), (lte, lambda v: field <= v)]
    tests = [f(F.lit(v)) for v, f in sides if v is not None and v not in (float("inf"), float("-inf"))]
    return _sure(reduce(lambda a, b: a & b, tests)) if tests else F.lit(True)


def any_of(field: Column, values: Sequence) -> Column:
    return _sure(field.isin(list(values)))


def in_box(lat: Column, lon: Column, top: float, left: float, bottom: float, right: float) -> Column:
    """Within a box of coordinates; one with left over right crosses the date line."""
    across = (lon >= left) & (lon <= right) if left <= right else (lon >= left) | (lon <= right)
    return _sure((lat <= top) & (lat >= bottom) & across)


def all_filters(filters: Sequence[dict]) -> Column:
    """The conjunction of enabled filters ``{"test": column, "negate": bool, "disabled": bool, "key": name}``; of
    several with one key and sense the first counts."""
    seen, out = set(), F.lit(True)
    for f in filters:
        mark = (f.get("key"), bool(f.get("negate")))
        if f.get("disabled") or (f.get("key") is not None and mark in seen):
            continue
        seen.add(mark)
        out = out & (~_sure(f["test"]) if f.get("negate") else _sure(f["test"]))
    return out


def _words(df: DataFrame, words: Sequence[str]) -> Column:
    """Any word in any text field."""
    fields = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return _any([_sure(F.contains(F.lower(c), F.lit(w))) for c in fields for w in words])


def object_query(df: DataFrame, query: dict) -> Column:
    """A query object as a predicate: an empty one fits all, else it has one kind of query.

    Kinds are ``match_all``; ``term``, ``match_phrase`` and ``prefix``, ``wildcard`` (a glob) with ``{field: value}``; ``match`` (any
    word); ``terms`` with a list; ``range`` with gt, gte, lt, lte; ``exists`` and ``missing`` with ``{"field": name}``;
    ``query_string`` with ``{"query": text}``; ``not``; and ``bool`` with must, filter, should and must_not, where without
    must and filter one of should has to fit. A value may be given as ``{"value": v}`` or ``{"query": v}``. A predicate is
    false where its field is null or no field of the table.
    """
    if not query:
        return F.lit(True)
    if len(query) != 1:
        raise ValueError(f"a query has one kind: {sorted(query)}")
    (kind, body), listed = next(iter(query.items())), lambda x: x if isinstance(x, list) else [x]
    if kind == "match_all":
        return F.lit(True)
    if kind == "query_string":
        return _text(df, body["query"])
    if kind == "not":
        return ~object_query(df, body)
    if kind == "bool":
        of = {k: [object_query(df, q) for q in listed(body.get(k, []))] for k in ("must", "filter", "should", "must_not")}
        out = reduce(lambda a, b: a & b, [*of["must"], *of["filter"], *(~q for q in of["must_not"])], F.lit(True))
        needed = int(body.get("minimum_should_match", 0 if of["must"] or of["filter"] else 1))
        fits = sum((q.cast("int") for q in of["should"]), F.lit(0)) >= needed
        return out & fits if of["should"] else out
    if kind in ("exists", "missing"):
        there = F.col(body["field"]).isNotNull() if body["field"] in df.columns else F.lit(False)
        return there if kind == "exists" else ~there
    (name, value), = body.items()
    tests = {
        "term": lambda c, v: phrase(c, v), "match_phrase": lambda c, v: _sure(F.contains(F.lower(c.cast("string")), F.lit(str(v).lower()))),
        "match": lambda c, v: _any([_sure(F.contains(F.lower(c.cast("string")), F.lit(w))) for w in str(v).lower().split()]),
        "prefix": lambda c, v: _sure(c.cast("string").startswith(v)), "wildcard": lambda c, v: _sure(c.cast("string").rlike(glob_regex(v))),
        "terms": lambda c, v: any_of(c, v), "range": lambda c, v: in_range(c, **v),
    }
    if kind not in tests:
        raise ValueError(f"unknown kind of query: {kind}")
    if kind != "range" and isinstance(value, dict):
        value = value.get("value", value.get("query"))
    return tests[kind](F.col(name), value) if name in df.columns else F.lit(False)


def _text(df: DataFrame, query: str | None) -> Column:
    query = (query or "").strip()
    return F.lit(True) if query in ("", "*") else _words(df, query.lower().split())


def text_query(df: DataFrame, query: str | dict | Column | None) -> DataFrame:
    """Rows that fit a user's query: all for nothing or ``*``; a predicate as a column; an object, or its JSON (see
    :func:`object_query`); else any word of the text in any text field. Text that only looks like JSON is text."""
    if isinstance(query, Column):
        return df.where(_sure(query))
    if isinstance(query, str) and query.strip().startswith("{"):
        try:
            query = json.loads(query)
        except ValueError:
            pass
    return df.where(object_query(df, query) if isinstance(query, dict) else _text(df, query))


def time_range(ts: Column, start: str | None = None, end: str | None = None, back: str | None = None, as_of: str | None = None, round_to: str | None = None) -> Column:
    """In ``[start, end)``, or within the interval ``back`` before ``as_of``; ``round_to`` moves that end up to a unit's end."""
    if back is not None:
        to = F.lit(as_of).cast("timestamp")
        to = F.date_trunc(round_to, to) + F.expr(f"interval 1 {round_to}") if round_to else to
        return (ts >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {back}")) & (ts < to)
    if start is not None and end is not None and start > end:
        raise ValueError("the range ends before it begins")
    return (F.lit(True) if start is None else ts >= F.lit(start).cast("timestamp")) & (F.lit(True) if end is None else ts < F.lit(end).cast("timestamp"))


#: Date parts by name.
PARTS = {
    "year": F.year, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "day_of_week": F.dayofweek, "day_of_year": F.dayofyear,
    "hour": F.hour, "minute": F.minute, "second": F.second,
}


def with_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Computed fields from SQL expressions."""
    return df.withColumns({name: F.expr(e) for name, e in fields.items()})


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested fields as columns with joined names.

    An array of plain values gives two columns: ``name`` has the element of an array that holds just one, and
    ``name[]`` any other array as it is (a column has one type); the one that does not apply is null, and both are
    where the array is. Arrays of records and maps stay as they are.
    """

    def leaves(schema: T.StructType, path: list[str]):
        for f in schema:
            name = separator.join([*path, f.name])
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, [*path, f.name])
                continue
            c = F.col(".".join(f"`{p}`" for p in [*path, f.name]))
            if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, T.StructType):
                yield F.when(F.size(c) == 1, F.get(c, F.lit(0))).alias(name)
                yield F.when(F.size(c) != 1, c).alias(f"{name}[]")
            else:
                yield c.alias(name)

    return df.select(*leaves(df.schema, []))


def sorted_page(df: DataFrame, order: Sequence[tuple[str, str]], size: int, start: int = 0, fields: Sequence[str] = ()) -> DataFrame:
    """One page of the hits in order; missing values come last."""
    keys = [F.col(c).asc_nulls_last() if d == "asc" else F.col(c).desc_nulls_last() for c, d in order]
    out = df.orderBy(*keys).offset(start).limit(size)
    return out.select(*fields) if fields else out


def highlight(text: Column, words: Sequence[str]) -> Column:
    """Marks whole or partial words, whatever their case."""
    return F.regexp_replace(text, "(?i)(" + "|".join(re.escape(w) for w in words) + ")", "<mark>$1</mark>")


def strip_secrets(text: Column) -> Column:
    """A connection string without its password, as key and value or within an address."""
    return F.regexp_replace(F.regexp_replace(text, r"password=\S+ ?", ""), r"(://[^:/@\s]+):[^@/\s]+@", "$1@")


def prefix_rename(name: Column, mapping: dict[str, str]) -> Column:
    """The name with its longest known prefix replaced."""
    out = name
    for old, new in sorted(mapping.items(), key=lambda kv: len(kv[0])):
        out = F.when(name.startswith(old), F.concat(F.lit(new), F.substring(name, len(old) + 1, 1 << 30))).otherwise(out)
    return out
