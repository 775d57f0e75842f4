"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of the units in size strings.
SIZES = {"b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40}


def ip_to_long(ip: Column) -> Column:
    """An IPv4 address as a number; null where it is none."""
    parts = F.split(ip, r"\.")
    value = sum(parts[i].cast("long") * 256 ** (3 - i) for i in range(4))
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return F.when(ip.rlike(rf"^(?:{octet}\.){{3}}{octet}$"), value)


def long_to_ip(value: Column) -> Column:
    """The address of a number from 0 to 2^32 - 1, else null."""
    return F.when((value >= 0) & (value < 1 << 32), dotted(value))


def dotted(value: Column) -> Column:
    """A number with its three lower bytes apart; an address has this form, other numbers have a first part that is no byte."""
    lower = [F.shiftright(value, 8 * i).bitwiseAND(F.lit(255)).cast("string") for i in (2, 1, 0)]
    return F.concat(F.shiftright(value, 24).cast("string"), *(x for part in lower for x in (F.lit("."), part)))


def cidr_range(cidr: str) -> tuple[int, int]:
    """First and last address of a block like ``10.0.16.0/20``, as numbers."""
    ip, _, bits = cidr.partition("/")
    a, b, c, d = map(int, ip.split("."))
    size = 1 << 32 - int(bits)
    first = (((a * 256 + b) * 256 + c) * 256 + d) // size * size
    return first, first + size - 1


def parse_size(text: Column) -> Column:
    """``1.2 GB`` and the like as whole bytes; null where the text is no size. A number alone is bytes."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$", 1)
    unit = F.lower(F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$", 2))
    factor = F.when(unit == "", 1)
    for name, n in SIZES.items():
        factor = factor.when(unit == name, n)
    return F.when(number != "", F.round(number.cast("double") * factor)).cast("long")


def series_key(*columns: str | Column) -> Column:
    """The columns' texts joined by a colon; nulls are empty."""
    return F.concat_ws(":", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns))


def series_id(*columns: str | Column) -> Column:
    """A 64-bit id of a series key."""
    return F.xxhash64(series_key(*columns))


def request_template(text: Column) -> Column:
    """What requests of one kind have in common: quoted strings, UUIDs, hex runs and numbers become ``_``."""
    out = F.regexp_replace(text, r"'[^']*'|\"[^\"]*\"", "_")
    out = F.regexp_replace(out, r"(?i)\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "_")
    out = F.regexp_replace(out, r"(?i)\b(?=[0-9a-f]*[0-9])[0-9a-f]{8,}\b", "_")
    return F.regexp_replace(out, r"[0-9]+", "_")


def pair_template(a: Column, b: Column) -> Column:
    """The words of ``a`` that stand anywhere in ``b``, too, with ``_`` for each run of others.

    Words are cut at white space. Null where the two texts do not keep equally many words, or where none is kept.
    """
    x, y = (F.filter(F.split(t, r"[ \t\r\n]"), lambda w: w != "") for t in (a, b))
    kept = lambda own, other: F.filter(own, lambda w: F.array_contains(other, w) & (w != "_"))
    words = F.transform(x, lambda w: F.when(F.array_contains(y, w), w).otherwise("_"))
    joined = F.regexp_replace(F.array_join(words, " "), r"(?<!\S)_(?: _)+(?!\S)", "_")
    return F.when((F.size(kept(x, y)) == F.size(kept(y, x))) & (F.size(kept(x, y)) > 0), joined)


def escape(text: Column, signs: str) -> Column:
    """A backslash before each of the signs."""
    return F.regexp_replace(text, "([" + "".join("\\" + s for s in signs) + "])", r"\\$1")


def unescape(text: Column, signs: str) -> Column:
    return F.regexp_replace(text, r"\\([" + "".join("\\" + s for s in signs) + "])", "$1")


def human_bytes(value: Column) -> Column:
    """Bytes with a unit of a power of 1024 and two digits."""
    out = F.format_string("%.2f TB", value / 2.0**40)
    for name, power in (("GB", 30), ("MB", 20), ("KB", 10)):
        out = F.when(value < 2.0 ** (power + 10), F.format_string(f"%.2f {name}", value / 2.0**power)).otherwise(out)
    return F.when(value < 1024, F.format_string("%d B", value.cast("long"))).otherwise(out)


def uptime_text(seconds: Column) -> Column:
    """``3 days, 04:05``."""
    s = seconds.cast("long")
    days = F.floor(s / 86400)
    clock = F.format_string("%02d:%02d", F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60))
    return F.concat(F.when(days > 0, F.concat(days.cast("string"), F.when(days == 1, " day, ").otherwise(" days, "))).otherwise(""), clock)


def range_label(value: Column, ranges: list[tuple[float, float, str]], default: str = "") -> Column:
    """The label of the first range ``[low, high)`` that holds the value."""
    out = F.lit(default)
    for low, high, label in reversed(ranges):
        out = F.when((value >= low) & (value < high), label).otherwise(out)
    return out


def truncated(text: Column, n: int) -> Column:
    """At most ``n`` characters, with dots where something is cut off."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
