"""Op 5, secret scans: multipart credentials linked by interval joins.

Strong findings (kinds assign, access, hex) are always reported. Weak parts are access identifiers (a user or
client name in an assignment), bare secrets (long runs that mix letters and digits), and endpoints (a URL or
a host in an assignment). A weak part is reported only where parts that complete it stand within ``REACH``
characters of it in the same document: a name needs a secret, a bare secret needs a name or an access key
next to it, an endpoint needs both a name and a secret. The join is on document and stretch of text, so that
a part meets only its neighbours, however long a document is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgrain.llm.common import written

#: Kinds in the order in which they are listed, and the part of a credential that each is.
KINDS = ("assign", "access", "hex", "name", "bare", "endpoint")
ROLE = {"assign": "secret", "access": "name", "hex": "secret", "name": "name", "bare": "secret", "endpoint": "endpoint"}
#: Characters between parts of one credential, at most.
REACH = 120
SCOPE = 512
_KEY = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_NAME = re.compile(r"""\b(?:user(?:_?name)?|login|client_?id|account|access_?key_?id)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9_.@-]{3,64}""", re.I | re.A)
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""\b(?:[a-z][a-z0-9+]{1,15}://[^\s"'<>|]{4,}|(?:host|server|endpoint)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9.-]{3,}(?::[0-9]+)?)""", re.I | re.A)
#: One of these stands in every text that holds such a part.
_KEY_HINTS, _NAME_HINTS, _ENDPOINT_HINTS = ("passw", "secret", "token", "api"), ("user", "login", "client", "account", "access"), ("://", "host", "server", "endpoint")


def parts(text: str) -> list[tuple[str, int, int]]:
    """All parts of a text, strong and weak: kind, start, end (code points)."""
    low = text.lower()
    hint = lambda words: any(w in low for w in words)
    out = []
    if hint(_KEY_HINTS):
        out += [("assign", *m.span()) for m in _KEY.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    if hint(_NAME_HINTS):
        out += [("name", *m.span()) for m in _NAME.finditer(text)]
    if hint(_ENDPOINT_HINTS):
        out += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    out += [
        ("bare", *m.span())
        for m in _BARE.finditer(text)
        if not m[0].isalpha() and not m[0].isdigit() and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])
    ]
    return out


FOUND = "doc_id long, copy long, parts array<struct<kind:string,start:int,end:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [
            [{"kind": k, "start": a, "end": b} for k, a, b in parts(text or "")] for text in batch.column("text").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(found, kind)], ["doc_id", "copy", "parts"])


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts with what completes them near by: doc_id, copy, kind, start, end.

    An interval join: two parts are near where fewer than ``reach`` characters lie between them. Each part
    goes to its stretches of text, widened by ``reach`` on one side of the join.
    """
    role = F.create_map(*[x for k, v in ROLE.items() for x in (F.lit(k), F.lit(v))])
    each = found.select("doc_id", "copy", F.explode("parts").alias("p")).select("doc_id", "copy", "p.*").distinct()
    each = each.withColumn("role", role[F.col("kind")])
    cell = lambda at: F.floor(at / SCOPE)
    weak = each.where(F.col("kind").isin("name", "bare", "endpoint"))
    wide = weak.withColumn("cell", F.explode(F.sequence(cell(F.greatest(F.col("start") - reach, F.lit(0))), cell(F.col("end") + reach))))
    by = each.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("role").alias("r"), F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("at"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")) & (F.col("cell") == F.col("at"))
    near = wide.join(by, same).where("r != role and s < end + {0} and start < e + {0}".format(reach))
    seen = near.groupBy("doc_id", "copy", "kind", "start", "end").agg(F.collect_set("r").alias("roles"))
    needs = F.when(F.col("kind") == "endpoint", F.array_contains("roles", "name") & F.array_contains("roles", "secret")).when(
        F.col("kind") == "name", F.array_contains("roles", "secret")
    )
    return seen.where(needs.otherwise(F.array_contains("roles", "name"))).drop("roles")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Findings in whole texts (null: empty) of ``doc_id, text``; other columns are not read.

    Returns doc_id, copy (a hash of the text, which tells rows of one id apart) and findings, an array of
    kind, start, end, sorted by start, then by kind as listed; a row for each row of the input.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("copy", F.xxhash64("text"))
    found = written(rows.mapInArrow(_scan, FOUND), "parts")
    weak = linked(found, reach).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("kind", "start", "end")).alias("weak"))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    strong = F.filter("parts", lambda p: p["kind"].isin("assign", "access", "hex"))
    both = F.concat(strong, F.coalesce("weak", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    keyed = F.array_sort(F.transform(both, lambda p: F.struct(p["start"].alias("start"), order[p["kind"]].alias("o"), p["end"].alias("end"), p["kind"].alias("kind"))))
    findings = F.transform(keyed, lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    weak = weak.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), "weak")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c"))
    return found.join(weak, same, "left").select("doc_id", "copy", findings.alias("findings"))


def digests(findings: DataFrame) -> DataFrame:
    """Counts and digests of :func:`scan`'s findings."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda p: p["kind"].isin("assign", "access", "hex"))
    return findings.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans")
    )


def redact(docs: DataFrame, reach: int = REACH, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns, with each finding in ``text`` replaced by ``mark``, overlapping ones as one; texts
    without findings, null ones included, are untouched. ``n_chars`` follows the text where it is there."""

    @F.arrow_udf("string")
    def masked(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for t, a, b in zip(text.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
            pieces, at = [], 0
            for lo, hi in zip(a or (), b or (), strict=True):
                if lo >= at:
                    pieces += [t[at:lo], mark]
                at = max(at, hi)
            out.append(None if t is None else "".join([*pieces, t[at:]]))
        return pa.array(out, pa.string())

    found = scan(docs, reach).where(F.size("findings") > 0).dropDuplicates(["doc_id", "copy"])
    found = found.select("doc_id", "copy", F.col("findings.start").alias("starts"), F.col("findings.end").alias("ends"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("copy"))
    # a text without findings goes to Python as a null
    text = masked(F.when(F.col("starts").isNotNull(), F.col("row.text")), "starts", "ends")
    out = whole.join(found, same, "left").select("row", F.col("starts").isNotNull().alias("hit"), text.alias("new"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns["text"] = F.when(F.col("hit"), F.col("new")).otherwise(F.col("row.text"))
    if "n_chars" in columns:
        length = F.length("new").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("hit"), length).otherwise(F.col("row.n_chars"))
    return out.select(*(x.alias(c) for c, x in columns.items()))
