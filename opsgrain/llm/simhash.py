"""Op 1, SimHash near-duplicates by the generalised pigeonhole principle.

Bits of the fingerprint that go together are grouped into partitions. If the thresholds of the partitions sum
to ``distance - partitions + 1``, two fingerprints within ``distance`` bits differ, in one partition at least,
by no more than its threshold (-1: the partition is passed over). Each distinct fingerprint gets its own
thresholds, those with the least estimated work by dynamic programming over the partitions, and probes the
values within them; every fingerprint stands in the buckets of its own values. What meets in a bucket is
verified there. Estimates come from the counts of values of at most 16 bits over all fingerprints, so they
are of bounded size. A bucket of more than ``CELL`` rows is split into blocks and each pair of blocks becomes
a bucket of its own; each bucket reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgrain.llm.common import components, row_key, written

#: Rows that one bucket holds before it is split into blocks.
CELL = 2048


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of word shingles: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    k = min(words, len(parts))
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=False)], "<u8")
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += part.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, kind: str = "long") -> DataFrame:
    """``doc_id, fp`` (as a signed long) for each row of ``doc_id, text``; ``kind`` is the type of ``doc_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(x, words) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class Partitions:
    """Groups of bits, with counts of the values of their halves, and the thresholds that follow.

    ``groups`` are lists of bit numbers. ``halves`` are the runs of at most 16 bits of each group, as
    (group, shift, width).
    """

    def __init__(self, together: np.ndarray, n: int, count: int):
        self.n = n
        share = np.diag(together) / max(n, 1)
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
        link = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
        np.fill_diagonal(link, 0)
        free, self.groups = set(range(64)), []
        for k in range(count):
            size = 64 // count + (k < 64 % count)
            group = [max(sorted(free), key=lambda b: link[b, sorted(free)].sum())]
            free -= set(group)
            while len(group) < size:
                group.append(max(sorted(free), key=lambda b: link[b, group].sum()))
                free.discard(group[-1])
            self.groups.append(group)
        self.halves = []
        for g, group in enumerate(self.groups):
            pieces = math.ceil(len(group) / 16)
            at = 0
            for k in range(pieces):
                width = len(group) // pieces + (k < len(group) % pieces)
                self.halves.append((g, at, width))
                at += width

    def values(self, fps: np.ndarray) -> np.ndarray:
        """The value of each group, a column each."""
        bits = _bits(fps).astype(np.int64)
        return np.stack([(bits[:, group] << np.arange(len(group))).sum(axis=1) for group in self.groups], axis=1)

    def set_counts(self, counts: list[np.ndarray], distance: int) -> None:
        """``near[h][d, v]``: how many values of half h differ from v by d bits."""
        self.near = []
        for (_, _, width), c in zip(self.halves, counts, strict=True):
            table = np.zeros((distance + 1, 1 << width))
            table[0] = c
            for b in range(width):
                other = np.arange(1 << width) ^ (1 << b)
                table[1:] += table[:-1, other].copy()
            self.near.append(table)

    def estimates(self, g: int, values: np.ndarray, distance: int) -> np.ndarray:
        """Expected fingerprints within r bits of values of group g, a row for each r; halves count as independent."""
        total = None
        for h, (own, shift, width) in enumerate(self.halves):
            if own == g:
                here = self.near[h][: distance + 1, values >> shift & ((1 << width) - 1)]
                total = here if total is None else np.stack([sum(total[i] * here[d - i] for i in range(d + 1)) for d in range(distance + 1)]) / max(self.n, 1)
        return np.cumsum(total, axis=0)

    def thresholds(self, values: np.ndarray, distance: int) -> np.ndarray:
        """The thresholds of each fingerprint, of least candidates and probes in sum."""
        m = len(self.groups)
        work = [
            self.estimates(g, values[:, g], distance) + np.cumsum([math.comb(len(group), r) for r in range(distance + 1)])[:, None]
            for g, group in enumerate(self.groups)
        ]
        goal = distance - m + 1
        low = -m  # sums so far run from -m to distance
        best = np.full((len(values), distance + m + 1), np.inf)
        best[:, -low] = 0
        choice = np.zeros((m, len(values), distance + m + 1), np.int8)
        for g in range(m):
            grown = np.full_like(best, np.inf)
            for t in range(-1, distance + 1):
                cost = work[g][t][:, None] if t >= 0 else 0.0
                moved = np.full_like(best, np.inf)
                if t >= 0:
                    moved[:, t:] = best[:, : best.shape[1] - t] + cost
                else:
                    moved[:, :-1] = best[:, 1:]
                less = moved < grown
                grown[less] = moved[less]
                choice[g][less] = t
            best = grown
        out = np.zeros((len(values), m), np.int64)
        at = np.full(len(values), goal - low)
        for g in range(m - 1, -1, -1):
            out[:, g] = choice[g][np.arange(len(values)), at]
            at = at - out[:, g]
        return out


def _masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``radius`` set, zero first."""
    out = [[0]]
    for _ in range(radius):
        out.append(sorted({m | 1 << b for m in out[-1] for b in range(width) if not m >> b & 1}))
    return np.array([m for level in out for m in level], np.int64)


def _probes(shared, distance: int, cell: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: Partitions = shared.value
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            values = parts.values(fps)
            chosen = parts.thresholds(values, distance)
            who, group, value, role = [], [], [], []

            def add(rows, g, v, r):
                who.append(rows), group.append(np.full(len(rows), g)), value.append(v), role.append(np.full(len(rows), r, np.int8))

            for g, bits in enumerate(parts.groups):
                own = chosen[:, g] >= 0
                for flag, r in ((own, 3), (~own, 1)):  # 1: stands here, 2: asks here
                    add(np.flatnonzero(flag), g, values[flag, g], r)
                for t in range(1, distance + 1):
                    rows = np.flatnonzero(chosen[:, g] == t)
                    masks = _masks(len(bits), t)[1:]
                    add(np.repeat(rows, len(masks)), g, (values[rows, g][:, None] ^ masks).ravel(), 2)
            who, group, value, role = map(np.concatenate, (who, group, value, role))
            load = np.zeros(len(who))
            for g in range(len(parts.groups)):
                here = group == g
                load[here] = parts.estimates(g, value[here], 1)[1]
            blocks = np.maximum(1, np.minimum(np.ceil(load / cell), 20_000)).astype(np.int64)
            mine = (fps[who].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
            row = np.repeat(np.arange(len(who)), blocks)
            other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            a, b = np.minimum(mine[row], other), np.maximum(mine[row], other)
            bucket = group[row].astype(np.int64) << 60 | value[row] << 28 | (b * (b + 1) // 2 + a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(fps[who[row]]), pa.array(role[row], pa.int8())], ["bucket", "fp", "role"]
            )

    return run


def _forest(bucket: np.ndarray, fps: np.ndarray, role: np.ndarray, distance: int) -> np.ndarray:
    """For each row, the row that it is linked to within its bucket, by way of others or directly."""
    n, label = len(fps), np.arange(len(fps))
    active, d = np.arange(n), 0
    while True:
        d += 1
        active = active[active + d < n]
        active = active[bucket[active] == bucket[active + d]]
        if not len(active):
            return label
        x = active[label[active] != label[active + d]]
        x = x[(role[x] & 1) & (role[x + d] >> 1) | (role[x] >> 1) & (role[x + d] & 1) > 0]
        x = x[np.bitwise_count(fps[x] ^ fps[x + d]) <= distance]
        while len(x):
            a, b = label[x], label[x + d]
            x = x[a != b]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]


def _verify(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)]

        def linked(some):
            label = _forest(*some, distance)
            x = np.flatnonzero(label != np.arange(len(label)))
            fps = some[1].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(fps[x]), pa.array(fps[label[x]])], ["a", "b"])

        for batch in batches:
            now = (batch.column("bucket").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("role").to_numpy())
            held = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last bucket may go on
            if cut:
                yield linked([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield linked(held)

    return run


def links(fps: DataFrame, distance: int = 3, partitions: int = 0, cell: int = CELL) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that connect all within ``distance`` bits of each other.

    ``fps`` has one column, ``fp``, of distinct longs. Two fingerprints within the distance are linked
    directly or by way of others in the same bucket. ``partitions`` is 0 for a number that follows from the
    number of fingerprints: four up to 2^24, three up to 2^30, else two.
    """
    spark = fps.sparkSession

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for batch in batches:
            bits = _bits(batch.column("fp").to_numpy()).astype(np.float64)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel().astype(np.int64))], ["at", "n"])

    n = fps.count()
    matrix = np.zeros(4096)
    for r in fps.mapInArrow(together, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        matrix[r["at"]] = r["n"]
    count = partitions or (4 if n <= 1 << 24 else 3 if n <= 1 << 30 else 2)
    if not 2 <= count <= 16:
        raise ValueError("from 2 to 16 partitions")
    parts = Partitions(matrix.reshape(64, 64), n, count)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(1 << width, np.int64) for _, _, width in parts.halves]
        for batch in batches:
            values = parts.values(batch.column("fp").to_numpy())
            for table, (g, shift, width) in zip(tables, parts.halves, strict=True):
                table += np.bincount(values[:, g] >> shift & ((1 << width) - 1), minlength=1 << width)
        for h, table in enumerate(tables):
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), h)), pa.array(at), pa.array(table[at])], ["half", "value", "n"])

    counts = [np.zeros(1 << width) for _, _, width in parts.halves]
    found = fps.mapInArrow(tally, "half long, value long, n long").groupBy("half", "value").agg(F.sum("n").alias("n"))
    for h, v, c in zip(*(found.toArrow()[x].to_numpy() for x in ("half", "value", "n")), strict=True) if n else ():
        counts[h][v] = c
    parts.set_counts(counts, distance)
    shared = spark.sparkContext.broadcast(parts)
    probes = fps.mapInArrow(_probes(shared, distance, cell), "bucket long, fp long, role byte")
    dealt = probes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_verify(distance), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``doc_id, text``; other columns are not read.

    A null or empty text, or one of white space, has fingerprint zero, linked like any other. Equal texts
    meet as one fingerprint. Repeated rows stay. A row with a null ``doc_id`` is linked, but names no
    component unless it has no other member (then null).
    """
    rows = written(fingerprints(docs, words), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(distinct.select("fp"), distance))
    joined = written(distinct.join(found, distinct.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "members")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    members = joined.select("fp", "component").join(least, "component").select("fp", "component_id")
    return rows.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """Keeps the row of the smallest ``doc_id`` of each group of near-duplicates; all columns stay.

    Rows are told apart by ``doc_id`` and text: rows of one id and different texts are judged each by its text, and
    so are rows with a null ``doc_id``, which stay only where the whole group has no other (then one of them). Of
    repeated rows one stays.
    """
    keyed = docs.select("doc_id", "text", row_key().alias("_row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole"))
    rows = written(fingerprints(keyed.select(F.struct("doc_id", "_row").alias("doc_id"), "text"), words, "struct<doc_id:long,_row:string>"), "fingerprints")
    least = F.min(F.struct(F.col("doc_id.doc_id").isNull().alias("none"), F.col("doc_id.doc_id"), F.col("doc_id._row")))
    distinct = written(rows.groupBy("fp").agg(least.alias("first")), "distinct")
    found = components(links(distinct.select("fp"), distance))
    first = distinct.join(found, distinct.fp == found.node, "left").groupBy(F.coalesce("component", "fp")).agg(F.min("first").alias("first"))
    return keyed.join(first.select("first._row"), "_row", "left_semi").dropDuplicates(["_row"]).select("_whole.*")
