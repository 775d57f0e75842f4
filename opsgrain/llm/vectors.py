"""Op 9, embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are taken from a bounded sample. Each vector is described by its nearest pivots, in
order; inverted lists keep, for each label and pivot, the vectors that have it among their nearest. Two
vectors that share at least ``shared`` pivots at places of their orders that are no more than ``drift`` apart are
candidates, and are verified by their cosine in double precision. A pair is counted in the list of the first pivot,
by number, that it shares, so that each pair is met once. Equal vectors of one label are one entry with a count.
Entries of each list are counted first; a list of more than ``CELL`` is split into blocks by that count and each pair
of blocks is a list of its own; lists report counts and a spanning forest. Vectors travel in the type they come in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgrain.llm.common import components, written

#: Entries in one list before it is split into blocks.
CELL = 2048
#: Candidate pairs that are verified at once.
PAIRS = 16_384
#: Pivots at most, so vectors in the sample; the number grows with the root of the number of vectors up to it.
PIVOTS = 2048


def usable(column):
    """Not null, no null or non-finite components, not zero."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good & F.exists(column, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _spread(x: np.ndarray, apart: float) -> np.ndarray:
    """The rows that are no nearer than cosine ``apart`` to one before them: near pivots would split a dense group."""
    kept = np.zeros(len(x), bool)
    for i in range(len(x)):
        kept[i] = not (x[kept] @ x[i] > apart).any()
    return x[kept]


def _describe(shared, nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                some = batch.filter(pa.array(sizes == size))
                x = _unit(_matrix(some.column("vector")))
                pivots = by_size[int(size)]
                k = min(nearest, len(pivots))
                near = x @ pivots.T
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
                top = np.take_along_axis(top, order, 1)  # nearest first
                yield pa.RecordBatch.from_arrays(
                    [some.column("label"), pa.array(np.full(len(x), size), pa.int32()), some.column("entry"), some.column("copies"), pa.array(list(top.astype(np.int32)), pa.list_(pa.int32())), some.column("vector")],
                    ["label", "size", "entry", "copies", "near", "vector"],
                )

    return run


def _same_order(a: np.ndarray, b: np.ndarray, drift: int) -> np.ndarray:
    """How many pivots two orders share at places no more than ``drift`` apart, row by row."""
    out = np.zeros(len(a), np.int64)
    for k in range(-drift, drift + 1):
        out += (a[:, max(k, 0) : a.shape[1] + min(k, 0)] == b[:, max(-k, 0) : b.shape[1] + min(-k, 0)]).sum(axis=1)
    return out


def _compare(cosine: float, shared_pivots: int, drift: int):
    def one(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(group)
        entry, copies, block = (table.column(c).to_numpy() for c in ("entry", "copies", "block"))
        pivot, cell = table.column("pivot")[0].as_py(), table.column("cell")[0].as_py()
        x, near = _unit(_matrix(table.column("vector"))), _matrix(table.column("near")).astype(np.int64)
        width = int(near.max()) + 1
        has = np.zeros((len(x), width), np.float32)
        np.put_along_axis(has, near, 1, 1)
        n, label, links = len(x), np.arange(len(x)), np.zeros(len(x), np.int64)
        b = (math.isqrt(8 * cell + 1) - 1) // 2
        apart = cell - b * (b + 1) // 2 != b  # two different blocks: pairs within one are met in its own cell
        for lo in range(0, n, 512):
            rows = slice(lo, min(lo + 512, n))
            ok = has[rows] @ has.T >= min(shared_pivots, near.shape[1])
            ok &= has[rows, :pivot] @ has[:, :pivot].T == 0
            if apart:
                ok &= block[rows, None] != block[None]
            i, j = np.nonzero(np.triu(ok, lo + 1)) if lo == 0 else np.nonzero(ok & (np.arange(n)[None] > np.arange(lo, rows.stop)[:, None]))
            i += lo
            near_enough = np.zeros(len(i), bool)
            for at in range(0, len(i), PAIRS):
                p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                near_enough[at : at + PAIRS] = _same_order(near[p], near[q], drift) >= min(shared_pivots, near.shape[1])
            i, j = i[near_enough], j[near_enough]
            hit = np.zeros(len(i), bool)
            for at in range(0, len(i), PAIRS):
                p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                hit[at : at + PAIRS] = (x[p] * x[q]).sum(axis=1) >= cosine
            i, j = i[hit], j[hit]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            while len(i):
                p, q = label[i], label[j]
                i, j = i[p != q], j[p != q]
                np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
                while (label[label] != label).any():
                    label = label[label]
        found = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(entry[found]), pa.array(entry[label[found]]), pa.array(links[found])], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("label", "size", "pivot", "cell")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                now = tuple(keys[lo])
                if held and now != key:
                    yield one(held)
                    held = []
                key = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield one(held)

    return run


def near_duplicates(
    rows: DataFrame, cosine: float = 0.98, nearest: int = 8, shared_pivots: int = 3, pivots: int = PIVOTS, cell: int = CELL, drift: int = 5
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vec_id, embedding, label``.

    Only vectors of one label, not null, and of one length are compared. Vectors that are null, empty or zero,
    or hold null or non-finite components, link with nothing, nor does one with a null label: no links, a
    component of their own. Links found are exact; which pairs are found depends on the shared pivots. Repeated
    rows are vectors of their own: they link with each other, and share the smallest ``vec_id``. A row with a null
    ``vec_id`` is linked like any, but names no component unless it has no other id (then null, and kept).
    """
    spark = rows.sparkSession
    element = rows.schema["embedding"].dataType.elementType.typeName()
    kind = element if element in ("float", "double") else "double"
    vector = F.transform("embedding", lambda x: x.cast(kind))
    base = rows.select("vec_id", F.col("label").cast("long").alias("label"), vector.alias("vector")).withColumn("ok", F.col("label").isNotNull() & usable(F.col("vector")))
    # -0.0 and 0.0 are one value
    good = base.where("ok").select("vec_id", "label", F.transform("vector", lambda x: (x + F.lit(0.0)).cast(kind)).alias("vector"))
    entries = good.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("size", F.size("vector"))
    entries = written(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")  # the numbers are kept with the table
    sizes = {r["size"]: r["count"] for r in entries.groupBy("size").count().collect()}  # a row for each length of vectors
    wanted = max(32, min(pivots, 4 * math.isqrt(sum(sizes.values()))))
    share = F.create_map(*[F.lit(x) for size, n in sizes.items() for x in (size, min(1.0, 1.5 * wanted / n))]) if sizes else F.create_map(F.lit(0), F.lit(0.0))
    place = F.pmod(F.xxhash64("vector"), F.lit(1 << 30))
    some = entries.where(place < share[F.col("size")] * (1 << 30)).select("size", place.alias("place"), "vector")
    taken: dict[int, list] = {size: [] for size in sizes}
    drawn = some.toArrow()  # about 1.5 times wanted of each length
    for size, at, x in zip(*(drawn[c] for c in ("size", "place", "vector")), strict=True):
        taken[size.as_py()].append((at.as_py(), x.as_py()))
    chosen = {size: _spread(_unit(np.array([x for _, x in sorted(of)[:wanted]], np.float64).reshape(-1, size)), 0.9) for size, of in taken.items()}
    for size in sizes:
        if not len(chosen[size]):  # few vectors of that length, and none was drawn
            first = entries.where(F.col("size") == size).select("vector").first()["vector"]
            chosen[size] = _unit(np.array([first], np.float64))
    shared = spark.sparkContext.broadcast(chosen)
    shape = f"label long, size int, entry long, copies long, near array<int>, vector array<{kind}>"
    described = written(entries.mapInArrow(_describe(shared, nearest), shape), "described")
    met = ["label", "size", "pivot"]
    hot = written(described.select("label", "size", F.explode("near").alias("pivot")).groupBy(*met).count().where(F.col("count") > cell), "hot_lists")
    # two blocks of two fifths of a cell each stay under it, however they are dealt
    listed = described.withColumn("pivot", F.explode("near")).join(hot, met, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") * 5 / (2 * cell)), F.lit(1)).cast("long"))
    listed = listed.withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.expr("greatest(block, other) * (greatest(block, other) + 1) div 2 + least(block, other)")
    listed = listed.select(*met, pair.alias("cell"), "block", "entry", "copies", "near", "vector")
    keys = ["label", "size", "pivot", "cell"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    compared = listed.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_compare(cosine, shared_pivots, drift), "a long, b long, links long")
    found = written(compared, "links")
    linked = found.groupBy("a").agg(F.sum("links").alias("links"))
    groups = components(found.select("a", "b"))
    by = entries.select("entry", "first", "copies", "label", "vector").join(linked, F.col("entry") == F.col("a"), "left").drop("a")
    by = by.join(groups, F.col("entry") == F.col("node"), "left").withColumn("component", F.coalesce("component", "entry"))
    least = by.groupBy("component").agg(F.min("first").alias("component_id"))
    by = by.join(least, "component").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = good.select("vec_id", "label", "vector").join(by, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return out.unionByName(alone).withColumn("kept", kept)
