"""Near-duplicates by the Jaccard similarity of their sets of word shingles: candidates by bands, verified exactly.

With a ``distance`` the closest copies are found by fingerprint, with op 1's method: candidates are the links of
:mod:`~opsgrain.llm.simhash`. SimHash of 64 bits cannot index all similarities from 0.8 on: such pairs differ in about 10 bits,
and half of them in more. So further candidates come from MinHash: ``BANDS`` bands of ``DEPTH`` minima each; a pair of similarity s shares a
band with probability 1 - (1 - s^DEPTH)^BANDS, which is 0.9996 at 0.8 and more above. Equal sets are one node.
Buckets with the same members are compared once; one of more than ``CELL`` members is split into blocks and
each pair of blocks is a cell of its own. In a cell all pairs not yet connected are verified on the whole sets;
a cell reports a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgrain.llm import simhash
from opsgrain.llm.common import components, row_key, written

BANDS, DEPTH = 20, 5
#: Members of one cell, about.
CELL = 512

_rng = np.random.default_rng(42)
_XOR, _TIMES = (_rng.integers(0, 1 << 63, BANDS * DEPTH, np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))


class _Hashes(dict):
    def __missing__(self, word):
        from xxhash import xxh64_intdigest

        if len(self) >= 200_000:
            self.clear()
        self[word] = out = xxh64_intdigest(word, 42)
        return out


_known = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a shorter text is one shingle, an empty one is zero."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(1, np.uint64)
    own = np.fromiter(map(_known.__getitem__, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    n = len(own) - k + 1
    out = own[:n].copy()
    for i in range(1, k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + own[i : n + i])
    return np.unique(out)


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of a set under each hash function."""
    least = np.full(len(_XOR), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        least = np.minimum(least, _mix((own[at : at + 4096, None] ^ _XOR) * _TIMES).min(axis=0))
    return least


def _described(words: int, fingerprints: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [shingles(x, words) for x in batch.column("text").to_pylist()]
            fp = np.array([xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64)
            least = np.stack([minima(x) for x in sets]).reshape(len(sets), BANDS, DEPTH)
            bands = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), least.shape[:2])
            for k in range(DEPTH):
                bands = _mix(bands * np.uint64(0x9E3779B97F4A7C15) + least[:, :, k])
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            bands = pa.ListArray.from_arrays(offsets, pa.array(bands.ravel().view(np.int64)))
            sim = [simhash.fingerprint(x) if fingerprints else None for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_row"), pa.array(fp.view(np.int64)), bands, pa.array(sim, pa.int64())], ["doc_id", "_row", "fp", "bands", "sim"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(x, words).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(own, pa.binary())], ["fp", "own"])

    return run


def _forest(cell: np.ndarray, fps: np.ndarray, own: list[bytes], similarity: float) -> np.ndarray:
    """For each row, the row that it is linked to within its cell, by way of others or directly."""
    n, label = len(fps), np.arange(len(fps))
    sets = [np.frombuffer(x, np.uint64) for x in own]
    sizes = np.array([len(x) for x in sets])
    once: dict[int, np.ndarray] = {}
    for f, x in zip(fps.tolist(), sets, strict=True):
        if f not in once:
            once[f] = minima(x).astype(np.uint8)
    least = np.stack([once[f] for f in fps.tolist()])
    active, d = np.arange(n), 0
    while True:
        d += 1
        active = active[active + d < n]
        active = active[cell[active] == cell[active + d]]
        if not len(active):
            return label
        x = active[label[active] != label[active + d]]
        x = x[np.minimum(sizes[x], sizes[x + d]) >= similarity * np.maximum(sizes[x], sizes[x + d]) - 1e-6]
        # seven standard deviations below the threshold: such pairs need no look at the whole sets
        x = x[(least[x] == least[x + d]).mean(axis=1) >= similarity - 0.3]
        hit = np.zeros(len(x), bool)
        for k, i in enumerate(x.tolist()):
            both = len(np.intersect1d(sets[i], sets[i + d], assume_unique=True))
            hit[k] = both / (sizes[i] + sizes[i + d] - both) >= similarity
        x = x[hit]
        while len(x):
            a, b = label[x], label[x + d]
            x = x[a != b]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]


def _compare(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((0, 2), np.int64), np.zeros(0, np.int64), []]

        def linked(keys, fps, own):
            cell = np.concatenate(([0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))))
            label = _forest(cell, fps, own, similarity)
            x = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(fps[x]), pa.array(fps[label[x]])], ["a", "b"])

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "cell")], axis=1)
                held = [np.concatenate((held[0], keys)), np.concatenate((held[1], batch.column("fp").to_numpy())), held[2] + batch.column("own").to_pylist()]
                cut = len(held[0])  # the last cell may go on
                while cut and (held[0][cut - 1] == held[0][-1]).all():
                    cut -= 1
                if cut:
                    yield linked(*(x[:cut] for x in held))
                    held = [x[cut:] for x in held]
        if len(held[1]):
            yield linked(*held)

    return run


def fingerprint_pairs(described: DataFrame, distance: int) -> DataFrame:
    """Pairs ``a, b`` of different sets (``fp``) whose texts' fingerprints (``sim``) link within ``distance`` bits.

    Sets of one fingerprint are paired with its least set, and the least sets of linked fingerprints with each other,
    so that there are no more pairs than sets and links.
    """
    sets = written(described.select("sim", "fp").distinct(), "fingerprints")
    least = written(sets.groupBy("sim").agg(F.min("fp").alias("least")), "fingerprint-sets")
    own = sets.join(least, "sim").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    found = simhash.links(least.select(F.col("sim").alias("fp")), distance)
    ends = [least.select(F.col("sim").alias(x), F.col("least").alias(f"_{x}")) for x in ("a", "b")]
    across = found.join(ends[0], "a").join(ends[1], "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return own.unionByName(across).where("a <> b").distinct()


def links(rows: DataFrame, distinct: DataFrame, words: int, similarity: float, cell: int = CELL, pairs: DataFrame | None = None) -> DataFrame:
    """Links ``a, b`` between sets that connect all candidates of at least that similarity.

    ``rows`` has ``_row, text``; ``distinct`` has ``fp, _row, bands``, the row of one text with that set. ``pairs`` are
    candidates from elsewhere; each is a cell of its own, verified like the rest.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    banded = distinct.select("fp", F.explode("bands").alias("bucket"))
    h = F.xxhash64("fp")
    counts = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(h).alias("x")).where("n > 1")
    kept = written(counts.groupBy("n", "s", "x").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "buckets")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") * 2 / F.lit(cell))).cast("long")
    met = banded.join(kept, "bucket").withColumn("blocks", F.when(F.col("n") <= cell, F.lit(1).cast("long")).otherwise(blocks))
    met = met.withColumn("mine", F.pmod(h, F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("bucket", F.expr("greatest(mine, other) * (greatest(mine, other) + 1) div 2 + least(mine, other)").alias("cell"), "fp")
    if pairs is not None:  # blocks' cells are not negative
        met = met.unionByName(pairs.select(F.xxhash64("a", "b").alias("bucket"), F.lit(-1).cast("long").alias("cell"), F.explode(F.array("a", "b")).alias("fp")))
    met = written(met, "cells")
    need = distinct.join(met.select("fp").distinct(), "fp").select("fp", "_row")
    texts = rows.join(need, "_row").select("fp", "text").mapInArrow(_sets(words), "fp long, own binary").dropDuplicates(["fp"])
    dealt = met.join(texts, "fp").repartition(parts, "bucket", "cell").sortWithinPartitions("bucket", "cell")
    return dealt.mapInArrow(_compare(similarity), "a long, b long")


def drop_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, cell: int = CELL, distance: int | None = None) -> DataFrame:
    """Keeps the row of the smallest ``doc_id`` of each group of near-duplicates; all columns stay.

    Texts are linked if the Jaccard similarity of their sets of word shingles is at least ``similarity``; a null or
    empty text, or one of white space, is linked to the others of that kind. Rows are told apart by ``doc_id`` and
    text: rows of one id and different texts are judged each by its text, and so are rows with a null ``doc_id``,
    which stay only where the whole group has no other (then one of them). Of repeated rows one stays. With ``distance``,
    texts whose SimHash fingerprints link within so many bits are candidates, too.
    """
    keyed = docs.select("doc_id", "text", row_key().alias("_row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole"))
    rows = written(keyed.select("doc_id", "_row", "text").mapInArrow(_described(words, distance is not None), "doc_id long, _row string, fp long, bands array<long>, sim long"), "described")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    distinct = written(rows.groupBy("fp").agg(least.alias("first"), F.first("bands").alias("bands")).select("fp", "first", F.col("first._row").alias("_row"), "bands"), "distinct")
    pairs = None if distance is None else fingerprint_pairs(rows, distance)
    groups = components(links(keyed.select("_row", "text"), distinct, words, similarity, cell, pairs))
    members = distinct.select("fp", "first").join(groups, distinct.fp == groups.node, "left").groupBy(F.coalesce("component", "fp")).agg(F.min("first").alias("first"))
    return keyed.join(members.select("first._row"), "_row", "left_semi").dropDuplicates(["_row"]).select("_whole.*")
