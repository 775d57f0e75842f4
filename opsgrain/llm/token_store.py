"""Op 4, token ids in a content-addressed store.

A rolling hash over the last few ids cuts each document's id stream into chunks, so that equal passages are
cut alike wherever they stand. The store is three tables:

* ``data/table=chunks``: key (the digest), n, ids (little-endian; 16 bits where the vocabulary allows it): each distinct
  chunk once;
* ``recipes``: documents in ascending ``doc_id`` order: doc_id, part, nth (in the part), local_start, n_tokens, digests,
  sizes, root, where root is the root of a Merkle tree over the document's chunk digests, and part_root at the last
  document of a part;
* ``manifest``: part, start, documents, root: where each part of the recipes begins in the stream of all ids,
  and the root of the Merkle tree over its documents' roots.

Ids cross the network once: tasks encode, cut and hash, leave out chunks that they have sent before, and send the
others to where the first of each digest is written. A part holds about :data:`PART` ids; its tree is folded as its
documents go by.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsgrain.llm.common import delete
from opsgrain.llm.tokens import encoder

#: Ids in the rolling window, and the least, usual and greatest number of ids in a chunk.
WINDOW, LEAST, USUAL, MOST = 16, 128, 512, 4096
#: Documents that a task encodes at once.
SLICE = 2000
#: Ids in a part of the recipes, about.
PART = 1 << 26
CUT = "table string, key binary, n int, ids binary, doc_id long, n_tokens long, digests array<binary>, sizes array<int>, root binary"
ORDERED = "part int, nth long, local_start long, doc_id long, n_tokens long, digests array<binary>, sizes array<int>, root binary, part_root binary"
_POWER = 0x9E3779B1


def _joined(a: bytes, b: bytes) -> bytes:
    return hashlib.sha256(b"\1" + a + b).digest()


class Merkle:
    """The root of a binary Merkle tree over leaves that come one by one; it holds one hash for each level.

    Leaves and inner nodes are hashed apart, an odd last node moves up.
    """

    def __init__(self):
        self.count, self.whole = 0, []

    def add(self, leaf: bytes) -> None:
        node, n = hashlib.sha256(b"\0" + leaf).digest(), self.count
        while n & 1:
            node, n = _joined(self.whole.pop(), node), n >> 1
        self.whole.append(node)
        self.count += 1

    def root(self) -> bytes:
        if not self.whole:
            return hashlib.sha256(b"").digest()
        out = self.whole[-1]
        for node in self.whole[-2::-1]:
            out = _joined(node, out)
        return out


def merkle(leaves: list[bytes]) -> bytes:
    """The root over all leaves."""
    if len(leaves) == 1:
        return hashlib.sha256(b"\0" + leaves[0]).digest()
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2^32."""
    with np.errstate(over="ignore"):
        return tuple(np.full(n, x, np.uint32).cumprod(dtype=np.uint32) for x in (_POWER, pow(_POWER, -1, 1 << 32)))


def boundaries(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each stream ``ids[bounds[i]:bounds[i + 1]]``, from the stream's own beginning.

    The hash of a window is a polynomial of its ids modulo 2^32, taken from one running sum; a chunk may end
    where its top bits are zero.
    """
    n = len(ids)
    power, back = (x[:n] for x in _powers(1 << max(n, 1).bit_length()))
    with np.errstate(over="ignore"):
        value = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
        value ^= value >> np.uint32(15)
        value *= back
        sums = np.zeros(n + 1, np.uint32)
        np.cumsum(value, dtype=np.uint32, out=sums[1:])
        hashed = (sums[WINDOW:] - sums[:-WINDOW]) * power[WINDOW - 1 :] if n >= WINDOW else np.zeros(0, np.uint32)
        hashed ^= hashed >> np.uint32(16)
        hashed *= np.uint32(0xC2B2AE35)
    where = np.flatnonzero(hashed < np.uint32((1 << 32) // USUAL)) + WINDOW  # a chunk may end here
    first, last_of = np.searchsorted(where, bounds[:-1] + LEAST), np.searchsorted(where, bounds[1:])
    out = []
    for lo, hi, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), first.tolist(), last_of.tolist(), strict=True):
        ends, last = [], lo
        for at in where[i:j].tolist():
            if at - last < LEAST:
                continue
            ends.extend(x - lo for x in range(last + MOST, at, MOST))
            last = at
            ends.append(at - lo)
        ends.extend(x - lo for x in range(last + MOST, hi, MOST))
        ends.append(hi - lo)
        out.append(ends)
    return out


def _cut(tokenizer: str, end_id: int):
    """Rows of both kinds: a recipe for each document, and each chunk that the task has not sent before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, nth = encoder(tokenizer), TaskContext.get().partitionId(), 0
        kind = "<u2" if max(encode.library.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        width, sent = int(kind[-1]), set()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                ids, bounds = encode.batch(some.column("text").to_pylist())
                ids = np.insert(ids, bounds[1:], end_id).astype(kind)
                bounds = bounds + np.arange(len(bounds))
                data, recipes, keys, counts, chunks = memoryview(ids.tobytes()), [], [], [], []
                for lo, ends in zip(bounds.tolist(), boundaries(ids, bounds), strict=False):
                    digests, sizes, begin = [], [], 0
                    for end in ends:
                        chunk = data[(lo + begin) * width : (lo + end) * width]
                        digest = hashlib.sha256(chunk).digest()
                        digests.append(digest)
                        sizes.append(end - begin)
                        if digest not in sent:
                            sent.add(digest)
                            keys.append(digest)
                            counts.append(end - begin)
                            chunks.append(chunk)
                        begin = end
                    recipes.append((ends[-1], digests, sizes, merkle(digests)))
                n_tokens, digests, sizes, roots = zip(*recipes, strict=True) if recipes else ([],) * 4
                n, m = len(recipes), len(keys)
                keys += [b"%d %d" % (part, nth + i) for i in range(n)]
                nth += n
                columns = [
                    pa.array(["chunks"] * m + ["cut"] * n), pa.array(keys, pa.binary()), pa.array(counts + [None] * n, pa.int32()), pa.array(chunks + [None] * n, pa.binary()),
                    pa.concat_arrays([pa.nulls(m, pa.int64()), some.column("doc_id").cast(pa.int64())]), pa.array([None] * m + list(n_tokens), pa.int64()),
                    pa.array([None] * m + list(digests), pa.list_(pa.binary())), pa.array([None] * m + list(sizes), pa.list_(pa.int32())), pa.array([None] * m + list(roots), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CUT.split(", ")])

    return run


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each key; all rows of one are in one task, one from each task that had it."""
    seen: set[bytes] = set()
    for batch in batches:
        keys = batch.column("key").to_pylist()
        fresh = [k not in seen and not seen.add(k) for k in keys]
        yield batch if all(fresh) else batch.filter(pa.array(fresh, pa.bool_()))


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the part and its documents, counts the ids before each, and folds the part's tree."""
    part, before, nth, tree, held = TaskContext.get().partitionId(), 0, 0, Merkle(), None

    def out(last: bool) -> pa.RecordBatch:
        roots = [None] * held[0].num_rows
        if last:
            roots[-1] = tree.root()
        n = held[0].num_rows
        columns = [pa.array(np.full(n, part, np.int32)), pa.array(held[2] + np.arange(n)), pa.array(held[1]), *held[0].columns, pa.array(roots, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ORDERED.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            yield out(False)
        n = batch.column("n_tokens").to_numpy()
        held = (batch, before + np.cumsum(n) - n, nth)
        before, nth = before + int(n.sum()), nth + len(n)
        for root in batch.column("root").to_pylist():
            tree.add(root)
    if held:
        yield out(True)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encodes whole texts (null: empty), appends ``end_id`` to each, and writes the store at ``path``.

    ``docs`` needs ``doc_id`` and ``text``. Repeated rows are documents of their own, next to each other;
    rows with a null ``doc_id`` come first. An empty table gives empty files.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, end_id), CUT).repartition(tasks, "key").mapInArrow(_first, CUT)
    rows.write.option("compression", "zstd").partitionBy("table").parquet(f"{path}/data")
    whole = spark.read.schema(CUT).parquet(f"{path}/data").where("table = 'cut'")
    total = whole.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    recipes = whole.repartitionByRange(max(tasks, -(-total // PART)), "doc_id", "root", "key").sortWithinPartitions("doc_id", "root")
    recipes = recipes.select("doc_id", "n_tokens", "digests", "sizes", "root").mapInArrow(_ordered, ORDERED)
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    delete(spark, f"{path}/data/table=cut")
    ends = spark.read.schema(ORDERED).parquet(f"{path}/recipes").where("part_root is not null")  # a row for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("local_start") + F.col("n_tokens")).over(before), F.lit(0))
    manifest = ends.select("part", start.alias("start"), (F.col("nth") + 1).alias("documents"), F.col("part_root").alias("root"))
    manifest.write.option("compression", "zstd").parquet(f"{path}/manifest")


def checked_parts(spark: SparkSession, path: str) -> DataFrame:
    """``part, documents, verified``: whether the manifest's root and count follow from the recipes of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree = None, Merkle()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tree.count], pa.int64()), pa.array([tree.root()], pa.binary())], ["part", "found", "found_root"])
        for batch in batches:
            for p, root in zip(batch.column("part").to_pylist(), batch.column("root").to_pylist(), strict=True):
                if p != part:
                    if part is not None:
                        yield out()
                    part, tree = p, Merkle()
                tree.add(root)
        if part is not None:
            yield out()

    recipes = spark.read.schema(ORDERED).parquet(f"{path}/recipes").select("part", "nth", "root")
    folded = recipes.repartition("part").sortWithinPartitions("part", "nth").mapInArrow(run, "part int, found long, found_root binary")
    same = (F.col("root") == F.col("found_root")) & (F.col("documents") == F.col("found"))
    return spark.read.parquet(f"{path}/manifest").join(folded, "part", "left").select("part", "documents", F.coalesce(same, F.lit(False)).alias("verified"))


@lru_cache(maxsize=1 << 16)
def _shift(n: int) -> int:
    """x to the power 8n modulo the CRC-32 polynomial, in CRC bit order."""
    out, square, n = 1 << 31, 1 << 30, 8 * n
    while n:
        if n & 1:
            out = _times(out, square)
        square, n = _times(square, square), n >> 1
    return out


def _times(a, b):
    """Products of polynomials modulo the CRC-32 polynomial, in CRC bit order; numbers or arrays."""
    out = b * 0
    for bit in range(31, -1, -1):
        out ^= b * (a >> bit & 1)
        b = b >> 1 ^ (b & 1) * 0xEDB88320
    return out


def joined_crc32(first, second, second_bytes):
    """The CRC-32 of two strings one after the other, from their own; numbers, or arrays of unsigned 64-bit."""
    if isinstance(first, np.ndarray):
        shift = np.fromiter(map(_shift, second_bytes.tolist()), np.uint64, len(second_bytes))
        return _times(shift, first) ^ second
    return _times(_shift(second_bytes), first) ^ second


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes, ids = (batch.column(c).to_pylist() for c in ("digest", "n", "ids"))
        crc = [zlib.crc32(np.frombuffer(x, f"<u{len(x) // n}").astype("<u4")) for x, n in zip(ids, sizes, strict=True)]
        ok = [hashlib.sha256(x).digest() == d for x, d in zip(ids, digests, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest").cast(pa.binary()), batch.column("n"), pa.array(crc, pa.int64()), pa.array(ok, pa.bool_())], ["digest", "n", "crc", "ok"]
        )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("chunks")
        bounds, items = lists.offsets.to_numpy(), lists.values
        crc, n, ok = (items.field(c).to_numpy(zero_copy_only=False) for c in ("crc", "n", "ok"))
        digests = items.field("digest").to_pylist()
        crc, bounds = crc.astype(np.uint64), bounds.astype(np.int64)
        sums, here, at = np.zeros(len(lists), np.uint64), np.arange(len(lists)), bounds[:-1]
        while len(here := here[at[here] < bounds[here + 1]]):  # the next chunk of each document that has one
            k = at[here]
            sums[here] = joined_crc32(sums[here], crc[k], 4 * n[k].astype(np.int64))
            at = at + 1
        oks = [
            bool(ok[a:b].all()) and merkle(digests[a:b]) == root
            for a, b, root in zip(bounds, bounds[1:], batch.column("root").to_pylist(), strict=False)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums.astype(np.int64)), pa.array(oks, pa.bool_())],
            ["doc_id", "start", "n_tokens", "ids_crc32", "verified"],
        )


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(CUT).parquet(f"{path}/data").where("table = 'chunks'")
    return rows.select(F.col("key").alias("digest"), "n", "ids")


def _starts(spark: SparkSession, path: str) -> DataFrame:
    manifest = spark.read.parquet(f"{path}/manifest").select("part", "start")
    recipes = spark.read.schema(ORDERED).parquet(f"{path}/recipes")
    return recipes.join(manifest, "part").withColumn("start", F.col("start") + F.col("local_start"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Reads a store back: doc_id, start, n_tokens, ids_crc32, verified.

    Each chunk is read, checked against its digest and summed once; a document's checksum is put together
    from those of its chunks, so that no ids are shuffled. ``verified`` also asks that the document's Merkle
    root follows from its chunks. A chunk that very many documents share is one key of the join, which adaptive
    execution splits; what is joined to it is one row.
    """
    chunks = _chunks(spark, path).mapInArrow(_checked, "digest binary, n int, crc long, ok boolean")
    refs = _starts(spark, path).select("doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("at", "digest"))
    found = refs.join(chunks, "digest", "left").groupBy("start", "doc_id").agg(
        F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"),
        F.sort_array(F.collect_list(F.struct("at", "digest", "n", "crc", "ok"))).alias("chunks"),
    )
    return found.mapInArrow(_summed, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Rebuilds the id stream of each document: doc_id, start, ids (array of long), from its recipe."""
    refs = _starts(spark, path).select("doc_id", "start", F.posexplode("digests").alias("at", "digest"))
    whole = refs.join(_chunks(spark, path), "digest").groupBy("start", "doc_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "n", "ids"))).alias("chunks")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [
                np.concatenate([np.frombuffer(c["ids"], f"<u{len(c['ids']) // c['n']}") for c in x]).astype(np.int64)
                for x in batch.column("chunks").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"]
            )

    return whole.mapInArrow(run, "doc_id long, start long, ids array<long>")
