"""Op 3, best-fit packing: documents' token ids into as few sequences of a fixed length as can be.

The packing is planned on the counts of each length alone, which the sequence length bounds, whatever the
number of documents. Linear grouping: the large lengths, in falling order, are dealt into groups of equal
cardinality, and each is rounded up to the largest of its group. Few sizes are left; the fractional optimum
over their configurations is found by column generation and rounded down. Then documents' own lengths stand
in for the rounded ones, and what is left, the small lengths included, goes by falling length to the
fullest sequence that still holds it. The plan is a list of runs, each of which places the next documents
of one length in consecutive sequences; a document finds its run by its rank within its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsgrain.llm.common import written
from opsgrain.llm.tokens import encoder

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, file string, row long, nth long"
)
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


#: Documents of one stretch of a table that is packed in its own order, at most.
SEGMENT = 20_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, follow: bool = False) -> DataFrame:
    """Token counts and checksums of each document's pieces, with the task (``file``) and their rank by length in it.

    Null and empty texts are one piece that holds the end id alone. Texts are encoded whole; one of more
    than ``capacity`` ids is cut into pieces of that length, of which the last may be shorter. With ``follow``, ``file``
    and ``row`` say where the document stands in the table's files instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task = encoder(tokenizer), np.zeros(capacity + 1, np.int64), f"{TaskContext.get().partitionId():010d}"
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                ids, bounds = encode.batch(some.column("text").to_pylist())
                if follow:
                    places = list(zip(some.column("_file").to_pylist(), some.column("_row").to_pylist(), strict=True))
                else:
                    places = [(task, 0)] * some.num_rows
                rows = []
                for doc, place, lo, hi in zip(some.column("doc_id").to_pylist(), places, bounds, bounds[1:], strict=False):
                    data = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4").tobytes()
                    for k, cut in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[cut : cut + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc, k, cut // 4, n, zlib.crc32(own), *place, int(seen[n])))
                        seen[n] += 1
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                names = [x.split()[0] for x in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    place = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")] if follow else []
    return docs.select("doc_id", "text", *place).mapInArrow(run, PIECES)


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """How often to use which configuration of the sizes, by column generation, rounded down."""
    n, need = len(sizes), np.array(counts, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    most = capacity // min(sizes)
    for _ in range(50 * n + 100):
        amount = np.linalg.solve(basis, need)
        worth = np.linalg.solve(basis.T, np.ones(n))
        best, how = [np.zeros(capacity + 1)], []
        for _ in range(most):  # the best sum of worths with one more item, for each room
            grown, by = best[-1].copy(), np.full(capacity + 1, -1)
            for g, s in enumerate(sizes):
                with_it = best[-1][: capacity + 1 - s] + worth[g]
                better = with_it > grown[s:] + 1e-12
                grown[s:][better], by[s:][better] = with_it[better], g
            best.append(grown)
            how.append(by)
        if best[-1][capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        for by in reversed(how):
            if (g := by[room]) >= 0:
                column[g] += 1
                room -= sizes[g]
        share = np.linalg.solve(basis, column)
        ratio = np.where(share > 1e-9, np.maximum(amount, 0) / np.where(share > 1e-9, share, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, ratio.argmin()] = column
    amount = np.floor(np.linalg.solve(basis, need) + 1e-7)
    return [(basis[:, j].astype(int).tolist(), int(x)) for j, x in enumerate(amount) if x > 0]


def plan(lengths: dict[int, int], capacity: int, groups: int = 48, small: float = 0.125) -> dict[str, np.ndarray]:
    """Runs ``length, first, bin, each, offset``: from the ``first``-th document of that length on, ``each``
    documents go to sequence ``bin``, the next ``each`` to the next one, the first of them at ``offset``.

    ``lengths`` has the number of documents of each length. Lengths of over ``small`` times the capacity are
    grouped. Also returns ``bins``, the number of sequences.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    first: dict[int, int] = defaultdict(int)
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: first sequence, number
    bins = 0

    def put(length: int, n: int, to: int, each: int, offset: int) -> None:
        runs.append((length, first[length], to, each, offset))
        first[length] += n

    left = {k: int(v) for k, v in lengths.items() if v > 0}
    large = sorted((k for k in left if k > small * capacity), reverse=True)
    if large:
        size = -(-sum(left[k] for k in large) // groups)
        grouped: list[list[list[int]]] = []  # of each group: length and number, from the longest on
        room = 0
        for k in large:
            n = left[k]
            while n:
                if not room:
                    grouped.append([])
                    room = size
                now = min(n, room)
                grouped[-1].append([k, now])
                n, room = n - now, room - now
        used = configurations([g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped], capacity)
        for column, times in used:
            blocks = [(bins, times, 0)]
            bins += times
            for g in (g for g, k in enumerate(column) for _ in range(k)):
                after = []
                for at, n, filled in blocks:
                    while n and grouped[g]:
                        k, there = grouped[g][0]
                        now = min(n, there)
                        put(k, now, at, 1, filled)
                        left[k] -= now
                        after.append((at, now, filled + k))
                        at, n = at + now, n - now
                        grouped[g][0][1] -= now
                        if now == there:
                            grouped[g].pop(0)
                    if n:
                        after.append((at, n, filled))
                blocks = after
            for at, n, filled in blocks:
                free[capacity - filled].append((at, n))
    rooms = np.array([len(x) for x in free])
    for k in sorted(left, reverse=True):
        while n := left[k]:
            open_rooms = np.flatnonzero(rooms[k:])
            if len(open_rooms):
                room = k + int(open_rooms[0])
                at, there = free[room].pop()
                rooms[room] -= 1
            else:
                room, at, there = capacity, bins, -(-n // (capacity // k))
                bins += there
            each = room // k
            whole = min(there, n // each)
            if whole:
                put(k, whole * each, at, each, capacity - room)
                free[room - each * k].append((at, whole))
                rooms[room - each * k] += 1
                left[k] -= whole * each
            at, there, n = at + whole, there - whole, left[k]
            if there and n:  # fewer are left than one sequence holds
                put(k, n, at, n, capacity - room)
                free[room - n * k].append((at, 1))
                rooms[room - n * k] += 1
                left[k], at, there = 0, at + 1, there - 1
            if there:
                free[room].append((at, there))
                rooms[room] += 1
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "bin", "each", "offset"), table.T, strict=True)) | {"bins": bins}


def fewest(lengths: dict[int, int], capacity: int, groups: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The plan with the fewest sequences of those by these numbers of groups; the first of several, and none are tried
    once a plan has as few as the sum of all lengths allows."""
    least = -(-sum(k * v for k, v in lengths.items() if v > 0) // capacity)
    best: dict | None = None
    for n in groups:
        now = plan(lengths, capacity, n)
        best = now if best is None or now["bins"] < best["bins"] else best
        if best["bins"] <= least:
            break
    return best


def _located(runs: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the documents of these lengths and ranks within them."""
    run = np.searchsorted((runs["length"] << 44) | runs["first"], (length << 44) | rank, "right") - 1
    nth, each = rank - runs["first"][run], runs["each"][run]
    return runs["bin"][run] + nth // each, runs["offset"][run] + nth % each * length


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, groups: tuple[int, ...] = (16, 48)) -> DataFrame:
    """Packs all documents; one row per piece with its place. The best plan of several numbers of ``groups`` is taken.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Repeated rows are documents of their
    own; pieces of one document may go to different sequences. An empty table gives an empty result. What
    comes to the driver is one count per length, of at most ``capacity`` lengths.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = written(cut.groupBy("file", "length").count(), "piece_counts")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(fewest(lengths, capacity, groups))
    before = Window.partitionBy("length").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("file", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("base").to_numpy() + batch.column("nth").to_numpy()
            sequence, offset = _located(shared.value, batch.column("length").to_numpy(), rank)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)],
                [x.split()[0] for x in PLACED.split(", ")],
            )

    return cut.join(base, ["file", "length"]).mapInArrow(place, PLACED)


def pack_in_order(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, groups: int = 16) -> DataFrame:
    """As :func:`pack`, for a table read from Parquet files that were written in an order to keep.

    Stretches of at most :data:`SEGMENT` rows of one file are packed each on its own, by the same plan, and numbered
    in the order of files and rows: the documents of a sequence come from one stretch, and sequences follow the table.
    A stretch that is not the last may leave one sequence part empty.
    """
    cut = written(pieces(docs, tokenizer, capacity, end_id, follow=True), "pieces")
    segment = F.format_string("%s %012d", F.col("file"), F.expr(f"row div {SEGMENT}"))
    cut = cut.withColumn("segment", segment)
    # a row for each segment
    numbers = cut.select("segment").distinct().withColumn("number", F.row_number().over(Window.orderBy("segment")).cast("long"))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        length = table["length"].to_numpy()
        rank = np.arange(len(length)) - np.searchsorted(length, length)
        sizes, counts = np.unique(length, return_counts=True)
        runs = plan(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), capacity, groups)
        sequence, offset = _located(runs, length, rank)
        sequence = sequence + (table["number"].to_numpy() << 32)
        columns = [table[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)]
        return pa.Table.from_arrays(columns, [x.split()[0] for x in PLACED.split(", ")])

    return cut.join(numbers, "segment").groupBy("segment").applyInArrow(place, PLACED)
