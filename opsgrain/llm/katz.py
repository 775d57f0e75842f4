"""Op 7, language-model scores by a Katz backoff model of word pairs.

Counts of words and of word pairs are discounted by Good-Turing; what a context's seen pairs leave goes to the
words not seen after it, in proportion to their own probability, by a backoff weight that makes the sum over
the vocabulary and the unknown word exactly one. Words of any count are kept, and pairs from the count
``lowest`` on: with 1 all, with 2 those seen once count as not seen (they only tell how much to leave), which is
the smaller variant that Katz suggests. A word is evaluated recursively: by its
pair with the word before it if that was kept, else by the backoff weight of that word times its own
probability, and that of the unknown word if it was never seen.

A text's sum is the same taken apart by key: each word adds its own log probability and its log backoff weight
for the word after it, and each kept pair adds what it is worth more. So a text asks for words and pairs by
key alone. Tasks send their keys sorted and packed in blocks to where the table's part for those keys is;
the answer is a sum for each document of the block. Entries that make up over 1 in ``COMMON`` of all tokens
are at most ``COMMON`` by that, go to every task, and are never sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgrain.llm.common import batches_of, discard, released, written

#: Counts up to which Good-Turing discounts apply.
DISCOUNTED = 5
COMMON = 20_000
#: Characters of text that are packed together at least, unless the task has less.
BLOCK = 6_000_000
_END, _START = b"\n", b" "  # white space is no word


def training(column):
    """Documents that the model learns from."""
    return F.crc32(column.cast("string").cast("binary")) % 7 != 2


def _hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word, 42)




def _marks() -> tuple[np.uint64, np.uint64]:
    return np.uint64(_hash(_END)), np.uint64(_hash(_START))


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The key of a pair: v is a word's hash, w the upper 48 bits of one."""
    with np.errstate(over="ignore"):
        x = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _planes(x: np.ndarray, width: int) -> bytes:
    """An array's bytes, lowest of all first, up to ``width`` of each, which compresses sorted keys and small counts well."""
    return zstandard.compress(np.ascontiguousarray(x.astype(x.dtype.newbyteorder("<")).view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :width].T).tobytes(), 1)


def _unplanes(data: bytes, width: int, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = raw.T
    return out.view(kind).ravel()


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= 200_000:
            self.clear()
        self[word] = out = _hash(word)
        return out


_known = _Hashes()


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of all texts and of the end; the texts' words by number, each text closed by the end; where each text begins
    (and the last ends)."""
    # an empty list of words splits to one empty string; those are taken out
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    coded = parts.values.dictionary_encode()
    named = [*coded.dictionary.cast(pa.binary()).to_pylist(), _END]
    words, bounds = coded.indices.to_numpy(), parts.offsets.to_numpy().astype(np.int64)
    if b"" in named:
        none = named.index(b"")
        del named[none]
        real = words != none
        words, bounds = (words - (words > none))[real], np.concatenate(([0], np.cumsum(real)))[bounds]
    types = np.fromiter(map(_known.__getitem__, named), np.uint64, len(named))
    return types, np.insert(words, bounds[1:], len(named) - 1), bounds + np.arange(len(bounds))


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text closed by the end's, and where each text begins (and the last ends)."""
    types, words, bounds = _coded(pa.array(texts, pa.large_string()))
    return types[words], bounds


def _before(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.roll(words, 1)
    out[bounds[:-1]] = _marks()[1]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str], together: int = BLOCK) -> Iterator[list[list]]:
    held, size = [[] for _ in columns], 0
    for some in (batch.slice(at, 1000) for batch in batches for at in range(0, batch.num_rows, 1000)):
        for row in zip(*(some.column(c).to_pylist() for c in columns), strict=True):
            for own, x in zip(held, row, strict=True):
                own.append(x)
            size += len(row[0])
            if size >= together or len(held[0]) >= 60_000:
                yield held
                held, size = [[] for _ in columns], 0
    if held[0]:
        yield held


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of one of each, and the sums of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), counts
    order = np.argsort(keys)
    keys = keys[order]
    at = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return keys[at], order[at], np.add.reduceat(counts[order], at)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in _blocks(batches, ["text"]):
            words, bounds = _tokens(texts)
            before, after = _before(words, bounds), words >> np.uint64(16)
            rows = []
            keys, _, n = _sums(words, np.ones(len(words), np.int64))
            to = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            for b in range(buckets):
                own = order[cuts[b] : cuts[b + 1]]
                rows.append((b, 0, _planes(keys[own], 8), b"", _planes(n[own].astype(np.uint32), 4)))
            _, at, n = _sums(_pair(before, after), np.ones(len(words), np.int64))
            v, w = before[at], after[at]
            # 64 buckets share a context, so that a frequent one spreads, and a task's pairs of one still meet
            to = (_pair(v, w >> np.uint64(42)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((v, to))
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            for b in range(buckets):
                own = order[cuts[b] : cuts[b + 1]]
                contexts, each = np.unique(v[own], return_counts=True)
                heads = _planes(contexts, 8)
                rows.append((b, 1, len(heads).to_bytes(4, "little") + heads + _planes(each.astype(np.uint32), 4), _planes(w[own], 6), _planes(n[own].astype(np.uint32), 4)))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int8(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "kind", "a", "b", "n"])

    return run


def _gather(lowest: int):
    def finish(kind, held):
        if not held:
            return
        if kind == 0:
            keys, _, n = _sums(np.concatenate([x[0] for x in held]), np.concatenate([x[2] for x in held]))
            out = (np.zeros(len(keys), np.int8), keys.view(np.int64), np.zeros(len(keys), np.int64), n, np.ones(len(keys), np.int64))
        else:
            v, w, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            _, at, n = _sums(_pair(v, w), n)
            kept = n >= lowest
            once = int(len(n) - kept.sum())
            v, w, n = v[at[kept]], w[at[kept]], n[kept]
            out = (np.ones(len(n), np.int8), v.view(np.int64), w.view(np.int64), n, np.ones(len(n), np.int64))
            if lowest > 1:  # those not kept count for the discounts
                out = tuple(np.append(x, np.array(last, x.dtype)) for x, last in zip(out, (2, 0, 0, 1, once), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["kind", "v", "w", "c", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for bucket, kind, a, b, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "a", "b", "n")), strict=True):
                if (bucket, kind) != group:
                    if group:
                        yield from finish(group[1], held)
                    group, held = (bucket, kind), []
                counts = _unplanes(n, 4, "<u4").astype(np.int64)
                if kind == 0:
                    held.append((_unplanes(a, 8, "<u8"), None, counts))
                else:
                    k = 4 + int.from_bytes(a[:4], "little")
                    each = _unplanes(a[k:], 4, "<u4")
                    held.append((np.repeat(_unplanes(a[4:k], 8, "<u8"), each), _unplanes(b, 6, "<u8"), counts))
        if group:
            yield from finish(group[1], held)

    return run


def _discounts(by_count: dict[int, int], lowest: int) -> list[float]:
    """Katz's discount ratios for counts up to :data:`DISCOUNTED`, from counts of counts; 1 below ``lowest``.

    Where a count of counts is missing or a ratio is not between 0 and 1, half a count is taken off.
    """
    n, out = lambda r: by_count.get(r, 0), [1.0]
    tail = (DISCOUNTED + 1) * n(DISCOUNTED + 1) / n(1) if n(1) else 0.0
    for r in range(1, DISCOUNTED + 1):
        d = ((r + 1) * n(r + 1) / (r * n(r)) - tail) / (1 - tail) if n(r) and n(r + 1) and tail < 1 else 0.0
        out.append(1.0 if r < lowest else d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _discounted(c, ratios: list[float]):
    ratio = F.lit(1.0)
    for r, d in enumerate(ratios):
        ratio = F.when(c == r, F.lit(d)).otherwise(ratio) if r else ratio
    return ratio * c


def train(docs: DataFrame, lowest: int = 2) -> dict:
    """A model of the pairs seen at least ``lowest`` times (1 or 2), from all rows of ``doc_id, text``: tables ``words`` (h, c, p, backoff) and ``pairs`` (v, w, c, worth),
    by hashes of words, and N, V, unknown, start (log10 backoff weight of a text's beginning)."""
    if lowest not in (1, 2):
        raise ValueError("pairs are kept from a count of 1 or 2 on")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count(parts), "bucket int, kind byte, a binary, b binary, n binary")
    dealt = sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    counts = written(dealt.mapInArrow(_gather(lowest), "kind byte, v long, w long, c long, n long"), "counts")
    released(spark)
    end, start = (int(x.view(np.int64)) for x in _marks())
    by_count = counts.groupBy("kind", F.least("c", F.lit(DISCOUNTED + 2)).alias("c")).agg(F.sum("n").alias("n"), F.sum("c").alias("total")).collect()
    total, types = sum(r["total"] for r in by_count if r["kind"] == 0), sum(r["n"] for r in by_count if r["kind"] == 0)
    singly = _discounts({r["c"]: r["n"] for r in by_count if r["kind"] == 0}, 1)
    doubly = _discounts({r["c"]: r["n"] for r in by_count if r["kind"] > 0}, lowest)
    kept = sum(r["total"] if r["c"] > DISCOUNTED else singly[r["c"]] * r["total"] for r in by_count if r["kind"] == 0)
    scale = min(1.0, total / (total + 1) * total / kept) if kept else 1.0  # something is always left
    unknown = 1 - kept * scale / total if total else 1.0
    words = counts.where("kind = 0").select(F.col("v").alias("h"), "c", (_discounted(F.col("c"), singly) * (scale / max(total, 1))).alias("p"))
    texts = words.where(F.col("h") == end).select(F.lit(start).alias("h"), "c")
    contexts = words.select("h", "c").unionByName(texts).select(F.col("h").alias("v"), F.col("c").alias("cv"))
    own = words.groupBy(F.shiftrightunsigned("h", 16).alias("w")).agg(F.sum("p").alias("p"))
    pairs = counts.where("kind = 1").select("v", "w", "c").join(own, "w").join(contexts, "v")
    pairs = written(pairs.select("v", "w", "c", "p", (_discounted(F.col("c"), doubly) / F.col("cv")).alias("q"), "cv"), "pairs")
    left = pairs.groupBy("v").agg(F.sum("q").alias("q"), F.sum("p").alias("p"), F.max("cv").alias("cv"))
    rest = F.greatest(1 - F.col("q"), 1 / (F.col("cv") + 1))
    left = written(left.select("v", ((1 - rest) / F.col("q")).alias("scale"), F.log10(rest / (1 - F.col("p"))).alias("backoff")), "backoff")
    worth = pairs.join(left, "v").select("v", "w", "c", (F.log10(F.col("q") * F.col("scale")) - F.col("backoff") - F.log10("p")).alias("worth"))
    worth = written(worth, "worth")
    full = words.join(left.select(F.col("v").alias("h"), "backoff"), "h", "left").select("h", "c", "p", F.coalesce("backoff", F.lit(0.0)).alias("backoff"))
    full = written(full, "words")
    for x in (counts, pairs):
        discard(x)
    first = left.where(F.col("v") == start).first()
    released(spark)
    return {"words": full, "pairs": worth, "N": total, "V": types, "unknown": unknown, "start": first["backoff"] if first else 0.0}


def _entries(buckets: int):
    """The model's entries by key, packed: words with their count and what they add, pairs with their worth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w, c, value, pair = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("v", "w", "c", "value", "pair"))
            v = v.view(np.uint64)
            keys = np.where(pair, _pair(v, w.view(np.uint64)), v)
            order = np.argsort(keys)
            keys, c, value = keys[order], c[order], value[order]
            to = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[b] : cuts[b + 1]]
                rows.append((int(b), 0, 0, _planes(keys[own], 8), _planes(c[own], 8), _planes(value[own], 8)))
            yield _packed(rows)

    return run


_SENT = "bucket int, kind byte, block long, a binary, b binary, c binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.int32(), pa.int8(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "kind", "block", "a", "b", "c"])


def _lookup(model: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray, facts: dict, pair: bool):
    """Base score, known (0 or 1) and score of each key."""
    table, c, value = model
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    hit = table[at] == keys if len(table) else np.zeros(len(keys), bool)
    if pair:
        return np.zeros(len(keys)), np.zeros(len(keys)), np.where(hit, value[at], 0.0) if len(table) else np.zeros(len(keys))
    count = np.where(hit, c[at], 0) if len(table) else np.zeros(len(keys))
    score = np.where(hit, value[at], np.log10(facts["unknown"])) if len(table) else np.full(len(keys), np.log10(facts["unknown"]))
    return np.log10((count + 1) / (facts["N"] + facts["V"] + 1)), hit.astype(float), score


def _ask(shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, facts = shared.value
        nth = TaskContext.get().partitionId() << 32
        for texts, ids, held in _blocks(batches, ["text", "doc_id", "held_out"]):
            words, bounds = _tokens(texts)
            doc = np.repeat(np.arange(len(texts), dtype=np.uint16), np.diff(bounds))
            own, rows = np.zeros((3, len(texts))), []
            own[2] += facts["start"]
            for kind, keys in ((1, words), (2, _pair(_before(words, bounds), words >> np.uint64(16)))):
                order = np.argsort(keys, kind="stable")
                keys, at = keys[order], doc[order]
                first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1)) if len(keys) else np.zeros(0, np.int64)
                each = np.diff(np.append(first, len(keys)))
                keys = keys[first]
                here = np.isin(keys, common[0], assume_unique=True)
                if here.any():
                    who = at[np.repeat(here, each)]
                    for k, x in enumerate(_lookup(common, keys[here], facts, kind == 2)):
                        own[k] += np.bincount(who, np.repeat(x, each[here]), len(texts))
                at, keys, each = at[np.repeat(~here, each)], keys[~here], each[~here]
                start = np.cumsum(each) - each
                to = (keys % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    mine = order[cuts[b] : cuts[b + 1]]
                    n = each[mine]
                    where = np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    rows.append((int(b), kind, nth, _planes(keys[mine], 8), _planes(n.astype(np.uint32), 4), _planes(at[where], 2)))
                yield _packed(rows)
                rows = []
            known = np.array([x is not None for x in ids])
            facts_of = np.concatenate((np.array([x or 0 for x in ids], "<i8").view("<f8"), known.astype(float), np.array(held, float), np.diff(bounds).astype(float)))
            rows.append((int(nth % buckets), 3, nth, facts_of.tobytes(), own.tobytes(), b""))
            nth += 1
            yield _packed(rows)

    return run


def _answer(facts: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, model = None, [], None
        for batch in batches:
            rows = []
            for b, kind, block, x, y, z in zip(*(batch.column(k).to_pylist() for k in ("bucket", "kind", "block", "a", "b", "c")), strict=True):
                if b != bucket:
                    bucket, parts, model = b, [], None
                if kind == 0:
                    parts.append((_unplanes(x, 8, "<u8"), _unplanes(y, 8, "<i8"), _unplanes(z, 8, "<f8")))
                    continue
                if kind == 3:
                    rows.append((0, 0, block, x, y, b""))
                    continue
                if model is None:
                    model = tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
                    order = np.argsort(model[0])
                    model, parts = tuple(p[order] for p in model), []
                keys, each, doc = _unplanes(x, 8, "<u8"), _unplanes(y, 4, "<u4"), _unplanes(z, 2, "<u2")
                found = _lookup(model, keys, facts, kind == 2)
                if kind == 2:
                    hit = np.repeat(found[2] != 0, each)
                    who, value = doc[hit], np.repeat(found[2], each)[hit]
                    docs, at = np.unique(who, return_inverse=True)
                    sums = np.zeros((3, len(docs)))
                    sums[2] = np.bincount(at, value, len(docs))
                else:
                    docs, at = np.unique(doc, return_inverse=True)
                    sums = np.stack([np.bincount(at, np.repeat(v, each), len(docs)) for v in found])
                if len(docs):
                    rows.append((0, kind, block, docs.astype("<u2").tobytes(), sums.tobytes(), b""))
            yield _packed(rows)

    return run


def _finish(facts: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, meta, sums = None, None, None

        def out():
            n = meta.shape[1]
            ids = pa.array(meta[0].view("<i8"), mask=meta[1] == 0)
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(meta[2] == 1), pa.array(meta[3].astype(np.int64)), pa.array(np.rint(sums[1]).astype(np.int64)), pa.array(np.full(n, facts["N"])), pa.array(sums[0].copy()), pa.array(sums[2].copy())],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for batch in batches:
            for kind, b, x, y in zip(*(batch.column(k).to_pylist() for k in ("kind", "block", "a", "b")), strict=True):
                if kind == 0:
                    if block is not None:
                        yield out()
                    block, meta = b, np.frombuffer(x, "<f8").reshape(4, -1)
                    sums = np.frombuffer(y, "<f8").reshape(3, -1).copy()
                else:
                    docs = np.frombuffer(x, "<u2")
                    sums[:, docs] += np.frombuffer(y, "<f8").reshape(3, -1)
        if block is not None:
            yield out()

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Each row's token counts and log10 probabilities under the base and the backoff model.

    ``docs`` needs ``doc_id, text``. A null or empty text has one token, its end. Repeated rows stay.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = {k: model[k] for k in ("N", "V", "unknown", "start")}
    words = model["words"].select(F.col("h").alias("v"), F.lit(0).cast("long").alias("w"), "c", (F.log10("p") + F.col("backoff")).alias("value"), F.lit(False).alias("pair"))
    pairs = model["pairs"].select("v", "w", "c", F.col("worth").alias("value"), F.lit(True).alias("pair"))
    entries = words.unionByName(pairs)
    often = entries.where(F.col("c") * COMMON > facts["N"]).toArrow()  # at most COMMON words and as many pairs
    v, w, c, value, pair = (often.column(k).to_numpy() for k in ("v", "w", "c", "value", "pair"))
    keys = np.where(pair.astype(bool), _pair(v.view(np.uint64), w.view(np.uint64)), v.view(np.uint64))
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast(((keys[order], c[order], value[order]), facts))
    held = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id", (~F.coalesce(training(F.col("doc_id")), F.lit(True))).alias("held_out"))
    asked = held.mapInArrow(_ask(shared, parts), _SENT)
    rest = entries.where(F.col("c") * COMMON <= facts["N"]).mapInArrow(_entries(parts), _SENT)
    met = rest.unionByName(asked).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    answers = met.mapInArrow(_answer(facts), _SENT).repartition(parts, "block").sortWithinPartitions("block", "kind")
    return answers.mapInArrow(_finish(facts), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_LISTS = "bucket int, kind byte, block long, a binary, b binary, c binary, d binary, e binary"
#: What rows of that form are: a block's texts, its words, its pairs, sums by its words, and counts of counts.
_HOME, _WORDS, _PAIRS, _SUMS, _TALLY = 0, 1, 2, 3, 10
#: Bytes of text whose words and pairs are asked for together, of text that is cut into words at once, and of a batch of rows that a task is sent.
TOGETHER, PIECE, BATCH = 8_000_000, 2_000_000, 4_000_000


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*(r + (b"",) * (8 - len(r)) for r in rows), strict=True)
    kinds = (pa.int32(), pa.int8(), pa.int64(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "kind", "block", *"abcde"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for some in (batch.slice(at, 100) for batch in batches for at in range(0, batch.num_rows, 100)):
        yield from zip(*(some.column(c).to_pylist() for c in ("bucket", "kind", "block", *"abcde")), strict=True)


def _steps(x: np.ndarray) -> bytes:
    """Keys as differences, which wrap around; sorted ones have their upper bytes small."""
    return _planes(np.diff(x, prepend=np.uint64(0)), 8)


def _unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, 8, "<u8"), dtype=np.uint64)


def _bits(x: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(x).tobytes(), 1)


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(data), np.uint8), count=n).astype(bool)


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by bucket and key, and where each bucket begins in it."""
    order = np.argsort(keys)
    to = (keys[order] % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.int64)
    by = np.argsort(to, kind="stable")
    return order[by], np.searchsorted(to[by], np.arange(buckets + 1))


def _pairs_of(words: np.ndarray, bounds: np.ndarray, start: int, types: int) -> np.ndarray:
    """Each token's pair, by the places of its two words."""
    before = np.roll(words, 1)
    before[bounds[:-1]] = start
    out = before.astype(np.int64)
    out *= types
    out += words
    return out


def _ranks(n: np.ndarray) -> np.ndarray:
    """Places of a block's words, the most frequent first: numbers of frequent words are small, and compress."""
    return np.argsort(-n, kind="stable")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Blocks of texts in pieces, which are words by number as soon as they are read: what :func:`_coded` has of a piece, ids and held-out marks."""
    block, size, docs = [], 0, 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, min(int(np.searchsorted(ends, before + PIECE, "right")), low + 10_000))
            texts, ids, held = (batch.column(c).slice(low, high - low) for c in ("text", "doc_id", "held_out"))
            block.append((*_coded(texts), ids.to_pylist(), held.to_numpy(zero_copy_only=False)))
            size, docs, low = size + ends[high - 1] - before, docs + high - low, high
            if size >= TOGETHER or docs >= 60_000:
                yield block
                block, size, docs = [], 0, 0
    if block:
        yield block


def _lists(buckets: int):
    """Each block's words and pairs by bucket with their counts in training texts, and what is needed to score its texts once
    the counts of all blocks are known: its tokens as numbers of its words."""

    def listed(block, nth):
        """The rows of a block; what was needed for them is let go before they are sent."""
        types = np.unique(np.concatenate([p[0] for p in block] + [_marks()[1:]]))
        order, cuts = _dealt(types, buckets)
        place = np.empty(len(types), np.int32)
        place[order] = np.arange(len(types), dtype=np.int32)
        hashes, words = types[order], np.concatenate([place[np.searchsorted(types, p[0])][p[1]] for p in block])
        start = int(place[np.searchsorted(types, _marks()[1])])
        lengths = np.concatenate([np.diff(p[2]) for p in block])
        ids, held = [i for p in block for i in p[3]], np.concatenate([p[4] for p in block])
        block.clear()
        bounds, train = np.concatenate(([0], np.cumsum(lengths))), np.repeat(~held, lengths)
        n, rows = np.bincount(words[train], minlength=len(types)).astype(np.uint32), []
        for b in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[b], cuts[b + 1])
            rows.append((int(b), _WORDS, nth, _steps(hashes[own]), _planes(n[own], 4)))
        n = np.bincount(words, minlength=len(types))
        rank = np.empty(len(types), np.uint32)
        rank[_ranks(n)] = np.arange(len(types), dtype=np.uint32)
        known = np.array([x is not None for x in ids], float)
        facts = np.concatenate((np.array([x or 0 for x in ids], "<i8").view("<f8"), known, held.astype(float), lengths.astype(float)))
        home = (((nth >> 32) + (nth & 0xFFFFFFFF)) % buckets, _HOME, nth, facts.tobytes(), _planes(rank[words], 4), _planes(n.astype(np.uint32), 4))
        codes = _pairs_of(words, bounds, start, len(types))
        del words
        codes <<= 1
        codes |= train
        codes.sort()
        at = np.concatenate(([0], np.flatnonzero((codes[1:] ^ codes[:-1]) > 1) + 1))
        n = np.add.reduceat(codes & 1, at).astype(np.uint32)
        codes = codes[at] >> 1
        keys = _pair(hashes[codes // len(types)], hashes[codes % len(types)] >> np.uint64(16))
        order, cuts = _dealt(keys, buckets)
        keys, n = keys[order], n[order]
        for b in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[b], cuts[b + 1])
            rows.append((int(b), _PAIRS, nth, _steps(keys[own]), _planes(n[own], 4)))
        return _listed([*rows, home])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nth, block in enumerate(_pieces(batches), TaskContext.get().partitionId() << 32):
            yield listed(block, nth)
        _known.clear()  # the worker goes on to tasks that need none

    return run


def _grouped(finish):
    """Rows in the order of bucket and kind, by lists of one bucket and kind; a block's own row passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for row in _rows(batches):
            if row[1] == _HOME:
                yield _listed([row])
                continue
            if row[:2] != group:
                if group:
                    yield finish(group, held)
                group, held = row[:2], []
            held.append(row[2:])
        if group:
            yield finish(group, held)

    return run


def _met(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of keys put together: their order, the first place of each distinct key in it, how many it has, and where each list ends."""
    ends = np.cumsum([len(k) for k in keys])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return order, at, np.diff(np.append(at, len(keys))), ends


def _counts_of_all(group: tuple, held: list[tuple]) -> pa.RecordBatch:
    """To each block the counts of its words or pairs in all blocks, in its order, which of them it is the first to have, and its words."""
    order, at, each, ends = _met([_unsteps(x[1]) for x in held])
    totals = np.add.reduceat(np.concatenate([_unplanes(x[2], 4, "<u4") for x in held]).astype(np.int64)[order], at)
    c, first = np.empty(len(order), np.int64), np.zeros(len(order), bool)
    c[order], first[order[at]] = np.repeat(totals, each), True
    rows, low = [], 0
    for x, end in zip(held, ends, strict=True):
        rows.append((*group, x[0], _planes(c[low:end], 8), _bits(first[low:end]), x[1] if group[1] == _WORDS else b""))
        low = end
    r = np.minimum(totals, DISCOUNTED + 2)
    tally = np.stack([np.bincount(r, minlength=DISCOUNTED + 3), [totals[r == i].sum() for i in range(DISCOUNTED + 3)]])
    return _listed([*rows, (group[0], _TALLY + group[1], -1, tally.astype("<i8").tobytes())])


def _sums_of_all(group: tuple, held: list[tuple]) -> pa.RecordBatch:
    """To each block the sums by its words over all blocks, in its order."""
    order, at, each, ends = _met([_unsteps(x[1]) for x in held])
    sums = []
    for i in (2, 3):
        out = np.empty(len(order))
        out[order] = np.repeat(np.add.reduceat(np.concatenate([_unplanes(x[i], 8, "<f8") for x in held])[order], at), each)
        sums.append(out)
    return _listed([(*group, x[0], *(_planes(s[end - n : end], 8) for s in sums)) for x, end, n in zip(held, ends, np.diff(ends, prepend=0), strict=True)])


def _by_block(finish):
    """Rows in the order of block, kind and bucket, by block: its own row, and lists by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, lists = None, {}
        for row in _rows(batches):
            if row[1] == _HOME:
                if home:
                    yield finish(home, lists)
                home, lists = row, {}
            else:
                lists.setdefault(row[1], []).append(row)
        if home:
            yield finish(home, lists)

    return run


def _discounted_counts(c: np.ndarray, ratios: list[float]) -> np.ndarray:
    return np.where(c <= DISCOUNTED, np.array(ratios)[np.minimum(c, DISCOUNTED)], 1.0) * c


def _score_by_counts(facts: dict, buckets: int):
    """All of a block's scores that counts tell, and sums by context over those pairs that no block before it has."""

    def finish(home, lists):
        _, _, block, texts, tokens, counts = home[:6]
        meta = np.frombuffer(texts, "<f8").reshape(4, -1)
        bounds = np.concatenate(([0], np.cumsum(meta[3].astype(np.int64))))
        hashes = np.concatenate([_unsteps(x[5]) for x in lists[_WORDS]])
        n = _unplanes(counts, 4, "<u4").astype(np.int64)
        words = _ranks(n).astype(np.int32)[_unplanes(tokens, 4, "<u4")]
        start, end = (int(np.flatnonzero(hashes == x)[0]) for x in _marks()[::-1])
        codes, pair = np.unique(_pairs_of(words, bounds, start, len(hashes)), return_inverse=True)
        pair = pair.astype(np.int32)
        v, w = (x.astype(np.int32) for x in np.divmod(codes, len(hashes)))
        del codes
        order, _ = _dealt(_pair(hashes[v], hashes[w] >> np.uint64(16)), buckets)
        c, first, low = np.empty(len(order), np.int64), np.empty(len(order), bool), 0
        for x in lists.pop(_PAIRS):
            some = _unplanes(x[3], 8, "<i8")
            at = order[low : low + len(some)]
            c[at], first[at], low = some, _unbits(x[4], len(some)), low + len(some)
        del order
        own = np.concatenate([_unplanes(x[3], 8, "<i8") for x in lists[_WORDS]])
        p = _discounted_counts(own, facts["singly"]) * (facts["scale"] / max(facts["N"], 1))
        hit = c >= facts["lowest"]
        less = _discounted_counts(c, facts["doubly"])
        with np.errstate(divide="ignore"):
            alone, together = np.log10(np.where(own > 0, p, facts["unknown"])), np.log10(less)
        hits = hit[pair]
        per_doc = lambda x: np.add.reduceat(x, bounds[:-1])
        sums = np.stack([
            per_doc(np.log10((own + 1) / (facts["N"] + facts["V"] + 1))[words]), per_doc((own > 0).astype(float)[words]), per_doc(np.where(hits, together[pair], alone[words]))
        ])
        mine = hit & first
        q, s = (np.bincount(v[mine], x[mine], len(hashes)) for x in (less, p[w]))
        cuts = np.searchsorted((hashes % np.uint64(buckets)).astype(np.int64), np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[b], cuts[b + 1])
            rows.append((int(b), _SUMS, block, _steps(hashes[part]), _planes(q[part], 8), _planes(s[part], 8)))
        own[start] = own[end]  # texts begin as often as they end
        return _listed([*rows, (-1, _HOME, block, np.concatenate((meta, sums)).tobytes(), tokens, counts, _planes(own, 8), _bits(hits))])

    return _by_block(finish)


def _score_by_contexts(facts: dict):
    """Adds what the contexts of a block's tokens are worth, by the sums over all their pairs."""

    def finish(home, lists):
        meta = np.frombuffer(home[3], "<f8").reshape(7, -1)
        bounds = np.concatenate(([0], np.cumsum(meta[3].astype(np.int64))))
        n, c = _unplanes(home[5], 4, "<u4").astype(np.int64), np.maximum(_unplanes(home[6], 8, "<i8"), 1)
        before = np.roll(_ranks(n)[_unplanes(home[4], 4, "<u4")], 1)
        before[bounds[:-1]] = np.flatnonzero(n == 0)[0]  # the mark of a text's beginning is the one that no text has
        q, p = (np.concatenate([_unplanes(x[i], 8, "<f8") for x in lists[_SUMS]]) for i in (3, 4))
        some = q > 0
        q, p = np.where(some, q / c, 0.5), np.where(some, p, 0.0)
        rest = np.maximum(1 - q, 1 / (c + 1))
        kept, backoff = np.log10((1 - rest) / q / c), np.where(some, np.log10(rest / (1 - p)), 0.0)
        score = meta[6] + np.add.reduceat(np.where(_unbits(home[7], len(before)), kept[before], backoff[before]), bounds[:-1])
        ids = pa.array(np.ascontiguousarray(meta[0]).view("<i8"), mask=meta[1] == 0)
        known, tokens = np.rint(meta[5]).astype(np.int64), meta[3].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(meta[2] == 1), pa.array(tokens), pa.array(known), pa.array(np.full(len(tokens), facts["N"])), pa.array(meta[4].copy()), pa.array(score)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return _by_block(finish)


def learn_and_score(docs: DataFrame, lowest: int = 2) -> DataFrame:
    """Trains on the training rows (a null ``doc_id`` is one) and scores all: what :func:`score` gives with :func:`train`'s model.

    The texts are read once and the model is never a table of its own. A block of texts sends its words and pairs as keys
    with its counts, and gets back their counts in all blocks, in its own order. With them it sums, over the pairs that no block before
    it has, what each context keeps and what its words have alone, sends the sums by word, and gets those of all blocks.
    """
    if lowest not in (1, 2):
        raise ValueError("pairs are kept from a count of 1 or 2 on")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id", (~F.coalesce(training(F.col("doc_id")), F.lit(True))).alias("held_out"))
    sent = rows.mapInArrow(_lists(parts), _LISTS).repartitionById(parts, "bucket").sortWithinPartitions("bucket", "kind")
    with batches_of(spark, BATCH):
        counted = written(sent.mapInArrow(_grouped(_counts_of_all), _LISTS), "counts", "none")
    tallies = {k: np.zeros((2, DISCOUNTED + 3), np.int64) for k in (_WORDS, _PAIRS)}
    for r in counted.where(F.col("kind") > _TALLY).select("kind", "a").toLocalIterator():  # two rows of counts of counts from each bucket
        tallies[r["kind"] - _TALLY] += np.frombuffer(r["a"], "<i8").reshape(2, -1)
    (n, each), (doubles, _) = tallies[_WORDS], tallies[_PAIRS]
    total, types = int(each.sum()), int(n[1:].sum())
    singly, doubly = (_discounts({r: int(x[r]) for r in range(1, len(x)) if x[r]}, k) for x, k in ((n, 1), (doubles, lowest)))
    kept = sum(float(each[r]) * (singly[r] if r <= DISCOUNTED else 1.0) for r in range(1, len(each)))
    scale = min(1.0, total / (total + 1) * total / kept) if kept else 1.0  # something is always left
    facts = {"N": total, "V": types, "unknown": 1 - kept * scale / total if total else 1.0, "scale": scale, "singly": singly, "doubly": doubly, "lowest": lowest}
    released(spark)
    by_block = lambda df: df.repartition(parts, "block").sortWithinPartitions("block", "kind", "bucket")
    with batches_of(spark, BATCH):
        scored = written(by_block(counted.where(F.col("kind") < _TALLY)).mapInArrow(_score_by_counts(facts, parts), _LISTS), "scored", "none")
    discard(counted)
    spark.range(1).count()  # Spark lets go of a job's plan when another has run
    released(spark)
    summed = scored.where(F.col("kind") == _SUMS).repartitionById(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_grouped(_sums_of_all), _LISTS)
    scores = by_block(scored.where(F.col("kind") == _HOME).unionByName(summed)).mapInArrow(
        _score_by_contexts(facts), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    with batches_of(spark, BATCH):
        out = written(scores, "scores")
    discard(scored)
    return out
