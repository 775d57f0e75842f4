"""Periodic runs of words, by internal pattern matching.

Words of many texts are numbered together. Prefix doubling gives the suffix array and, for each power of two, the names
of all factors of that length; a factor's occurrences are an interval of the suffix array. A run with period q contains a
block of a fixed power-of-two length b, at a multiple of b/2, that occurs again q words later; so each block asks for
its occurrences in the window behind it. A wavelet matrix over the suffix array answers the next occurrence from a place
on. Occurrences no more than b/2 apart have the block's period as difference and are one progression, which ends where
that period ends. Distances are candidate periods; each is extended both ways by names of factors, so runs are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are numbered together; a longer text is taken alone.
WORDS = 400_000
#: The shortest run and the least blocks.
SHORTEST, BLOCK = 12, 4
FOUND = "struct<start:bigint,length:bigint,period:bigint>"


class Names:
    """Names of the factors of lengths 1, 2, 4, ... of all texts, and the suffix array.

    A name is the first place of the factor's interval in the suffix array, so suffixes that are told apart keep theirs.
    Texts are told apart from the start. A factor that would reach beyond its text has a name of its own.
    """

    def __init__(self, word: np.ndarray, text: np.ndarray) -> None:
        n = len(word)
        key = text * (int(word.max(initial=0)) + 1) + word
        self.array = np.argsort(key, kind="stable").astype(np.int32)
        name = np.empty(n, np.int32)
        name[self.array] = _firsts(key[self.array])
        self.names = [name]
        # the bounds of each position's text: beyond its end, names are -1
        sizes = np.bincount(text) if n else np.empty(0, np.int64)
        end = np.cumsum(sizes)
        self.begin, self.end = (end - sizes)[text], (end := end[text])
        length = 1
        open_ = np.arange(n, dtype=np.int32)  # places of the array whose suffixes are not told apart yet
        while True:
            of = name[self.array[open_]]
            open_ = open_[_shared(of)]
            if not len(open_):
                break
            at = self.array[open_]
            then = np.where(at + length < end[at], name[np.minimum(at + length, n - 1)], -1)
            key = name[at].astype(np.int64) * (n + 1) + then + 1
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            self.array[open_] = at  # intervals stay where they are
            name = name.copy()
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            name[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            self.names.append(name)
            length *= 2

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are the same from i and from j on (i < j, of one text). At the last level all names differ."""
        i, j, start, end = i.copy(), j.copy(), i, self.end[i]
        for level in range(len(self.names) - 2, -1, -1):
            name, length = self.names[level], 1 << level
            k = np.flatnonzero(j + length <= end)
            k = k[name[i[k]] == name[j[k]]]
            i[k] += length
            j[k] += length
        return i - start

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are the same before i and before j (i < j, of one text)."""
        i, j, start, begin = i.copy(), j.copy(), i, self.begin[i]
        for level in range(len(self.names) - 2, -1, -1):
            name, length = self.names[level], 1 << level
            k = np.flatnonzero(i - length >= begin)
            k = k[name[i[k] - length] == name[j[k] - length]]
            i[k] -= length
            j[k] -= length
        return start - i


def _shared(of: np.ndarray) -> np.ndarray:
    """Of sorted values: which occur more than once."""
    same = of[1:] == of[:-1]
    out = np.zeros(len(of), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _firsts(of: np.ndarray) -> np.ndarray:
    """Of sorted values: the place of each one's first."""
    new = np.ones(len(of), bool)
    new[1:] = of[1:] != of[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))


class Wavelet:
    """A wavelet matrix: which numbers stand in an interval of an array, from a given number on."""

    def __init__(self, values: np.ndarray, largest: int) -> None:
        self.bits = max(1, int(largest).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(one, out=before[1:])
            self.ones.append(before)
            self.zeros.append(len(values) - int(before[-1]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers in [lo, hi) are under value."""
        out = np.zeros(len(lo), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (value >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            out += np.where(one, (hi - b) - (lo - a), 0)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, none: int) -> np.ndarray:
        """The smallest number of [lo, hi) that is at least value, or none, which is more than all."""
        nth = self.below(lo, hi, np.minimum(value, none))
        found = nth < hi - lo
        lo, hi, nth = lo[found], hi[found], nth[found]
        got = np.zeros(len(lo), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            a, b = ones[lo], ones[hi]
            low = (hi - b) - (lo - a)
            one = nth >= low
            nth = np.where(one, nth - low, nth)
            got |= one.astype(np.int64) << (self.bits - 1 - level)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        out = np.full(len(found), none, np.int64)
        out[found] = got
        return out


def find(word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, by start and period; ``text`` numbers the texts, in ascending order."""
    names = Names(word, text)
    n, none = len(word), np.empty(0, np.int64)
    place = np.arange(n)
    blocks, ats, los, his = [], [], [], []
    for level in range(BLOCK.bit_length() - 1, len(names.names)):
        b, name = 1 << level, names.names[level]
        in_array = name[names.array]  # the intervals of this length
        size = np.bincount(in_array, minlength=n)
        at = np.flatnonzero(((place - names.begin) % (b // 2) == 0) & (place + b <= names.end))
        at = at[size[name[at]] > 1]
        if not len(at):
            break
        blocks.append(np.full(len(at), b))
        ats.append(at)
        los.append(name[at].astype(np.int64))
        his.append(name[at] + size[name[at]])
    if not ats:
        return none, none, none
    b, at, lo, hi = (np.concatenate(x) for x in (blocks, ats, los, his))
    # only intervals of repeated blocks are asked for
    repeated = np.bincount(names.names[BLOCK.bit_length() - 1], minlength=n)[names.names[BLOCK.bit_length() - 1][names.array]] > 1
    tree = Wavelet(names.array[repeated].astype(np.int64), n)
    lo, hi = (np.concatenate([[0], np.cumsum(repeated)])[x] for x in (lo, hi))
    # period q has a block with 3b/2 - 1 <= q < 3b - 1; the shortest runs leave room for the least block at all smaller q
    fro = at + np.where(b == BLOCK, 1, 3 * b // 2 - 1)
    upto = at + 3 * b - 2
    starts, periods = [], []
    while len(at):
        p = tree.successor(lo, hi, fro, n)
        k = (p <= upto) & (p < n)
        b, at, lo, hi, upto, p = b[k], at[k], lo[k], hi[k], upto[k], p[k]
        after = tree.successor(lo, hi, p + 1, n)
        step = after - p
        many = np.flatnonzero((step <= b // 2) & (after < n))  # a progression: its period holds to the end of the stretch
        last = p.copy()
        stretch = after[many] + names.right(p[many], after[many])
        last[many] = p[many] + (stretch - b[many] - p[many]) // step[many] * step[many]
        starts.append(at)
        periods.append(p - at)
        # the others of a progression that is the block's own stretch are multiples of its period
        own = at[many] + step[many] + names.right(at[many], at[many] + step[many]) >= p[many] + b[many]
        some = many[~own]
        count = (np.minimum(last[some], upto[some]) - p[some]) // step[some]
        each = np.repeat(np.arange(len(some)), count)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + 1
        starts.append(at[some][each])
        periods.append((p - at)[some][each] + nth * step[some][each])
        fro = last + 1
    i, q = np.concatenate(starts), np.concatenate(periods)
    start = i - names.left(i, i + q)
    end = i + q + names.right(i, i + q)
    long = end - start >= np.maximum(SHORTEST, 2 * q)
    start, end, q = start[long], end[long], q[long]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(start), bool)  # one stretch with several periods: the smallest is its period
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each text and its words without repeats; takes texts of about WORDS words together."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        words = [(t or "").encode(errors="replace").split() for t in texts]
        lo = 0
        while lo < len(words):
            hi, size = lo + 1, len(words[lo])
            while hi < len(words) and size + len(words[hi]) <= WORDS:
                size += len(words[hi])
                hi += 1
            yield _described(batch.slice(lo, hi - lo), words[lo:hi])
            lo = hi


def _described(batch: pa.RecordBatch, words: list[list[bytes]]) -> pa.RecordBatch:
    sizes = np.array([len(w) for w in words], np.int64)
    seen = dict.fromkeys(chain.from_iterable(words))
    number = dict(zip(seen, range(len(seen)), strict=True))
    word = np.concatenate([np.empty(0, np.int64), *(np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words)])
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(words)), sizes)
    start, end, period = find(word, text)
    of = text[start] if len(start) else start
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, end, -1)
    drop = np.cumsum(cover)[:-1] > 0
    kept = []
    for i, w in enumerate(words):
        gone = drop[begin[i] : begin[i] + sizes[i]]
        if gone.any():
            w = [w[j] for j in np.flatnonzero(~gone)]
        kept.append(b" ".join(w))
    offsets = np.searchsorted(of, np.arange(len(words) + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(start - begin[of] if len(of) else start), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
    columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, collapsed`` for each row of ``doc_id, text``: its periodic runs and its words without repeats.

    Words are split at the bytes 9 to 13 and 32. A run is a stretch of words with smallest period q, at least
    max(12, 2q) words long, that no neighbouring word extends with that period; runs are given as start (word number),
    length and period, by start, then period. ``collapsed`` has the words that no run holds after its first q words,
    joined by one space. A null or empty text has no runs and no words; a text of any length is taken whole, in one
    task; repeated rows, null ids and other columns don't matter (other columns are not returned); an empty table gives
    no rows.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(_runs, f"doc_id {dict(base.dtypes)['doc_id']}, runs array<{FOUND}>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a periodic end in each text whose id's crc32 h is a multiple of 10 (a null id's is none).

    Of its n words, each word i >= a becomes word a + (i - a) % p, with g = h div 10, a = g % n and
    p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    base = docs.select("doc_id", "text", (h % 10 == 0).alias("_plant"), F.floor(h / 10).cast("long").alias("_g"))
    base = base.withColumn("_words", F.when(F.col("_plant"), words))
    base = base.withColumn("_n", F.size("_words").cast("long")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    base = base.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p")))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get("_words", place(i).cast("int"))), " ")
    return base.select("doc_id", F.when(F.col("_n") > 0, made).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`detect`: the longest run, and digests of all runs and of the kept words."""
    key = lambda r: F.struct((-r["length"]).alias("below"), r["start"].alias("start"), r["period"].alias("period"))
    best = F.array_min(F.transform("runs", key))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    length, period = -best["below"], best["period"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
