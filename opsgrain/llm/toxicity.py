"""Op 2, toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score of its words, and the document's score is
the noisy-or of its sentences': one minus the product of their complements. The sentence model is trained from
document labels alone, by gradient descent on the likelihood of those labels; it then tells which sentences
make a document toxic.

Training takes a bounded sample of labelled documents (``sample`` of each class at most, those with the
smallest hash of their id, one row of each id, so that the driver holds the known words of ``2 * sample`` texts at
most); classes are weighted back to their numbers among all labels, and a missed toxic document counts as ``missed``
wrongly rejected ones. The words are the ``words`` most telling ones of the sample, and beginnings of words count
like words. Scores use nothing but the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgrain.llm.common import written

#: Bytes that end a sentence become line ends, other ASCII signs and white space become spaces.
_SIGNS = bytes(10 if chr(c) in ".!?\n" else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


#: Bytes of the beginnings of words that count as features of their own, for forms that were never seen.
STEM = 5


def features(words: list[bytes]) -> set[bytes]:
    """The distinct words of a sentence, and the beginnings of the longer ones."""
    return {*words, *(b"^" + w[:STEM] for w in words if len(w) >= STEM)}


def sentences(text: str | None) -> list[set[bytes]]:
    """The features of each sentence; sentences without words are left out."""
    lines = (text or "").encode("utf-8", "surrogatepass").lower().translate(_SIGNS).split(b"\n")
    return [features(words) for line in lines if (words := line.split())]


def held_out(column):
    """Documents whose labels are never learnt."""
    return F.crc32(column.cast("string").cast("binary")) % 5 == 0


def sampled(docs: DataFrame, known: DataFrame, sample: int) -> DataFrame:
    """``text, y`` of ``sample`` documents of each class at most; of several rows of one id the smallest text that is not null."""
    by_hash = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(by_hash(1).unionByName(by_hash(0)))  # at most 2 * sample rows
    one = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return one.select("text", "y").repartition(32)  # few rows, but their words are work


def learn(docs: DataFrame, labels: DataFrame, sample: int = 6000, words: int = 4096, epochs: int = 700, rate: float = 0.05, missed: float = 3.0) -> dict:
    """A sentence model: ``bias`` and ``weights`` by word.

    ``labels`` has ``doc_id, toxic``; rows of held-out documents and null labels are not used, and of several
    labels of one document the largest counts. Without labels of both classes the model scores every sentence
    by the share of toxic labels (0 where there are none).
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = written(known, "labels")
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return {"bias": -30.0 if not n1 else 30.0, "weights": {}}
    taken = written(sampled(docs, known, sample), "sample")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                for word in {w for s in sentences(text) for w in s}:
                    counts.setdefault(word, [0, 0])[y == 1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())],
            ["word", "n0", "n1"],
        )

    counts = taken.mapInArrow(tally, "word binary, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    s1, s0 = min(n1, sample), min(n0, sample)
    odds = F.log(((F.col("n1") + 0.5) / (s1 + 1)) / ((F.col("n0") + 0.5) / (s0 + 1)))
    telling = counts.where(F.col("n0") + F.col("n1") >= 4).withColumn("odds", odds)
    telling = telling.withColumn("by", F.abs("odds") * F.sqrt(F.col("n1") + F.col("n0")))
    best = telling.orderBy(F.desc("by"), "word").limit(words).collect()
    number = {bytes(r["word"]): i for i, r in enumerate(best)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [[[number[w] for w in s if w in number] for s in sentences(x)] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y").cast(pa.int32()), pa.array([sum(not s for s in bag) for bag in bags], pa.int32()), pa.array([[s for s in bag if s] for bag in bags], pa.list_(pa.list_(pa.int32())))],
                ["y", "bare", "bag"],
            )

    got = taken.select("text", "y").mapInArrow(vectors, "y int, bare int, bag array<array<int>>").toArrow()  # bounded by the sample
    y = got.column("y").to_numpy().astype(float)
    bare = got.column("bare").to_numpy().astype(float)
    bags = got.column("bag").combine_chunks()
    bags = bags if isinstance(bags, pa.Array) else pa.concat_arrays(bags.chunks)
    doc = np.repeat(np.arange(len(y)), np.diff(bags.offsets.to_numpy()))
    inner = bags.values
    sent = np.repeat(np.arange(len(inner)), np.diff(inner.offsets.to_numpy()))
    word = inner.values.to_numpy()
    share = np.where(y == 1, missed * n1 / max(y.sum(), 1), n0 / max((1 - y).sum(), 1))
    share /= share.sum()
    theta = np.append(np.clip([r["odds"] for r in best], -1, 3) * 0.3, -6.0)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        w, b = theta[:-1], theta[-1]
        z = b + np.bincount(sent, w[word], len(inner))
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -40, 40))), 1 / (1 + math.exp(-max(min(b, 40), -40)))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + bare * math.log1p(-min(p0, 1 - 1e-12))
        whole = -np.expm1(none)
        slope = share * np.where(y == 1, -np.exp(none) / np.maximum(whole, 1e-9), 1.0)
        dz = slope[doc] * p
        grad = np.append(np.bincount(word, dz[sent], len(w)), dz.sum() + (slope * bare).sum() * p0)
        grad[:-1] += 2e-6 * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-10)
    return {"bias": float(theta[-1]), "weights": {w: float(theta[i]) for w, i in number.items()}}


def _scores(texts: list[str | None], bias: float, weights: dict[bytes, float]) -> list[float]:
    """The noisy-or of each text's sentences."""
    known, weight, base, out = weights.keys(), weights.__getitem__, -math.log1p(math.exp(min(bias, 40))), []
    for text in texts:
        log_none = 0.0
        for line in (text or "").encode("utf-8", "surrogatepass").lower().translate(_SIGNS).split(b"\n"):
            if words := line.split():
                hit = known & features(words)
                log_none += -math.log1p(math.exp(min(bias + sum(map(weight, sorted(hit))), 40))) if hit else base
        out.append(min(1.0, max(0.0, -math.expm1(log_none))))
    return out


def score(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, sentences`` for each row of ``doc_id, text``: the noisy-or over the whole text, and, where
    it is at least ``threshold``, the sentences that score at least half of the strongest, as start, end
    (code points) and score, in order. A text without words (null, empty) scores 0."""
    shared = docs.sparkSession.sparkContext.broadcast((model["bias"], model["weights"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = shared.value
        known, weight = weights.keys(), weights.__getitem__
        place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores, spans = _scores(texts, bias, weights), []
            for text, whole in zip(texts, scores, strict=True):
                own = []
                if whole >= threshold:
                    for m in _SENTENCE.finditer(text or ""):
                        for words in sentences(m[0]):
                            z = bias + sum(map(weight, sorted(known & words)))
                            own.append({"start": m.start(), "end": m.end(), "score": 1 / (1 + math.exp(-min(max(z, -40), 40)))})
                    top = max((s["score"] for s in own), default=0)
                    own = [s for s in own if s["score"] >= top / 2]
                spans.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, place)], ["doc_id", "score", "sentences"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores with the held-out flag and the decision at 0.5; the offending sentences as start:end, joined."""
    out = score(docs, learn(docs, labels))
    spans = F.array_join(F.transform("sentences", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("offending"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``threshold``; each is scored and passed on in one step."""
    model = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model["bias"], model["weights"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array(_scores(batch.column("text").to_pylist(), *shared.value))
            yield batch.filter(pa.array(scores < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
