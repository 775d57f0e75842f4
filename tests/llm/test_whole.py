"""The whole job where an operator once did less of it."""

import itertools
import math
import os
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from brute import groups, words

import corpus_pipeline
from opsgrain.llm import common, katz, mixing, queries, shingles, simhash, vectors

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(a), words(b)))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("cell", [512, 4])
def test_pipeline_drops_near_copies_from_similarity_080(spark, cell):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(2000)]
    rows, bands = [], []
    for i in range(60):
        base = rng.choices(vocabulary, k=300)
        rows.append((i, " ".join(base)))
        for k, changes in enumerate((1, 3, 6, 10)):  # scattered words replaced: similarities from 0.97 down to 0.7
            copy = base.copy()
            for at in rng.sample(range(10, 290, 20), changes):
                copy[at] = "changed"
            rows.append((1000 + 10 * i + k, " ".join(copy)))
            bands.append(jaccard(rows[-1][1], " ".join(base)))
    assert {round(x, 1) for x in bands} >= {1.0, 0.9, 0.8, 0.7}
    top = groups(len(rows), lambda i, j: abs(len(rows[i][1]) - len(rows[j][1])) < 400 and rows[i][0] % 1000 // (10 if rows[i][0] >= 1000 else 1) == rows[j][0] % 1000 // (10 if rows[j][0] >= 1000 else 1) and jaccard(rows[i][1], rows[j][1]) >= 0.8)
    want = {rows[k][0] for k in range(len(rows)) if top[k] == k}
    got = shingles.drop_duplicates(frame(spark, rows), cell=cell)
    assert {r.doc_id for r in got.collect()} == want and got.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    if cell == 512:
        assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "").collect()} == want
        assert shingles.drop_duplicates(frame(spark, [])).count() == 0
        assert {r.doc_id for r in shingles.drop_duplicates(frame(spark, [(1, None), (2, " \n"), (3, ""), (4, "one"), (5, "One")])).collect()} == {1, 4}


def test_pipeline_takes_candidates_from_fingerprints(spark, monkeypatch):
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    far = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(far)), (4, " ".join(base).upper()), (5, None)]
    fps = [simhash.fingerprint(t) for _, t in rows]
    assert 0 <= (fps[0] ^ fps[1]).bit_count() <= 3 < (fps[0] ^ fps[2]).bit_count()
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: asked.append(a[1:]) or links(*a))
    # sets 10 and 20 are of one fingerprint, 30 of one that is linked to it, 40 of another
    described = spark.createDataFrame([(fps[0], 10), (fps[0], 20), (fps[0], 10), (fps[1], 30) if fps[1] != fps[0] else (fps[0], 30), (fps[2], 40)], "sim long, fp long")
    assert {tuple(r) for r in shingles.fingerprint_pairs(described, 3).collect()} == {(10, 20), (10, 30)}
    docs = frame(spark, rows)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 3, 5}
    assert asked == [(3,), (3,)]


@pytest.mark.parametrize("drop", [simhash.drop_duplicates, shingles.drop_duplicates])
def test_rows_without_or_with_a_shared_id_are_told_apart_by_text(spark, drop):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (None, c), (1, c), (2, d), (2, e), (3, d), (2, d), (0, e)]
    got = [(r.doc_id, r.text) for r in drop(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(None, a), (None, b), (1, c), (2, d), (0, e)], key=repr)


def full_katz(texts, ids):
    """Scores by a Katz model of all pairs."""
    tokens = [[*words(t), "\n"] for t in texts]
    learn = [t for t, i in zip(tokens, ids, strict=True) if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c, pairs = Counter(), Counter()
    for t in learn:
        c.update(t)
        pairs.update(zip([" ", *t], t, strict=False))

    def discounted(counts):
        n = Counter(counts)
        tail = 6 * n[6] / n[1]
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and n[r + 1] and tail < 1 else 0 for r in range(1, 6)}
        return lambda x: x if x > 5 else x * d[x] if 0 < d[x] < 1 else x - 0.5

    one, two = discounted(c.values()), discounted(pairs.values())
    total = sum(c.values())
    kept = sum(map(one, c.values()))
    scale = min(1.0, total / (total + 1) * total / kept)
    p, unknown = {w: one(x) * scale / total for w, x in c.items()}, 1 - kept * scale / total
    contexts, seen, back = c | {" ": len(learn)}, defaultdict(dict), {}
    for (v, w), x in pairs.items():
        seen[v][w] = two(x) / contexts[v]
    for v, q in seen.items():
        rest = max(1 - sum(q.values()), 1 / (contexts[v] + 1))
        factor = (1 - rest) / sum(q.values())
        seen[v] = {w: x * factor for w, x in q.items()}
        back[v] = rest / (1 - sum(p[w] for w in q))
    return [sum(math.log10(seen[v][w]) if w in seen.get(v, ()) else math.log10(back.get(v, 1.0) * p.get(w, unknown)) for v, w in zip([" ", *t], t, strict=False)) for t in tokens]


def test_katz_query_keeps_pairs_seen_once(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = dict(zip([i for i, _ in rows], full_katz([t for _, t in rows], [i for i, _ in rows]), strict=True))
    got = {r.doc_id: r.score for r in queries.op7_katz_backoff(spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    assert katz.train(frame(spark, [(1, "a b a b c d")]), 1)["pairs"].count() == 6


@pytest.mark.parametrize("weights", [{"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 1.0, "b": 2.0, "c": 4.0}, {"s0": 0.3} | {f"s{i}": 0.7 / 249 for i in range(1, 250)}])
def test_mixing_keeps_to_the_weights_passed_in(spark, weights):
    total, slots = sum(weights.values()), 10_000
    rows = [(s, math.ceil(w / total * slots) + 2) for s, w in weights.items()]
    docs = spark.createDataFrame(rows, "source string, n int").selectExpr("source", "explode(sequence(1, n)) as doc_id")
    got = mixing.mix(docs, weights, block=1).where("on_target").orderBy("slot").select("source").collect()
    assert len(got) >= slots - len(weights)
    have, bound = Counter(), 1 if len(weights) == 3 and total < 2 else 2
    for t, r in enumerate(got, 1):
        have[r.source] += 1
        if t % 97 == 0 or t == len(got) or len(weights) == 3:
            assert all(abs(have[s] - w / total * t) < bound for s, w in weights.items())


def test_mixing_units_are_positive_and_sum_to_the_period(spark):
    for weights in ([1.01] * 100 + [3.0] * 97 + [0.001] * 103, [1.0] * 300, [1e-9] * 3 + [1.0], [0.0] * 5):
        weights = {f"s{i}": w for i, w in enumerate(weights)}
        sizes = spark.createDataFrame([(s, 10) for s in weights], "source string, n long")
        got = mixing.units(sizes, weights, period=1).collect()
        assert all(r.units >= 1 for r in got) and {sum(r.units for r in got)} == {r.period for r in got}


def test_vectors_split_the_lists_of_a_dense_group_by_their_length(spark, monkeypatch):
    """A dense group shares its lists: no cell is much over the limit, candidates are verified in slices, all links are found."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.01).tolist(), 1) for i in range(600)] + [(1000 + i, rng.normal(size=16).tolist(), 1) for i in range(600)]
    seen, limit, compare = spark.sparkContext.accumulator(0), 100, vectors._compare

    def counting(*parameters):
        run = compare(*parameters)

        def counted(batches):
            def each():
                most = Counter()
                for b in batches:
                    most.update(zip(*(b.column(c).to_pylist() for c in ("label", "size", "pivot", "cell")), strict=True))
                    yield b
                seen.add(sum(n > 1.5 * limit for n in most.values()))

            yield from run(each())

        return counted

    monkeypatch.setattr(vectors, "_compare", counting)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: r for r in vectors.near_duplicates(df, cell=limit).collect()}
    assert all(got[i].n_links == 599 and got[i].component_id == 0 for i in range(600)) and not seen.value


@pytest.mark.parametrize("lowest", [1, 2])
def test_katz_in_one_reading_gives_the_scores_of_the_model(spark, lowest):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(200))) for i in range(1500)] + [(None, "w1 W2"), (3, None), (3, "W1 w1 w1"), (16, "\t")]
    docs = frame(spark, rows).repartition(5)
    root = common.shared_dir(spark).removeprefix("file://") + "/tables"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    fast = katz.learn_and_score(docs, lowest)
    left = sum(os.path.getsize(os.path.join(d, f)) for t in set(os.listdir(root)) - before for d, _, fs in os.walk(f"{root}/{t}") for f in fs)
    assert left < 5 * 200 * len(rows)  # bytes a token; the tables of a model of all pairs take 9.5
    plain = katz.score(docs, katz.train(docs.where(F.coalesce(katz.training(F.col("doc_id")), F.lit(True))), lowest))
    got, want = (sorted((tuple(r) for r in df.collect()), key=repr) for df in (fast, plain))
    assert len(got) == len(rows) and [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], abs=1e-7)


def test_katz_blocks_take_little_memory(spark, monkeypatch):
    """Blocks of texts leave nothing behind but what is sent, and hold no words as strings: the peak is under 16 bytes for each byte of a block."""
    monkeypatch.setattr(katz.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(katz, "TOGETHER", 2_000_000)
    monkeypatch.setattr(katz, "PIECE", 200_000, raising=False)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(20_000)]

    def batches():
        for low in range(0, 2000, 500):
            texts = [" ".join(rng.choices(vocabulary, k=500)) for _ in range(500)]
            yield pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(low, low + 500)), pa.array([i % 7 == 2 for i in range(500)])], ["text", "doc_id", "held_out"])

    run = katz._lists(13)
    assert sum(b.num_rows for b in run(batches())) > 13
    tracemalloc.start()
    try:
        blocks = sum(1 for _ in run(batches()))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert blocks == 4 and peak < 16 * 2_000_000


def test_katz_cuts_slices_of_batches_into_words():
    texts = pa.array(["x", " A b\tc  ", "", " \n", "a a É ", "zz top", "\x1c y"])
    for low in range(len(texts)):
        for high in range(low + 1, len(texts) + 1):
            types, tokens, bounds = katz._coded(texts.slice(low, high - low))
            want = [[*words(t), "\n"] for t in texts.slice(low, high - low).to_pylist()]
            assert types[tokens].tolist() == [katz._hash(w.encode()) for t in want for w in t]
            assert bounds.tolist() == [0, *itertools.accumulate(map(len, want))]
            assert set(tokens) == set(range(len(types))) and len(set(types)) == len(types)  # a word that no text has would be taken for the texts' beginning


def test_katz_sends_small_batches_and_leaves_the_setting(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, most = spark.conf.get(key), spark.sparkContext.accumulator(0)
    lists = katz._lists

    def counting(buckets):
        def run(batches):
            def each():
                for b in batches:
                    most.add(b.num_rows > 50)
                    yield b

            yield from lists(buckets)(each())

        return run

    monkeypatch.setattr(katz, "_lists", counting)
    monkeypatch.setattr(katz, "BATCH", 20_000, raising=False)
    rows = [(i, f"w{i} " * 200) for i in range(900)]
    assert katz.learn_and_score(frame(spark, rows), 1).count() == 900
    assert most.value == 0 and spark.conf.get(key) == before
