"""Second implementations of what operators compute beyond their contracts, production parameters, and odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import encode, packed
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from opsgrain.llm import common, matroska, mixing, packing, queries, secrets, tokens, toxicity, vectors

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["findings", "_id", "_place", "_keep", "_doc", "row", "rank", "slot", "k", "fp", "copy", "bucket"]


@pytest.mark.parametrize("size,labels", [(64, 1), (32, 2)])
def test_recall_with_production_parameters(spark, size, labels):
    """Vectors near the threshold, one dense label among them, against all pairs."""
    rng = np.random.default_rng(size)
    base = rng.normal(size=(4000, size))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[rng.integers(0, 300, 900)]
    noise = rng.normal(size=near.shape)
    noise -= (noise * near).sum(axis=1, keepdims=True) * near
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.concatenate([base, 0.982 * near + math.sqrt(1 - 0.982**2) * noise]).astype(np.float32)
    label = np.concatenate([np.arange(4000) % labels, np.zeros(900, int)])
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, 0.98).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.98) & (label[:, None] == label[None])).sum(axis=1) - 1
    assert want.sum() > 500 and all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.95 * want.sum()


def test_toxicity_learns_one_row_of_each_id(spark):
    """A third of all rows in one id, null texts and null ids: training still gets ``sample`` rows of each class at most."""
    ids = F.when(F.col("id") % 3 == 0, 3).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 7)
    docs = spark.range(20000).select(ids.alias("doc_id"), F.when(ids < 6, F.concat(F.lit("t"), "id")).alias("text"))
    known = spark.range(7).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("y"))
    taken = {(r.text, r.y) for r in toxicity.sampled(docs, known, 9).collect()}
    least = {r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    assert taken == {(t, k % 2) for k, t in least.items()} and len(least) == 7
    few = toxicity.sampled(docs, known, 2).collect()
    assert sorted(r.y for r in few) == [0, 0, 1, 1]
    assert toxicity.sampled(docs.limit(0), known, 2).count() == 0
    model = toxicity.learn(docs, known.withColumnRenamed("y", "toxic"), sample=2, epochs=5)
    assert set(model) == {"bias", "weights"}


def test_toxicity_scores_are_the_noisy_or(spark):
    """Scores again, from the model's weights, by the definition; and a true ranking of the held-out labels."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for doc, text in docs.select("doc_id", "text").collect()[:300]:
        none = 1.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            found = re.findall(rb"[0-9a-z\x80-\xff]+", sentence.encode().lower())
            marks = {*found, *(b"^" + w[:5] for w in found if len(w) >= 5)}
            if marks:
                none *= 1 - 1 / (1 + math.exp(-(model["bias"] + sum(model["weights"].get(w, 0.0) for w in marks))))
        assert got[doc].score == pytest.approx(1 - none, abs=1e-9)
        for s in got[doc].sentences:
            assert 0 <= s.start < s.end <= len(text) and s.score <= got[doc].score + 1e-9
    held = [(got[r.doc_id].score, r.toxic) for r in labels.where(toxicity.held_out(F.col("doc_id"))).collect() if r.doc_id in got]
    one, zero = ([s for s, y in held if y == k] for k in (1, 0))
    assert one and zero and np.mean([[a > b for b in zero] for a in one]) > 0.9


def test_weak_parts_against_all_pairs(spark):
    """Linked parts by looking at all pairs of parts of a text."""
    rng = random.Random(11)
    bits = ["user=alice", "login: bob_1", "client_id=app77", "https://db.example.org/x", "host=db1.local:99", "abcdEFGH1234abcdEFGH1234wxyz", "password=hunter2222", "AKIA" + "A1B2C3D4E5F6", "0123456789abcdef" * 2]
    rows = []
    for i in range(300):
        text = ""
        for _ in range(rng.randint(1, 9)):
            text += rng.choice(bits) + " " * rng.choice([1, 3, 60, 115, 118, 121, 500, 700])
        rows.append((i, text, None, None, None))
    got = {r.doc_id: Counter((f.kind, f.start, f.end) for f in r.findings) for r in secrets.scan(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    reach, role = secrets.REACH, secrets.ROLE
    for i, text, *_ in rows:
        parts, want = sorted(set(secrets.parts(text))), Counter()
        for kind, a, b in parts:
            near = {role[k] for k, c, d in parts if role[k] != role[kind] and c < b + reach and a < d + reach}
            full = kind in ("assign", "access", "hex") or (kind == "endpoint" and {"name", "secret"} <= near) or (kind == "name" and "secret" in near) or (kind == "bare" and "name" in near)
            want.update([(kind, a, b)] if full else [])
        assert got[i] == want


def test_mixing_against_a_plain_schedule(spark):
    """The stream of blocks against a loop over slots that takes the released block with the earliest deadline."""
    sizes = {"a": 700, "b": 300, "c": 120}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)] + [(None, "a")] * 90 + [(7, "b")] * 40
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    got = mixing.mix(df, {"a": 5, "b": 3, "c": 2}, block=4, period=20).collect()
    n = Counter(s for _, s in rows)
    units = {"a": 10, "b": 6, "c": 4}
    done, want = Counter(), {}
    for t in range(4000):
        ready = [(-(-(done[s] + 1) * 20 // u), s) for s, u in units.items() if done[s] * 20 // u <= t]
        if ready:
            _, s = min(ready)
            want[(s, done[s])] = t
            done[s] += 1
    ends = min(want[(s, -(-n[s] // 4))] for s in units)
    assert all(want[(r.source, r.block)] == r.slot and r.on_target == (r.slot < ends) for r in got)
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows) and len({(r.source, r.block, r.nth) for r in got}) == len(rows)


def test_a_hot_id_is_listed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 7)
    rows = [(None, "a")] * 500 + [(i, "b") for i in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block=4).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    assert len({(r.slot, r.nth) for r in got}) == 1000


def odd_table(spark, extra=True):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    copied = prose(200)
    rows = [(None, prose(80), None), (None, prose(90), "s1"), (7, prose(60), "s1"), (7, prose(70), "s1"), (8, None, "s0"), (9, "", None), (10, prose(170_000), "s0")]
    rows += [(20 + i, copied, "s2") for i in range(4)] + [(30, prose(50) + " password=hunter2222 " + prose(50), "s0")] * 2
    rows += [(40 + i, prose(rng.randint(5, 200)), f"s{i % 3}") for i in range(60)]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)
    return rows, df.withColumns({c: F.lit("clash") for c in CLASHING}) if extra else df


def test_stages_on_an_odd_table(spark):
    """Null and repeated ids, null, empty and very long texts, repeated rows and clashing columns through all stages."""
    rows, docs = odd_table(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.written(stage(spark, docs, SF), name)
        assert after.columns == docs.columns
        assert {r.findings for r in after.collect()} == {"clash"}
        if name == "simhash":
            kept = Counter((r.doc_id, r.text) for r in after.collect())
            texts = {r.text for r in docs.collect()} - {None, ""}
            assert {t for _, t in kept} - {None, ""} == texts and max(kept.values()) == 1
            assert [i for i, t in kept if t == rows[7][1]] in ([20], [])
            assert len([1 for i, t in kept if not t]) == 1
        elif name != "toxicity":
            assert after.count() == docs.count()
        if name == "secrets":
            assert not any("hunter2222" in (r.text or "") for r in after.collect())
        docs = after
    library = Tokenizer.from_file(tokens.public("word_bpe_49k.json"))
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    packed([(r.sequence_id, r.offset, r.length) for r in got], 4096)
    assert sum(r.length for r in got) == sum(len(encode(library, r.text, 1)) for r in docs.collect())


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = odd_table(spark, False)[1].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_sequences_follow_the_mix(spark, monkeypatch):
    """A small source with half of the weight fills half of the first sequences, not its share of the rows."""
    monkeypatch.setattr(packing, "SEGMENT", 400)
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([30, 40, 50]))), "en", "small" if i % 5 == 0 else "large", 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    mixed = common.written(mixing.in_order(docs, {"small": 1.0, "large": 1.0}), "mixed")
    source = {r.doc_id: r.source for r in docs.collect()}
    got = sorted((r.sequence_id, r.doc_id) for r in packing.pack_in_order(mixed, tokens.public("word_bpe_49k.json"), 1024, 1).collect())
    sequences = sorted({s for s, _ in got})
    first = Counter(source[i] for s, i in got if s < sequences[len(sequences) // 5])
    last = Counter(source[i] for s, i in got if s > sequences[len(sequences) * 4 // 5])
    assert last["small"] == 0
    assert abs(first["small"] / sum(first.values()) - 0.5) < 0.06


def test_the_best_of_several_plans_is_taken():
    """Fewest sequences of all numbers of groups; whole plans; no more are made once none can be better."""
    rng, better = np.random.default_rng(5), 0
    for _ in range(4):
        drawn = np.clip(rng.lognormal(6.3, 1.0, 4000).astype(int), 1, 4096)
        lengths = dict(zip(*(x.tolist() for x in np.unique(drawn, return_counts=True)), strict=True))
        each = [packing.plan(lengths, 4096, n)["bins"] for n in (16, 48)]
        got = packing.fewest(lengths, 4096, (16, 48))
        assert got["bins"] == min(each) >= -(-int(drawn.sum()) // 4096)
        better += got["bins"] < each[1]
    assert better
    assert packing.fewest({}, 4096, (16, 48))["bins"] == 0 and packing.fewest({2048: 6}, 4096, (16, None))["bins"] == 3


def test_media_are_stored_and_described(spark):
    """Features again, from the packet table and the bytes, for a stored column."""
    rows = [(1, "x" * 100_000), (2, None), (3, "é" * 50), (None, "a b"), (1, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).withColumns({c: F.lit(1) for c in CLASHING})
    stored = common.written(matroska.store(docs), "media")
    files = [(r.doc_id, r.n_bytes, bytes(r.media)) for r in stored.collect()]
    got = Counter((r.doc_id, r.media_bytes, r.feature) for r in matroska.features(stored).collect())
    want = Counter()
    for i, n, data in files:
        packets, info = matroska.demux(data)
        x = np.frombuffer(b"".join(data[a : a + size] for _, _, _, a, size, _, _ in packets), np.uint8).astype(float)
        over, clusters = x > x.mean(), {c: t for _, t, _, _, _, c, _ in reversed(packets)}
        cues = sum(clusters.get(c) == t * info["scale"] for t, c in info["cues"])
        assert cues == len(clusters) == info["clusters"] and len(x) % 192 == 0 and x.sum() > 0
        want[(i, len(data), f"codec=A_PCM/INT/LIT;rate=8000;depth=8;packets={len(packets)};blocks={info['blocks']};laced={info['laces']};clusters={len(clusters)};cues={cues};ms={len(x) // 8};mean={x.mean():.4f};deviation={x.std():.4f};crossings={np.mean(over[1:] != over[:-1]):.4f}")] += 1
    assert got == want
    assert matroska.features(matroska.store(docs.limit(0))).count() == 0
    missing = spark.createDataFrame([(5, None, None)], "doc_id long, n_bytes long, media binary")
    assert matroska.packet_table(missing).count() == 0 and matroska.features(missing).first().feature is None


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        conf, sparkContext = {}, Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_queries_are_listed(spark):
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
