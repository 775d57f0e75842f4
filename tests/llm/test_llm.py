"""The operators against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and
columns of clashing names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import crc, encode, groups, katz, packed, secret_spans, simhash, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from opsgrain.llm import common, katz as K, matroska, mixing, packing, queries, secrets, simhash as S, token_store, tokens, toxicity, url_filter, vectors

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["copy", "label", "bucket", "k", "n", "fp", "slot", "score", "start", "u", "v", "w", "entry", "parts", "_id", "_place", "_keep", "_doc", "_row", "_copy", "findings", "rank", "row", "first", "starts", "hit"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd():
    """Rows with nulls, white space, repeats, copies, near copies, signs of many kinds and a very long text."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    base = [rng.choice(vocabulary) for _ in range(400)]
    rows = [(None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one two"), (5, "one two"), (6, "Naïve É 1½ 中文 🙂 it's\r\n\tx   y"), (7, " ".join(rng.choices(vocabulary, k=60_000)))]
    rows += [(10 + i, " ".join(base)) for i in range(5)]
    for i in range(40):  # a chain of near copies, each with another word changed
        base = base.copy()
        base[rng.randrange(400)] = "changed"
        rows.append((100 + i, " ".join(base)))
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in EXTRA}) if extra else df


def check_components(rows, got):
    fps = [simhash(t) for _, t in rows]
    top = groups(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    least = {}
    for (i, _), g in zip(rows, top, strict=True):
        least[g] = min(x for x in (least.get(g), i, float("inf")) if x is not None)
    want = [(i, f"{f:016x}", None if least[g] == float("inf") else least[g]) for (i, _), f, g in zip(rows, fps, top, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_simhash(spark, odd):
    check_components(odd, S.near_duplicates(frame(spark, odd)).select("doc_id", "fingerprint", "component_id").collect())
    assert S.near_duplicates(frame(spark, [])).count() == 0
    assert {r.doc_id for r in S.drop_duplicates(frame(spark, odd)).collect() if r.doc_id in range(10, 15)} == {10}


@pytest.mark.parametrize("partitions,cell", [(2, 2048), (3, 2048), (4, 2048), (4, 8)])
def test_simhash_links(spark, partitions, cell):
    """Dense balls of fingerprints, and hot values of a partition: all links, whatever the partitions and blocks."""
    rng = random.Random(partitions)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(25)}
    fps |= {rng.getrandbits(48) << 16 | 0xABCD for _ in range(60)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = S.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3), 3, partitions, cell)
    pairs = {(r.a, r.b) for r in found.collect()}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 * len(fps) for a, b in pairs)
    at = {s: i for i, s in enumerate(signed)}
    linked = {frozenset((at[a], at[b])) for a, b in pairs}
    want = groups(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert groups(len(fps), lambda i, j: frozenset((i, j)) in linked) == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (1, 0), (None, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    known = {frozenset(e) for e in edges if None not in e}
    want = groups(260, lambda i, j: frozenset((i, j)) in known)
    assert got == {i: want[i] for i in range(260) if any(i in e and len(e) == 2 for e in known)}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_equal_the_library(name):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab'sS t\n\n  \t1½ªA,.Éßÿ-_’́中🙂İſ", k=rng.randint(0, 25))) for _ in range(4000)]
    texts += ["".join(rng.choices("abcd  \n.,'dllve1É", k=rng.randint(0, 25))) for _ in range(4000)] + ["", None, "end <|endoftext|> x", "<|startoftext|>a<|ENDOFTEXT|>b", "a<|endoftext|>", "x" * 5000]
    encoder, library = tokens.Encoder(tokens.public(name)), Tokenizer.from_file(tokens.public(name))
    ids, bounds = encoder.batch(texts)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_packing(spark, odd):
    path = tokens.public("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(frame(spark, odd), path, 512, 1).collect()
    want = Counter()
    for i, t in odd:
        ids = encode(library, t, 1)
        want.update((i, at // 512, at, len(ids[at : at + 512]), crc(ids[at : at + 512])) for at in range(0, len(ids), 512))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    n = packed([(r.sequence_id, r.offset, r.length) for r in got], 512)
    assert n <= sum(r.length for r in got) / 512 * 1.05 + 1
    assert packing.pack(frame(spark, []), path).count() == 0


@pytest.mark.parametrize("n", [1, 50, 3000])
def test_packing_plan(n):
    rng = random.Random(n)
    lengths = Counter(min(1000, int(rng.lognormvariate(5, 1)) + 1) for _ in range(n))
    plan = packing.plan(lengths, 1000)
    key = plan["length"] << 44 | plan["first"]
    rows = []
    for k, count in lengths.items():
        for rank in range(count):
            run = np.searchsorted(key, k << 44 | rank, "right") - 1
            nth, each = rank - plan["first"][run], plan["each"][run]
            rows.append((int(plan["bin"][run] + nth // each), int(plan["offset"][run] + nth % each * k), k))
    assert packed(rows, 1000) == plan["bins"] <= -(-sum(k * c for k, c in lengths.items()) // 1000) * 1.03 + 1


def test_token_store(spark, odd, tmp_path):
    path, table = tokens.public("byte_bpe_50k.json"), str(tmp_path / "store")
    library = Tokenizer.from_file(path)
    rows = [*odd, (None, "no id, again <|endoftext|>")]
    token_store.write_store(frame(spark, rows), table, path, 2)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.verified) for r in token_store.read_digests(spark, table).collect())
    texts = Counter((i, tuple(encode(library, t, 2))) for i, t in rows)
    assert Counter((i, n, c) for _, i, n, c, _ in got) == Counter((i, len(t), crc(t)) for i, t in texts.elements()) and all(v for *_, v in got)
    assert [i for _, i, *_ in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [s for s, *_ in got] == [0, *np.cumsum([n for _, _, n, _, _ in got])[:-1]]
    assert Counter((r.doc_id, tuple(r.ids)) for r in token_store.read_ids(spark, table).collect()) == texts
    chunks = spark.read.parquet(f"{table}/data/table=chunks")
    assert chunks.count() == chunks.select("key").distinct().count()
    parts = token_store.checked_parts(spark, table).collect()
    assert all(r.verified for r in parts) and sum(r.documents for r in parts) == len(rows)
    broken = str(tmp_path / "broken")
    spark.read.parquet(f"{table}/manifest").write.parquet(f"{broken}/manifest")
    recipes = spark.read.parquet(f"{table}/recipes")
    recipes.withColumn("root", F.when(F.col("nth") == 0, F.lit(b"x")).otherwise(F.col("root"))).write.parquet(f"{broken}/recipes")
    chunks.withColumn("ids", F.concat(F.expr("substring(ids, 3)"), F.lit(b"\x01\x00"))).write.parquet(f"{broken}/data/table=chunks")
    assert not any(r.verified for r in token_store.read_digests(spark, broken).collect())
    assert not any(r.verified for r in token_store.checked_parts(spark, broken).collect())
    token_store.write_store(frame(spark, []), str(tmp_path / "empty"), path)
    assert token_store.read_digests(spark, str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("n", range(18))
def test_merkle_tree(n):
    """The folded tree against one that is built level by level."""
    level = [hashlib.sha256(b"\0%d" % i).digest() for i in range(n)] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert token_store.merkle([b"%d" % i for i in range(n)]) == level[0]


def test_crc_of_joined_strings():
    a, b = b"hello", bytes(range(256)) * 9
    assert token_store.joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_chunks_are_cut_by_content():
    rng = np.random.default_rng(1)
    shared, head = rng.integers(0, 50_000, 8000), rng.integers(0, 50_000, 777)
    ids = np.concatenate([shared, head, shared]).astype("<u2")
    bounds = np.array([0, 8000, 16_777])
    first, second = token_store.boundaries(ids, bounds)
    one = {ids[a:b].tobytes() for a, b in zip([0, *first], first, strict=False)}
    two = {ids[8000 + a : 8000 + b].tobytes() for a, b in zip([0, *second], second, strict=False)}
    assert len(one & two) >= len(one) - 3
    assert first[-1] == 8000 and max(np.diff([0, *first])) <= token_store.MOST


def test_secrets(spark):
    key, hexa = "AKIA" + "A1B2C3D4E5F6", "0123456789abcdef" * 2
    bare = "abcdEFGH1234abcdEFGH1234wxyz"
    rows = [
        (1, f'Password: "hunter2222" x {key} {hexa} TOKEN=short api_key=longenough ſecret=notasecret1'), (2, None), (3, ""), (4, f"user=alice then {bare} at https://db.example.org/x"),
        (5, f"{bare} alone"), (6, f"user=alice alone, endpoint https://db.example.org/x"), (7, "user=alice " + "x " * 200 + bare), (4, f"{bare} alone"), (8, "password=" * 3 + "a" * 50_000),
        (None, f"client_id=app {bare}"),
    ]
    got = {(r.doc_id, r.spans): r for r in secrets.digests(secrets.scan(frame(spark, rows))).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = secret_spans(t)
        assert any(d == i and r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(filter(None, s.split(","))) for (d, s), r in got.items())
    spans = lambda i: [s for d, s in got if d == i]
    assert "name:0:10" in spans(4)[0] + spans(4)[1] and any("bare" in s and "endpoint" in s for s in spans(4)) and "" in spans(4)
    assert spans(5) == [""] and spans(6) == [""] and spans(7) == [""] and "bare" in spans(None)[0]
    masked = {r.text for r in secrets.redact(frame(spark, rows)).collect()}
    assert f"{bare} alone" in masked and None in masked and not any(t and (hexa in t or key in t) for t in masked)
    assert secrets.digests(secrets.scan(frame(spark, []))).count() == 0


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "b", None, "c"])) for i in range(1200)] + [(5, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumns({c: F.lit(1) for c in EXTRA})
    got = mixing.mix(df, {"a": 0.5, "b": 0.3, "c": 0.2}, block=4, period=50).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    assert len({(r.slot, r.nth) for r in got}) == len(rows)
    blocks = {(r.slot, r.source, r.release, r.deadline) for r in got}
    assert len({b[0] for b in blocks}) == len(blocks) and all(release <= slot < deadline for slot, _, release, deadline in blocks)
    n = Counter(s for _, s in rows)
    sizes = spark.createDataFrame(sorted(n.items(), key=repr), "source string, n long")
    share = {r.source: r.units / r.period for r in mixing.units(sizes, {"a": 0.5, "b": 0.3, "c": 0.2}, period=50).collect()}
    assert abs(sum(share.values()) - 1) < 1e-9
    on = sorted((r.slot, r.source) for r in got if r.on_target and r.nth == 0)
    have = Counter()
    for t, (slot, source) in enumerate(on, 1):
        assert slot == t - 1
        have[source] += 1
        assert all(abs(have[s] - share[s] * t) < 1 for s in n)
    assert mixing.mix(df.limit(0)).count() == 0


def test_katz(spark, odd):
    rows = [(i, t) for i, t in odd if t is None or len(t) < 10_000]
    got = {}
    for r in K.learn_and_score(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for (i, t), want in zip(rows, katz([t for _, t in rows], [i for i, _ in rows]), strict=True):
        r = got[i].pop()
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert (r.base_score, r.score) == pytest.approx(want[3:], abs=1e-7)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
    assert not any(got.values())
    assert K.learn_and_score(frame(spark, [])).count() == 0


def test_katz_on_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want = dict(zip([i for i, _ in rows], katz([t for _, t in rows], [i for i, _ in rows], 1), strict=True))
    got = queries.op7_katz_backoff(spark, SF).collect()
    assert all((r.base_score, r.score) == pytest.approx(want[r.doc_id][3:], abs=1e-6) for r in got) and len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_urls_against_sql(spark):
    from pairs import same

    same(spark, queries.op8_url_filter, url_filter.SQL, SF)


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/x", "http://example.com/en/x", "https://a.example.com/en/", "http://example.com", "http://notexample.com/en/", "x.net/es/", "ftp://b.NET/fr/?q=://", None, "", "http://q.org/login", "http://q.org/loginx", "http://m.q.org/de/", "http://q.org/de/?://m.a.org/de/", "http://q.org/a?utm_source=z.html", "http://q.org/a?utm_source=z.htmlx"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumns({c: F.lit(1) for c in EXTRA + ["host", "path", "token", "rule"]})
    got = url_filter.judge(df, url_filter.HOST_RULES + url_filter.PATTERN_RULES).collect()
    assert len(got) == len(urls) + 1
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert by[1][2:] == ("example.com/en/", "block") and by[2][2:] == ("example.com/en/", "block")
    assert by[3] == ("example.com", "", None, "allow") and by[4][2:] == ("com/", "allow") and by[5] == ("", "", None, "allow")
    assert by[6] == ("b.net", "/fr/", "net/fr/", "block") and by[7] == by[8] == ("", "", None, "allow")
    assert [by[i][3] for i in range(9, 15)] == ["block", "allow", "block", "block", "allow", "block"]
    assert url_filter.judge(df.limit(0), url_filter.HOST_RULES).count() == 0


@pytest.mark.parametrize("cell", [2048, 8])
def test_vectors(spark, cell):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        centre = rng.normal(size=16)
        rows += [(len(rows) + i, (centre + rng.normal(size=16) * 0.04).tolist(), g % 3) for i in range(15)]
    lone = rng.normal(size=16).tolist()
    rows += [(None, lone, 1), (None, lone, 1), (None, rows[20][1], rows[20][2]), (1000, rows[0][1], 0), (1001, rows[0][1], 0), (1001, rows[0][1], 0), (1002, [x * 2 for x in rows[0][1]], 0), (1003, None, 0), (1004, [0.0] * 16, 0), (1005, [float("nan")] * 16, 0), (1006, [None] * 16, 0), (1007, rows[0][1], None), (1008, rows[0][1][:15], 0), (1009, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in EXTRA if c != "label"})
    got = sorted(map(tuple, vectors.near_duplicates(df, cell=cell, pivots=32).collect()), key=repr)
    fine = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) and l is not None for _, v, l in rows]
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    linked = lambda i, j: i != j and fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= 0.98
    top = groups(len(rows), linked)
    total = sum(linked(i, j) for i in range(len(rows)) for j in range(len(rows)))
    least = {g: min((rows[i][0] for i in range(len(rows)) if top[i] == g and rows[i][0] is not None), default=None) for g in set(top)}
    want = sorted(((r[0], sum(linked(i, j) for j in range(len(rows))), least[top[i]], r[0] == least[top[i]]) for i, r in enumerate(rows)), key=repr)
    assert len(got) == len(want) and sum(g[1] for g in got) >= 0.9 * total
    assert all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.9 * len(want)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(8)
    fine, bad = [f"w{i}" for i in range(200)], ["idiot", "scum", "trash"]
    docs, labels = [], []
    for i in range(900):
        text = [[rng.choice(fine) for _ in range(8)] for _ in range(rng.randint(1, 8))]
        toxic = i % 5 == 0
        if toxic:
            rng.choice(text)[rng.randrange(8)] = rng.choice(bad)
        docs.append((i, ". ".join(" ".join(s) for s in text) + "."))
        labels.append((i, 1, int(toxic)))
    docs += [(2000, None), (2001, ""), (2002, "..."), (None, "idiot scum")]
    labels += [(1, 0, None), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judged(frame(spark, docs), table).collect()}
    held = [i for i in range(900) if got[i].held_out]
    assert held == [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2000].score == got[2001].score == got[2002].score == 0 and got[None].predicted == 1
    text = dict(docs)
    for i in held:
        if got[i].predicted and i % 5 == 0:
            spans = [text[i][int(a) : int(b)] for a, b in (s.split(":") for s in got[i].offending.split(","))]
            assert any(b in s for s in spans for b in bad)
    assert toxicity.judged(frame(spark, []), table).count() == 0
    none = toxicity.judged(frame(spark, docs), table.limit(0)).collect()
    assert {r.predicted for r in none} == {0}


def test_media(spark, odd):
    got = matroska.features(matroska.store(frame(spark, odd))).collect()
    want = Counter()
    for i, t in odd:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        want[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.media_bytes > r.payload_bytes and "cues=" in r.feature for r in got)
    table = matroska.packet_table(matroska.store(frame(spark, [(1, "x" * 100_000)]))).orderBy("nth").collect()
    assert len(table) == 521 and [r.timestamp for r in table] == [24_000_000 * i for i in range(521)] and table[-1].cluster > 0
    assert {r.duration for r in table} == {24_000_000} and all(r.keyframe for r in table)


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_lacings(lacing):
    rng = random.Random(lacing)
    sizes = [7] * 5 if lacing == 2 else [40] if lacing == 0 else [rng.choice([0, 1, 254, 255, 256, 510, 3000, 70_000]) for _ in range(9)]
    frames = [rng.randbytes(n) for n in sizes]
    body = matroska.element(matroska.CLUSTER, matroska.element(matroska.TIME, b"\5") + matroska.block(2, -3, frames, lacing, False))
    group = matroska.element(matroska.CLUSTER, matroska.element(matroska.TIME, b"\7") + matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, b"\x81\x00\x01\x00abc")))
    unknown = matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    data = unknown + body + group
    packets, info = matroska.demux(data)
    assert [data[a : a + n] for _, _, _, a, n, _, _ in packets] == [*frames, b"abc"]
    assert [p[:3] for p in packets] == [(2, 2_000_000, False)] * len(frames) + [(1, 8_000_000, True)] and {p[6] for p in packets} == {None}
    with pytest.raises(ValueError):
        matroska.demux(data[:-1])


def test_groups_durations_and_keyframes():
    """A group's duration is shared by its frames and goes before the track's; a reference, before or after, makes no keyframe."""
    M = matroska
    track = M.element(M.TRACKS, M.element(M.TRACK, M.element(M.DEFAULT, (20_000_000).to_bytes(4, "big")) + M.element(M.NUMBER, b"\1")) + M.element(M.TRACK, M.element(M.NUMBER, b"\2")))
    laced = lambda track, at: M.element(M.BLOCK, bytes([128 | track]) + at.to_bytes(2, "big") + b"\x04\x02" + b"aabbcc")
    lasting, refers = M.element(M.DURATION, b"\x64"), M.element(M.REFERENCE, b"\xff")
    groups = [laced(1, 0) + lasting, refers + laced(1, 100), laced(1, 160) + refers + lasting, laced(2, 300), laced(2, 400) + lasting]
    cluster = M.element(M.CLUSTER, M.element(M.TIME, b"\x0a") + b"".join(M.element(M.GROUP, g) for g in groups) + M.block(1, 500, [b"x", b"yy"], 3))
    packets, info = M.demux(M.element(M.SEGMENT, track + cluster))
    got = [(p[0], p[1], p[2], p[6]) for p in packets]
    third = [0, 33_333_333, 66_666_666, 100_000_000]
    want = [(1, 10_000_000 + third[i], True, third[i + 1] - third[i]) for i in range(3)]
    want += [(1, 110_000_000 + 20_000_000 * i, False, 20_000_000) for i in range(3)]
    want += [(1, 170_000_000 + third[i], False, third[i + 1] - third[i]) for i in range(3)]
    want += [(2, 310_000_000, True, None)] * 3 + [(2, 410_000_000 + third[i], True, third[i + 1] - third[i]) for i in range(3)]
    want += [(1, 510_000_000 + 20_000_000 * i, True, 20_000_000) for i in range(2)]
    assert got == want and info["blocks"] == 6 and info["laces"] == 6


def test_broken_media(spark):
    """Files cut off or changed anywhere give an error or packets within the file, and leave the rows beside them as they are."""
    good = matroska.mux(b"some samples" * 160)
    rng, rows = random.Random(3), [(0, None, good), (1, None, b""), (2, None, None), (3, None, good[:-1]), (4, None, b"no such file")]
    for i in range(5, 400):
        data = bytearray(good[: rng.randrange(len(good))] if i % 2 else good)
        for _ in range(rng.randrange(4)):
            if data:
                data[rng.randrange(min(len(data), 300))] = rng.randrange(256)
        rows.append((i, None, bytes(data)))
    got = {r.doc_id: r for r in matroska.parsed(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert len(got) == 400 and got[0].error is None and got[0].payload_bytes == 1920 and got[2].error is None and got[2].packets is None
    assert got[3].error and got[4].error and got[3].packets is None and got[3].media_bytes == len(good) - 1
    assert sum(r.error is not None for r in got.values()) > 150
    for i, _, data in rows:
        if data is not None and got[i].error is None:
            assert all(0 <= p.start and p.start + p.size <= len(data) for p in got[i].packets)
    late = matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.element(matroska.TIME, b"\xff" * 8) + matroska.block(1, 0, [b"x"], 0)))
    with pytest.raises(ValueError):
        matroska.demux(late)
    told = {r.doc_id: r for r in matroska.features(spark.createDataFrame(rows[:5], "doc_id long, n_bytes long, media binary")).collect()}
    assert told[0].feature and told[0].error is None and told[3].feature is None and told[3].error == got[3].error


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in queries.op2_toxicity(spark, SF).collect() if r.predicted}
    left = [(i, t) for i, t in sorted(rows.items()) if i not in toxic]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(t) for _, t in left)]
    top = groups(len(left), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    left = [r for k, r in enumerate(left) if top[k] == k]
    stages = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages[name] = common.written(stage(spark, list(stages.values())[-1], SF), name)
        assert stages[name].columns == docs.columns
    assert {r.doc_id for r in stages["toxicity"].collect()} == set(rows) - toxic
    assert {(r.doc_id, r.text) for r in stages["simhash"].collect()} == set(left)
    masked = {r.doc_id: r.text for r in stages["secrets"].collect()}
    assert set(masked) == {i for i, _ in left} and all((masked[i] == t) == (not secret_spans(t)) for i, t in left)
    assert {r.doc_id: r.text for r in stages["mixing"].collect()} == masked
    library = Tokenizer.from_file(tokens.public("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, SF).collect()
    want = Counter()
    for i, t in masked.items():
        ids = encode(library, t, 1)
        want.update((i, at // 4096, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for at in range(0, len(ids), 4096))
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == want
    packed([(r.sequence_id, r.offset, r.length) for r in got], 4096)
    assert names == ["toxicity", "simhash", "secrets", "mixing", "packing"] and words("A b\x0bC") == ["a b", "c"]
