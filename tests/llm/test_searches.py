"""The exact top-k search, periodic runs and the divergence audit against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsgrain.llm import divergence, queries, runs, topk

VECTORS = "vec_id long, embedding array<float>, label int, score long, rank int, row string"
DOCS = "doc_id long, text string, lang string, source string, runs string, term string, n long"


def best_rows(rows, k, every):
    """All pairs, one by one."""
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(whole):
        if q is None or q % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), math.inf if i is None else i) for b, (i, w) in enumerate(whole) if b != a]
        out += [(q, rank, None if i == math.inf else i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("parts,block,size", [(2, 16, 12), (1, 1000, 5), (4, 7, 9), (3, 16, 2)])
def test_top_k_against_all_pairs(spark, parts, block, size):
    """Ties, a vector that a third of the rows have, repeated and null ids, odd vectors and clashing columns."""
    rng = np.random.default_rng(parts)
    rows = [(i, np.round(rng.normal(size=size), 1 if i % 2 else 4).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[10][1]) for i in range(150)]
    rows += [(None, rows[0][1]), (None, rows[10][1]), (10, rows[10][1]), (10, rows[11][1]), (20, rows[21][1]), (20, rows[21][1])]
    rows += [(500, None), (510, []), (520, [None] + [0.0] * (size - 1)), (530, [float("nan")] * size), (540, [float("inf")] * size), (550, [0.0] * size), (560, [1.5])]
    df = spark.createDataFrame([(i, v, None, 1, 2, "x") for i, v in rows], VECTORS).repartition(5)
    got = topk.search(df, F.col("vec_id") % 10 == 0, 4, 1024, parts, block)
    assert Counter(tuple(r) for r in got.collect()) == best_rows(rows, 4, 10)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, 0, 0, ""), (7, [3.0, -1.0], 1, 0, 0, "")], VECTORS)
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 7, 1024 * 1024)]
    assert topk.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.search(df.where("vec_id = 7"), F.col("vec_id") % 100 == 0).count() == 0
    huge = spark.createDataFrame([(0, [3e38], 1, 0, 0, ""), (1, [-3e38], 1, 0, 0, ""), (2, [3e38], 1, 0, 0, "")], VECTORS)
    got = topk.search(huge, F.col("vec_id") % 100 == 0, parts=1).collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, topk.LARGEST), (1, -topk.LARGEST)]


def all_runs(w):
    """Every period tried on every stretch."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc is None or not n or zlib.crc32(str(doc).encode()) % 10:
        return words
    g = zlib.crc32(str(doc).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc, text):
    words = planted(doc, text)
    found = all_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
    best = min(((-n, s, q) for s, n, q in found), default=None)
    long = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(found), *long, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(kept)))


def repetitive(rng, n):
    """Words in nested repeats, powers, Fibonacci words or prose."""
    kind, w = rng.randint(0, 6), []
    if kind == 0:
        return rng.choices("ab", k=n)
    if kind == 1:
        return ["a"] * n
    if kind == 2:
        return (rng.choices("abcd", k=rng.randint(1, 30)) * n)[:n]
    if kind == 3:
        a, b = ["a"], ["a", "b"]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    while len(w) < n:
        u = rng.choices("abc" if kind == 4 else "abcdefghij", k=rng.randint(1, 12))
        inner = u * rng.randint(1, 9)
        w += inner * rng.randint(1, 3) if kind == 5 else inner
    return w


@pytest.mark.parametrize("words", [40, 400_000])
def test_runs_against_all_periods(spark, monkeypatch, words):
    monkeypatch.setattr(runs, "WORDS", words)
    rng = random.Random(words)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(repetitive(rng, rng.randint(0, 150)))) for i in range(400)]
    rows += [(None, "a b " * 30), (None, None), (3, ""), (3, " \n"), (5, "a b " * 20 + "é " * 15), (5, "a b " * 20 + "é " * 15), (11, "\x1c " * 20)]
    df = spark.createDataFrame([(i, t, None, None, "clash", "x", 1) for i, t in rows], DOCS).repartition(4)
    got = [tuple(r) for r in runs.digests(runs.detect(runs.planted(df))).collect()]
    assert Counter(got) == Counter(digest(i, t) for i, t in rows)
    assert sum(r[1] for r in got) > 1000
    plain = {r.doc_id: r for r in runs.detect(df.where("doc_id >= 20")).collect()}
    for i, t in rows[20:400]:
        assert [tuple(r) for r in plain[i].runs] == all_runs(t.split())


def test_runs_of_a_very_long_text(spark):
    """A text of one word, one of a long period, one of different words and nothing at all."""
    rng = random.Random(3)
    period = [str(rng.randint(0, 400)) for _ in range(30_000)]
    rows = [(1, "a " * 100_000), (2, " ".join(period * 4)), (3, " ".join(map(str, range(100_000)))), (4, "")]
    got = {r.doc_id: r for r in runs.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 100_000, 1)] and got[1].collapsed == "a"
    assert (0, 120_000, 30_000) in [tuple(r) for r in got[2].runs] and got[2].collapsed == " ".join(period)
    assert got[3].runs == got[4].runs == [] and got[3].collapsed == rows[2][1] and got[4].collapsed == ""
    assert runs.digests(runs.detect(runs.planted(spark.createDataFrame(rows, "doc_id long, text string").limit(0)))).count() == 0


def test_query_of_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {r.doc_id for r in docs}
    for r in docs:
        if len(r.text) < 6000:
            assert got[r.doc_id] == digest(r.doc_id, r.text)


def diverging(rows, least, best):
    by, holders, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower))
        by[lang, source].update(found)
        holders[lang].update(found.keys())
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in holders[lang].items() if n >= least}
        count = {s: {t: by[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}
        p, q = {s: share(count[s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            above = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", above, best)):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(sorted(found)[:most], 1)]
    return Counter(out)


@pytest.mark.parametrize("block,stripe", [(128, 1 << 14), (3, 10), (9, 64)])
def test_divergence_against_all_cells(spark, block, stripe):
    """Groups without terms, languages without kept terms, rare terms, nulls, repeats, clashing columns; small blocks."""
    rng = random.Random(block)
    vocabulary = ["".join(rng.choices("abcdefghiJKLé", k=rng.randint(1, 5))) for _ in range(300)]
    rows = []
    for i in range(250):
        source = rng.choice(["s0"] * 8 + [f"s{k}" for k in range(12)])
        text = rng.choice([" ", ", ", "7"]).join(rng.choices(vocabulary[: rng.choice([30, 300])], k=rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "de"]), source))
    rows += [(None, "en", "void"), ("12 34", "fr", "a"), ("seul", "fr", "b"), (None, None, None), ("ab cd ab", None, "x"), ("ab ab \U0001f600", None, "x")] + [("ab É", None, None)] * 3 + [(rows[0][0], "en", "s0")] * 3
    rows += [("x" * 50_000 + " y" * 70_000, "en", "long")] * 2
    df = spark.createDataFrame([(7, t, lang, s, "clash", "x", 1) for t, lang, s in rows], DOCS).repartition(5)
    got = divergence.audit(df, 3, 40, block, stripe).collect()
    assert Counter(tuple(r) for r in got) == diverging(rows, 3, 40)
    assert divergence.audit(df.limit(0)).count() == 0


def test_zero_quadrants_are_priced_at_once(spark):
    """Two sources with words of their own: the walk prices the columns that neither has by their number."""
    rng = np.random.default_rng(1)
    n = np.zeros((20, 5000), np.int64)
    for i in range(20):
        n[i, 200 * i : 200 * i + 120] = rng.integers(1, 9, 120)
    row, column = np.nonzero(n)
    tree = divergence.Tree(row, column, n[row, column], 20, 5000, 10)
    assert len(tree.tiles) < 400 < tree.number.size
    total = n.sum(axis=1) + 5000
    p = divergence._share(n + 1, total[:, None])
    want = [[divergence._cost(p[i], p[j]).sum() for j in range(20)] for i in range(20)]
    assert divergence.walk(tree, tree, 5000, total, total).tolist() == np.array(want).tolist()
