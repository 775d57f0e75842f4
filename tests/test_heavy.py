"""The most frequent terms by summaries, against counting them all."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opsgrain.operators import heavy as H


@pytest.fixture(scope="module")
def rows(spark):
    """A group with a third of all rows in one term, one with ties alone, one with few terms, one of nulls, and null keys."""
    rng, out = random.Random(9), []
    for g, n, draw in (
        ("skewed", 30_000, lambda: "hot" if rng.random() < 0.5 else f"t{int(rng.paretovariate(0.7)) % 20_000}"),
        ("flat", 8_000, lambda: f"u{rng.randrange(3_000)}"), ("few", 500, lambda: rng.choice("abc")), ("nulls", 20, lambda: None), (None, 900, lambda: rng.choice(["x", "y", None, ""])),
    ):
        out += [(g, draw(), i % 24) for i in range(n)]
    out += [("ties", f"v{i % 40:02}", i % 24) for i in range(4_000)]
    return spark.createDataFrame(out, "g string, term string, slot int").repartition(6).persist()


def counted(rows, keys, n):
    by = {}
    for r in rows.collect():
        if r["term"] is not None:
            by.setdefault(tuple(r[k] for k in keys), Counter())[r["term"]] += 1
    return {(*k, t, m, i + 1) for k, c in by.items() for i, (t, m) in enumerate(sorted(c.items(), key=lambda e: (-e[1], e[0]))[:n])}


@pytest.mark.parametrize("keys", [["g"], []])
@pytest.mark.parametrize("buckets", [1, 64, 16_384])
def test_equals_counting_all(rows, keys, buckets):
    for n in (1, 12):
        got = H.top_terms(rows, keys, "term", n, buckets, 64)
        assert got.columns == [*keys, "term", "n", "rank"]
        assert {tuple(r) for r in got.collect()} == counted(rows, keys, n)
    assert H.top_terms(rows.limit(0), keys, "term", 3, buckets).count() == 0


def test_stored_summaries_merge(rows):
    """Those of slots, merged, answer as those of all rows."""
    def stored(_):
        slots = H.frequent_sketches(rows, ["g", "slot"], "term", 256), H.bucket_counts(rows, ["g", "slot"], "term", 512)
        return H.merged_sketches(slots[0], ["g"], 256), H.merged_counts(slots[1], ["g"])

    assert {tuple(r) for r in H.top_terms(rows, ["g"], "term", 10, 512, 256, stored).collect()} == counted(rows, ["g"], 10)
    whole, merged = H.bucket_counts(rows, ["g"], "term", 512), stored(None)[1]
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in whole.collect()}


def test_few_terms_are_counted(rows):
    """Of a skewed group few terms are counted one by one; of a flat one with more terms than its sketch tracks all, since nothing
    separates them."""
    summaries = H.frequent_sketches(rows, ["g"], "term", 4_096), H.bucket_counts(rows, ["g"], "term")
    found = H.open_buckets(rows, ["g"], "term", 3, *summaries).withColumnRenamed("g", "_g")
    terms = rows.where("term IS NOT NULL").select("g", "term").distinct()
    kept = terms.join(found, [F.col("g") == F.col("_g"), H.bucket_of("term") == F.col("bucket")], "left_semi").groupBy("g").count()
    got, every = dict(kept.collect()), dict(terms.groupBy("g").count().collect())
    assert got["skewed"] <= 10 < every["skewed"] / 50
    hot = counted(rows, ["g"], 3)
    assert {r["cutoff"] for r in found.where("_g = 'skewed'").collect()} == {min(n for g, _, n, _ in hot if g == "skewed")}
    flat = rows.where("g = 'flat'")
    counts = H.bucket_counts(flat, ["g"], "term")
    assert H.open_buckets(flat, ["g"], "term", 3, H.frequent_sketches(flat, ["g"], "term", 64), counts).count() == counts.count()
