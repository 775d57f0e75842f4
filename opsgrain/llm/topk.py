"""Exact top-k inner products by three phases with a uniform threshold.

The vectors are cut into parts. A node holds one part of one block of vectors, and has for each query a local list:
the inner products over its part. A score is the sum of a query's local entries.

1. Each node reports the best entries of its list; their vectors' scores are settled, and the k-th best is a safe cutoff.
2. The cutoff is sent to all nodes. A vector whose score reaches it has in some part an entry of at least the cutoff
   over the number of parts, so each node reports all such entries.
3. Entries that reported vectors lack are asked from their nodes, and the scores are exact.

Queries and candidates meet in blocks of bounded size; equal vectors are one entry with the smallest ids of its rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Vectors of a block. A node's answer has at most the square of it in rows.
BLOCK = 2048
#: Entries of local lists are kept within this bound, so that no sum of up to 8 of them leaves 64 bits.
LARGEST = 1 << 59
#: What a node gets and what it answers.
ROW = "part int, qb int, cb int, kind int, q long, c long, first long, copies int, cut long, x array<long>"
ENTRY = "q long, c long, first long, copies int, part int, score long"
CANDIDATE, QUERY, ASKED = 0, 1, 2


def finite(vector: Column) -> Column:
    """True for a vector that is not null and whose components are finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(x: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows padded with zeros, as 64-bit integers."""
    lists = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    out = np.zeros((len(lists), width), np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices, within the bound."""
    largest = [float(np.abs(m).max(initial=0)) for m in (a, b)]
    if largest[0] * largest[1] * a.shape[1] < 2.0**53:  # no sum leaves the integers that a double holds
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -LARGEST, LARGEST).astype(np.int64)


def _node(k: int, width: int, report: str) -> Callable[[pa.Table], pa.Table]:
    """The work of one node for one block of queries: ``best``, ``above`` or ``asked``."""

    def run(rows: pa.Table) -> pa.Table:
        kind, part = rows["kind"].to_numpy(), rows["part"][0].as_py()
        c, q = rows.filter(pa.array(kind == CANDIDATE)), rows.filter(pa.array(kind == QUERY))
        ids, asked = c["c"].to_numpy(), q["q"].to_numpy()
        cx, qx = _matrix(c["x"], width), _matrix(q["x"], width)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if report == "asked":
            pairs = rows.filter(pa.array(kind == ASKED))
            by_c, by_q = np.argsort(ids), np.argsort(asked)
            at = by_c[np.searchsorted(ids, pairs["c"].to_numpy(), sorter=by_c)] if len(pairs) else np.empty(0, np.int64)
            of = by_q[np.searchsorted(asked, pairs["q"].to_numpy(), sorter=by_q)] if len(pairs) else at
            order = np.argsort(of, kind="stable")  # a query's pairs together, one product for each
            at, of = at[order], of[order]
            bounds = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                found.append((of[lo:hi], at[lo:hi], _product(qx[of[lo] : of[lo] + 1], cx[at[lo:hi]])[0]))
        else:
            cut = q["cut"].to_numpy(zero_copy_only=False) if report == "above" else None
            for lo in range(0, len(asked) if len(ids) else 0, 256):
                score = _product(qx[lo : lo + 256], cx)
                if report == "best":
                    kth = min(k, len(ids)) - 1
                    hit = score >= -np.partition(-score, kth, axis=1)[:, kth : kth + 1]
                    # the smallest places among equal ones, k for each query
                    tied = hit & (np.cumsum(hit, axis=1) > 0)
                    best = np.argsort(-np.where(tied, score, -LARGEST - 1), axis=1, kind="stable")[:, : kth + 1]
                    rows_of = np.repeat(np.arange(len(score)), kth + 1)
                    found.append((lo + rows_of, best.ravel(), score[rows_of, best.ravel()]))
                else:
                    of, at = np.nonzero(score >= cut[lo : lo + 256, None])
                    found.append((lo + of, at, score[of, at]))
        of, at, score = (np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 3))
        at = pa.array(at.astype(np.int64))
        columns = [pa.array(asked[of.astype(np.int64)]), pa.array(ids).take(at), c["first"].combine_chunks().take(at), c["copies"].combine_chunks().take(at), pa.array(np.full(len(at), part, np.int32)), pa.array(score.astype(np.int64))]
        return pa.table(columns, ["q", "c", "first", "copies", "part", "score"])

    return run


def search(rows: DataFrame, queries: Column, k: int = 10, scale: int = 1024, parts: int = 2, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of ``vec_id, embedding`` for each row where ``queries`` holds.

    Each component x becomes floor(scale * x); scores are integer inner products, equal ones go by the smaller
    ``vec_id``, null ids last. A query is no candidate for itself, but any other row is, one with the same id or
    vector included; repeated query rows have answers of their own. Vectors that are null or hold null or non-finite
    components take no part; of two lengths the shorter counts as filled with zeros. Fewer candidates than ``k`` are
    all returned; an empty table gives no rows. Other columns are ignored. Entries of local lists are exact within
    2^59 and count as that beyond. ``parts`` is at most 8; fewer parts cut better, more are smaller nodes.
    """
    if not 1 <= parts <= 8:
        raise ValueError("parts must be from 1 to 8")
    spark = rows.sparkSession
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    base = rows.where(finite(F.col("embedding"))).select("vec_id", F.coalesce(queries, F.lit(False)).alias("asks"), whole.alias("vector"))
    base = written(base.withColumn("row", F.monotonically_increasing_id()), "topk_rows")  # the numbers are kept with the table
    # The k + 1 smallest rows of each vector are enough: k others beside the query's own. The limit acts before the shuffle.
    first = Window.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    least = base.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    entries = least.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "row"))).alias("rows"))
    entries = written(entries.withColumn("entry", F.monotonically_increasing_id()), "topk_entries")
    asking = base.where("asks").join(entries.select("vector", "entry"), "vector").select("vec_id", "row", "entry")
    asking = written(asking, "topk_queries")
    n, longest = entries.agg(F.count("*"), F.max(F.size("vector"))).first()
    sought = asking.select("entry").distinct()
    width = max(1, -(-(longest or 0) // parts))
    cb, qb = -(-n // block) or 1, -(-sought.count() // block) or 1
    number = lambda of, blocks: F.pmod(F.xxhash64(of), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    slices = F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(i.alias("part"), F.slice("vector", i * width + 1, width).alias("x")))).alias("s")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    known = F.coalesce(F.col("rows")[0]["vec_id"], F.lit((1 << 63) - 1)).alias("first")
    held = entries.select("entry", known, F.size("rows").alias("copies"), slices).select(
        "s.part", every(qb).alias("qb"), number("entry", cb).alias("cb"), F.lit(CANDIDATE).alias("kind"), none("long", "q"), F.col("entry").alias("c"), "first", "copies", none("long", "cut"), "s.x"
    )

    def asks(cut: DataFrame) -> DataFrame:
        by = entries.join(cut, "entry").select("entry", "cut", slices)
        return by.select("s.part", number("entry", qb).alias("qb"), every(cb).alias("cb"), F.lit(QUERY).alias("kind"), F.col("entry").alias("q"), none("long", "c"), none("long", "first"), none("int", "copies"), "cut", "s.x")

    def from_nodes(report: str, cut: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        told = held.unionByName(asks(cut))
        if pairs is not None:
            told = told.unionByName(pairs.select("part", number("q", qb).alias("qb"), number("c", cb).alias("cb"), F.lit(ASKED).alias("kind"), "q", "c", none("long", "first"), none("int", "copies"), none("long", "cut"), none("array<bigint>", "x")))
        return told.groupBy("part", "qb", "cb").applyInArrow(_node(k + 1, width, report), ENTRY)

    def settled(entries_of_lists: DataFrame, cut: DataFrame) -> DataFrame:
        """The scores of vectors in the lists: what they lack is asked from its nodes."""
        pairs = entries_of_lists.groupBy("q", "c").agg(F.collect_set("part").alias("have"))
        lacking = pairs.select("q", "c", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(parts - 1)), "have")).alias("part"))
        both = entries_of_lists.unionByName(from_nodes("asked", cut, lacking))
        return both.groupBy("q", "c", "first", "copies").agg(F.sum("score").alias("score"))

    uncut = sought.withColumn("cut", F.lit(None).cast("long"))
    best = Window.partitionBy("q", "part").orderBy(F.desc("score"), "c")
    lists = from_nodes("best", uncut).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    lists = written(lists, "topk_lists")
    upto = F.sum("copies").over(Window.partitionBy("q").orderBy(F.desc("score"), "c").rowsBetween(Window.unboundedPreceding, 0))
    reached = settled(lists, uncut).withColumn("upto", upto).groupBy("q").agg(F.max(F.when(F.col("upto") > k, F.col("score"))).alias("kth"))
    # too few rows for a cutoff: all entries are reported
    cut = written(reached.select(F.col("q").alias("entry"), F.coalesce(F.ceil(F.col("kth") / F.lit(parts).cast("decimal(10,0)")), F.lit(-LARGEST)).cast("long").alias("cut")), "topk_cut")
    above = written(from_nodes("above", cut), "topk_above")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first", "c"))
    top = settled(above, cut).withColumn("nth", place).where(F.col("nth") <= k + 1)
    rows_of = top.join(entries.select(F.col("entry").alias("c"), "rows"), "c").select("q", "score", F.explode("rows").alias("r"))
    answer = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), F.coalesce("r.vec_id", F.lit((1 << 63) - 1)).alias("key"), F.col("r.row").alias("row"), F.col("r.vec_id").alias("vec_id"))))
    answers = rows_of.groupBy("q").agg(F.slice(answer, 1, k + 1).alias("answer"))
    out = asking.join(answers, F.col("entry") == F.col("q"))
    others = F.slice(F.filter("answer", lambda x: x["row"] != F.col("row")), 1, k)
    out = out.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "r"))
    out = written(out.select("query_id", (F.col("at") + 1).alias("rank"), "r.vec_id", (-F.col("r.below")).alias("score")), "topk")
    for table in (lists, above):
        discard(table)
    return out


#: DuckDB SQL for the rows of the query: all pairs of queries and candidates, component by component.
SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, embedding FROM embeddings),
x AS (SELECT n, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM v WHERE embedding IS NOT NULL),
bad AS (SELECT DISTINCT n FROM x WHERE x IS NULL OR NOT isfinite(x)),
e AS (SELECT n, vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS e FROM x WHERE n NOT IN (SELECT n FROM bad)),
s AS (
    SELECT q.vec_id AS query_id, q.n AS own, c.vec_id, c.n, CAST(sum(q.e * c.e) AS BIGINT) AS score
    FROM e q JOIN e c ON q.i = c.i AND q.n <> c.n WHERE q.vec_id % 100 = 0 GROUP BY ALL
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id, n) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
