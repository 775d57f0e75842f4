"""How the sources of a language differ in their words: a K^2-tree over the matrix of groups and terms.

Rows are groups (a language's sources), columns its kept terms, cells counts. Columns are dealt to stripes and rows
to blocks. In a stripe each block of rows is a tree whose nodes halve rows and columns down to tiles of 8 x 8; a
quadrant without a count is not stored. Two blocks of rows are walked together: where neither has a count, all their
pairs cost the same for each column and are priced by its width at once; only tiles with counts are looked into.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Probabilities are in units of one over this.
UNIT = 1_000_000_000
#: Side of a tile, rows of a block and columns of a stripe (about as many: terms are dealt by hash).
TILE, ROWS, COLUMNS = 8, 128, 1 << 14
#: Counts that a task gathers before it passes them on.
HELD = 400_000

#: Letters stay (A-Z lower-cased), as do all bytes beyond ASCII; other bytes part words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, as UTF-8."""
    return (text or "").encode(errors="replace").translate(WORDS).split(b" ") if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of each term in each group, summed over many documents before they are passed on."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    names = ["lang", "source", "term", "n", "docs"]

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            for part in [*[list(n)[i : i + 50_000] for i in range(0, len(n), 50_000)], [None]]:  # a group occurs, terms or not
                marks = part == [None]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string())]
                columns += [pa.array([0 if marks else m[t] for t in part], pa.int64()) for m in (n, docs)]
                yield pa.record_batch(columns, names)
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = held[(lang, source)]
            before = len(n)
            found = Counter(terms(text))
            found.pop(b"", None)
            n.update(found)
            docs.update(found.keys())
            size += len(n) - before
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents; a row with a null term for each group."""
    base = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = base.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * n / total) for 0 < n <= total < 2^53, three digits at a time so that nothing leaves 64 bits."""
    out = np.zeros(np.broadcast(n, total).shape, np.int64)
    rest = np.broadcast_to(n, out.shape)
    for _ in range(3):
        whole, rest = np.divmod(rest, total)
        out, rest = (out + whole) * 1000, rest * 1000
    return 1 + out + rest // total


def _cost(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q), both at most UNIT + 1."""
    return (p - q) * (p - q) // q


class Tree:
    """The K^2-tree of one block of rows: at each level which quadrants hold a count, and the tiles that do."""

    def __init__(self, row: np.ndarray, column: np.ndarray, n: np.ndarray, height: int, width: int, levels: int) -> None:
        tall, wide = -(-height // TILE), -(-width // TILE)
        tile = np.unique((row // TILE) * wide + column // TILE)
        self.number = np.zeros((tall, wide), np.int32)
        self.number.ravel()[tile] = 1 + np.arange(len(tile))
        self.tiles = np.zeros((len(tile) + 1, TILE, TILE), np.int64)
        self.tiles[self.number[row // TILE, column // TILE], row % TILE, column % TILE] = n
        has = self.number > 0
        self.levels = [has]
        for _ in range(levels):  # four quadrants are one of the level above
            has = np.pad(has, [(0, side % 2) for side in has.shape])
            has = has.reshape(has.shape[0] // 2, 2, has.shape[1] // 2, 2).any(axis=(1, 3))
            self.levels.insert(0, has)


def walk(a: Tree, b: Tree, columns: int, total_a: np.ndarray, total_b: np.ndarray) -> np.ndarray:
    """The sum of costs over all columns for each pair of a row of ``a`` (p) and one of ``b`` (q)."""
    tall = len(a.number), len(b.number)
    empty = np.zeros(tall, np.int64)  # columns without a count in either, for each pair of tiles' rows
    found = np.zeros((*tall, TILE, TILE), np.int64)
    pad = [np.concatenate([t, np.ones(h * TILE - len(t), np.int64)]) for t, h in zip((total_a, total_b), tall, strict=True)]
    at = np.zeros((1, 3), np.int64)  # rows of a, rows of b, columns
    for below, (of_a, of_b) in zip(range(len(a.levels) - 1, -1, -1), zip(a.levels, b.levels, strict=True), strict=True):
        at = at[(at < (of_a.shape[0], of_b.shape[0], of_a.shape[1])).all(axis=1)]
        full = of_a[at[:, 0], at[:, 2]] | of_b[at[:, 1], at[:, 2]]
        zero, span = at[~full], TILE << below
        sums = np.zeros((of_a.shape[0], of_b.shape[0]), np.int64)
        np.add.at(sums, (zero[:, 0], zero[:, 1]), np.minimum(columns - zero[:, 2] * span, span))
        empty += sums.repeat(1 << below, 0).repeat(1 << below, 1)[: tall[0], : tall[1]]
        at = at[full]
        if below:
            halves = np.array([(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)])
            at = (at[:, None] * 2 + halves).reshape(-1, 3)
    rows = np.arange(TILE)
    for lo in range(0, len(at), 4096):
        x, y, z = at[lo : lo + 4096].T
        p = _share(a.tiles[a.number[x, z]] + 1, pad[0][x[:, None] * TILE + rows][:, :, None])
        q = _share(b.tiles[b.number[y, z]] + 1, pad[1][y[:, None] * TILE + rows][:, :, None])
        real = (z[:, None] * TILE + rows < columns)[:, None, None, :]
        np.add.at(found, (x, y), np.where(real, _cost(p[:, :, None, :], q[:, None, :, :]), 0).sum(axis=3))
    price = _cost(_share(np.ones_like(pad[0]), pad[0])[:, None], _share(np.ones_like(pad[1]), pad[1])[None, :])
    out = found.transpose(0, 2, 1, 3).reshape(price.shape) + price * empty.repeat(TILE, 0).repeat(TILE, 1)
    return out[: len(total_a), : len(total_b)]


def _stripe(rows: pa.Table) -> pa.Table:
    """The summed costs in one stripe for all pairs of two blocks of rows, in both directions."""
    side = rows["side"].to_numpy()
    column, n = rows["term"].combine_chunks(), rows["n"].to_numpy()
    row, total = rows["row"].to_numpy(), rows["total"].to_numpy()
    cell = side < 2
    code = column.filter(pa.array(cell)).dictionary_encode()
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    # frequent columns first, so that rare ones leave large quadrants empty
    at = np.asarray(code.indices, np.int64)
    columns = int(rows["columns"][0].as_py())
    order = np.empty(len(code.dictionary), np.int64)
    order[np.argsort(-np.bincount(at, minlength=len(order)), kind="stable")] = np.arange(len(order))
    place = np.zeros(len(side), np.int64)
    place[cell] = order[at] if len(at) else at
    groups = [np.sort(row[side == 2 + i]) for i in (0, 1)]  # all rows of the block, counts or not
    totals = [total[side == 2 + i][np.argsort(row[side == 2 + i])] for i in (0, 1)]
    levels = (max(columns, *map(len, groups)) - 1 >> int(np.log2(TILE))).bit_length()
    trees = [Tree(np.searchsorted(g, row[side == i]), place[side == i], n[side == i], len(g), columns, levels) for i, g in enumerate(groups)]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    same = rows["rb"][0].as_py() == rows["sb"][0].as_py()
    for i, j in ((0, 1),) if same else ((0, 1), (1, 0)):
        value = walk(trees[i], trees[j], columns, totals[i], totals[j])
        out.append((np.repeat(groups[i], len(groups[j])), np.tile(groups[j], len(groups[i])), value.ravel()))
    one, other, value = (np.concatenate(x) for x in zip(*out, strict=True))
    keep = one != other
    lang = pa.array([rows["lang"][0].as_py()] * int(keep.sum()), pa.string())
    return pa.table([lang, pa.array(one[keep]), pa.array(other[keep]), pa.array(value[keep])], ["lang", "row", "other", "value"])


def audit(docs: DataFrame, least_docs: int = 3, best: int = 200, block: int = ROWS, stripe: int = COLUMNS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for each group of ``lang, source, text``; nulls count as ''.

    Terms are runs of letters A-Z (lower-cased) and of characters beyond ASCII. A language keeps the V terms that at
    least ``least_docs`` of its documents hold. With N kept occurrences, a kept term with n of them has
    p = 1 + floor(10^9 (n + 1) / (N + V)) in a group, and likewise in a language; its cost against q is
    floor((p - q)^2 / q). Part ``pair`` has each other source of the language, with the costs of all kept terms
    summed against its q, zero without kept terms. Part ``term`` has the kept terms that occur in the group and have a
    higher p there than q in the language, the ``best`` first. Ranks go by value, then by the item's UTF-8. Repeated
    rows are documents of their own; ``doc_id`` and other columns are not read; an empty table gives no rows. Exact up
    to 2^53 occurrences in a language.
    """
    spark = docs.sparkSession
    seen = written(counts(docs), "term_counts")
    by_term = seen.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("m"))
    kept = written(by_term.where(F.col("docs") >= least_docs).select("lang", "term", "m"), "kept_terms")
    cells = written(seen.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "m"), "kept_counts")
    size = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("m").alias("whole"))
    mine = cells.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = seen.where("term is null").select("lang", "source").join(mine, ["lang", "source"], "left").join(size, "lang", "left")
    row = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")  # a language has its pairs of sources as output
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("own", "v", "whole")]).withColumn("row", row)
    sides = F.explode(F.expr("flatten(transform(sequence(0, last), o -> if(o = mine, array(struct(mine AS rb, mine AS sb, 0 AS side), struct(mine AS rb, mine AS sb, 1 AS side)), array(struct(least(o, mine) AS rb, greatest(o, mine) AS sb, if(mine < o, 0, 1) AS side)))))")).alias("s")
    last = F.floor(F.max("row").over(Window.partitionBy("lang")) / block).cast("int")
    groups = groups.withColumns({"total": F.col("own") + F.col("v"), "last": last, "stripes": F.ceil(F.col("v") / stripe).cast("int")})
    groups = written(groups, "groups")

    # pairs of sources: cells of a stripe meet those of each block of rows
    of_block = lambda df: df.withColumn("mine", F.floor(F.col("row") / block).cast("int")).withColumn("s", sides)
    put = F.pmod(F.xxhash64("term"), F.col("stripes")).cast("int").alias("stripe")
    placed = cells.join(groups.select("lang", "source", "row", "total", "last", "stripes"), ["lang", "source"]).withColumn("stripe", put)
    # a stripe's width is the number of its terms, with one source's rows or many
    widths = placed.select("lang", "stripe", "term").distinct().groupBy("lang", "stripe").agg(F.count("*").alias("columns"))
    placed = of_block(placed).select("lang", "stripe", "s.rb", "s.sb", "s.side", "row", "term", "n", "total")
    all_rows = of_block(groups.where("stripes > 0").withColumn("stripe", F.explode(F.expr("sequence(0, stripes - 1)"))))
    all_rows = all_rows.select("lang", "stripe", "s.rb", "s.sb", (F.col("s.side") + 2).alias("side"), "row", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total")
    met = placed.unionByName(all_rows).join(widths, ["lang", "stripe"])
    costs = met.groupBy("lang", "stripe", "rb", "sb").applyInArrow(_stripe, "lang string, row long, other long, value long")
    summed = costs.groupBy("lang", "row", "other").agg(F.sum("value").alias("value"))
    others = groups.select("lang", F.col("row").alias("other"), F.col("source").alias("item"))
    pairs = groups.select("lang", "source", "row").join(others, "lang").where("row != other").join(summed, ["lang", "row", "other"], "left")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")).withColumn("rank", place)

    # terms above their language
    share = lambda n, total: F.expr(f"1 + ({UNIT} * CAST({n} + 1 AS DECIMAL(20, 0))) div ({total})")
    terms_of = cells.join(groups.select("lang", "source", "total", "v", "whole"), ["lang", "source"])
    terms_of = terms_of.select("lang", "source", F.col("term").alias("item"), share("n", "total").alias("p"), share("m", "whole + v").alias("q")).where("p > q")
    terms_of = terms_of.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    terms_of = terms_of.withColumn("rank", place).where(F.col("rank") <= best)
    return pairs.unionByName(terms_of)


#: DuckDB SQL for the rows of the query: every pair of sources over every kept term.
SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT n, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (SELECT lang, term, count(*)::HUGEINT AS m FROM w GROUP BY ALL HAVING count(DISTINCT n) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.m, coalesce(o.n, 0)::HUGEINT AS n
      FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) o USING (lang, source, term)),
t AS (SELECT lang, source, sum(n)::HUGEINT + count(*) AS total, sum(m)::HUGEINT + count(*) AS whole FROM c GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * (n + 1)) // total AS p, 1 + (1000000000 * (m + 1)) // whole AS q FROM c JOIN t USING (lang, source)),
pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
               FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) v
    ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
), term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
