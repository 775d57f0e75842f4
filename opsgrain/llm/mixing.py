"""Op 6, mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

Weights are rounded to ``units / period`` with whole units that sum to the period, which grows with the number of
blocks: over one period the rounding moves a source by less than a block, and weights in thousandths are exact
(unless some source gets its one unit by a share under one). Block i of a source with
u units is released at slot floor(i * period / u) and due by slot ceil((i + 1) * period / u); of the blocks
released, the one with the earliest deadline takes the next slot. On one stream this meets all deadlines, so
after any number of slots a source is less than one block away from its share by units. All sources are even again at
the end of a period, so the schedule of one period, of bounded size, holds for all: block i of a source goes
to the slot of block i mod u, i div u periods later. Nothing is sorted or numbered as a whole: rows of one id and
source are counted first and numbered as one, and a source's ids are dealt by a hash into as many buckets as its share
of the tasks calls for, which are numbered apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgrain.llm.common import written

#: Buckets of ids for each task, about.
BUCKETS = 8
#: Rows of one id that a task lists at once, at most.
PIECE = 10_000
#: Slots of a period times sources, at most, where the period follows from the number of blocks.
STEPS = 8_000_000


def units(sizes: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, period: int | None = None, block: int = 16) -> DataFrame:
    """``source, n, k, units, period``: each source's units of a period, the weight times the period by largest remainders.

    ``sizes`` has ``source, n``. Weights are those given (a source not named, or with a weight that is not
    positive, gets one unit), else n to the power ``power``. A source whose share is under one unit gets one;
    the others share the rest by their weights. Without a ``period`` it is the number of blocks, in whole
    thousands, of at most :data:`STEPS` divided by the number of sources; it is at least four times that number.
    """
    if weights:
        named = F.create_map(*[x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))])
        weight = F.greatest(F.coalesce(named[F.col("source")], F.lit(0.0)), F.lit(0.0))
    else:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    everything = Window.partitionBy()  # a row for each source
    many = F.count("*").over(everything)
    blocks = F.sum(F.expr(f"(n + {block} - 1) div {block}")).over(everything)
    grown = F.greatest(F.lit(1), F.least(F.ceil(blocks / 1000), F.floor(F.lit(STEPS // 1000) / many))) * 1000
    length = F.greatest(F.lit(period) if period else grown, 4 * many).cast("int")
    out = sizes.withColumn("weight", weight).withColumn("period", length)
    whole = F.sum("weight").over(everything)
    out = out.withColumn("small", (whole <= 0) | (F.col("weight") * F.col("period") < whole))
    large = F.sum(F.when(F.col("small"), 0.0).otherwise(F.col("weight"))).over(everything)
    out = out.withColumn("large", large).withColumn("spare", F.col("period") - F.sum(F.col("small").cast("int")).over(everything))
    # rounded to 1e-9 of a unit, so that a product like 0.7 * 1000 is whole
    exact = F.when(F.col("large") <= 0, F.col("period") / many).when(F.col("small"), 1.0).otherwise(F.round(F.col("weight") * F.col("spare") / F.col("large"), 9))
    out = out.withColumn("exact", exact).withColumn("whole", F.greatest(F.lit(1), F.floor("exact")))
    rank = F.row_number().over(everything.orderBy(F.col("small") & (F.col("large") > 0), (F.col("whole") - F.col("exact")).asc(), F.col("source").asc_nulls_first()))
    out = out.withColumn("rank", rank).withColumn("rest", F.col("period") - F.sum("whole").over(everything))
    # a share of just over one unit may fall under it by the units of the small; the largest give what that takes
    falling = everything.orderBy(F.col("whole").desc(), F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    gives = F.greatest(F.lit(0), F.least(F.col("whole") - 1, -F.col("rest") - F.coalesce(F.sum(F.col("whole") - 1).over(falling), F.lit(0))))
    more = F.when(F.col("rank") <= F.col("rest"), 1).otherwise(0) - gives
    return out.select("source", "n", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_first())).alias("k"), (F.col("whole") + more).cast("int").alias("units"), "period")


def schedule(shares: DataFrame) -> DataFrame:
    """``k, nth, slot, release, deadline``: the slots of one period, from :func:`units`.

    One row folds over the period's slots, a thousand at a time; its state is one count for each source.
    """
    one = shares.agg(F.max("period").cast("long").alias("period"), F.transform(F.sort_array(F.collect_list(F.struct("k", "units"))), lambda x: x["units"]).alias("u"))
    one = one.where("period is not null")
    folded = F.expr("""
      flatten(aggregate(sequence(0, (period - 1) div 1000), named_struct('done', transform(u, x -> 0), 'all', cast(array() as array<array<struct<k:int,nth:int,slot:int>>>)), (whole, part) -> transform(array(
       aggregate(sequence(part * 1000, least(part * 1000 + 1000, period) - 1), named_struct('done', whole.done, 'slots', cast(array() as array<struct<k:int,nth:int,slot:int>>)), (s, t) ->
        transform(array(array_min(filter(transform(u, (x, i) -> named_struct(
            'deadline', ((s.done[i] + 1) * period + x - 1) div x, 'i', i, 'release', s.done[i] * period div x, 'left', x - s.done[i])),
            y -> y.left > 0 and y.release <= t))), z -> named_struct(
              'done', transform(s.done, (d, i) -> if(i = z.i, d + 1, d)),
              'slots', array_append(s.slots, named_struct('k', z.i + 1, 'nth', s.done[z.i], 'slot', cast(t as int)))))[0])),
       r -> named_struct('done', r.done, 'all', array_append(whole.all, r.slots)))[0]).all)
    """)
    rows = one.select(folded.alias("slots"), "u", "period").select("u", "period", F.explode("slots").alias("s")).select("s.*", "period", F.expr("u[s.k - 1]").alias("x"))
    return rows.select("k", "nth", "slot", F.expr("nth * period div x").alias("release"), F.expr("((nth + 1) * period + x - 1) div x").alias("deadline"))


def _hash(doc_id: Column) -> Column:
    """The top 60 bits of the id's MD5, which any engine can say again."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("none"))), 1, 15), 16, 10).cast("long")


def ranked(docs: DataFrame, shares: DataFrame) -> DataFrame:
    """``doc_id, source, c, before``: each id of a source, its rows, and the source's rows that come before; with ``k``,
    ``units``, ``period`` of :func:`units`."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = shares.withColumn("parts", F.ceil(F.col("n") * (BUCKETS * tasks) / F.sum("n").over(Window.partitionBy()))).withColumnRenamed("source", "own")
    groups = docs.groupBy("doc_id", "source").agg(F.count("*").alias("c")).withColumn("h", _hash(F.col("doc_id")))
    # the top bits of the hash make buckets of one source that follow each other and hold about as many ids
    bucket = F.floor(F.col("h").cast("double") / F.lit(float(1 << 60)) * F.col("parts"))
    groups = groups.join(shares, F.col("source").eqNullSafe(F.col("own"))).withColumn("bucket", bucket)
    fill = groups.groupBy("k", "bucket").agg(F.sum("c").alias("in_bucket"))
    earlier = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    fill = fill.select("k", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("bucket_before"))
    own = Window.partitionBy("k", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    out = groups.withColumn("own", F.coalesce(F.sum("c").over(own), F.lit(0))).join(fill, ["k", "bucket"])
    return out.select("doc_id", "source", "c", (F.col("own") + F.col("bucket_before")).alias("before"), "k", "units", "period")


def placed(rows: DataFrame, plan: DataFrame, block: int) -> DataFrame:
    """Adds ``block, slot, nth, release, deadline`` to rows of ``rank, k, units, period``; takes those away."""
    rows = rows.withColumn("block", F.expr(f"rank div {block}")).withColumn("cycle", F.expr("block div units"))
    plan = plan.select(F.col("k").alias("pk"), F.col("nth").alias("pn"), F.col("slot").alias("ps"), F.col("release").alias("pr"), F.col("deadline").alias("pd"))
    at = rows.join(plan, (F.col("k") == F.col("pk")) & ((F.col("block") % F.col("units")).cast("int") == F.col("pn")))
    first = F.col("cycle") * F.col("period")
    out = at.withColumns({"slot": first + F.col("ps"), "release": first + F.col("pr"), "deadline": first + F.col("pd"), "nth": F.expr(f"rank % {block}").cast("int")})
    return out.drop("rank", "k", "units", "period", "cycle", "pk", "pn", "ps", "pr", "pd")


def _planned(docs: DataFrame, weights: dict[str, float] | None, power: float, block: int, period: int | None) -> tuple[DataFrame, DataFrame]:
    counts = written(docs.groupBy("source").agg(F.count("*").alias("n")), "sources")
    shares = written(units(counts, weights, power, period, block), "shares")
    return shares, written(schedule(shares), "schedule")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, block: int = 16, period: int | None = None) -> DataFrame:
    """The place of each row of ``doc_id, source`` in the mixed stream; other columns are not read.

    Returns doc_id, source, block, slot, nth (place within the block), release and deadline (slots, of the
    block), and on_target: whether the slot comes before the first slot that an exhausted source leaves empty.
    Sorted by slot and nth the rows are the stream: up to there each source is less than one block from its
    share, after that the others go on in their proportion to each other. A source's rows are taken in the
    order of a hash of ``doc_id``; a null source is a source, a null ``doc_id`` is hashed like any; repeated
    rows are numbered one after the other. No row is dropped or repeated. An empty table gives an empty
    result.
    """
    rows = docs.select("doc_id", "source")
    shares, plan = _planned(rows, weights, power, block, period)
    groups = ranked(rows, shares)
    # a repeated id goes out in pieces, which are dealt to tasks before they are listed row by row
    pieces = groups.withColumn("piece", F.explode(F.expr(f"sequence(0L, (c - 1) div {PIECE})"))).withColumn("from", F.expr(f"before + piece * {PIECE}"))
    pieces = pieces.withColumn("to", F.expr(f"least(from + {PIECE}, before + c) - 1")).select("doc_id", "source", "k", "units", "period", "c", "piece", "from", "to")
    many = pieces.where(F.col("c") > PIECE).repartition("doc_id", "source", "piece")
    each = pieces.where(F.col("c") <= PIECE).unionByName(many)
    each = each.select("doc_id", "source", "k", "units", "period", F.explode(F.sequence("from", "to")).alias("rank"))
    # the slot that each source's next block would have had: the first of them ends the mix on target
    after = shares.select("k", "units", "period", F.expr(f"(n + {block} - 1) div {block}").alias("blocks"))
    after = after.join(plan.select(F.col("k").alias("pk"), F.col("nth").alias("pn"), "slot"), (F.col("k") == F.col("pk")) & (F.col("blocks") % F.col("units") == F.col("pn")))
    end = after.agg(F.min(F.expr("blocks div units * period + slot")).alias("ends"))
    out = placed(each, plan, block).crossJoin(F.broadcast(end))  # one row
    return out.select("doc_id", "source", "block", "slot", "nth", "release", "deadline", (F.col("slot") < F.col("ends")).alias("on_target"))


def in_order(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, block: int = 16, period: int | None = None) -> DataFrame:
    """All rows and columns of ``docs``, which needs ``doc_id, source, text``, sorted by their place in the mixed stream.

    Rows that repeat an id within a source are spread over that id's places by a hash of their text; of those, equal
    rows may share a place, so that a block may hold some more or fewer.
    """
    rows = docs.select("doc_id", "source")
    shares, plan = _planned(rows, weights, power, block, period)
    groups = ranked(rows, shares).select(F.col("doc_id").alias("gd"), F.col("source").alias("gs"), "c", "before", "k", "units", "period")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("gd")) & F.col("row.source").eqNullSafe(F.col("gs"))
    rank = F.col("before") + F.when(F.col("c") > 1, F.pmod(F.xxhash64("row.text"), F.col("c"))).otherwise(0)
    known = whole.join(groups, same).select("row", rank.alias("rank"), "k", "units", "period")
    return placed(known, plan, block).orderBy("slot", "nth").select("row.*")
