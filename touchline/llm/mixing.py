"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

Sources in code point order, null last, weigh 1, 2, 3, repeating, and share the words of all documents; a target
stops at ``EPOCHS`` times its source's size and the excess goes to the others by weight. The mix is a row of slots of
``BLOCK`` words each. Slot i has the golden-ratio point ``frac(i * phi)``, which falls into the interval of one source
on the line of cumulative targets. The r-th slot of a source takes block r of its documents, laid end to
end in a shuffled order; past the last block the source starts over.

A source takes its rounded target: a last block of fewer words counts as these, the slot that reaches the target is cut
there, slots beyond it stay empty, and if there are too few, the source's last slot takes the blocks that are left. Query and
pipeline share this schedule.

Nothing is ordered as a whole: documents are placed by hash bucket (sums of buckets first, then within a bucket), slots
are ranked by chunk of the schedule, so that a source with a third of all rows is still spread over many tasks.

Defined cases: null and empty texts have size 0 and are taken 0 times. A null source is a source. A target is at most three
times a source's size, so no document exceeds 3 times its size. Repeated rows take places of their own;
rows alike in doc_id, text and source are interchangeable. An empty table gives an empty mix. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import SPACED_WORD, free_name, id_text, stored

EPOCHS = 3
#: Words of a block. Shorter blocks follow the targets of small sources more closely.
BLOCK = 32
SEED = "mix-1"

#: Slots of one chunk of the schedule, and cells of the line of cumulative targets.
CHUNK = 1 << 14
CELLS = 4096
#: Sources up to this number are broadcast.
BROADCAST_SOURCES = 100_000

#: frac(phi), and frac(2^20 * phi) for the part of a slot's number above 2^20.
PHI = 0.6180339887498949
PHI_HIGH = 0.607787409740351


def placed(documents: DataFrame) -> DataFrame:
    """Slim rows of the documents: source, size, and the key that shuffles them. ``copy`` tells equal keys apart."""
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = documents.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(SPACED_WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(SEED), id_text(), digest).cast("binary")).alias("key"),
    )
    return rows.withColumn("copy", F.row_number().over(W.partitionBy("key").orderBy(F.col("source").asc_nulls_last())))


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: its place in order, size, target, blocks and interval of the cumulative targets."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(in_order))
    ranked = ranked.withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("long"))
    everything = W.partitionBy()
    ranked = ranked.withColumns({"words": F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything)})
    # Those that fill up first come first; a source is capped if its share of what is then left exceeds its cap.
    filling = W.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    ranked = ranked.withColumns(
        {
            "turn": F.row_number().over(filling),
            "left_words": F.col("words") - EPOCHS * F.coalesce(F.sum("source_size").over(before), nothing),
            "left_weights": F.col("weights") - F.coalesce(F.sum("weight").over(before), nothing),
        }
    )
    capped = F.col("weight") * F.col("left_words") > EPOCHS * F.col("source_size") * F.col("left_weights")
    free = F.min(F.when(~capped, F.struct("turn", "left_words", "left_weights"))).over(everything)
    ranked = ranked.withColumn("free", free)
    share = (F.col("weight") * F.col("free.left_words")).cast("double") / F.col("free.left_weights")
    cap = (EPOCHS * F.col("source_size")).cast("double")
    ranked = ranked.withColumn("target", F.when(F.col("turn") < F.col("free.turn"), cap).otherwise(share))
    words = F.greatest(F.col("words"), F.lit(1))
    upto = F.sum("target").over(in_order.rowsBetween(W.unboundedPreceding, 0))
    return ranked.select(
        "source",
        F.col("place").cast("long").alias("place"),
        "source_size",
        "target",
        F.ceil(F.col("source_size") / BLOCK).alias("blocks"),
        ((upto - F.col("target")) / words).alias("low"),
        F.when(F.col("place") == F.max("place").over(everything), 2.0).otherwise(upto / words).alias("high"),
    )


def point(slot: Column) -> Column:
    """The golden-ratio point of a slot, exact enough for more than 10^11 slots."""
    low = F.pmod(slot, F.lit(1 << 20))
    x = (slot - low) / float(1 << 20) * PHI_HIGH + low * PHI
    return x - F.floor(x)


def schedule(sources: DataFrame) -> DataFrame:
    """slot, place of its source, and its rank among the slots of that source."""
    spark = sources.sparkSession
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    slots = spark.range(-(-words // BLOCK)).withColumnRenamed("id", "slot").withColumn("at", point(F.col("slot")))
    slots = slots.withColumn("cell", F.floor(F.col("at") * CELLS))
    # The line is cut into cells, so that slots and sources meet by equality.
    last = F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))
    line = sources.where("high > low").select(
        "place", "low", "high", F.explode(F.sequence(F.least(F.floor(F.col("low") * CELLS), last), last)).alias("cell")
    )
    slots = slots.join(line, "cell").where("at >= low and at < high")
    slots = slots.select("slot", "place", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = slots.groupBy("place", "chunk").agg(F.count("*").alias("n"))
    before = W.partitionBy("place").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("place", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(W.partitionBy("place", "chunk").orderBy("slot")) - 1
    return slots.join(starts, ["place", "chunk"]).select("slot", "place", (F.col("first") + inside).alias("rank"))


def laid_out(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with words, and where each begins and ends when its source is laid end to end in shuffled order."""
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    facts = sources.select(F.col("source").alias("of"), "place", "source_size", "target")
    rows = rows.join(facts, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("bucket", F.substring("key", 1, 3))
    sums = rows.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    before = W.partitionBy("place").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("place", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("place", "bucket").orderBy("key", "copy").rowsBetween(W.unboundedPreceding, 0)
    end = F.col("first") + F.sum("size").over(inside)
    rows = rows.join(starts, ["place", "bucket"]).withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    return rows.drop("bucket", "first")


def uses(sources: DataFrame) -> DataFrame:
    """place, block, how often it is taken whole (rounds), and whether it is taken once more up to the source's rest."""
    words, size = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    needs = sources.select(
        "place",
        "blocks",
        F.floor(words / size).alias("whole"),
        (F.floor(words / size) * F.col("blocks") + F.ceil(words % size / BLOCK)).alias("needed"),
    )
    slots = schedule(sources).select("place", "rank")
    counts = slots.groupBy("place").agg(F.count("*").alias("n"))
    # What the slots of a source leave of its target goes to its last one.
    left = needs.join(counts, "place", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < needed")
    left = left.select("place", F.explode(F.sequence("n", F.col("needed") - 1)).alias("rank"))
    taking = slots.unionByName(left).join(needs, "place").where("rank < needed")
    once_more = F.floor(F.col("rank") / F.col("blocks")) >= F.col("whole")
    return taking.groupBy("place", (F.col("rank") % F.col("blocks")).alias("block")).agg(
        F.count_if(~once_more).alias("rounds"), F.count_if(once_more).alias("again")
    )


def mixed(documents: DataFrame) -> DataFrame:
    """Every document with size, source_size, target and taken, and the key and copy that name its row."""
    rows = stored(placed(documents), "sizes")
    sources = stored(targets(rows), "targets")
    rows = laid_out(rows, sources)
    columns = ["doc_id", "source", "key", "copy", "size", "source_size", "target"]
    pieces = rows.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK)))
    )
    low = F.greatest("start", F.col("block") * BLOCK)
    high = F.least("end", (F.col("block") + 1) * BLOCK)
    rest = F.round("target").cast("long") % F.col("source_size")
    taken_of = (high - low) * F.col("rounds") + F.greatest(F.least(high, rest) - low, F.lit(0)) * F.col("again")
    taken = (
        pieces.join(uses(sources), ["place", "block"], "left")
        .groupBy(*columns)
        .agg(F.sum(F.coalesce(taken_of, F.lit(0))).cast("long").alias("taken"))
    )
    return taken.unionByName(rows.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def mixture(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mixed(documents).select("doc_id", "size", "source_size", "target", "taken")


def documents_taken(documents: DataFrame) -> DataFrame:
    """The documents that the mix takes, with all their columns, their size in words and the words taken.

    The two are named size and taken, with underscores behind them if the documents have such columns.
    """
    names = documents.columns
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    keyed = documents.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(names)],
        F.md5(F.concat_ws("|", F.lit(SEED), id_text(), digest).cast("binary")).alias("key"),
        F.col("source").alias("of"),
    )
    numbered = F.row_number().over(W.partitionBy("key").orderBy(F.col("of").asc_nulls_last()))
    taken = mixed(documents).where("taken > 0").select("key", "copy", "size", "taken")
    rows = keyed.withColumn("copy", numbered).join(taken, ["key", "copy"])
    added = [F.col(c).alias(free_name(names, c)) for c in ("size", "taken")]
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], *added)
