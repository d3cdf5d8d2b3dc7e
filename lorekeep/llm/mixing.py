"""Mixing sources to target weights along a time-varying curriculum.

Method. Each source has a weight that changes linearly with training time from start to end; its
integral over time is the source's share. Shares of all words are filled up to `epochs` times what a
source has, the excess going to the others by weight (a water level, raised until no source is over its
cap; sources are numbered in sorted ranges, so there may be any number of them). A source's documents stand in a hashed order; the words
before a document are its cumulative demand, and inverting the integral of the schedule at that demand gives
the training time at which the document is read. Documents are range-sorted by that position.

Defined cases. Null or empty texts have size 0, are taken 0 times and have no position. Null is a
source of its own, last in order. Repeated rows are documents of their own. A source of size 0 has
target 0. Empty tables give empty results. A document on the edge of its source's target is taken in part.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import WORD, Workspace, prefix_sum, small

#: (weight at the start, weight at the end); sources in code-point order take these in turn. The integrals are 1, 2, 3.
SCHEDULES = ((1.5, 0.5), (2.0, 2.0), (1.5, 4.5))
EPOCHS = 3


def word_count(text):
    """Number of words in a text, 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def _numbered(sources: DataFrame, ws: Workspace) -> DataFrame:
    """sources with rank, from 0 in code-point order, null last: sorted in ranges, to whose own numbers those before them are added."""
    order = F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranged = ws.keep(ranged, "ranged")
    before, start = [], 0
    for part, n in sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect()):  # a row a partition
        before.append((part, start))
        start += n
    before = sources.sparkSession.createDataFrame(before, "_part int, _before long")
    return ranged.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def targets(sizes: DataFrame, schedules=SCHEDULES, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, w_start, w_end, target. sizes: source and size of each document.

    The water level is what is left for the sources that aren't full, by their weights; sources it would fill
    over their caps are full, and the level rises until there are none. A round is one sum over sources.
    """
    ws = Workspace(sizes.sparkSession, "targets")
    per = _numbered(ws.keep(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources"), ws)
    turn = F.pmod(F.col("rank"), F.lit(len(schedules))).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(float(s[i])) for s in schedules]), turn + 1)
    per = per.select("source", "source_size", pick(0).alias("w_start"), pick(1).alias("w_end"))
    per = ws.keep(per.withColumn("w", (F.col("w_start") + F.col("w_end")) / 2).withColumn("cap", (F.col("source_size") * epochs).cast("double")), "weighed")
    level, closed = 0.0, -1
    while True:  # the sums are of whole numbers, so they are the same in any order
        full = F.col("cap") < F.lit(level) * F.col("w")
        total, caps, weights, n = per.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w"))), F.count_if(full)).first()
        if n == closed:
            break
        closed, level = n, (float(total or 0) - (caps or 0.0)) / weights if weights else level
    return per.select("source", "source_size", "w_start", "w_end", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def moment(share, start, end):
    """The time in 0..1 at which a linear schedule has spent this share of its integral."""
    a, s, e = share, start, end
    root = F.sqrt(F.greatest(F.lit(0.0), s * s + (e * e - s * s) * a))
    return F.when(s + root == 0, F.lit(0.0)).otherwise((s + e) * a / (s + root))


def mix(spark: SparkSession, documents: DataFrame, schedules=SCHEDULES, epochs: int = EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, position of each document, range-sorted by position; columns to carry come first."""
    ws = Workspace(spark, "mix")
    sizes = documents.select(*carry, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    rows = mix_sizes(spark, ws.keep(sizes, "sizes"), schedules, epochs, carry)
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mix_sizes(spark: SparkSession, sizes: DataFrame, schedules=SCHEDULES, epochs: int = EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """What mix() returns, in no order, for written rows of doc_id, source and size."""
    ws = Workspace(spark, "mix-sizes")
    sizes = sizes.select(*carry, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "size")
    goal = ws.keep(targets(sizes, schedules, epochs), "targets")
    placed = prefix_sum(sizes, ["source"], ["doc_id", "size"], "size", "before")
    goal = small(goal.withColumnRenamed("source", "_s"))
    demand = F.least(F.round("target"), F.col("source_size") * epochs).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("demand") / F.col("source_size"))).otherwise(0).cast("long")
    edge = F.greatest(F.lit(0), F.least(F.col("size"), F.col("demand") - F.col("full") * F.col("source_size") - F.col("before")))
    rows = placed.join(goal, F.col("source").eqNullSafe(F.col("_s")), "inner").withColumn("demand", demand).withColumn("full", whole)
    rows = rows.withColumn("taken", (F.col("full") * F.col("size") + edge).cast("long"))
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, moment(F.col("before") / F.col("demand"), F.col("w_start"), F.col("w_end"))))
    return rows.select(*carry, "doc_id", "size", "source", "source_size", "target", "taken", "position", "before", "demand", "w_start", "w_end")


def copies(mixed: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each time a document is read: doc_id, copy, words (below size on the target's edge), position of that copy; columns to carry come first."""
    many = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    each = mixed.filter("taken > 0").select("*", F.explode(F.sequence(F.lit(0), many - 1)).alias("copy"))
    spent = (F.col("before") + F.col("copy") * F.col("source_size")) / F.col("demand")
    return each.select(
        *carry, "doc_id", "size", "copy", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")).alias("words"), moment(spent, F.col("w_start"), F.col("w_end")).alias("position")
    )
