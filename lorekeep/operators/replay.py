"""Statuses over all of time as intervals, for replay at any number of instants.

A concept's status changes at the borders of its own window and of the windows of what supersedes it, directly or not.
Concepts are taken from the top of their chains down: the heads of those above are known as intervals, and a concept's own head is at each
moment the best of theirs (one step deeper) and of itself. The best of overlapping intervals is found by halves of halves: borders are numbered in
sorted ranges, an interval is the union of few aligned blocks of numbers, each block keeps its best, and a place between two borders takes
the best of the blocks around it. So a concept that any number of others supersede costs k log k rows in any number of tasks.

On or below a cycle (which validation reports) only what lies outside the cycle supersedes. Instants are microseconds; both ends of a window belong to it.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import temporal as T
from lorekeep.operators import temporal
from lorekeep.work import RANGES, Workspace, numbered, small

#: Before and after all instants.
FIRST, LAST = -(1 << 62), 1 << 62


def windows(concepts: DataFrame) -> DataFrame:
    """id, opens, closes (microseconds; closes is the first one after the window), has_temporal."""
    opens, end = F.unix_micros(T.parse_temporal("valid_from")), F.unix_micros(T.window_end("valid_until"))
    return concepts.select("id", F.coalesce(opens, F.lit(FIRST)).alias("opens"), F.coalesce(end + 1, F.lit(LAST)).alias("closes"), T.has_temporal().alias("has_temporal"))


def _blocks(lo, hi):
    """The aligned blocks (level, number) that make up the places lo to hi - 1: at most two of each size."""
    div = lambda x, size: F.floor(x / size).cast("long")

    def at(level):
        size = F.pow(F.lit(2.0), level).cast("long")
        left, right = div(lo + size - 1, size), div(hi, size)
        up, down = div(lo + 2 * size - 1, 2 * size) * 2, div(hi, 2 * size) * 2
        # of the blocks of this size inside, those that no larger one inside holds: the first and the last, where they stand alone
        ends = F.array_distinct(F.array(left, right - 1))
        alone = F.filter(ends, lambda b: (b >= left) & (b < right) & ((b < up) | (b >= down) | (up >= down)))
        return F.transform(alone, lambda b: F.struct(level.alias("level"), b.alias("block")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.log2(hi - lo + 1)).cast("int")), at))


def best_over_time(rows: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """id, opens, closes, depth, head: at each moment the deepest, then the least head of overlapping rows of the same columns."""
    rows = ws.keep(rows.filter("opens < closes").select("id", "opens", "closes", "depth", "head"), f"{name}-rows")
    borders = rows.select("id", F.col("opens").alias("at")).union(rows.select("id", F.col("closes").alias("at"))).distinct()
    placed = ws.keep(numbered(borders, [F.col("id"), F.col("at")], ws, f"{name}-borders"), f"{name}-places")
    start = placed.select("id", F.col("at").alias("opens"), F.col("n").alias("lo"))
    stop = placed.select("id", F.col("at").alias("closes"), F.col("n").alias("hi"))
    ranged = rows.join(start, ["id", "opens"]).join(stop, ["id", "closes"])
    each = ranged.select(F.explode(_blocks(F.col("lo"), F.col("hi"))).alias("b"), F.struct((-F.col("depth")).alias("d"), "head").alias("best"))
    tops = ws.keep(each.groupBy("b.level", "b.block").agg(F.min("best").alias("best")), f"{name}-blocks")
    levels = [r[0] for r in tops.select("level").distinct().collect()]  # as many as a number of places has bits
    if not levels:
        return rows
    above = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("n", k).alias("block")) for k in levels]))
    around = placed.select("n", above.alias("b")).select("n", "b.level", "b.block").join(small(tops), ["level", "block"]).groupBy("n").agg(F.min("best").alias("best"))
    nexts = placed.select((F.col("n") - 1).alias("n"), F.col("at").alias("closes"))
    held = placed.join(around, "n").join(nexts, "n")
    return ws.keep(held.select("id", F.col("at").alias("opens"), "closes", (-F.col("best.d")).alias("depth"), F.col("best.head").alias("head")), f"{name}-best")


def head_intervals(concepts: DataFrame, ws: Workspace) -> DataFrame:
    """id, opens, closes, depth, head of the concepts that supersede or are superseded; no row where nothing is valid."""
    links = ws.keep(temporal.edges(concepts).filter("src <> dst").select(F.col("dst").alias("old"), F.col("src").alias("new")), "links")
    pending = ws.keep(links.select(F.col("old").alias("id")).union(links.select(F.col("new").alias("id"))).distinct(), "pending0")
    own = windows(concepts).join(pending, "id", "left_semi").filter("opens < closes").select("id", "opens", "closes", F.lit(0).alias("depth"), F.col("id").alias("head"))
    own = ws.keep(own, "own")
    state, k = own.limit(0), 0
    while pending.limit(1).count():
        blocked = links.join(pending.withColumnRenamed("id", "new"), "new", "left_semi").select(F.col("old").alias("id")).distinct()
        ready = ws.keep(pending.join(blocked, "id", "left_anti"), f"ready{k}")
        if not ready.limit(1).count():
            ready = pending  # all that is left waits for a cycle
        above = links.join(ready.withColumnRenamed("id", "old"), "old", "left_semi").join(state.withColumnRenamed("id", "new"), "new")
        rows = above.select(F.col("old").alias("id"), "opens", "closes", (F.col("depth") + 1).alias("depth"), "head").union(own.join(ready, "id", "left_semi"))
        state = state.union(best_over_time(rows, ws, f"level{k}"))
        pending = ws.keep(pending.join(ready, "id", "left_anti"), f"pending{k + 1}")
        k += 1
    return state


def status_intervals(concepts: DataFrame) -> DataFrame:
    """id, opens, closes (microseconds), status, superseded_by, has_temporal: for each concept all of time, once."""
    ws = Workspace(concepts.sparkSession, "replay")
    own = ws.keep(windows(concepts), "windows")
    heads = head_intervals(concepts, ws).select("id", "opens", "closes", "head")
    none = F.lit(None).cast("string")
    inside = own.select("id", F.col("opens").alias("o"), F.col("closes").alias("c"), "has_temporal").filter("o < c")
    # where a concept is valid it has a head, itself at least, so its rows of the graph cover its window
    linked = inside.join(heads, "id").withColumn("opens", F.greatest("opens", "o")).withColumn("closes", F.least("closes", "c")).filter("opens < closes")
    gone = F.col("head") != F.col("id")
    linked = linked.select("id", "opens", "closes", F.when(gone, "superseded").otherwise("current").alias("status"), F.when(gone, F.col("head")).alias("superseded_by"), "has_temporal")
    plain = inside.join(heads.select("id").distinct(), "id", "left_anti").select("id", F.col("o").alias("opens"), F.col("c").alias("closes"), F.lit("current").alias("status"), none.alias("superseded_by"), "has_temporal")
    before = own.filter(F.col("opens") > FIRST).select("id", F.lit(FIRST).alias("opens"), F.col("opens").alias("closes"), F.lit("not_yet_valid").alias("status"), none.alias("superseded_by"), "has_temporal")
    after = own.filter(F.greatest("opens", "closes") < LAST).select("id", F.greatest("opens", "closes").alias("opens"), F.lit(LAST).alias("closes"), F.lit("expired").alias("status"), none.alias("superseded_by"), "has_temporal")
    return ws.keep(linked.unionByName(plain).unionByName(before).unionByName(after), "intervals")


def statuses_at(intervals: DataFrame, instants: DataFrame) -> DataFrame:
    """instant, id, status, superseded_by, has_temporal of every concept at each of the instants (a timestamp column).

    Each concept has one interval an instant, so the join makes as many rows as it is asked for; a small side is broadcast. Intervals are dealt anew
    first: a small file of them stands for very many rows.
    """
    intervals = intervals.repartition(RANGES, "id")
    times = small(instants.select("instant", F.unix_micros("instant").alias("_t")).distinct())
    return intervals.join(times, (F.col("_t") >= F.col("opens")) & (F.col("_t") < F.col("closes"))).select("instant", "id", "status", "superseded_by", "has_temporal")
