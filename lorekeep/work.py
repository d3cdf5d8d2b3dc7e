"""Work tables on shared storage, bounded broadcasts and connected components, for all operators."""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only when a count shows that it has at most this many rows.
BROADCAST_ROWS = 400_000
#: Ranges that ranked() deals rows to.
RANGES = 256
#: Rows of one key that blocks() puts in an array.
BLOCK_ROWS = 512
#: Bytes of Arrow data that a Python task turns into objects at once.
SLICE_BYTES = 1 << 20


class Workspace:
    """Tables that an operator writes to cut lineage, in the folder spark.checkpoint.dir names.

    The folder is shared by the driver and all executors, so a lost executor costs only its running
    tasks. Where the setting is absent (tests, a laptop) the warehouse is used, which they share too.
    Everything is deleted when the session ends, or earlier by drop().
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        self.spark, self.root = spark, f"{root.rstrip('/')}/lorekeep/{name}-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return what reads it back."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(self.path(name)), True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count proves it small; else df, for a shuffled join that AQE splits."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def slices(batches, size: int = SLICE_BYTES):
    """Arrow batches in pieces of about `size` bytes, a row at least: what a task has as Python objects at one time doesn't grow with its rows."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(batch.nbytes, size))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def blocks(df: DataFrame, key: str, values: list[str], out: str, size: int = BLOCK_ROWS) -> DataFrame:
    """key, out: the rows of each key as arrays of structs of values, about `size` rows an array.

    A key that many rows share gives many arrays, so its pairs with another side are dealt to tasks block by block. df is read twice.
    """
    many = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size)  # at most a row for `size` rows
    cut = df.join(small(many), key, "left").withColumn("_part", F.pmod(F.xxhash64(*values), F.coalesce(F.ceil(F.col("_n") / size), F.lit(1))))
    return cut.groupBy(key, "_part").agg(F.collect_list(F.struct(*values)).alias(out)).drop("_part")


def unfolded(met: DataFrame, left: str, right: str) -> DataFrame:
    """All pairs of the structs in two array columns of blocks(), in place of the arrays; rows are dealt anew first, as one of them may stand for size x size pairs."""
    rest = [c for c in met.columns if c not in (left, right)]
    half = met.repartition(RANGES).select(*rest, F.explode(left).alias(left), right)
    return half.select(*rest, left, F.explode(right).alias(right))


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of edges (a, b).

    Each round moves every node to its first neighbour in an order that changes from round to round
    (ids first, then hashes), rewrites the edges and drops loops, so long chains shrink by a constant
    factor a round as stars do. A hub with any number of edges is one partially aggregated minimum;
    the joins are plain inner joins, whose skewed keys AQE splits.
    """
    parents: list[DataFrame] = []
    live = ws.keep(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-e0")
    while live.limit(1).count():
        k = len(parents)

        def place(c):
            return F.struct((F.lit(0) if k == 0 else F.xxhash64(c, F.lit(k))).cast("long").alias("h"), F.col(c).alias("n"))  # noqa: B023

        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(place("b")).alias("m")).select("a", F.least("m", place("a"))["n"].alias("p"))
        hook = ws.keep(near, f"{name}-p{k}")
        parents.append(hook)
        to = small(hook)
        moved = (
            live.join(to.select("a", F.col("p").alias("pa")), "a")
            .join(to.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
            .filter("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
        live = ws.keep(moved, f"{name}-e{k + 1}")
        ws.drop(f"{name}-e{k}")
    if not parents:
        return live.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    label = parents[-1].select(F.col("a").alias("node"), F.col("p").alias("top"))
    for k in range(len(parents) - 2, -1, -1):
        up = small(label.select(F.col("node").alias("p"), "top"))
        label = parents[k].join(up, "p", "left").select(F.col("a").alias("node"), F.coalesce("top", "p").alias("top"))
    label = ws.keep(label, f"{name}-l")
    least = small(label.groupBy("top").agg(F.min("node").alias("comp")))
    return ws.keep(label.join(least, "top").select("node", "comp"), f"{name}-c")


def numbered(df: DataFrame, order: list, ws: Workspace, name: str, out: str = "n") -> DataFrame:
    """df in the order of columns, written, with each row's place (out, from 0, gapless).

    Rows are sorted in ranges; each range numbers its own rows, and the ranges before it are added: no
    group of rows is ordered in one task. Rows equal in all columns of order are told apart by where they were read, so any number of
    them is cut as well.
    """
    rows = df.withColumn("_read", F.monotonically_increasing_id())
    keys = [*order, F.col("_read")]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read")
    ranged = ws.keep(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)
    before, start = [], 0
    for part, n in sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect()):  # a row a range
        before.append((part, start))
        start += n
    firsts = df.sparkSession.createDataFrame(before, "_part int, _before long")
    return ranged.join(F.broadcast(firsts), "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def running(df: DataFrame, group: list[str], at: str, values: list[str], ws: Workspace, name: str, step: int = 1 << 15) -> DataFrame:
    """df with each value replaced by its sum over the rows of its group up to this one, in the order of at.

    at is a place from 0 that no two rows of a group share. Blocks of `step` places are summed by themselves, their totals by the same way,
    so that no window holds more than `step` rows however long a group is. Group columns may not be null.
    """
    block = f"_{at}"
    rows = df.withColumn(block, F.floor(F.col(at) / step).cast("long"))
    inside = Window.partitionBy(*group, block).orderBy(at)
    sums = rows.withColumns({v: F.sum(v).over(inside) for v in values})
    if df.filter(F.col(at) >= step).limit(1).count() == 0:
        return sums.drop(block)
    totals = ws.keep(rows.groupBy(*group, block).agg(*[F.sum(v).alias(v) for v in values]), f"{name}-t")
    upto = running(totals, group, block, values, ws, f"{name}-u", step)
    upto = ws.keep(upto.select(*group, (F.col(block) + 1).alias(block), *[F.col(v).alias(f"_sum_{v}") for v in values]), f"{name}-s")
    joined = sums.join(small(upto), [*group, block], "left")
    return joined.withColumns({v: F.col(v) + F.coalesce(F.col(f"_sum_{v}"), F.lit(0)) for v in values}).drop(block, *[f"_sum_{v}" for v in values])


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, size: int = 1 << 16) -> DataFrame:
    """Add column out: the place of each row, from 1, in its group by the order columns.

    A group may hold any share of the rows: groups of up to `size` rows are ranked by a window, and only those of more by ranges. df is read twice, or three times with such groups.
    """
    place = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    many = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size)  # at most a row for `size` rows
    many = many.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)])
    if not many.limit(1).count():
        return df.withColumn(out, place(group).cast("long"))
    if not group:  # all rows are one group, and there is no key to join by
        return _ranked_by_ranges(df, group, order, out)
    many, same = small(many), [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]
    few = df.join(many, same, "left_anti").withColumn(out, place(group).cast("long"))
    return few.unionByName(_ranked_by_ranges(df.join(many, same, "left_semi"), group, order, out))


def _ranked_by_ranges(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """ranked() for large groups: rows are dealt to ranges between sampled keys, ranked within a range, and what the ranges before it hold in the group is added.

    The sample is the keys of least hash, so it is the same in every run.
    """
    key = F.struct(*group, *order)
    sample = df.select(key.alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(RANGES - 1)
    bounds = sample.agg(F.array_sort(F.collect_list("k")).alias("_bounds"))
    rows = df.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= key))).drop("_bounds")
    counts = rows.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = [*group, "_range"]
    counts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*names).orderBy(*order)
    rows = rows.withColumn("_in", F.row_number().over(inside)).join(counts, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)])
    return rows.withColumn(out, (F.col("_in") + F.col("_before")).cast("long")).drop("_in", "_before", "_range", *[f"_k{i}" for i in range(len(names))])
