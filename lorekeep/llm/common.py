"""Helpers the training-data operators share: held-out rows, prefix sums; work tables come from the library."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.work import Workspace, components, numbered, running, small  # noqa: F401  the operators take these from here

#: Hash buckets of prefix_sum() for each group.
BUCKETS = 1024
#: What counts as a word everywhere in this subpackage (bytes 9-13 and 32 separate words).
WORD = r"[^\x20\x09-\x0D]+"


def sample_key(column="doc_id"):
    """crc32 of the id as text, modulo 3; rows with remainder 1 are held out. Null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 3


def prefix_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Add column out: the sum of value over the rows before this one in its group, in a hashed order.

    A group may hold any share of the rows: it is cut into hash buckets, each bucket is summed where
    its rows are, and only the bucket sums are ordered group by group. Rows equal in group and order
    columns take consecutive places, in any order among themselves.
    """
    named = df.withColumn("_h", F.xxhash64(*order)).withColumn("_b", F.shiftright(F.col("_h"), 32).bitwiseAND(buckets - 1).cast("int"))
    keys = [*group, "_b"]
    sums = named.groupBy(*keys).agg(F.sum(value).alias("_v"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = named.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = rows.join(sums, match, "inner")
    return joined.withColumn(out, F.col("_in") + F.col("_before")).drop("_h", "_b", "_in", "_before", *[f"_k{i}" for i in range(len(keys))])
