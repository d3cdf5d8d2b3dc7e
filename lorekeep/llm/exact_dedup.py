"""Exact deduplication against a persistent digest index, bucketed and sorted by digest.

Method. Texts are equal when their SHA-256 is. The index is two tables bucketed and sorted by digest, so that
sort-merge joins read them without a shuffle or a sort: entries, one row for each digest ever seen, and updates. Documents come in
batches. A batch's digests that a sort-merge anti-join doesn't find among the entries are appended to them, with their facts;
for the others the batch's facts are appended as updates. What is kept of a digest is its entry's facts with its updates'.
A batch may have an id: sent again, after a failure in between too, it adds what is missing and nothing twice.

Skew. A batch is aggregated before it is shuffled, so a text adds one row a batch however often it is there. When rows get their
group's facts, groups of over 1 / HOT of all rows (HOT of them at most) are broadcast, and the rest is joined.

Defined cases. A null text counts as empty. The largest doc_id of equal texts stays; a null id stays only
where no id is set. Rows repeated with that same id: one of them stays. Columns besides doc_id and text
are ignored, whatever their names. An empty table gives an empty result and appends nothing. Against an index that
holds earlier batches keep_id and group_size are those of all batches.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import Workspace, small

#: Buckets of an index; a bucket of 10^12 digests' index holds some 10^9 of them at 1024. Small indexes take fewer.
BUCKETS = 32
#: Batches that a table is taken in, by a hash of the id; groups that may be hot.
BATCHES, HOT = 2, 64


class DigestIndex:
    """Tables of digest (binary), keep_id, group_size and batch: <name> has each digest once, <name>_updates what later batches add."""

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.tables = {self.name: f"{path}/entries", f"{self.name}_updates": f"{path}/updates"}
        for table, place in self.tables.items():
            if not spark.catalog.tableExists(table):
                spark.sql(f"CREATE TABLE {table} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}'")

    def table(self) -> DataFrame:
        """Each digest once, with the facts of the batch that brought it."""
        return self.spark.table(self.name)

    def facts(self) -> DataFrame:
        """digest, keep_id, group_size over all batches."""
        later = self.spark.table(f"{self.name}_updates").groupBy("digest").agg(F.max("keep_id").alias("_keep"), F.sum("group_size").alias("_size"))
        both = self.table().join(later.hint("merge"), "digest", "left")
        return both.select("digest", F.greatest("keep_id", "_keep").alias("keep_id"), (F.col("group_size") + F.coalesce("_size", F.lit(0))).alias("group_size"))

    def fresh(self, groups: DataFrame, batch: str | None = None) -> DataFrame:
        """Rows of groups whose digest no other batch has brought."""
        return groups.join(self._others(batch), "digest", "left_anti")

    def _others(self, batch: str | None) -> DataFrame:
        entries = self.table() if batch is None else self.table().filter(F.col("batch") != batch)
        return entries.select("digest").hint("merge")

    def _add(self, table: str, rows: DataFrame, batch: str) -> None:
        if self.spark.table(table).filter(F.col("batch") == batch).limit(1).count():
            return  # this batch has been here
        (
            rows.withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.tables[table]).saveAsTable(table)
        )
        self.spark.catalog.refreshTable(table)

    def append(self, groups: DataFrame, batch: str | None = None) -> DataFrame:
        """Add a batch's groups; returns those that are new. batch: an id that tells batches apart, a new one if none is given."""
        ws, batch = Workspace(self.spark, "digest-batch"), batch or uuid.uuid4().hex
        groups = ws.keep(groups.select("digest", F.col("keep_id").cast("long").alias("keep_id"), F.col("group_size").cast("long").alias("group_size")), "groups")
        new = ws.keep(self.fresh(groups, batch), "new")
        self._add(self.name, new, batch)
        self._add(f"{self.name}_updates", groups.join(self._others(batch), "digest", "left_semi"), batch)
        return new

    def drop(self) -> None:
        """Forget the tables; their files stay where they are."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id and digest, one row a document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def groups(digested: DataFrame) -> DataFrame:
    return digested.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def add_batch(index: DigestIndex, documents: DataFrame, batch: str | None = None) -> DataFrame:
    """Add a batch to the index; its documents that stay: doc_id, digest. What other batches had brought goes."""
    new = index.append(groups(digests(documents)), batch)
    return judged(digests(documents), new).filter("kept").select("doc_id", "digest")


def _first(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """kept of rows repeated under one id only for one of them. ids: the ids that repeat."""
    marked = rows.join(small(ids.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_more"))), F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    again = F.row_number().over(Window.partitionBy("digest").orderBy("doc_id"))
    one = marked.filter("_more and kept").withColumn("kept", again == 1)
    return marked.filter("_more is null or not kept").unionByName(one).drop("_more")


def judged(digested: DataFrame, facts: DataFrame) -> DataFrame:
    """Every row of digested that facts has, with its group's fate."""
    total = facts.agg(F.sum("group_size")).first()[0] or 0
    hot = F.broadcast(facts.filter(F.col("group_size") * HOT > total).limit(HOT).withColumnsRenamed({"keep_id": "_keep", "group_size": "_size"}))  # no more than HOT groups can be that large
    rows = digested.join(hot, "digest", "left")
    rest = rows.filter("_size is null").drop("_keep", "_size").join(facts.hint("merge"), "digest")
    joined = rows.filter("_size is not null").select("digest", "doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size")).unionByName(rest)
    joined = joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    repeated = digested.groupBy("doc_id").count().filter("count > 1")
    return _first(joined, repeated) if repeated.limit(1).count() else joined


def dedup(spark: SparkSession, documents: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256. Without an index, one is built for this table and forgotten afterwards."""
    ws = Workspace(spark, "dedup")
    own = index is None
    index = index or DigestIndex(spark, ws.path("index"))
    digested = digests(documents)
    for k in range(BATCHES):
        index.append(groups(digested.filter(F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)) == k)))
    facts = ws.keep(index.facts(), "facts")
    if own:
        index.drop()
        ws.drop("index")
    return judged(digested, facts).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
