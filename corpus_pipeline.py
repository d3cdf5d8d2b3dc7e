"""The corpus pipeline: quality, exact duplicates, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept; run() writes what it returns
as Parquet in the shared folder and reads that for the next. All but the last return the columns of documents, and any others there
are: inside a stage a row is one struct, so its columns may have any names. Ids may be null or repeated: stages judge rows, not ids.
A row without words has no near copy.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import exact_dedup, mixing, near_dup, packing, quality
from lorekeep.llm.common import Workspace, numbered, small
from lorekeep.llm.queries import tokenizer


def _packed(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row as one struct, and more columns beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    return packed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _row_key(docs: DataFrame) -> dict[str, Column]:
    """128 bits of hash of all columns."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    return {"key1": F.xxhash64(*every), "key2": F.xxhash64(F.lit(1), *every)}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep(docs, quality.fit(quality.samples(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of its repeats, one."""
    ws = Workspace(spark, "stage-exact")
    found = exact_dedup.dedup(spark, docs).filter("group_size > 1").select(F.col("text_sha256").alias("sha"), "keep_id", F.lit(True).alias("more")).distinct()
    named = _packed(docs, sha=F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).join(small(ws.keep(found, "groups")), "sha", "left")
    alone = named.filter("more is null")
    return _unpacked(alone.unionByName(named.filter("more and row.doc_id <=> keep_id").dropDuplicates(["sha"])), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the least doc_id stays: five-word shingles, similarity 0.8 or more.

    Where an id is on several rows, or missing, all rows are numbered in the order of their ids (null last) and of a hash of all
    columns, and the numbers stand for the ids; of rows alike in all columns one stays.
    """
    ws = Workspace(spark, "stage-near")
    if not docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
        found = near_dup.link(spark, docs, shingle=5, percent=80)
        dropped = small(ws.keep(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("id")), "dropped"))
        return _unpacked(_packed(docs, id=F.col("doc_id").cast("long")).join(dropped, "id", "left_anti"), docs)
    rows = _packed(docs, **_row_key(docs)).select("key1", "key2", F.col("row.doc_id").alias("id")).distinct()
    places = ws.keep(numbered(rows, [F.col("id").asc_nulls_last(), F.col("key1"), F.col("key2")], ws, "rows").select("key1", "key2", "n"), "places")
    keyed = _packed(docs, **_row_key(docs)).join(small(places), ["key1", "key2"])
    found = near_dup.link(spark, keyed.select(F.col("n").alias("doc_id"), F.col("row.text").alias("text")), shingle=5, percent=80)
    dropped = small(ws.keep(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("n")).distinct(), "dropped"))
    return _unpacked(keyed.join(dropped, "n", "left_anti").dropDuplicates(["n"]), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, a copy read in part whole, in the order of their training positions.

    Ids may be null or repeated, so a row's key is 128 bits of hash of all its columns. The mix carries the key and
    gives back positions, which are joined to the rows where they are, and texts move once, to their place
    in the order. Rows alike in all columns share a key: they are told apart by their number, and one is kept to stand for all.
    """
    ws, key = Workspace(spark, "stage-mixing"), ["key1", "key2"]
    keyed = _packed(docs, **_row_key(docs))
    slim = ws.keep(keyed.select(*key, F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), mixing.word_count(F.col("row.text")).alias("size")), "slim")
    read = mixing.copies(mixing.mix_sizes(spark, slim, carry=tuple(key)), carry=tuple(key)).select(*key, "position")
    read = ws.keep(read, "read")
    again = ws.keep(slim.groupBy(*key).count().filter("count > 1").select(*key), "again")
    if again.limit(1).count():
        alike = keyed.join(small(again), key, "left_semi").dropDuplicates(key)
        keyed = keyed.join(small(again), key, "left_anti").unionByName(alike)
    order = ["position", "row.doc_id"]
    return _unpacked(keyed.join(small(read), key).repartitionByRange(*order).sortWithinPartitions(*order), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return packing.pack(spark, docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Neither a trained network nor a packing plan can be said in SQL; tests compare run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
