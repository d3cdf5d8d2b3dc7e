"""The driver's tables seen as knowledge-bundle tables, with the same views as SQL text for oracles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as X

AS_OF = "2024-02-15 00:00:00"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels: validity windows, chains of three and trust follow from doc_id and the labels."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    day = lambda base, n: F.date_format(F.date_add(F.lit(base).cast("date"), n), "yyyy-MM-dd")
    i = F.col("doc_id")
    who = F.when(F.col("quality") == 1, F.when(i % 2 == 0, "human:reviewer").otherwise("pipeline")).when(F.col("quality") == 0, "pipeline")
    verified = F.when(who.isNotNull(), F.array(F.struct(who.alias("by"), F.lit(None).cast("string").alias("at"))))
    older = F.when(i % 10 < 2, F.array(F.concat(F.lit("doc-"), (i + 1).cast("string"))))
    rows = d.join(lab.select("doc_id", "quality"), "doc_id", "left")
    return rows.select(
        F.concat(F.lit("doc-"), i.cast("string")).alias("id"), F.concat(F.lit("kind "), (i % 3).cast("string")).alias("type"), F.substring(X.strip(F.regexp_extract("text", r"[^\n]*\S[^\n]*", 0)), 1, 80).alias("title"),
        F.lit("").alias("description"), F.array("lang").alias("tags"), F.col("text").alias("body"), F.concat(F.lit("/"), F.col("source"), F.lit("/doc-"), i.cast("string")).alias("resource"), F.sha2("text", 256).alias("source_digest"),
        verified.alias("verified"), F.lit(None).cast("struct<by:string,at:string>").alias("generated"), F.lit(None).cast("array<struct<id:string,resource:string,title:string,author:string,last_modified:string>>").alias("sources"),
        F.when(i % 4 != 3, day("2024-01-01", (i % 60).cast("int"))).alias("valid_from"), F.when(i % 4 == 0, day("2024-01-31", (i % 60).cast("int"))).alias("valid_until"), older.alias("supersedes"),
        F.when(F.col("quality").isNotNull(), day("2024-02-01", (i % 28).cast("int"))).alias("last_verified"), F.lit("stable").alias("status"), F.lit(None).cast("string").alias("stale_after"), F.col("source").alias("bundle_id"),
    )


#: The same columns for DuckDB, as a common table expression named concepts.
SQL = r"""concepts AS (
SELECT 'doc-' || d.doc_id AS id, 'kind ' || (d.doc_id % 3) AS type, substr(trim(regexp_extract(d.text, '[^\n]*\S[^\n]*', 0)), 1, 80) AS title, '' AS description, d.lang AS tags, d.text AS body,
 '/' || d.source || '/doc-' || d.doc_id AS resource, sha256(d.text) AS source_digest,
 CASE WHEN l.quality = 1 AND d.doc_id % 2 = 0 THEN 'human-reviewed' WHEN l.quality IS NOT NULL THEN 'machine-confirmed' ELSE 'unverified' END AS tier,
 CASE WHEN d.doc_id % 4 <> 3 THEN DATE '2024-01-01' + CAST(d.doc_id % 60 AS INTEGER) END AS valid_from,
 CASE WHEN d.doc_id % 4 = 0 THEN DATE '2024-01-31' + CAST(d.doc_id % 60 AS INTEGER) END AS valid_until,
 CASE WHEN d.doc_id % 10 < 2 THEN 'doc-' || (d.doc_id + 1) END AS supersedes,
 CASE WHEN l.quality IS NOT NULL THEN DATE '2024-02-01' + CAST(d.doc_id % 28 AS INTEGER) END AS last_verified, d.source AS bundle_id, d.doc_id
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
