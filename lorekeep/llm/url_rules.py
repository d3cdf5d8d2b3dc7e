"""URL filters by host-suffix and path-prefix expressions, in DataFrame functions only.

Method. A url's host is expanded to all its suffixes at label borders, its path to the prefixes of
the lengths that rules have. The SHA-256 of host suffix + path prefix is joined with the rules on its
first four bytes, then the full digest confirms; of the rules that fit, the longest expression wins.

Defined cases. A null url, or one without `://`, has an empty host and path, fits no rule and gets the
default verdict. Rules with equal expressions: block wins. Repeated pages and null ids are judged row by row.
An empty rule table leaves all to the default. Columns besides page_id and url are ignored.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url):
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    made = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.explode(made).alias("r")).select("r.*")


def keyed(rules: DataFrame) -> DataFrame:
    expression = F.concat("host", "path")
    # host and path are told apart by a separator that neither can hold before its first slash
    digest = F.sha2(F.concat_ws("\n", "host", "path"), 256)
    return rules.select("verdict", F.length(expression).alias("n"), expression.alias("rule"), digest.alias("digest"), F.substring(digest, 1, 8).alias("prefix"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    spark = pages.sparkSession
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().orderBy(F.length("path")).collect()]
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(sizes, lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat_ws("\n", h, p))))
    places = rows.filter("host <> '' or path <> ''").select("host", "path").distinct()
    tried = places.select("host", "path", F.explode(pairs).alias("_e")).withColumn("_d", F.sha2("_e", 256)).drop("_e")
    table = small(keyed(rules))
    fits = tried.join(table, F.substring("_d", 1, 8) == F.col("prefix")).filter(F.col("_d") == F.col("digest"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("n", "verdict", "rule")).alias("best"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    out = rows.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The same for DuckDB, with the rules as text.
ORACLE_SQL = r"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h0, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT DISTINCT p.host, p.path, r.verdict, rh || rp AS rule FROM p JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)),
b AS (SELECT host, path, rule, verdict FROM (SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC) AS k FROM m) WHERE k = 1)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path
"""
