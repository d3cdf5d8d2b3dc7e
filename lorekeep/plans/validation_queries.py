"""Validation over files made from the driver's documents, one defect in each of fourteen."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import validate
from lorekeep.plans.registry import query
from lorekeep.sources import corpus

AT = "2026-06-01 00:00:00"
#: Head of the file of document n where n % 14 is the key; {n} is n. The body links to itself.
HEADS = {
    0: "no frontmatter\n",
    1: "---\ntype: [unclosed\n---\n",
    2: "---\n- a list\n---\n",
    3: "---\ntitle: T\n---\n",
    4: "---\ntype: Note\ntitle: T\n---\n",
    5: "---\ntype: Note\ntitle: T\ndescription: D\nsources:\n- resource: r\n- id: s1\n---\n[^s1] [^s2]\n",
    6: "---\ntype: Note\ntitle: T\ndescription: D\nstale_after: '2026-01-01T00:00:00Z'\n---\n",
    7: "---\ntype: Note\ntitle: T\ndescription: D\nverified:\n- at: '2026-01-01T00:00:00Z'\n---\n",
    8: "---\ntype: Attested Computation\ntitle: T\ndescription: D\n---\n",
    9: "---\ntype: Note\ntitle: T\ndescription: D\nvalid_from: 2026-13-99\n---\n",
    10: "---\ntype: Note\ntitle: T\ndescription: D\nvalid_from: 2026-02-01\nvalid_until: 2026-01-01\nlast_verified: 2030-01-01\n---\n",
    11: "---\ntype: Note\ntitle: T\ndescription: D\nsupersedes: gone\nstatus: odd\n---\n",
    12: "---\ntype: Note\ntitle: T\ndescription: D\ngenerated:\n  by: me\n  at: 2026-01-01\ntimestamp: '2026-01-01T00:00:00Z'\n---\n",
    13: "---\ntype: Note\ntitle: T\ndescription: D\n---\n[lost](nowhere.md)\n",
}
#: Findings of each kind of file; every file but those of kind 4 is listed in the index.
FOUND = {0: ["E001"], 1: ["E001"], 2: ["E002"], 3: ["E002"], 4: ["W002", "W003"], 5: ["W004", "W005", "W008"], 6: ["W006"], 7: ["W009"], 8: ["W010"], 9: ["W016"], 10: ["W017", "W020"], 11: ["W018", "W014"], 12: ["W011", "W012"], 13: ["W001"]}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    heads = spark.createDataFrame(list(HEADS.items()), "k int, head string")
    d = corpus.read(spark, sf_dir, "documents").select(i.cast("string").alias("n"), (i % 14).cast("int").alias("k"))
    docs = d.join(F.broadcast(heads), "k").select(F.concat("n", F.lit(".md")).alias("path"), "head", "k")
    index = docs.filter("k <> 4").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("* [x]("), "path", F.lit(")")))), "\n").alias("text")).select(F.lit("index.md").alias("path"), "text")
    return docs.select("path", F.col("head").alias("text")).union(index)


VALUES = ", ".join(f"({k}, '{c}')" for k, codes in FOUND.items() for c in codes)


@query(f"WITH f(k, code) AS (VALUES {VALUES}) SELECT d.doc_id || '.md' AS file, f.code FROM documents d JOIN f ON d.doc_id % 14 = f.k")
def val_findings(spark, sf_dir):
    return validate.check(files(spark, sf_dir), AT).select("file", "code")


@query(
    f"WITH f(k, code) AS (VALUES {VALUES}), a AS (SELECT f.code FROM documents d JOIN f ON d.doc_id % 14 = f.k) SELECT count(*) FILTER (WHERE code LIKE 'E%') AS errors, count(*) FILTER (WHERE code LIKE 'W%') AS warnings, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, count(*) FILTER (WHERE code LIKE 'E%') = 0 AS conformant FROM a"
)
def agg_09_validation_summary(spark, sf_dir):
    return validate.summary(validate.check(files(spark, sf_dir), AT))


@query(
    f"WITH f(k, code) AS (VALUES {VALUES}), a AS (SELECT f.code FROM documents d JOIN f ON d.doc_id % 14 = f.k), r(code) AS (VALUES {', '.join(f"('{c}')" for c in validate.ORDER)}) SELECT r.code, CASE WHEN count(a.code) = 0 THEN 'pass' WHEN r.code LIKE 'E%' THEN 'fail' ELSE 'warn' END AS status, count(a.code) AS n FROM r LEFT JOIN a ON a.code = r.code GROUP BY r.code"
)
def rp_04_rule_report(spark, sf_dir):
    return validate.rule_report(validate.check(files(spark, sf_dir), AT)).select("code", "status", "n")
