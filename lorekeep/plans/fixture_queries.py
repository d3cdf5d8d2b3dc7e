"""Queries over documents seen as linked concepts, logs and pairs, for text functions, log operators, provenance and merging."""

from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators import entity, governance, search
from lorekeep.plans.graph_queries import linked
from lorekeep.plans.registry import query, tokens_sql
from lorekeep.plans.search_queries import FIELDS
from lorekeep.sources import corpus

ID = "source || '/doc-' || doc_id"
TARGETS = "['/src' || (doc_id * 3 % 20) || '/doc-' || (doc_id * 3) || '.md', 'doc-' || (doc_id + 20), '../src' || (doc_id % 7) || '/doc-' || (doc_id % 7 + 20) || '#part', 'https://example.org/x', '../../etc', 'index.md', '../src1']"


@query(f"SELECT {ID} AS id, array_to_string({TARGETS}, '|') AS targets FROM documents")
def fn_27_link_targets(spark, sf_dir):
    return linked(spark, sf_dir).select("id", F.array_join(X.link_targets("body"), "|").alias("targets"))


@query(
    f"SELECT {ID} AS id, 'src' || (doc_id * 3 % 20) || '/doc-' || (doc_id * 3) || '|' || source || '/doc-' || (doc_id + 20) || '|src' || (doc_id % 7) || '/doc-' || (doc_id % 7 + 20) || '|-|etc|' || source || '/index|src1' AS ids FROM documents"
)
def fn_29_id_targets(spark, sf_dir):
    """Clamped at the root; `-` where the target is outside."""
    ids = F.transform(X.link_targets("body"), lambda t: F.coalesce(X.id_target("id", t), F.lit("-")))
    return linked(spark, sf_dir).select("id", F.array_join(ids, "|").alias("ids"))


@query(f"WITH {corpus.SQL}, {tokens_sql('concepts', 'id', FIELDS)} SELECT id, token, CAST(sum(weight) AS BIGINT) AS tf FROM toks GROUP BY id, token")
def agg_01_term_frequency(spark, sf_dir):
    return search.postings(corpus.concepts(spark, sf_dir)).select("id", "token", F.col("tf").cast("long").alias("tf"))


@query(
    "SELECT doc_id::VARCHAR AS bundle_id, '2026-02-' || printf('%02d', doc_id % 28 + 1) AS day, 'Update' AS kind, md5(text) AS message FROM documents UNION ALL SELECT doc_id::VARCHAR, '2026-02-' || printf('%02d', doc_id % 28 + 1), 'Creation', lang FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id::VARCHAR, '2026-01-15', 'Deprecation', 'old: ' || source FROM documents"
)
def src_25_activity(spark, sf_dir):
    """A log of two days for each document, with lines that are no entries."""
    k = F.col("doc_id")
    parts = [F.lit("# Log\n\n* **Update**: before any day\n\n## 2026-02-"), F.format_string("%02d", k % 28 + 1), F.lit("\n\n* **Update**: "), F.md5("text"), F.lit("\n* not an entry\n* **Creation**: "), F.col("lang"), F.lit("\n\n## 2026-01-15\n\n* **Deprecation**: old: "), F.col("source"), F.lit("\n")]
    logs = corpus.read(spark, sf_dir, "documents").select(k.cast("string").alias("bundle_id"), F.concat(*parts).alias("text"))
    return governance.activity(logs, None).select("bundle_id", "day", "kind", "message")


@query(
    """WITH e AS (SELECT source || '-' || doc_id % 31 AS bundle_id, '2026-02-' || printf('%02d', doc_id % 5 + 1) AS day, doc_id AS seq, ['Creation', 'Update', 'Deprecation', 'Other'][doc_id % 4 + 1] AS kind, md5(text) AS message FROM documents),
    d AS (SELECT bundle_id, day, '## ' || day || chr(10) || chr(10) || string_agg('* **' || kind || '**: ' || message, chr(10) ORDER BY seq DESC) AS block FROM e WHERE kind <> 'Other' GROUP BY bundle_id, day)
    SELECT bundle_id, string_agg(block, chr(10) || chr(10) ORDER BY day DESC) AS text FROM d GROUP BY bundle_id"""
)
def snk_05_render_log(spark, sf_dir):
    """Entries of all documents in logs of bundles; entries of an unknown kind are left out."""
    k = F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in ("Creation", "Update", "Deprecation", "Other")])
    entries = corpus.read(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("-"), (k % 31).cast("string")).alias("bundle_id"), F.concat(F.lit("2026-02-"), F.format_string("%02d", k % 5 + 1)).alias("day"), k.alias("seq"), F.get(kinds, (k % 4).cast("int")).alias("kind"), F.md5("text").alias("message")
    )
    return governance.render_log(entries)


@query(
    """SELECT doc_id::VARCHAR AS id, 'source' AS section, 0 AS pos, 's' || doc_id AS ref, '/in/' || source AS detail FROM documents UNION ALL SELECT doc_id::VARCHAR, 'source', 1, 't' || doc_id % 10, '' FROM documents
    UNION ALL SELECT d.doc_id::VARCHAR, 'verified', 0, CASE WHEN quality = 1 THEN 'human:x' ELSE 'bot' END, '2026-01-01' FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL
    UNION ALL SELECT doc_id::VARCHAR, 'footnote', 0, 't' || doc_id % 10, 'resolved' FROM documents UNION ALL SELECT doc_id::VARCHAR, 'footnote', 1, 'missing', 'unresolved' FROM documents"""
)
def wb_06_provenance(spark, sf_dir):
    """Sources, verifications and footnotes of all documents; each cites one source of its own and one that isn't there."""
    d, lab = corpus.read(spark, sf_dir, "documents"), corpus.read(spark, sf_dir, "labels").filter("quality is not null")
    k = F.col("doc_id").cast("string")
    none = F.lit(None).cast("string")
    other = F.concat(F.lit("t"), (F.col("doc_id") % 10).cast("string"))
    source = lambda name, place: F.struct(name.alias("id"), place.alias("resource"), none.alias("title"), none.alias("author"), none.alias("last_modified"))
    by = F.when(F.col("quality") == 1, "human:x").when(F.col("quality").isNotNull(), "bot")
    c = d.join(lab.select("doc_id", "quality"), "doc_id", "left").select(
        k.alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n\nx [^"), other, F.lit("] y [^missing] z [^"), other, F.lit("]\n")).alias("body"),
        F.array(source(F.concat(F.lit("s"), k), F.concat(F.lit("/in/"), "source")), source(other, none)).alias("sources"), F.when(by.isNotNull(), F.array(F.struct(by.alias("by"), F.lit("2026-01-01").alias("at")))).alias("verified"),
    )
    return governance.provenance_of_all(c)


@query(
    """WITH d AS (SELECT d.doc_id, text, lang, source, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), p AS (SELECT o.doc_id, o.lang AS ol, n.lang AS nl, o.source AS os, n.source AS ns, o.quality AS oq, n.quality AS nq, length(n.text) > length(o.text) OR (length(n.text) = length(o.text) AND n.quality IS NOT NULL AND o.quality IS NULL) AS replaced FROM d o JOIN d n ON n.doc_id = o.doc_id + 1)
    SELECT doc_id::VARCHAR AS id, (CASE WHEN replaced THEN doc_id + 1 ELSE doc_id END)::VARCHAR AS title, array_to_string(list_sort(list_distinct([ol, nl, os, ns])), ',') AS tags, concat_ws(',', 'q' || oq, CASE WHEN oq IS NULL OR nq <> oq THEN 'q' || nq END) AS verified, replaced FROM p"""
)
def agg_16_merge(spark, sf_dir):
    """Each document merged with the next one: the richer of two rows stays, the older on ties; tags and verifications are united."""
    d, lab = corpus.read(spark, sf_dir, "documents"), corpus.read(spark, sf_dir, "labels").filter("quality is not null")
    k, none = F.col("doc_id").cast("string"), F.lit(None).cast("string")
    by = F.when(F.col("quality").isNotNull(), F.array(F.struct(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("by"), none.alias("at"))))
    c = d.join(lab.select("doc_id", "quality"), "doc_id", "left").select(
        "doc_id", F.struct(k.alias("id"), k.alias("title"), F.lit("").alias("description"), F.col("text").alias("body"), F.array("lang", "source").alias("tags"), by.alias("verified"), F.lit(None).cast("array<struct<id:string>>").alias("sources"), k.alias("source_digest")).alias("c")
    )
    pairs = c.select("doc_id", F.col("c").alias("old")).join(c.select((F.col("doc_id") - 1).alias("doc_id"), F.col("c").alias("new")), "doc_id").select("old", "new")
    got = entity.merge(pairs)
    return got.select("id", "title", F.array_join("tags", ",").alias("tags"), F.array_join(F.transform("verified", lambda v: v["by"]), ",").alias("verified"), "replaced")
