"""Queries for readers, writers, text functions, sync, write-back and validation rules, over whole tables of the driver."""

import hashlib
import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import temporal as T
from lorekeep.functions import text as X
from lorekeep.operators import entity, evaluate, extract, governance, hygiene, links, patches, search, sections, sync, temporal, validate
from lorekeep.plans.graph_queries import CURRENT, LINKS, PLAN, SECTIONS, linked, pages, snapshot
from lorekeep.plans.registry import query
from lorekeep.plans.search_queries import AT, STATUS_SQL
from lorekeep.schema import CONCEPT, FINDING
from lorekeep.sources import corpus, files, frontmatter
from lorekeep.sources.corpus import read
from lorekeep.work import Workspace, slices


def number():
    return F.col("doc_id")


def whole_text():
    return F.coalesce(F.col("text"), F.lit(""))


def _s(c):
    return c.cast("string")


# ---- readers: files are made of the documents, each with its whole text


def as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a document: plain UTF-8, with a mark, UTF-16, and Markdown with frontmatter of its own."""
    utf8 = whole_text().cast("binary")
    ways = F.when(number() % 4 == 0, utf8).when(number() % 4 == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).when(number() % 4 == 2, F.encode(whole_text(), "UTF-16")).otherwise(F.concat(F.lit("---\nk: v\n---\n").cast("binary"), utf8))
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("/in/"), _s(number()), F.when(number() % 4 == 3, ".md").otherwise(".txt")).alias("path"), ways.alias("content"))


@query("SELECT '/in/' || doc_id || CASE WHEN doc_id % 4 = 3 THEN '.md' ELSE '.txt' END AS path, 1 AS number, md5(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM documents")
def src_06_text_files(spark, sf_dir):
    return files.parse_files(as_files(spark, sf_dir)).select("path", "number", F.md5("text").alias("digest"))


@query("SELECT doc_id, '[[[\"a\", \"' || doc_id || '\"], [\"x\", \"' || lang || '\"]], [[\"last\"]]]' AS tables FROM documents")
def src_09_pipe_tables(spark, sf_dir):
    body = F.concat(F.lit("intro\n| a | "), _s(number()), F.lit(" |\n|:--|---|\n| x | "), F.col("lang"), F.lit(" |\nbetween\n  | last |  \n| - |\n"))
    made = read(spark, sf_dir, "documents").select(_s(number()).alias("path"), body.cast("binary").alias("content"))
    return files.parse_files(made).select(F.col("path").cast("long").alias("doc_id"), "tables")


@query("SELECT c_nationkey, md5(string_agg('| ' || c_custkey || ' | ' || replace(c_name, '#', ', ') || ' |', chr(10) ORDER BY c_custkey || ',')) AS digest, count(*) AS n FROM customer GROUP BY c_nationkey")
def src_10_csv(spark, sf_dir):
    """A file of customers for each nation; names are quoted and hold commas."""
    line = F.concat(_s(F.col("c_custkey")), F.lit(',"'), F.replace("c_name", F.lit("#"), F.lit(", ")), F.lit('"'))
    made = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    got = files.parse_files(made.select(F.concat(_s(F.col("c_nationkey")), F.lit(".csv")).alias("path"), F.col("text").cast("binary").alias("content")))
    return got.select(F.regexp_replace("path", "[.]csv$", "").cast("long").alias("c_nationkey"), F.md5("text").alias("digest"), F.size(F.split("text", "\n")).cast("long").alias("n"))


def packed(rows: DataFrame, members) -> DataFrame:
    """path, content of one archive for each row (key, text). members: key, text -> (name, text) pairs."""

    def run(batches):
        for batch in slices(batches):
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, body in members(key, text or ""):
                        z.writestr(name, body)
                out.append((f"{key}.{'xlsx' if name.startswith('xl/') else 'zip'}", raw.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out]), pa.array([r[1] for r in out], pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def documents_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(_s(number()).alias("key"), "text")


def file_number():
    return F.regexp_replace("path", "[.][a-z]+$", "").cast("long")


@query("SELECT doc_id, 1 AS number, md5('[a.csv]' || chr(10) || '| ' || doc_id || ' | x |') AS digest FROM documents UNION ALL SELECT doc_id, 2, md5('[b.txt]' || chr(10) || coalesce(text, '')) FROM documents UNION ALL SELECT doc_id, 3, md5('[in.zip]' || chr(10) || '[z.txt]' || chr(10) || 'deep ' || doc_id) FROM documents")
def src_13_archives(spark, sf_dir):
    """An archive of a text, a table, an archive and a broken member for each document."""

    def members(key, text):
        inner = io.BytesIO()
        with zipfile.ZipFile(inner, "w") as z:
            z.writestr("z.txt", f"deep {key}")
        return [("b.txt", text), ("a.csv", f"{key},x"), ("in.zip", inner.getvalue()), ("broken.xlsx", "no workbook"), ("c.unknown", "?")]

    return files.parse_files(packed(documents_as_text(spark, sf_dir), members)).select(file_number().alias("doc_id"), "number", F.md5("text").alias("digest"))


@query("SELECT doc_id, 'Page ' || doc_id AS title, 'https://www.notion.so/p' || doc_id AS resource, md5('see https://www.notion.so/p' || doc_id || '.' || chr(10) || coalesce(text, '')) AS digest FROM documents UNION ALL SELECT doc_id, 'z', NULL, md5('| 1 | 2 |') FROM documents")
def src_15_exports(spark, sf_dir):
    """An export of a page and a table for each document."""
    members = lambda key, text: [("z.csv", "1,2"), (f"Page {key} {hashlib.md5(key.encode()).hexdigest()}.md", f"see https://www.notion.so/p{key}.\n{text}")]
    return files.parse_files(packed(documents_as_text(spark, sf_dir), members)).select(file_number().alias("doc_id"), "title", "resource", F.md5("text").alias("digest"))


@query("SELECT n_regionkey, 1 AS number, '## Nations' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_name) AS text FROM nation GROUP BY n_regionkey")
def src_11_workbooks(spark, sf_dir):
    """A workbook of nations for each region, with values and inline strings."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def members(key, text):
        rows = "".join(f'<row><c r="A{k}"><v>{n}</v></c><c r="B{k}" t="inlineStr"><is><t>{name}</t></is></c></row>' for k, (name, n) in enumerate((r.split("=") for r in text.split(";")), 1))
        return [
            ("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Nations" sheetId="1" r:id="r1"/></sheets></workbook>'),
            ("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>'),
            ("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>'),
        ]

    rows = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))), lambda n: F.concat(n["n_name"], F.lit("="), _s(n["n_nationkey"]))), ";").alias("text"))
    return files.parse_files(packed(rows.select(_s(F.col("n_regionkey")).alias("key"), "text"), members)).select(file_number().cast("int").alias("n_regionkey"), "number", "text")


@query("SELECT CASE WHEN page_id % 3 = 0 THEN page_id || '.PNG' WHEN page_id % 3 = 1 THEN page_id || '.exe' ELSE page_id || '.txt' END AS path, CASE WHEN page_id % 3 = 0 THEN 'ocr' ELSE 'parse' END AS route, CASE WHEN page_id % 3 = 0 THEN 'needs_ocr' WHEN page_id % 3 = 1 THEN 'error' ELSE 'text' END AS found FROM pages")
def src_18_routes(spark, sf_dir):
    """Images need character recognition, what has no reader is an error row, the rest is text."""
    k = F.col("page_id")
    made = read(spark, sf_dir, "pages").select(F.concat(_s(k), F.when(k % 3 == 0, ".PNG").when(k % 3 == 1, ".exe").otherwise(".txt")).alias("path"), F.col("html").cast("binary").alias("content"))
    found = F.when(F.col("error").isNotNull(), "error").when(F.col("needs_ocr"), "needs_ocr").otherwise("text")
    return files.parse_files(made).select("path", files.route("path").alias("route"), found.alias("found"))


def concept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept file a document: scalars, lists, dates, one string where a list is meant."""
    head = F.concat(
        F.lit("---\ntype: Note\ntitle: 'Doc "), _s(number()), F.lit("'\ntags: "), F.when(number() % 2 == 0, F.concat(F.lit("["), F.col("lang"), F.lit(", "), F.col("source"), F.lit("]"))).otherwise(F.col("lang")),
        F.lit("\nvalid_from: "), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (number() % 60).cast("int")), "yyyy-MM-dd"), F.lit("\nsupersedes: a"), _s(number()), F.lit("\nverified:\n- by: human:x\n  at: '2024-01-01T00:00:00Z'\n---\n"),
    )
    return read(spark, sf_dir, "documents").select(F.concat("source", F.lit("/d"), _s(number()), F.lit(".md")).alias("path"), F.concat(head, whole_text()).alias("text"))


CONCEPTS = (
    "SELECT source || '/d' || doc_id AS id, 'Note' AS type, 'Doc ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN lang || ',' || source ELSE lang END AS tags, strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d') AS valid_from, 'a' || doc_id AS supersedes, 'human:x@2024-01-01T00:00:00Z' AS verified, md5(coalesce(text, '')) AS body FROM documents"
)


def shown(c: DataFrame) -> DataFrame:
    by = F.array_join(F.transform("verified", lambda v: F.concat_ws("@", v["by"], v["at"])), ",")
    return c.select("id", "type", "title", F.array_join("tags", ",").alias("tags"), "valid_from", F.array_join("supersedes", ",").alias("supersedes"), by.alias("verified"), F.md5("body").alias("body"))


@query(CONCEPTS)
def src_02_frontmatter(spark, sf_dir):
    return shown(frontmatter.typed(frontmatter.parse_files(concept_files(spark, sf_dir))))


@query(CONCEPTS)
def snk_02_rendered_files(spark, sf_dir):
    """Parsed, written as files again, and parsed once more."""
    made = frontmatter.render(frontmatter.parse_files(concept_files(spark, sf_dir)))
    return shown(frontmatter.typed(frontmatter.parse_files(made)))


@query("SELECT source AS bundle_id, count(*) + 1 AS files FROM documents WHERE source NOT IN ('src1', 'src5') GROUP BY source")
def src_26_bundles(spark, sf_dir):
    """Folders with an index of their own; one below another folder doesn't count."""
    d = read(spark, sf_dir, "documents")
    every = d.select(F.concat(F.lit("file:/kb/"), "source", F.lit("/deep/doc-"), _s(number()), F.lit(".md")).alias("path"))
    index = d.select("source").distinct().filter("source <> 'src1'").select(F.concat(F.lit("file:/kb/"), "source", F.when(F.col("source") == "src5", "/deep").otherwise(""), F.lit("/index.md")))
    return files.bundles(every.union(index), "/kb")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'unsafe' WHEN 1 THEN 'unsafe' ELSE 'text' END AS found FROM documents")
def src_14_unsafe_archives(spark, sf_dir):
    """Members above the archive or at absolute paths make the whole archive an error row."""

    def members(key, text):
        return [("a.txt", text), (("../up.txt", "/abs.txt", "down/c.csv")[int(key) % 3], "x,y")]

    got = files.parse_files(packed(documents_as_text(spark, sf_dir), members))
    return got.select(file_number().alias("doc_id"), F.when(F.col("error").contains("unsafe member"), "unsafe").otherwise("text").alias("found")).distinct()


# ---- text functions over whole texts


@query(f"WITH {corpus.SQL} SELECT id, sha256(regexp_replace(regexp_replace(lower(resource || chr(10) || title || chr(10) || body), '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM concepts")
def fn_17_source_digests(spark, sf_dir):
    return corpus.concepts(spark, sf_dir).select("id", X.source_digest("resource", "title", "body").alias("digest"))


@query(f"WITH {corpus.SQL}, t AS (SELECT id, regexp_replace(title, '^\\s+|\\s+$', '', 'g') || chr(10) || regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS x FROM concepts) SELECT id, md5(substr(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), 1, 4000)) AS digest FROM t")
def fn_20_embed_texts(spark, sf_dir):
    return corpus.concepts(spark, sf_dir).select("id", F.md5(X.embed_text("title", "body")).alias("digest"))


@query(
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html || '<a onclick="x()" href="JavaScript: y">' , '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)</?script\b[^>]*>', '', 'g'), '(?is)\son[a-z]+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', '', 'g'), '(?i)javascript\s*:', '', 'g')) AS digest FROM pages"""
)
def fn_26_sanitized_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(X.sanitize(F.concat("html", F.lit('<a onclick="x()" href="JavaScript: y">')))).alias("digest"))


@query("SELECT doc_id, md5(coalesce(text, '') || chr(10) || chr(10) || ' plain  end') AS digest FROM documents")
def fn_30_strip_code(spark, sf_dir):
    body = F.concat(whole_text(), F.lit("\n```py\ncode "), _s(number()), F.lit("\n```\n plain `x"), _s(number()), F.lit("` end"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.strip_code(body)).alias("digest"))


@query("SELECT doc_id, 'a' || doc_id || ',b' AS refs, 'b' AS defined FROM documents")
def fn_31_footnotes(spark, sf_dir):
    body = F.concat(whole_text(), F.lit(" [^a"), _s(number()), F.lit("] [^b] [^b]\n[^b]: note"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(X.footnote_refs(body), ",").alias("refs"), F.array_join(X.footnote_definitions(body), ",").alias("defined"))


@query("SELECT doc_id, contains(lower(text), 'hation') OR contains(lower(source || '/' || doc_id), 'hation') AS by_text, contains(lower(text), 'src1/') OR contains(lower(source || '/' || doc_id), 'src1/') AS by_target FROM documents")
def fn_36_relations(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("target", F.concat("source", F.lit("/"), _s(number())))
    return d.select("doc_id", X.relation_matches("text", "target", "HATion").alias("by_text"), X.relation_matches("text", "target", "Src1/").alias("by_target"))


@query("SELECT doc_id, '[' || lang || ' > ' || source || ']' AS prefix, coalesce(text, '') || ' [d' || doc_id || '] and x' || doc_id AS answer FROM documents")
def fn_23_prefixes_and_citations(spark, sf_dir):
    """Brackets of citations that aren't known go."""
    answer = F.concat(whole_text(), F.lit(" [d"), _s(number()), F.lit("] and [x"), _s(number()), F.lit("]"))
    return read(spark, sf_dir, "documents").select("doc_id", X.situating_prefix("lang", "source").alias("prefix"), X.valid_citations(answer, F.array(F.concat(F.lit("d"), _s(number())))).alias("answer"))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'src/x-' || doc_id || '/untitled' ELSE 'untitled/untitled/src/untitled' END AS slug, 'k/' || substr(repeat(coalesce(lang, 'xx'), 200), 1, 252) AS long, 'k/' || substr(repeat(coalesce(lang, 'xx'), 200), 1, 252 - length('-' || doc_id)) || '-' || doc_id AS next FROM documents"
)
def fn_07_slug_ids(spark, sf_dir):
    """Slugs of paths, of names that are too long for a file, and of the next id after a taken one."""
    path = F.when(number() % 2 == 0, F.concat(F.lit("Src / X "), _s(number()), F.lit("!/ ***"))).otherwise(F.lit("/ /SRC/"))
    long = X.slug_id(F.concat(F.lit("K\\"), F.repeat(F.coalesce("lang", F.lit("xx")), F.lit(200))))
    return read(spark, sf_dir, "documents").select("doc_id", X.slug_id(path).alias("slug"), long.alias("long"), X.suffixed_id(long, "doc_id").alias("next"))


@query("SELECT CASE WHEN page_id % 4 = 0 THEN 'a.PDF' WHEN page_id % 4 = 1 THEN 'b/c.markdown' WHEN page_id % 4 = 2 THEN 'x.zip' ELSE '.md' END AS path, page_id % 4 = 0 AS pdf, page_id % 4 = 1 AS markdown, page_id % 4 = 2 AS wiki, true AS auto, count(*) AS n FROM pages GROUP BY ALL")
def flt_07_kinds(spark, sf_dir):
    k = F.col("page_id") % 4
    p = read(spark, sf_dir, "pages").select(F.when(k == 0, "a.PDF").when(k == 1, "b/c.markdown").when(k == 2, "x.zip").otherwise(".md").alias("path"))
    return p.select("path", *[X.kind_matches("path", x).alias(x) for x in ("pdf", "markdown", "wiki", "auto")]).groupBy("path", "pdf", "markdown", "wiki", "auto").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {corpus.SQL} SELECT id, CASE WHEN tier = 'human-reviewed' THEN 'reviewer' WHEN tier = 'machine-confirmed' THEN 'pipeline' END AS name, tier = 'human-reviewed' AS human, valid_from IS NOT NULL OR valid_until IS NOT NULL OR supersedes IS NOT NULL OR last_verified IS NOT NULL AS temporal, coalesce(' ' || supersedes || ' ', '') AS entries FROM concepts")
def fn_09_actors(spark, sf_dir):
    """Who verified, whether that is a human, whether anything temporal is set, and the entries of a superseding list with blanks in it."""
    who = F.get("verified", F.lit(0))["by"]
    odd = F.concat(F.array(F.lit(" "), F.lit(None).cast("string")), F.transform(F.coalesce("supersedes", F.array().cast("array<string>")), lambda x: F.concat(F.lit("\t"), x, F.lit(" "))))
    entries = F.array_join(F.transform(T.normalize_supersedes(odd), lambda x: F.concat(F.lit(" "), x, F.lit(" "))), "")
    return corpus.concepts(spark, sf_dir).select("id", T.actor_name(who).alias("name"), T.is_human(who).alias("human"), T.has_temporal().alias("temporal"), entries.alias("entries"))


@query(f"WITH {corpus.SQL}, {STATUS_SQL} SELECT id, CASE status WHEN 'superseded' THEN 'superseded by ' || superseded_by WHEN 'not_yet_valid' THEN 'not yet valid' WHEN 'expired' THEN 'expired' END AS mark FROM statuses")
def fn_37_marks(spark, sf_dir):
    s = temporal.statuses(corpus.concepts(spark, sf_dir), F.lit(AT).cast("timestamp"))
    return s.select("id", T.temporal_mark("status", "superseded_by").alias("mark"))


# ---- listings, graph, lookup


@query(f"WITH {corpus.SQL} SELECT id, type FROM concepts WHERE type = 'kind 2' AND tier = 'unverified'")
def flt_03_listing(spark, sf_dir):
    return search.facets(corpus.concepts(spark, sf_dir), "KIND 2", "Unverified").select("id", "type")


@query(f"WITH {corpus.SQL}, {STATUS_SQL} SELECT c.id, c.title, tier, status AS temporal_status, superseded_by FROM concepts c JOIN statuses s ON s.id = c.id WHERE c.id = 'doc-11'")
def rp_07_concept(spark, sf_dir):
    c = corpus.concepts(spark, sf_dir)
    return search.get_concept(c, temporal.statuses(c, F.lit(AT).cast("timestamp")), "doc-11")


@query(
    f"WITH {corpus.SQL}, s AS (SELECT id, type, tier, CAST(sum(s) AS BIGINT) AS score FROM (SELECT id, type, tier, CASE WHEN contains(lower(id), w) OR contains(lower(title), w) THEN 3 ELSE 0 END + CASE WHEN contains(lower(tags), w) THEN 2 ELSE 0 END + CASE WHEN contains(lower(body), w) THEN 1 ELSE 0 END AS s FROM concepts, (VALUES ('the'), ('of')) q(w)) GROUP BY ALL HAVING sum(s) > 0 ORDER BY score DESC, id LIMIT 40) SELECT id, score::DOUBLE AS score FROM s WHERE type = 'kind 1'"
)
def rp_03_fallback(spark, sf_dir):
    """Words that the engine leaves out: the plain scorer's hits, with filters after the cut."""
    return search.search_or_fallback(corpus.concepts(spark, sf_dir), "the OF", 40, type_filter="Kind 1").select("id", "score")


@query("SELECT source AS doc, min(source || '/doc-' || doc_id) AS primary FROM documents GROUP BY source")
def jn_05_primary_sections(spark, sf_dir):
    return links.primary_sections(linked(spark, sf_dir)).select("doc", "primary")


@query("SELECT 'notes/n' || doc_id AS source, '../' || source AS target, 'ok' AS kind, (SELECT min(p.source || '/doc-' || p.doc_id) FROM documents p WHERE p.source = d.source) AS concept_id FROM documents d")
def jn_06_section_fallback(spark, sf_dir):
    """A link to a document's directory, which is no file of the bundle, finds the document's primary section from above."""
    c = linked(spark, sf_dir).select("id", "generated")
    found = read(spark, sf_dir, "documents").select(F.concat(F.lit("notes/n"), _s(number())).alias("source"), F.lit(0).alias("pos"), F.concat(F.lit("../"), "source").alias("target"))
    none = spark.createDataFrame([("other.md",)], "path string")
    return links.resolve(found.withColumn("target", F.regexp_replace("target", "^../", "")), c, none).select("source", F.concat(F.lit("../"), "target").alias("target"), "kind", "concept_id")


def marked_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and dead links of the linked documents; every ninth is superseded by the first, every tenth expired."""
    c = linked(spark, sf_dir)
    i = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    states = c.select("id", F.when(i % 9 == 4, "superseded").when(i % 10 == 7, "expired").otherwise("current").alias("status"), F.when(i % 9 == 4, "first").alias("superseded_by"))
    found = links.resolve(links.graph_links(c), c)
    return links.nodes(c, states), links.edges(found, c), links.dead_links(found, c)


@query(f"WITH {LINKS} SELECT (SELECT count(*) FROM c) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT id, hit FROM r WHERE hit IS NOT NULL)) AS edges, (SELECT count(*) FROM r WHERE hit IS NULL) AS dead_links, (SELECT count(*) FROM c WHERE doc_id % 9 = 4 OR doc_id % 10 = 7) AS non_current")
def agg_14_graph_stats(spark, sf_dir):
    return links.graph_stats(*marked_nodes(spark, sf_dir))


@query(
    f"""WITH {LINKS} SELECT 'counts' AS section, (SELECT count(*) FROM c) || ' concepts, ' || (SELECT count(*) FROM (SELECT DISTINCT id, hit FROM r WHERE hit IS NOT NULL)) || ' links, ' || (SELECT count(*) FROM r WHERE hit IS NULL) || ' dead links' AS line
    UNION ALL SELECT 'non-current', id || CASE WHEN doc_id % 9 = 4 THEN ' (superseded by first)' ELSE ' (expired)' END FROM c WHERE doc_id % 9 = 4 OR doc_id % 10 = 7 UNION ALL SELECT 'orphan', id FROM c WHERE source <> 'src2' UNION ALL SELECT 'dead link', id || ': ' || target FROM r WHERE hit IS NULL"""
)
def rp_09_graph_report(spark, sf_dir):
    nodes, edges, dead = marked_nodes(spark, sf_dir)
    index = spark.createDataFrame([("index.md", "* [all](src2/)\n")], "path string, text string")
    return links.graph_report(nodes, edges, dead, links.orphans(linked(spark, sf_dir), index))


@query(f"WITH {LINKS}, k AS (SELECT id FROM c ORDER BY id LIMIT 150) SELECT DISTINCT r.id AS \"from\", r.hit AS \"to\" FROM r JOIN k a ON a.id = r.id JOIN k b ON b.id = r.hit")
def gr_07_bounded_graph(spark, sf_dir):
    nodes, edges, _ = marked_nodes(spark, sf_dir)
    return links.bounded_graph(nodes, edges, 150)[1].select("from", "to")


NAME = "'n_' || replace(replace(replace({0}, '_', '__'), '/', '_u002f_'), '-', '_u002d_')"


@query(
    f"WITH {LINKS}, k AS (SELECT id, doc_id FROM c ORDER BY id LIMIT 2000) SELECT 'flowchart LR' AS line UNION ALL SELECT '    ' || {NAME.format('id')} || '[\"' || id || ' — Doc ' || doc_id || CASE WHEN doc_id % 9 = 4 THEN ' (superseded by first)' WHEN doc_id % 10 = 7 THEN ' (expired)' ELSE '' END || '\"]' FROM k "
    f"UNION ALL SELECT DISTINCT '    ' || {NAME.format('r.id')} || ' --> ' || {NAME.format('r.hit')} FROM r JOIN k a ON a.id = r.id JOIN k b ON b.id = r.hit"
)
def snk_09_flowchart(spark, sf_dir):
    nodes, edges, _ = marked_nodes(spark, sf_dir)
    return spark.createDataFrame([(x,) for x in links.mermaid(nodes, edges)], "line string")


# ---- sync


DONORS = "st AS (SELECT '/s/' || doc_id AS path, sha256(text) AS sha256, doc_id % 2 = 0 AS able FROM documents), man AS (SELECT sha256(text) AS sha256, '/s/' || doc_id AS path FROM documents WHERE doc_id % 5 = 0)"


@query(
    f"WITH {DONORS}, k AS (SELECT sha256, path AS donor, 0 AS rank FROM man UNION ALL SELECT sha256, path, 1 FROM st WHERE able), j AS (SELECT '/f/' || d.doc_id AS path, donor, row_number() OVER (PARTITION BY d.doc_id ORDER BY rank, donor) AS n FROM documents d JOIN k ON k.sha256 = sha256(d.text) WHERE donor IN (SELECT path FROM st WHERE able)) SELECT path, donor FROM j WHERE n = 1"
)
def jn_17_donors(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    at = lambda prefix: F.concat(F.lit(prefix), _s(number()))
    state = d.select(at("/s/").alias("path"), "sha256", F.when(number() % 2 == 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("concepts"))
    return sync.donors(d.select(at("/f/").alias("path"), "sha256"), d.filter(number() % 5 == 0).select(F.col("sha256").alias("digest"), at("/s/").alias("path")), state)


@query(
    "WITH s AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN '/else/' ELSE '/root/' END || doc_id AS path, doc_id % 3 = 0 AS moved FROM documents WHERE doc_id % 5 <> 0) SELECT 'c' || coalesce(c.doc_id, s.doc_id) AS id, CASE WHEN s.doc_id IS NULL THEN 'added' WHEN c.doc_id IS NULL THEN 'removed' WHEN moved THEN 'changed' ELSE 'unchanged' END AS change, CASE WHEN moved THEN path END AS origin "
    "FROM (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) c FULL JOIN (SELECT * FROM s WHERE path LIKE '/root/%') s ON s.doc_id = c.doc_id"
)
def jn_19_diff_state(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    path = F.concat(F.when(number() % 8 == 0, "/else/").otherwise("/root/"), _s(number()))
    state = d.filter(number() % 5 != 0).select(path.alias("path"), "sha256", F.array(F.concat(F.lit("c"), _s(number()))).alias("concepts"))
    now = d.select(path.alias("path"), F.when(number() % 3 == 0, "new").otherwise(F.col("sha256")).alias("sha256"))
    return governance.diff_state(d.filter(number() % 7 != 0).select(F.concat(F.lit("c"), _s(number())).alias("id")), state, now, "/root")


MANIFEST = "m AS (SELECT sha256(text) AS digest, '/m/' || doc_id AS path, CAST(doc_id % 10 AS BIGINT) AS ingested_at FROM documents)"


@query(f"WITH {MANIFEST}, k AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY ingested_at DESC, path DESC) AS n FROM m) SELECT digest, path, ingested_at FROM k WHERE n = 1")
def snk_06_record(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), F.concat(F.lit("/m/"), _s(number())).alias("path"), (number() % 10).alias("ingested_at"), "doc_id")
    return sync.record(d.filter(number() % 2 == 0).drop("doc_id"), d.filter(number() % 2 == 1).drop("doc_id"))


@query(f"WITH {MANIFEST} SELECT digest, path FROM m WHERE CAST(substr(path, 4) AS BIGINT) % 4 <> 1")
def snk_06_unrecord(spark, sf_dir):
    """Only where the same path owns the digest."""
    d = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), F.concat(F.lit("/m/"), _s(number())).alias("path"), "doc_id")
    gone = d.filter(number() % 4 == 1).union(d.filter(number() % 4 == 2).withColumn("path", F.lit("/other")))
    return sync.unrecord(d.drop("doc_id"), gone.drop("doc_id"))


@query(
    f"WITH {PLAN}, o AS (SELECT path, sha256, 'c' || (doc_id // 2) AS c FROM old), n AS (SELECT plan.*, cur.sha256 AS now, o.sha256 AS was, o.c FROM plan LEFT JOIN cur ON cur.path = plan.path LEFT JOIN o ON o.path = coalesce(plan.old_path, plan.path) WHERE change <> 'removed') "
    "SELECT path, CASE WHEN change = 'updated' AND length(path) % 3 <> 0 THEN was ELSE now END AS sha256, CASE WHEN change IN ('added', 'updated') AND length(path) % 3 = 0 THEN 'new' ELSE coalesce(c, '') END AS concepts FROM n"
)
def syn_02_next_state(spark, sf_dir):
    """Some of the added and updated files gave concepts; updated ones that gave none keep their record."""
    now, old = snapshot(spark, sf_dir)
    planned = sync.plan(now, old)
    given = planned.filter("change in ('added', 'updated') and length(path) % 3 = 0").select("path", F.array(F.lit("new")).alias("concepts"))
    return sync.apply(planned, old, given).select("path", "sha256", F.array_join("concepts", ",").alias("concepts"))


@query(f"WITH {PLAN}, c AS (SELECT doc_id, '/old/' || doc_id AS resource FROM documents) SELECT c.doc_id, coalesce(plan.path, resource) AS resource FROM c LEFT JOIN plan ON plan.change = 'renamed' AND plan.old_path = c.resource")
def syn_02_renamed_resources(spark, sf_dir):
    c = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/old/"), _s(number())).alias("resource"))
    return sync.rewrite_resources(c, sync.plan(*snapshot(spark, sf_dir)))


@query(f"WITH {PLAN} SELECT path, change, change = 'updated' AND length(path) % 2 = 1 AS skipped FROM plan")
def syn_03_preflight(spark, sf_dir):
    planned = sync.plan(*snapshot(spark, sf_dir))
    able = planned.select("path", F.when(F.length("path") % 2 == 0, "create").otherwise("too_small").alias("status"))
    return sync.preflight(planned, able).select("path", "change", "skipped")


@query("SELECT doc_id, '/p/' || doc_id AS path FROM documents WHERE doc_id % 6 < 3")
def syn_06_changed_files(spark, sf_dir):
    """New files, files of another size, and files of another time."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/p/"), _s(number())).alias("path"), F.length("text").cast("long").alias("size"), number().alias("mtime_ns"))
    state = d.filter(number() % 6 != 0).select("path", F.when(number() % 6 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(number() % 6 == 2, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")).alias("mtime_ns"))
    return sync.changed_fast(d, state).select("doc_id", "path")


LATER = "CASE WHEN doc_id % 11 = 5 THEN sha256(text || 'x') ELSE sha256(text) END"


@query(
    f"""SELECT '/p/' || doc_id AS path, 'added' AS change, sha256(text) AS sha256, 1000 AS ms FROM documents WHERE doc_id % 17 <> 0
    UNION ALL SELECT '/p/' || doc_id, 'added', {LATER}, 2000 FROM documents WHERE doc_id % 17 = 0 AND doc_id % 13 <> 3
    UNION ALL SELECT '/p/' || doc_id, 'updated', {LATER}, 2000 FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 13 <> 3 AND doc_id % 11 = 5
    UNION ALL SELECT '/p/' || doc_id, 'removed', sha256(text), 2000 FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 13 = 3
    UNION ALL SELECT '/p/' || doc_id, 'updated', sha256(text || 'y'), 400000 FROM documents WHERE doc_id % 13 <> 3 AND doc_id % 11 = 7"""
)
def syn_06_folder_events(spark, sf_dir):
    """Three listings as a stream: files that come, change, are only touched, go, and that a full verification alone tells apart."""
    from lorekeep.streaming import folder

    d, i, ws = read(spark, sf_dir, "documents"), F.col("doc_id"), Workspace(spark, "listings")
    later = F.when(i % 11 == 5, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    moved = i.cast("long") + F.when((i % 11).isin(5, 6), 1).otherwise(0)
    size = F.octet_length("text").cast("long").alias("size")
    row = lambda text, mtime, ms: [F.concat(F.lit("/p/"), _s(i)).alias("path"), size, mtime.alias("mtime_ns"), F.lit(ms).cast("long").alias("ms"), F.sha2(text, 256).alias("sha256")]
    verified = F.when(i % 11 == 7, F.concat("text", F.lit("y"))).otherwise(later)
    ticks = [d.filter(i % 17 != 0).select(*row("text", i.cast("long"), 1_000)), d.filter(i % 13 != 3).select(*row(later, moved, 2_000)), d.filter(i % 13 != 3).select(*row(verified, moved, 400_000))]
    for tick in ticks:
        tick.write.mode("append").parquet(ws.path("in"))
        stream = folder.events(spark.readStream.schema(ticks[0].schema).parquet(ws.path("in")))
        q = stream.writeStream.option("checkpointLocation", ws.path("checkpoint")).format("parquet").option("path", ws.path("events")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(folder.EVENT).parquet(ws.path("events")).select("path", "change", "sha256", "ms")


@query(f"WITH o AS ({CURRENT}) SELECT 'mine' AS owner, count(*) AS n FROM (SELECT DISTINCT doc_id // 2 AS c FROM documents WHERE source = 'src1' AND doc_id % 2 = 0 EXCEPT SELECT DISTINCT doc_id // 2 FROM documents WHERE source <> 'src1')")
def set_04_owned(spark, sf_dir):
    """Concepts recorded for one path of many, or whose resource it is, and that no other path records."""
    d = read(spark, sf_dir, "documents")
    path = F.when(F.col("source") == "src1", "/src1").otherwise(F.concat(F.lit("/"), "source", F.lit("/"), _s(number())))
    c = F.concat(F.lit("c"), _s(F.floor(number() / 2)))
    state = d.filter("source <> 'src1'").select(path.alias("path"), F.array(c).alias("concepts"))
    concepts = d.filter("source = 'src1' and doc_id % 2 = 0").select(c.alias("id"), path.alias("resource"))
    return sync.owned_by("/src1", state, concepts).agg(F.lit("mine").alias("owner"), F.count(F.lit(1)).alias("n"))


# ---- concepts: merging, ingest, write-back


@query(f"WITH {corpus.SQL} SELECT id, CASE WHEN doc_id % 2 = 0 THEN '2030-01-01' ELSE strftime(valid_from, '%Y-%m-%d') END AS valid_from, strftime(valid_until, '%Y-%m-%d') AS valid_until, supersedes, strftime(last_verified, '%Y-%m-%d') AS last_verified FROM concepts")
def tmp_08_carry_over(spark, sf_dir):
    """Ingested again, with a new start for every second one."""
    old = corpus.concepts(spark, sf_dir)
    none = lambda kind: F.lit(None).cast(kind)
    new = old.select("id", F.when(F.expr("cast(substr(id, 5) as bigint) % 2 = 0"), "2030-01-01").alias("valid_from"), none("string").alias("valid_until"), none("array<string>").alias("supersedes"), none("string").alias("last_verified"))
    return temporal.carry_over(new, old).withColumn("supersedes", F.array_join("supersedes", ","))


@query(f"WITH {corpus.SQL} SELECT id, CASE WHEN supersedes IS NULL OR supersedes = 'doc-1' THEN 'doc-1' ELSE supersedes || ',doc-1' END AS supersedes FROM concepts")
def tmp_09_stamp(spark, sf_dir):
    return corpus.concepts(spark, sf_dir).select("id", F.array_join(temporal.stamp_supersedes(F.col("supersedes"), F.lit("doc-1")), ",").alias("supersedes"))


@query(
    f"""WITH {SECTIONS}, u AS (SELECT doc_id, section_no, title, text, 'f-' || doc_id || '/' || CASE WHEN trim(title) = '' THEN 'section-' || section_no ELSE coalesce(nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled') END AS base FROM s WHERE NOT too_small AND text <> ''),
    k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY section_no) AS n FROM u)
    SELECT doc_id, section_no, base || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS id, title, '/in/F ' || doc_id || '.md' AS resource, CASE WHEN n > 1 THEN base END AS displaced, 
      CASE WHEN length(text) <= 8000 THEN length(text) ELSE length(rtrim(CASE WHEN contains(substr(text, 1, 8000), chr(10)) THEN regexp_replace(substr(text, 1, 8000), '\\n[^\\n]*$', '') ELSE substr(text, 1, 8000) END, ' ' || chr(10) || chr(9) || chr(13))) + length(chr(10) || chr(10) || '[... truncated: section body exceeds no-LLM limit ...]') END AS chars FROM k"""
)
def ing_02_drafts(spark, sf_dir):
    """Concepts drafted from the sections of documents that are large enough, without a model."""
    p = pages(spark, sf_dir)
    src = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/in/F "), _s(number()), F.lit(".md")).alias("path"))
    taken = spark.createDataFrame([], "id string")
    got = sections.draft(p, src, taken)
    return got.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "id", "title", "resource", "displaced", F.length("body").cast("long").alias("chars"))


@query("SELECT '/in/' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'already_ingested' WHEN doc_id % 7 = 0 THEN 'error' WHEN length(text) < 1000 THEN 'too_small' WHEN doc_id % 3 = 0 THEN 'needs_ocr' ELSE 'create' END AS status FROM documents")
def ing_04_dry_run(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    here = d.select("doc_id", F.concat(F.lit("/in/"), _s(number())).alias("path"), _s(number()).alias("sha256"), F.when(number() % 7 == 0, "broken").alias("error"))
    manifest = d.filter(number() % 5 == 0).select(_s(number()).alias("digest"))
    return sections.status(here, manifest, d.select("doc_id", "text", (number() % 3 == 0).alias("needs_ocr")))


@query(
    f"WITH {corpus.SQL} SELECT id, CASE WHEN doc_id % 4 IN (1, 2) THEN tags || ',needs-review' ELSE tags END AS tags, CASE WHEN tier = 'human-reviewed' THEN 'human:reviewer' WHEN tier = 'machine-confirmed' THEN 'pipeline' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN CASE WHEN tier = 'unverified' THEN 'critic' ELSE ',critic' END ELSE '' END AS verified, md5(CASE WHEN doc_id % 4 = 1 THEN 'fixed ' || doc_id ELSE body END) AS body FROM concepts"
)
def ing_08_verdicts(spark, sf_dir):
    """pass, fix, fail and no verdict in turn."""
    c = corpus.concepts(spark, sf_dir)
    i = F.expr("cast(substr(id, 5) as bigint)")
    v = c.filter(i % 4 < 3).select("id", F.when(i % 4 == 0, "pass").when(i % 4 == 1, "fix").otherwise("fail").alias("verdict"), F.concat(F.lit("fixed "), _s(i)).alias("body"), F.lit("critic").alias("critic"))
    got = entity.apply_verdict(c, v, "2026-01-01T00:00:00Z")
    by = F.array_join(F.transform("verified", lambda x: x["by"]), ",")
    return got.select("id", F.array_join("tags", ",").alias("tags"), F.coalesce(by, F.lit("")).alias("verified"), F.md5("body").alias("body"))


@query(f"WITH {corpus.SQL} SELECT id, CASE WHEN id = 'doc-5' THEN 'human-reviewed' ELSE tier END AS tier FROM concepts")
def ing_09_reviewed(spark, sf_dir):
    got = entity.mark_reviewed(corpus.concepts(spark, sf_dir), "doc-5", "ann", "2026-01-01T00:00:00Z")
    return got.select("id", T.trust_tier("verified").alias("tier"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 1 THEN 'T' || doc_id END AS title, CASE WHEN doc_id % 3 = 0 THEN md5(text) WHEN doc_id % 3 = 2 THEN md5('') END AS body, doc_id % 3 <> 0 OR text = '' AS vacuous FROM documents")
def ing_06_model_answers(spark, sf_dir):
    """Answers of a model: whole, broken, without a body."""
    whole = F.to_json(F.struct(F.concat(F.lit(" T"), _s(number())).alias("title"), F.lit("d").alias("description"), F.array(F.lit("x")).alias("tags"), whole_text().alias("body")))
    answer = F.when(number() % 3 == 0, whole).when(number() % 3 == 1, "{broken").otherwise(F.concat(F.lit('{"title": "T'), _s(number()), F.lit('", "body": ""}')))
    got = entity.from_model_json(read(spark, sf_dir, "documents").select(_s(number()).alias("id"), answer.alias("answer")))
    return got.select(F.col("id").cast("long").alias("doc_id"), "title", F.md5("body").alias("body"), "vacuous")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS title FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT -doc_id - 1, 'new' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0")
def snk_01_upsert_and_delete(spark, sf_dir):
    """New rows replace those of the same id, then every fifth goes."""
    d = read(spark, sf_dir, "documents").select(number().alias("id"))
    new = d.filter("id % 2 = 0").union(d.filter("id % 2 = 0 and id % 3 = 0").select((-F.col("id") - 1).alias("id"))).withColumn("title", F.lit("new"))
    got = governance.upsert(d.withColumn("title", F.lit("old")), new)
    return governance.delete(got, d.filter("id % 5 = 0")).select(F.col("id").alias("doc_id"), "title")


@query("SELECT doc_id, doc_id % 2 = 1 AS refused FROM documents WHERE doc_id % 4 < 2")
def wb_02_insert_only(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(number().alias("id"))
    old, new = d.filter("id % 2 = 1"), d.filter("id % 4 < 2")
    after, refused = governance.insert_only(old, new)
    gone = refused.withColumn("refused", F.lit(True))
    return after.join(new, "id", "left_semi").join(gone, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("refused", F.lit(False)).alias("refused"))


@query("SELECT 'E002' AS code, doc_id || '.md' AS file FROM documents WHERE doc_id % 2 = 1")
def set_05_new_errors(spark, sf_dir):
    """Errors that a change brings; warnings and old errors don't count."""
    at = lambda rule, severity, cond: read(spark, sf_dir, "documents").filter(cond).select(F.lit(severity).alias("severity"), F.lit(rule).alias("code"), F.concat(_s(number()), F.lit(".md")).alias("file"), F.lit("m").alias("message"))
    before = at("E002", "error", number() % 2 == 0).union(at("E001", "error", number() % 3 == 0))
    after = at("E002", "error", number() >= 0).union(at("W003", "warning", number() >= 0))
    return governance.new_errors(before, after).select("code", "file")


@query(
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'added' WHEN doc_id % 4 = 1 THEN 'removed' WHEN doc_id % 8 = 2 THEN 'changed' ELSE 'unchanged' END AS change FROM documents"
)
def wb_04_changes_of_any_field(spark, sf_dir):
    """A new window end alone is a change."""
    c = corpus.concepts(spark, sf_dir).withColumn("i", F.expr("cast(substr(id, 5) as bigint)"))
    new = c.filter("i % 4 <> 1").withColumn("valid_until", F.when(F.col("i") % 8 == 2, F.lit("2031-01-01")).otherwise(F.col("valid_until")))
    return governance.diff(c.filter("i % 4 <> 0").drop("i"), new.drop("i")).select(F.expr("cast(substr(id, 5) as bigint)").alias("doc_id"), "change")


@query("SELECT doc_id, md5(coalesce(rtrim(text, chr(10) || ' ' || chr(9) || chr(13)), '') || chr(10) || chr(10) || '## Links' || chr(10) || chr(10) || '- [x](y)' || chr(10)) AS digest FROM documents")
def wb_05_links_section(spark, sf_dir):
    """An old links section gives way to the new one."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(governance.with_links_section(F.concat("text", F.lit("\n\n## Links\n\n- [old](z)\n")), [("x", "y")])).alias("digest"))


# ---- evaluation


@query(f"WITH {corpus.SQL} SELECT 'sample-' || id AS id, 'What is ' || title || '?' AS question, '' AS expected_answer, id AS must_cite FROM concepts ORDER BY id LIMIT 3")
def snk_12_sample_golden(spark, sf_dir):
    return evaluate.sample_golden(corpus.concepts(spark, sf_dir)).select("id", "question", "expected_answer", F.array_join("must_cite", ",").alias("must_cite"))


@query("WITH g AS (SELECT CASE WHEN item_id % 10 = 0 THEN 'same' ELSE CAST(item_id AS VARCHAR) END AS id, CASE WHEN item_id % 7 = 0 THEN ' ' ELSE text END AS question FROM benchmark) SELECT 'blank_field' AS code, id FROM g WHERE trim(question) = '' UNION ALL SELECT 'duplicate_id', id FROM g GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'too_many', NULL FROM g HAVING count(*) > 10")
def src_22_golden_checks(spark, sf_dir):
    k = F.col("item_id")
    g = read(spark, sf_dir, "benchmark").select(F.when(k % 10 == 0, "same").otherwise(_s(k)).alias("id"), F.when(k % 7 == 0, " ").otherwise(F.col("text")).alias("question"))
    return evaluate.check_golden(g, 10)


# ---- validation: rules on index and log files, duplicates and cycles, with their messages

STRUCTURE = {
    "E003": "'{0}/index.md', 'non-root index.md must not contain frontmatter'",
    "E004": "'{0}/log.md', 'log date heading is not ISO YYYY-MM-DD: ''Someday {0}'''",
    "W013": "'{0}/log.md', 'log date headings are not newest-first: ''2026-02-01'' follows ''2026-01-01'''",
    "W015": "'d{0}.md', 'duplicate `sources[].id` ''s{0}'''",
    "W019": "'p{0}.md', 'supersession cycle: p{0} supersedes q{0} supersedes p{0}'",
}


@query(" UNION ALL ".join([*(f"SELECT '{c}' AS code, f AS file, m AS message FROM (SELECT {v.replace('{0}', '#').split(', ', 1)[0]} AS f0, {v.replace('{0}', '#').split(', ', 1)[1]} AS m0, doc_id FROM documents) x, LATERAL (SELECT replace(f0, '#', CAST(doc_id AS VARCHAR)) AS f, replace(m0, '#', CAST(doc_id AS VARCHAR)) AS m)" for c, v in STRUCTURE.items()), "SELECT 'W007', 'index.md', 'unknown okf_version; expected \"0.2\"'"]))
def val_structure(spark, sf_dir):
    """For each document: a folder whose index has frontmatter and whose log has an odd and a late heading, a concept with one source id twice, and two that supersede each other."""
    head = "---\ntype: Note\ntitle: T\ndescription: D\n"
    n = _s(number())
    kinds = {
        "index": (F.concat(n, F.lit("/index.md")), F.lit("---\nx: 1\n---\n* [a](a.md)\n")),
        "log": (F.concat(n, F.lit("/log.md")), F.concat(F.lit("# Log\n\n## Someday "), n, F.lit("\n\n## 2026-01-01\n\n* x\n\n## 2026-02-01\n\n* y\n"))),
        "twice": (F.concat(F.lit("d"), n, F.lit(".md")), F.concat(F.lit(head + "sources:\n- id: s"), n, F.lit("\n  resource: r\n- id: s"), n, F.lit("\n  resource: q\n---\n"), whole_text())),
        "p": (F.concat(F.lit("p"), n, F.lit(".md")), F.concat(F.lit(head + "supersedes: q"), n, F.lit("\n---\n"))),
        "q": (F.concat(F.lit("q"), n, F.lit(".md")), F.concat(F.lit(head + "supersedes: p"), n, F.lit("\n---\n"))),
    }
    each = F.array(*[F.struct(p.alias("path"), t.alias("text")) for p, t in kinds.values()])
    made = read(spark, sf_dir, "documents").select(F.explode(each).alias("f")).select("f.path", "f.text")
    root = spark.createDataFrame([("index.md", "---\nokf_version: '9.9'\n---\n")], "path string, text string")
    return validate.check(made.union(root), "2026-06-01 00:00:00").filter(F.col("code").isin(*STRUCTURE, "W007")).select("code", "file", "message")


# ---- files, states and versions in a work folder


def own_columns(df: DataFrame) -> DataFrame:
    """df with the columns of a stored concept; those it lacks are null."""
    kinds = df.sparkSession.createDataFrame([], CONCEPT).dtypes
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(k).alias(n) for n, k in kinds])


@query(
    """WITH d AS (SELECT doc_id, '/f/' || doc_id AS path, sha256(text) AS sha256 FROM documents),
    st AS (SELECT path, CASE WHEN doc_id % 2 = 1 THEN 's' ELSE '' END || sha256 AS sha256, CASE doc_id % 4 WHEN 0 THEN ['c' || doc_id // 8] WHEN 1 THEN ['c' || doc_id // 8, 'x' || doc_id] ELSE ['x' || doc_id] END AS concepts, doc_id FROM d WHERE doc_id % 3 <> 0),
    cl AS (SELECT path, unnest(concepts) AS id FROM st), src AS (SELECT '/f/' || doc_id AS path, 'a' || doc_id AS id FROM documents WHERE doc_id % 5 = 0),
    gone AS (SELECT path FROM st WHERE doc_id % 2 = 1), ad AS (SELECT path, sha256 FROM d WHERE doc_id % 3 = 0),
    man AS (SELECT sha256 AS digest, min_by(path, doc_id) AS path FROM d WHERE doc_id % 2 = 0 GROUP BY 1),
    dn AS (SELECT path, donor FROM (SELECT ad.path, st.path AS donor, row_number() OVER (PARTITION BY ad.path ORDER BY CASE WHEN man.path = st.path THEN 0 ELSE 1 END, st.path) AS k FROM ad JOIN st ON st.sha256 = ad.sha256 AND st.path <> ad.path LEFT JOIN man ON man.digest = ad.sha256) WHERE k = 1),
    new AS (SELECT ad.path, CASE WHEN src.id IS NOT NULL THEN 'adopted' WHEN man.digest IS NULL THEN 'ingest' WHEN dn.donor IS NOT NULL THEN 'shared' ELSE 'stale' END AS outcome, src.id AS adopted, dn.donor FROM ad LEFT JOIN src ON src.path = ad.path LEFT JOIN man ON man.digest = ad.sha256 LEFT JOIN dn ON dn.path = ad.path),
    sh AS (SELECT a.path, min(b.path) AS by FROM cl a JOIN gone g ON g.path = a.path JOIN cl b ON b.id = a.id AND b.path <> a.path WHERE b.path NOT IN (SELECT path FROM gone) OR b.path > a.path GROUP BY 1),
    fr AS (SELECT o.path, string_agg(o.id, ',' ORDER BY o.id) AS ids FROM (SELECT cl.path, id FROM cl JOIN gone USING (path) UNION SELECT src.path, id FROM src JOIN gone USING (path)) o WHERE NOT EXISTS (SELECT 1 FROM cl b WHERE b.id = o.id AND b.path <> o.path AND (b.path NOT IN (SELECT path FROM gone) OR b.path > o.path)) GROUP BY 1)
    SELECT new.path, outcome, CASE outcome WHEN 'adopted' THEN adopted WHEN 'shared' THEN array_to_string(st.concepts, ',') ELSE '' END AS concepts, CASE WHEN outcome = 'shared' THEN donor END AS by FROM new LEFT JOIN st ON st.path = new.donor
    UNION ALL SELECT g.path, CASE WHEN sh.by IS NULL THEN 'removed' ELSE 'kept' END, CASE WHEN sh.by IS NULL THEN coalesce(fr.ids, '') ELSE '' END, sh.by FROM gone g LEFT JOIN sh ON sh.path = g.path LEFT JOIN fr ON fr.path = g.path"""
)
def syn_02_ownership(spark, sf_dir):
    """Every third document is new, half of the others are removed; concepts are shared in eights, some say where they come from, and half of the digests are in the manifest."""
    i, path = number(), F.concat(F.lit("/f/"), _s(number()))
    d = read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.sha2("text", 256).alias("sha256"))
    own, both = F.concat(F.lit("x"), _s(i)), F.concat(F.lit("c"), _s(F.floor(i / 8)))
    shared = F.when(i % 4 == 0, F.array(both)).when(i % 4 == 1, F.array(both, own)).otherwise(F.array(own))
    was = F.concat(F.when(i % 2 == 1, "s").otherwise(""), F.col("sha256"))  # what is gone had other texts, so that nothing is a rename
    state = d.filter("doc_id % 3 <> 0").select("path", was.alias("sha256"), shared.alias("concepts"))
    concepts = d.filter("doc_id % 5 = 0").select(F.concat(F.lit("a"), _s(i)).alias("id"), F.col("path").alias("resource"))
    manifest = d.filter("doc_id % 2 = 0").groupBy(F.col("sha256").alias("digest")).agg(F.min_by("path", "doc_id").alias("path"))
    planned = sync.plan(d.filter("doc_id % 3 = 0 or doc_id % 2 = 0").select("path", "sha256"), state)
    return sync.resolve(planned, state, concepts, manifest).select("path", "outcome", F.array_join("concepts", ",").alias("concepts"), "by")


@query(
    """WITH d AS (SELECT doc_id, lang, source, md5(text) AS m, doc_id % 37 AS n FROM documents)
    SELECT doc_id AS id, CASE WHEN n > 31 THEN 'too deep' END AS refused,
      CASE WHEN n <= 31 THEN '{"items":[{"n":' || doc_id || ',"text":"' || m || '"},{"deep":{"lang":"' || lang || '"}},"plain"],"k":' || repeat('[', n::INT) || n || repeat(']', n::INT) || ',"source":"' || source || '"}' END AS cleaned,
      CASE WHEN n <= 31 THEN 16 + n END AS nodes FROM d"""
)
def fn_41_nested_values(spark, sf_dir):
    """A nested value of each document with marks of trust on three levels, some of them too deep."""
    n = (number() % 37).cast("int")
    parts = ['{"source": "', F.col("source"), '", "verified": [{"by": "human:x"}], "items": [{"text": "', F.md5("text"), '", "verified": true, "n": ', _s(number()), '}, {"deep": {"verified": null, "lang": "', F.col("lang"), '"}}, "plain"], "k": ', F.repeat(F.lit("["), n), _s(n), F.repeat(F.lit("]"), n), "}"]
    value = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    got = hygiene.clean(read(spark, sf_dir, "documents").select(number().alias("id"), value.alias("value")))
    return got.select("id", "refused", "cleaned", F.when(F.col("refused").isNull(), F.col("nodes")).alias("nodes"))


@query(
    """WITH c AS (SELECT d.doc_id, text, CASE WHEN quality = 1 THEN 'human' WHEN quality = 0 THEN 'machine' END AS tier FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND quality IS NOT NULL),
    o AS (SELECT *, CASE WHEN doc_id % 5 = 3 THEN 'empty' WHEN tier = 'human' AND doc_id % 3 > 0 THEN 'refused' WHEN doc_id % 5 = 2 THEN 'no change' ELSE 'updated' END AS outcome FROM c)
    SELECT doc_id::VARCHAR AS id, outcome, CASE WHEN outcome <> 'updated' THEN '' WHEN doc_id % 5 = 0 THEN 'body' WHEN doc_id % 5 = 1 THEN 'title' ELSE 'title,body' END AS changed, coalesce(outcome = 'updated' AND (tier = 'human' OR (tier = 'machine' AND doc_id % 5 <> 1)), false) AS lost_trust,
      md5(CASE WHEN outcome = 'updated' AND doc_id % 5 IN (0, 4) THEN text || chr(10) || 'more' ELSE text END) AS digest FROM o UNION ALL SELECT 'no-' || doc_id, 'missing', '', false, NULL FROM documents"""
)
def wb_03_patches(spark, sf_dir):
    """A patch of each document and of as many that aren't there: bodies, titles, both, neither, blank ones."""
    d, lab, i = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter("quality is not null"), number()
    by = F.when(F.col("quality") == 1, "human:x").when(F.col("quality") == 0, "bot")
    c = d.join(lab.select("doc_id", "quality"), "doc_id", "left").select(_s(i).alias("id"), F.lit("old").alias("title"), F.col("text").alias("body"), F.when(by.isNotNull(), F.array(F.struct(by.alias("by"), F.lit(None).cast("string").alias("at")))).alias("verified"))
    more = F.concat("text", F.lit("\nmore"))
    body = F.when(i % 5 == 0, more).when(i % 5 == 2, F.col("text")).when(i % 5 == 3, " \n").when(i % 5 == 4, more)
    asked = d.select(_s(i).alias("id"), F.when((i % 5).isin(1, 4), "new").alias("title"), body.alias("body"), (i % 3 == 0).alias("downgrade"))
    asked = asked.unionByName(asked.withColumn("id", F.concat(F.lit("no-"), "id")))
    return patches.patched(c, asked).select("id", "outcome", F.array_join("changed", ",").alias("changed"), "lost_trust", F.md5("body").alias("digest"))


@query(
    """WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), q AS (SELECT doc_id, list_concat(list_concat(['inserted'], l[2:]), ['appended ' || doc_id]) AS n FROM p)
    SELECT doc_id::VARCHAR AS id, md5(array_to_string(n, chr(10))) AS digest, true AS whole FROM q"""
)
def wb_03_hunks(spark, sf_dir):
    """Each document with another first line and one more at the end: its hunks, applied to the old text, give the new one."""
    d = read(spark, sf_dir, "documents")
    l = F.split(F.coalesce("text", F.lit("")), "\n", -1)  # noqa: E741
    new = F.array_join(F.concat(F.array(F.lit("inserted")), F.slice(l, F.lit(2), F.size(l)), F.array(F.concat(F.lit("appended "), _s(number())))), "\n")
    pairs = d.select(_s(number()).alias("id"), F.col("text").alias("old"), new.alias("new"))
    found = Workspace(spark, "hunks").keep(patches.hunks(pairs), "hunks")
    small = found.groupBy("id").agg((F.sum(F.size("added")) + F.sum(F.size("removed"))).alias("lines"))
    return patches.rebuilt(pairs, found).join(small, "id").select("id", F.md5("new").alias("digest"), (F.col("lines") <= 3).alias("whole"))


@query("SELECT n_name AS folder, sha256(n_comment || chr(10)) AS sha256, CAST(strlen(n_comment) + 1 AS BIGINT) AS size, true AS listed FROM (SELECT n_name, 'nation ' || n_nationkey AS n_comment FROM nation)")
def src_21_scan(spark, sf_dir):
    """A file in a folder for each nation, found, read and hashed; the listing has the same sizes."""
    root = Workspace(spark, "scan").path("in")
    read(spark, sf_dir, "nation").select("n_name", F.concat(F.lit("nation "), _s(F.col("n_nationkey"))).alias("value")).repartition(1).write.partitionBy("n_name").text(root)
    sizes = files.listing(spark, root, "*.txt").select("path", F.col("size").alias("listed"))
    got = files.scan(spark, root, "*.txt").join(sizes, "path")
    return got.select(F.regexp_extract("path", "n_name=([^/]+)/", 1).alias("folder"), "sha256", "size", (F.col("size") == F.col("listed")).alias("listed"))


@query("SELECT '/' || source || '/' || doc_id AS path, sha256(text) AS sha256, 'c' || doc_id AS concepts, CAST(length(text) AS BIGINT) AS size FROM documents")
def src_23_sync_state(spark, sf_dir):
    """A state of all documents, written as JSON in shards and read back."""
    path = Workspace(spark, "state").path("state.json")
    name = F.concat(F.lit("/"), "source", F.lit("/"), _s(number()))
    state = read(spark, sf_dir, "documents").select(name.alias("path"), F.sha2("text", 256).alias("sha256"), F.array(F.concat(F.lit("c"), _s(number()))).alias("concepts"), F.length("text").cast("long").alias("size"), F.lit(1).cast("long").alias("mtime_ns"))
    files.save_sync_state(state, path)
    return files.sync_state(spark, path).select("path", "sha256", F.array_join("concepts", ",").alias("concepts"), "size")


@query("SELECT CAST(item_id AS VARCHAR) AS id, text AS question, 'd' || item_id AS must_cite FROM benchmark")
def src_22_golden_set(spark, sf_dir):
    path = Workspace(spark, "golden").path("golden.json")
    k = _s(F.col("item_id"))
    item = F.struct(k.alias("id"), F.col("text").alias("question"), F.lit("").alias("expected_answer"), F.array(F.concat(F.lit("d"), k)).alias("must_cite"), F.array(F.lit("t")).alias("tags"))
    read(spark, sf_dir, "benchmark").agg(F.to_json(F.struct(F.collect_list(item).alias("questions"))).alias("value")).coalesce(1).write.text(path)
    return files.golden_set(spark, path).select("id", "question", F.array_join("must_cite", ",").alias("must_cite"))


BUNDLE = "o AS (SELECT path, 'c' || (doc_id // 2) AS id FROM old), l AS (SELECT path FROM plan WHERE change IN ('removed', 'updated')), gone AS (SELECT id FROM o WHERE path IN (SELECT path FROM l) EXCEPT SELECT id FROM o WHERE path NOT IN (SELECT path FROM l)) SELECT DISTINCT id FROM o WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'n' || path FROM plan WHERE change IN ('added', 'updated')"


@query(f"WITH {PLAN}, {BUNDLE}")
def syn_04_sync_run(spark, sf_dir):
    """The bundle after one locked run: moved and unchanged files keep their concepts, shared ones stay while any file has them."""
    return synced(spark, sf_dir).read().select("id")


def synced(spark, sf_dir):
    now, old = snapshot(spark, sf_dir)
    store = governance.Store(spark, Workspace(spark, "sync").path("kb"))
    store.publish(own_columns(old.select(F.explode("concepts").alias("id")).distinct()), {"state": old})

    def ingest(todo):
        name = F.concat(F.lit("n"), "path")
        return own_columns(todo.select(name.alias("id"))), todo.select("path", F.array(name).alias("concepts"))

    sync.run_once(store, now, None, ingest, now.select("path", F.lit("create").alias("status")), "me", day="2026-01-31")
    return store


@query(
    f"""WITH {PLAN}, ids AS (WITH {BUNDLE}), leaf AS (SELECT id, regexp_extract(id, '[^/]*$') AS t FROM ids)
    SELECT 'state' AS part, p.path AS name, cur.sha256 AS value, CASE WHEN change IN ('unchanged', 'renamed') THEN 'c' || (old.doc_id // 2) ELSE 'n' || p.path END AS detail FROM plan p JOIN cur ON p.path = cur.path LEFT JOIN old ON old.path = coalesce(p.old_path, p.path)
    UNION ALL SELECT 'index', id, '* [' || t || '](' || id || '.md)', CAST(row_number() OVER (ORDER BY lower(t), id) AS VARCHAR) FROM leaf
    UNION ALL SELECT 'log', 'Update', 'Sync: ' || count(*) FILTER (change = 'added') || ' added, ' || count(*) FILTER (change = 'updated') || ' updated, ' || count(*) FILTER (change = 'renamed') || ' renamed, ' || count(*) FILTER (change = 'removed') || ' removed.', '2026-01-31' FROM plan"""
)
def syn_04_published_tables(spark, sf_dir):
    """State, index page and log that one run publishes with the concepts."""
    store = synced(spark, sf_dir)
    part = lambda kind, name, value, detail: [F.lit(kind).alias("part"), F.col(name).alias("name"), F.col(value).alias("value"), detail.cast("string").alias("detail")]
    state = store.beside("state", sync.STATE).select(*part("state", "path", "sha256", F.array_join("concepts", ",")))
    index = store.beside("index", sync.INDEX).select(*part("index", "id", "line", F.col("pos")))
    return state.union(index).union(store.beside("log", sync.LOG).select(*part("log", "kind", "message", F.col("day"))))


@query("SELECT doc_id, doc_id % 2 = 1 AS reviewed, doc_id = 1 AS updated FROM documents")
def wb_03_trust_downgrade(spark, sf_dir):
    """An update of one concept in a stored bundle takes that concept's verifications away, and no other's."""
    store = governance.Store(spark, Workspace(spark, "writeback").path("kb"))
    people = F.array(F.struct(F.when(number() % 2 == 1, "human:x").otherwise("bot").alias("by"), F.lit(None).cast("string").alias("at")))
    store.publish(own_columns(read(spark, sf_dir, "documents").select(_s(number()).alias("id"), F.lit("Note").alias("type"), F.col("text").alias("body"), people.alias("verified"))))
    none = spark.createDataFrame([], FINDING)
    governance.governed_update(store, lambda c: governance.downgrade(c, "1", body="new"), "me", "update", "1", lambda c: none)
    tier = T.trust_tier("verified")
    return store.read().select(F.col("id").cast("long").alias("doc_id"), ((tier == "human-reviewed") | ((F.col("id") == "1") & (tier == "unverified"))).alias("reviewed"), (F.col("body") == "new").alias("updated"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'E002' END AS refused FROM documents WHERE doc_id % 5 = 0")
def wb_01_preview(spark, sf_dir):
    """What a change of every fifth concept would bring, with nothing written: every tenth would lose its type."""
    store = governance.Store(spark, Workspace(spark, "preview").path("kb"))
    store.publish(own_columns(read(spark, sf_dir, "documents").select(_s(number()).alias("id"), F.lit("Note").alias("type"), F.col("text").alias("body"))))
    at = F.col("id").cast("long")
    change = lambda c: c.withColumn("type", F.when(at % 10 == 0, "").otherwise(F.col("type"))).withColumn("title", F.when(at % 5 == 0, "T"))
    judge = lambda c: c.filter("type = ''").select(F.lit("error").alias("severity"), F.lit("E002").alias("code"), F.col("id").alias("file"), F.lit("m").alias("message"))
    before = store.read()
    changes, errors = governance.previewed(before, change(before), judge)
    return changes.join(errors.select(F.col("file").alias("id"), F.col("code").alias("refused")), "id", "left").select(F.col("id").cast("long").alias("doc_id"), "refused")


@query("SELECT count(*) AS files, true AS same, false AS moved FROM documents")
def syn_07_fingerprint(spark, sf_dir):
    """Equal for the same files in any order, another when one size changes."""
    d = read(spark, sf_dir, "documents").select(_s(number()).alias("path"), F.length("text").cast("long").alias("size"), number().alias("mtime_ns"))
    a, b = sync.fingerprint(d), sync.fingerprint(d.repartition(3)).select(F.col("fingerprint").alias("again"))
    c = sync.fingerprint(d.withColumn("size", F.when(F.col("path") == "1", F.col("size") + 1).otherwise(F.col("size")))).select(F.col("fingerprint").alias("other"))
    return a.crossJoin(b).crossJoin(c).select("files", (F.col("fingerprint") == F.col("again")).alias("same"), (F.col("fingerprint") == F.col("other")).alias("moved"))  # one row each


@query()
def ing_05_extraction(spark, sf_dir):
    """Concepts of all sections, those before the first heading and empty ones too, by a stub model, folded into the bundle of all documents; tests hold it against a sequential loop over given tables."""
    old = own_columns(corpus.concepts(spark, sf_dir))
    s = sections.sections(pages(spark, sf_dir))
    found = s.select(F.format_string("%019d-%09d", F.col("doc_id"), F.col("section_no").cast("int")).alias("section_id"), "title", "text", F.concat(F.lit("/in/"), _s(number())).alias("resource"))
    return extract.run(old, found, extract.stub_model, "2026-01-01T00:00:00Z").select("id", "title", F.array_join("tags", ",").alias("tags"), F.md5("body").alias("digest"))
