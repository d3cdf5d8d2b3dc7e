"""Link graph, sync, section, entity, evaluation and governance queries over the driver's tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators import entity, evaluate, governance, links, sections, sync, temporal
from lorekeep.plans.registry import micro, query, tokens_sql
from lorekeep.sources import corpus
from lorekeep.sources.corpus import read

PATH = "d.source || '/doc-' || d.doc_id"


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts source/doc-n: their whole texts, and links to absolute and relative targets, out of the bundle, to a missing file and to the web."""
    i = F.col("doc_id")
    body = F.concat(
        "text", F.lit("\n\n"),
        F.lit("See [three](/src"), (i * 3 % 20).cast("string"), F.lit("/doc-"), (i * 3).cast("string"), F.lit(".md) and [next](doc-"), (i + 20).cast("string"), F.lit(' "titled") or [up](../src'), (i % 7).cast("string"), F.lit("/doc-"), ((i % 7) + 20).cast("string"),
        F.lit("#part), ![pic](p.png), [web](https://example.org/x), [out](../../etc), [idx](index.md), [dir](../src1)."),
    )
    return read(spark, sf_dir, "documents").select(F.concat("source", F.lit("/doc-"), i.cast("string")).alias("id"), F.lit("Note").alias("type"), F.concat(F.lit("Doc "), i.cast("string")).alias("title"), body.alias("body"), F.lit(None).cast("struct<by:string,at:string>").alias("generated"))


LINKS = f"""c AS (SELECT {PATH} AS id, source, doc_id FROM documents d),
 t AS (SELECT id, '/src' || (doc_id * 3 % 20) || '/doc-' || (doc_id * 3) || '.md' AS target, 'src' || (doc_id * 3 % 20) || '/doc-' || (doc_id * 3) AS to_id, 0 AS pos FROM c
  UNION ALL SELECT id, 'doc-' || (doc_id + 20), source || '/doc-' || (doc_id + 20), 1 FROM c
  UNION ALL SELECT id, '../src' || (doc_id % 7) || '/doc-' || (doc_id % 7 + 20) || '#part', 'src' || (doc_id % 7) || '/doc-' || (doc_id % 7 + 20), 2 FROM c
  UNION ALL SELECT id, '../../etc', NULL, 4 FROM c),
 r AS (SELECT t.*, c.id AS hit FROM t LEFT JOIN c ON c.id = t.to_id)"""


@query(f"WITH {LINKS} SELECT DISTINCT id AS \"from\", hit AS \"to\" FROM r WHERE hit IS NOT NULL")
def gr_01_edges(spark, sf_dir):
    c = linked(spark, sf_dir)
    return links.edges(links.resolve(links.graph_links(c), c), c)


@query(f"WITH {LINKS} SELECT id AS source, target FROM r WHERE hit IS NULL")
def gr_01_dead_links(spark, sf_dir):
    c = linked(spark, sf_dir)
    return links.dead_links(links.resolve(links.graph_links(c), c), c)


@query(f"WITH {LINKS}, k AS (SELECT id, CASE WHEN hit IS NULL THEN 'dead' ELSE 'ok' END AS kind FROM r UNION ALL SELECT id, 'external' FROM c UNION ALL SELECT id, 'reserved' FROM c UNION ALL SELECT id, CASE WHEN EXISTS (SELECT 1 FROM c WHERE source = 'src1') THEN 'dir' ELSE 'dead' END FROM c) SELECT kind, count(*) AS n FROM k GROUP BY kind")
def gr_02_link_kinds(spark, sf_dir):
    c = linked(spark, sf_dir)
    return links.resolve(links.graph_links(c), c).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINKS} SELECT c.id, coalesce(string_agg(DISTINCT hit, ',' ORDER BY hit), '') AS \"to\" FROM c LEFT JOIN r ON r.id = c.id AND r.hit IS NOT NULL GROUP BY c.id")
def agg_10_adjacency(spark, sf_dir):
    c = linked(spark, sf_dir)
    return links.adjacency(c, links.edges(links.resolve(links.graph_links(c), c), c)).select("id", F.array_join("to", ",").alias("to"))


@query("SELECT source || '/doc-' || doc_id AS id FROM documents WHERE source <> 'src3' AND NOT (source IN ('src0', 'src4') AND doc_id % 40 < 20)")
def jn_07_orphans(spark, sf_dir):
    """The index lists one directory, and single documents of two others."""
    c = linked(spark, sf_dir)
    one = c.filter("id rlike '^src[04]/' and cast(regexp_extract(id, '-([0-9]+)$', 1) as bigint) % 40 < 20").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("* [x]("), "id", F.lit(")")))), "\n").alias("text"))
    index = one.select(F.lit("index.md").alias("path"), F.concat(F.lit("* [all](src3/)\n"), "text").alias("text"))
    return links.orphans(c, index)


@query(f"WITH {LINKS}, v AS (SELECT DISTINCT id AS \"from\", coalesce(to_id, 'etc') AS \"to\", hit IS NULL AS dead FROM r UNION SELECT id, source || '/index', true FROM c UNION SELECT id, 'src1', true FROM c) SELECT * FROM v WHERE \"from\" <> \"to\"")
def gr_04_viz_links(spark, sf_dir):
    return links.viz_links(linked(spark, sf_dir))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written links between plain ids: n to 2n, 3n and a missing one."""
    i = F.col("doc_id")
    body = F.concat("text", F.lit("\n[twice]("), (2 * i).cast("string"), F.lit(") [thrice]("), (3 * i).cast("string"), F.lit(") [gone](x"), i.cast("string"), F.lit(")"))
    return read(spark, sf_dir, "documents").select(i.cast("string").alias("id"), body.alias("body"))


@query(
    """WITH l AS (SELECT doc_id::VARCHAR AS s, 0 AS pos, (2 * doc_id)::VARCHAR AS t, 'twice' AS text FROM documents UNION ALL SELECT doc_id::VARCHAR, 1, (3 * doc_id)::VARCHAR, 'thrice' FROM documents UNION ALL SELECT doc_id::VARCHAR, 2, 'x' || doc_id, 'gone' FROM documents)
    SELECT s AS node, 'out' AS direction, pos, t AS id, text FROM l UNION ALL SELECT t, 'in', min(pos), s, min_by(text, pos) FROM l GROUP BY t, s"""
)
def gr_05_neighbors(spark, sf_dir):
    """Neighbours of all nodes, missing ones too."""
    return links.neighbors_of_all(links.raw_links(raw(spark, sf_dir)))


@query(
    """WITH l AS (SELECT doc_id AS s, 2 * doc_id AS t FROM documents UNION ALL SELECT doc_id, 3 * doc_id FROM documents), ok AS (SELECT doc_id FROM documents WHERE doc_id % 5 <> 4),
    l1 AS (SELECT DISTINCT t FROM l WHERE s = 3 AND t <> 3), k1 AS (SELECT t AS id, CAST(t AS VARCHAR) AS ord FROM l1 JOIN ok ON ok.doc_id = t),
    l2 AS (SELECT l.t, k1.id AS via, row_number() OVER (PARTITION BY l.t ORDER BY k1.ord) AS k FROM k1 JOIN l ON l.s = k1.id WHERE l.t NOT IN (SELECT t FROM l1) AND l.t <> 3)
    SELECT 1 AS level, CAST(id AS VARCHAR) AS id, '3' AS via, 'current' AS status FROM k1 UNION ALL SELECT 2, CAST(t AS VARCHAR), CAST(via AS VARCHAR), 'current' FROM l2 JOIN ok ON ok.doc_id = t WHERE k = 1"""
)
def gr_06_traverse(spark, sf_dir):
    c = raw(spark, sf_dir)
    states = c.select("id", F.when(F.expr("try_cast(id as bigint)") % 5 == 4, "superseded").otherwise("current").alias("status"))
    return links.traverse(links.raw_links(c), states, "3", 2)


@query(
    """WITH l AS (SELECT doc_id AS s, CAST(2 * doc_id AS VARCHAR) AS t FROM documents UNION ALL SELECT doc_id, CAST(3 * doc_id AS VARCHAR) FROM documents UNION ALL SELECT doc_id, 'x' || doc_id FROM documents), st AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 5 = 4 AS gone FROM documents),
    l1 AS (SELECT DISTINCT t, gone FROM l LEFT JOIN st ON st.id = l.t WHERE s = 1), l2 AS (SELECT DISTINCT l.t, st.gone FROM l1 JOIN l ON CAST(l.s AS VARCHAR) = l1.t AND NOT l1.gone LEFT JOIN st ON st.id = l.t WHERE l.t NOT IN (SELECT t FROM l1)),
    l3 AS (SELECT DISTINCT l.t, st.gone FROM l2 JOIN l ON CAST(l.s AS VARCHAR) = l2.t AND NOT l2.gone LEFT JOIN st ON st.id = l.t WHERE l.t NOT IN (SELECT t FROM l1 UNION SELECT t FROM l2)), v AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)
    SELECT count(*) FILTER (WHERE NOT gone) AS reached, count(*) FILTER (WHERE gone) AS hidden, count(*) FILTER (WHERE gone IS NULL) AS dangling FROM v"""
)
def agg_15_traverse_counts(spark, sf_dir):
    c = raw(spark, sf_dir)
    states = c.select("id", F.when(F.expr("try_cast(id as bigint)") % 5 == 4, "superseded").otherwise("current").alias("status"))
    return links.traverse_counts(links.raw_links(c), states, "1", 3)


@query(
    """WITH d AS (SELECT doc_id, doc_id // 5 AS g, count(*) OVER (PARTITION BY doc_id // 5) AS n FROM documents)
    SELECT string_agg(printf('%09d', doc_id), '>' ORDER BY doc_id) AS cycle FROM d WHERE g % 3 = 0 AND n = 5 GROUP BY g UNION ALL SELECT printf('%09d', doc_id) FROM d WHERE g % 3 = 1 AND doc_id % 5 = 2"""
)
def tmp_05_cycles(spark, sf_dir):
    """Documents in fives: rings of five, fives with one that supersedes itself, and chains whose ends supersede members of the next ring."""
    i, name = F.col("doc_id"), lambda c: F.format_string("%09d", c)
    five, last = F.floor(i / 5) % 3, i % 5 == 4
    ring = F.when(last, F.array(name(i - 4))).otherwise(F.array(name(i + 1)))
    older = F.when(five == 0, ring).when(five == 1, F.when(i % 5 == 2, F.array(name(i)))).otherwise(F.array(name(i + 1)))
    c = read(spark, sf_dir, "documents").select(name(i).alias("id"), older.alias("supersedes"))
    return temporal.cycles(c).select(F.array_join("cycle", ">").alias("cycle"))


CURRENT = "SELECT '/' || source || '/' || doc_id AS path, sha256(text) AS sha256 FROM documents WHERE doc_id % 17 <> 0"
STATE = "SELECT CASE WHEN doc_id % 13 = 3 THEN '/old/' || doc_id ELSE '/' || source || '/' || doc_id END AS path, CASE WHEN doc_id % 11 = 5 THEN 'stale' ELSE sha256(text) END AS sha256, 'c' || doc_id AS concept, doc_id FROM documents WHERE doc_id % 7 <> 2"


def snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A scan and an older state: some files new, changed, moved or gone; each concept may be shared by two files."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat(F.lit("/"), "source", F.lit("/"), i.cast("string"))
    now = d.filter(i % 17 != 0).select(path.alias("path"), F.sha2("text", 256).alias("sha256"))
    old = d.filter(i % 7 != 2).select(
        F.when(i % 13 == 3, F.concat(F.lit("/old/"), i.cast("string"))).otherwise(path).alias("path"), F.when(i % 11 == 5, "stale").otherwise(F.sha2("text", 256)).alias("sha256"), F.array(F.concat(F.lit("c"), F.floor(i / 2).cast("string"))).alias("concepts")
    )
    return now, old


PLAN = f"""cur AS ({CURRENT}), old AS ({STATE}),
 app AS (SELECT path, sha256, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS k FROM cur WHERE path NOT IN (SELECT path FROM old)),
 van AS (SELECT path, sha256, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS k FROM old WHERE path NOT IN (SELECT path FROM cur)),
 ren AS (SELECT app.path, van.path AS old_path FROM app JOIN van ON app.sha256 = van.sha256 AND app.k = van.k),
 plan AS (SELECT path, 'renamed' AS change, old_path FROM ren
  UNION ALL SELECT path, 'added', NULL FROM app WHERE path NOT IN (SELECT path FROM ren)
  UNION ALL SELECT path, 'removed', NULL FROM van WHERE path NOT IN (SELECT old_path FROM ren)
  UNION ALL SELECT cur.path, CASE WHEN cur.sha256 = old.sha256 THEN 'unchanged' ELSE 'updated' END, NULL FROM cur JOIN old ON cur.path = old.path)"""


@query(f"WITH {PLAN} SELECT * FROM plan")
def syn_01_plan(spark, sf_dir):
    return sync.plan(*snapshot(spark, sf_dir)).select("path", "change", "old_path")


@query(f"WITH {PLAN} SELECT v.change, count(plan.change) AS n FROM (VALUES ('added'), ('updated'), ('renamed'), ('removed'), ('unchanged')) v(change) LEFT JOIN plan ON plan.change = v.change GROUP BY v.change")
def agg_08_sync_summary(spark, sf_dir):
    return sync.summary(sync.plan(*snapshot(spark, sf_dir)))


@query(f"WITH {PLAN}, o AS (SELECT path, 'c' || (doc_id // 2) AS id FROM old) SELECT DISTINCT id FROM o WHERE path IN (SELECT path FROM plan WHERE change = 'removed') AND id NOT IN (SELECT id FROM o WHERE path NOT IN (SELECT path FROM plan WHERE change = 'removed'))")
def jn_16_deletable_concepts(spark, sf_dir):
    now, old = snapshot(spark, sf_dir)
    return sync.deletable(sync.plan(now, old), old)


@query(f"SELECT path FROM ({STATE}) WHERE starts_with(path, '/src1/') OR starts_with(path, '/old/')")
def jn_15_scope(spark, sf_dir):
    roots = spark.createDataFrame([("/src1",), ("/old/",)], "root string")
    return sync.scoped(snapshot(spark, sf_dir)[1], roots).select("path")


@query(f"WITH o AS (SELECT path, 'c' || (doc_id // 2) AS concept FROM ({STATE})) SELECT concept, string_agg(path, ',' ORDER BY path) AS owners FROM o GROUP BY concept")
def jn_16_owners(spark, sf_dir):
    return sync.owners(snapshot(spark, sf_dir)[1]).select("concept", F.array_join("owners", ",").alias("owners"))


@query(f"WITH cur AS ({CURRENT}), old AS ({STATE}) SELECT old.path, CASE WHEN doc_id % 29 = 0 THEN 'error' WHEN cur.sha256 IS NULL OR cur.sha256 <> old.sha256 THEN 'stale' ELSE 'ok' END AS health FROM old LEFT JOIN cur ON cur.path = old.path")
def jn_23_staleness(spark, sf_dir):
    now, old = snapshot(spark, sf_dir)
    failed = old.filter("cast(regexp_extract(path, '([0-9]+)$', 1) as bigint) % 29 = 0").select("path")
    return sync.staleness(old, now, failed).select("path", "health")


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def jn_11_digest_groups(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 1)")
def jn_11_not_ingested(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return sync.not_ingested(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1").withColumnRenamed("sha256", "digest")).select("doc_id")


@query(
    f"WITH {corpus.SQL}, {tokens_sql('concepts', 'id, doc_id', [('title', 1)])}, s AS (SELECT id, doc_id, list_distinct(list(token)) AS t FROM toks GROUP BY id, doc_id) SELECT a.id AS a, b.id AS b, {micro('len(list_intersect(a.t, b.t)) * 1.0 / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))')} AS similarity FROM s a, s b WHERE a.id < b.id AND len(list_intersect(a.t, b.t)) >= 0.8 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))"
)
def jn_09_title_jaccard(spark, sf_dir):
    c = corpus.concepts(spark, sf_dir)
    found = entity.jaccard_titles(c, c).filter("a < b")
    return found.select("a", "b", (F.floor(F.col("similarity") * 1e6 + 0.5) / 1e6).alias("similarity"))


@query(
    f"WITH {corpus.SQL}, {tokens_sql('concepts', 'id, doc_id', [('title', 1)])}, s AS (SELECT id, doc_id, list_distinct(list(token)) AS t FROM toks GROUP BY id, doc_id), n AS (SELECT id, doc_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title FROM concepts), "
    "m1 AS (SELECT a.id, min(b.id) AS m FROM n a JOIN n b ON a.title = b.title AND a.title <> '' AND b.doc_id % 2 = 1 WHERE a.doc_id % 2 = 0 GROUP BY a.id), "
    "m2 AS (SELECT a.id, b.id AS m, row_number() OVER (PARTITION BY a.id ORDER BY len(list_intersect(a.t, b.t)) * 1.0 / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) DESC, b.id) AS k FROM s a, s b WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 AND len(list_intersect(a.t, b.t)) >= 0.8 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))) "
    "SELECT n.id, coalesce(m1.m, m2.m) AS match, CASE WHEN m1.m IS NOT NULL THEN 'title' WHEN m2.m IS NOT NULL THEN 'similar_title' END AS reason FROM n LEFT JOIN m1 ON m1.id = n.id LEFT JOIN m2 ON m2.id = n.id AND m2.k = 1 WHERE n.doc_id % 2 = 0"
)
def jn_09_entity_match(spark, sf_dir):
    c = corpus.concepts(spark, sf_dir).withColumn("i", F.expr("cast(substr(id, 5) as bigint)"))
    return entity.match(c.filter("i % 2 = 0"), c.filter("i % 2 = 1"))


@query("SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.35")
def jn_10_cosine_pairs(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return entity.cosine_pairs(v, v, 0.35).filter("a < b").select("a", "b")


NOISY = "SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE + (CASE WHEN a.vec_id % 3 = 0 THEN 0.9 ELSE 0.3 END) * p[2]::DOUBLE) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 1) % (SELECT count(*) FROM embeddings)"


@query(f"WITH n AS ({NOISY}), s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.v) AS c FROM embeddings a, n b) SELECT a, min_by(b, (-c, b)) AS b, round(max(c), 6) AS similarity FROM s WHERE c >= 0.87 GROUP BY a")
def jn_10_nearest(spark, sf_dir):
    """The most similar of all vectors that have been mixed with others, where it is similar enough to be a duplicate."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    other = v.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e2"))
    pairs = v.withColumn("other", (F.col("vec_id") * 7 + 1) % F.lit(v.count())).join(other, "other")
    part = F.when(F.col("vec_id") % 3 == 0, 0.9).otherwise(0.3)
    noisy = pairs.select(F.col("vec_id").alias("id"), part.alias("w"), "embedding", "e2").select("id", F.zip_with("embedding", "e2", lambda x, y: x + F.col("w") * y).alias("embedding"))
    return entity.nearest(v.withColumnRenamed("vec_id", "id"), noisy).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, {micro('list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))')} AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fn_19_cosine(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(w, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), (F.floor(X.cosine("embedding", "other") * 1e6 + 0.5) / 1e6).alias("similarity"))


@query(
    f"WITH {corpus.SQL}, n AS (SELECT id, tier, body, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, trim(regexp_replace(lower(title || ' ' || body), '[^a-z0-9]+', ' ', 'g')) AS h FROM concepts) "
    "SELECT x.id AS source, y.id AS target FROM n x JOIN n y ON x.id <> y.id AND length(y.t) >= 4 AND x.tier <> 'human-reviewed' AND contains(' ' || x.h || ' ', ' ' || y.t || ' ') AND NOT contains(x.body, '](/' || y.id || ')') AND NOT contains(x.body, '](' || replace(y.t, ' ', '-') || ')')"
)
def jn_12_backlinks(spark, sf_dir):
    """Titles of any length, in titles and bodies; concepts that a human has reviewed are never added to."""
    return entity.backlinks(corpus.concepts(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one page each, with the lines that begin with `The` or `And` made headings."""
    text = F.regexp_replace(F.regexp_replace("text", "\nThe ", "\n# The "), "\nAnd ", "\n## And ")
    return read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("number"), text.alias("text"))


SECTIONS = r"""p AS (SELECT doc_id, replace(replace(text, chr(10) || 'The ', chr(10) || '# The '), chr(10) || 'And ', chr(10) || '## And ') AS text FROM documents),
 l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p),
 m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM l WHERE NOT (line = '' AND pos = (SELECT len(string_split(p.text, chr(10))) FROM p WHERE p.doc_id = l.doc_id))),
 h AS (SELECT doc_id, section_no, max(CASE WHEN regexp_matches(line, '^#{1,6}\s') THEN line END) AS heading, string_agg(CASE WHEN regexp_matches(line, '^#{1,6}\s') THEN NULL ELSE line END, chr(10) ORDER BY pos) AS body FROM m GROUP BY doc_id, section_no),
 f AS (SELECT doc_id, min_by(trim(line), pos) AS first FROM l WHERE trim(line) <> '' GROUP BY doc_id),
 s AS (SELECT h.doc_id, CAST(section_no AS BIGINT) AS section_no, CASE WHEN section_no = 0 THEN substr(first, 1, 80) ELSE trim(regexp_extract(heading, '^(#{1,6})\s+(.*?)\s*#*\s*$', 2)) END AS title, CASE WHEN section_no = 0 THEN 0 ELSE length(regexp_extract(heading, '^(#{1,6})', 1)) END AS level,
   trim(coalesce(body, ''), ' ' || chr(9) || chr(10) || chr(13)) AS text, (SELECT length(text) < 1000 FROM p WHERE p.doc_id = h.doc_id) AS too_small FROM h LEFT JOIN f ON f.doc_id = h.doc_id)"""


@query(f"WITH {SECTIONS} SELECT doc_id, section_no, title, level, md5(text) AS digest, too_small FROM s")
def ing_01_sections(spark, sf_dir):
    s = sections.sections(pages(spark, sf_dir))
    return s.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "title", "level", F.md5("text").alias("digest"), "too_small")


@query("SELECT length(text) < 1000 AS too_small, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY 1")
def agg_11_stub_gate(spark, sf_dir):
    """The gate of sections() on whole documents; characters counted from the texts."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("number"), "text")
    gate = sections.sections(d).select("doc_id", "too_small").distinct()
    return d.join(gate, "doc_id").groupBy("too_small").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    f"WITH {SECTIONS}, w AS (SELECT doc_id, section_no, lead(section_no) OVER o AS nxt, lag(section_no) OVER o AS prv FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY section_no)), "
    r"said AS (SELECT x.doc_id, x.section_no, y.section_no AS target_no, 0 AS kind FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.section_no <> y.section_no AND length(trim(y.title)) >= 4 AND contains(lower(x.text), lower(trim(y.title))) AND regexp_matches(x.text, '(?i)(^|[^\p{L}\p{N}_])' || regexp_escape(trim(y.title)) || '($|[^\p{L}\p{N}_])') "
    "UNION ALL SELECT doc_id, section_no, nxt, 1 FROM w WHERE nxt IS NOT NULL UNION ALL SELECT doc_id, section_no, prv, 2 FROM w WHERE prv IS NOT NULL), "
    "b AS (SELECT doc_id, section_no, target_no, min(kind) AS kind FROM said GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY kind, target_no) AS pos FROM b) "
    "SELECT doc_id, section_no, target_no, CASE kind WHEN 0 THEN 'mentioned' WHEN 1 THEN 'next' ELSE 'previous' END AS why FROM k WHERE pos <= 8"
)
def jn_13_see_also(spark, sf_dir):
    """Sections that the text mentions by their titles, and neighbouring ones."""
    return sections.see_also(sections.sections(pages(spark, sf_dir))).select("doc_id", F.col("section_no").cast("long").alias("section_no"), F.col("target_no").cast("long").alias("target_no"), "why")


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT doc_id, source || CASE WHEN k + 1 = 1 THEN '' ELSE '-' || (k + 1) END AS id FROM r")
def win_06_allocate_ids(spark, sf_dir):
    """Every base is taken once already."""
    d = read(spark, sf_dir, "documents")
    return sections.allocate_ids(d.select(F.col("source").alias("base"), F.col("doc_id").alias("ord"), "doc_id"), d.select(F.col("source").alias("id")).distinct()).select("doc_id", "id")


@query("SELECT p_brand AS doc, p_size AS size, least(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC), 6) AS level FROM (SELECT p_brand, p_size, sum(length(p_name)) AS c, max_by(p_size, sum(length(p_name)) * 1000 + p_size) OVER (PARTITION BY p_brand) AS body FROM part GROUP BY p_brand, p_size) WHERE p_size > body")
def win_16_font_levels(spark, sf_dir):
    items = read(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_name").alias("text"), F.col("p_size").alias("size"))
    return sections.font_levels(items).select(F.col("doc_id").alias("doc"), "size", F.col("level").cast("long").alias("level"))


@query(
    f"WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations), q AS (SELECT conv_id || '-' || turn AS k, prev FROM t WHERE prev IS NOT NULL), a AS (SELECT conv_id || '-' || turn AS k, text FROM t), {tokens_sql('q', 'k', [('prev', 1)], 'qt')}, {tokens_sql('a', 'k', [('text', 1)], 'ans')}, "
    f"qd AS (SELECT DISTINCT k, token FROM qt), ad AS (SELECT DISTINCT k, token FROM ans) SELECT q.k, {micro('coalesce(count(ad.token) * 1.0 / nullif(count(qd.token), 0), 0)')} AS relevancy FROM q LEFT JOIN qd ON qd.k = q.k LEFT JOIN ad ON ad.k = qd.k AND ad.token = qd.token GROUP BY q.k"
)
def ev_03_answer_relevancy(spark, sf_dir):
    """Each turn as the answer to the one before."""
    t = read(spark, sf_dir, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("prev is not null")
    value = evaluate.answer_relevancy("prev", "text")
    return t.select(F.concat_ws("-", "conv_id", "turn").alias("k"), (F.floor(value * 1e6 + 0.5) / 1e6).alias("relevancy"))


EVAL = f"""WITH {corpus.SQL}, {tokens_sql('concepts', 'id', [('id', 3), ('title', 3), ('description', 2), ('tags', 2), ('body', 1)])}, q AS (SELECT item_id, text FROM benchmark), {tokens_sql('q', 'item_id', [('text', 1)], 'qw')}, qd AS (SELECT DISTINCT item_id, token FROM qw),
 lens AS (SELECT id, sum(weight) AS dl FROM toks GROUP BY id), stats AS (SELECT (SELECT count(*) FROM concepts) AS n, sum(dl) * 1.0 / (SELECT count(*) FROM concepts) AS avgdl FROM lens), post AS (SELECT id, token, sum(weight) AS tf FROM toks GROUP BY id, token), dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
 scored AS (SELECT item_id, p.id, {micro("sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))")} AS score FROM qd JOIN post p ON p.token = qd.token JOIN dfs d ON d.token = qd.token JOIN lens l ON l.id = p.id JOIN stats ON true GROUP BY item_id, p.id),
 best AS (SELECT * FROM (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 5),
 x AS (SELECT id, concat_ws(chr(10), id, title, description, tags, body) AS t, '[' || id || '] ' || coalesce(substr(list_extract(list_filter(list_transform(string_split(body, chr(10)), lambda y: trim(y)), lambda y: y <> '' AND NOT starts_with(y, '#')), 1), 1, 200), '') AS line FROM concepts WHERE id IN (SELECT id FROM best)),
 {tokens_sql('x', 'id', [('t', 1)], 'xw')}, ctx AS (SELECT DISTINCT item_id, token FROM best JOIN xw ON xw.id = best.id), hit AS (SELECT DISTINCT best.item_id, best.id FROM best JOIN xw ON xw.id = best.id JOIN qd ON qd.item_id = best.item_id AND qd.token = xw.token),
 ans AS (SELECT item_id, string_agg(line, chr(10) ORDER BY rank) AS answer, string_agg(best.id, ',' ORDER BY rank) AS retrieved, count(*) AS n FROM best JOIN x ON x.id = best.id GROUP BY item_id), {tokens_sql('ans', 'item_id', [('answer', 1)], 'aw')}, ad AS (SELECT DISTINCT item_id, token FROM aw),
 cut AS (SELECT item_id, string_split(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM ans), sent AS (SELECT * FROM (SELECT item_id, generate_subscripts(l, 1) AS i, trim(unnest(l), ' ' || chr(9) || chr(10)) AS said FROM cut) WHERE said <> ''), {tokens_sql('sent', 'item_id, i', [('said', 1)], 'sw')},
 sup AS (SELECT sw.item_id, sw.i, count(DISTINCT sw.token) AS n, count(DISTINCT ctx.token) AS k FROM sw LEFT JOIN ctx ON ctx.item_id = sw.item_id AND ctx.token = sw.token GROUP BY sw.item_id, sw.i), faith AS (SELECT sent.item_id, sum(CASE WHEN sup.k >= 0.5 * sup.n THEN 1 ELSE 0 END) * 1.0 / count(*) AS f FROM sent LEFT JOIN sup ON sup.item_id = sent.item_id AND sup.i = sent.i GROUP BY sent.item_id),
 m AS (SELECT CAST(q.item_id AS VARCHAR) AS qid, coalesce((SELECT count(*) FROM hit WHERE hit.item_id = q.item_id) * 1.0 / ans.n, 0) AS context_relevancy, coalesce(f, 0) AS faithfulness, coalesce((SELECT count(*) FROM qd JOIN ad ON ad.item_id = qd.item_id AND ad.token = qd.token WHERE qd.item_id = q.item_id) * 1.0 / nullif((SELECT count(*) FROM qd WHERE qd.item_id = q.item_id), 0), 0) AS answer_relevancy,
  coalesce((SELECT count(*) FROM qd JOIN ctx ON ctx.item_id = qd.item_id AND ctx.token = qd.token WHERE qd.item_id = q.item_id) * 1.0 / nullif((SELECT count(*) FROM qd WHERE qd.item_id = q.item_id), 0), 1) AS reference_support, coalesce(retrieved, '') AS retrieved FROM q LEFT JOIN ans ON ans.item_id = q.item_id LEFT JOIN faith ON faith.item_id = q.item_id),
 e AS (SELECT *, (context_relevancy + faithfulness + answer_relevancy) / 3 AS overall, concat_ws(',', CASE WHEN context_relevancy < 0.6 THEN 'context_relevancy' END, CASE WHEN faithfulness < 0.6 THEN 'faithfulness' END, CASE WHEN answer_relevancy < 0.4 THEN 'answer_relevancy' END) AS failing FROM m),
 d AS (SELECT *, CASE WHEN context_relevancy < 0.6 THEN 'retrieval' WHEN failing <> '' THEN 'generation' ELSE 'ok' END AS diagnosis, failing = '' AS passed FROM e)"""
MEANS = ("context_relevancy", "faithfulness", "answer_relevancy", "overall")


def _micro(*names: str) -> list:
    return [(F.floor(F.col(n) * 1e6 + 0.5) / 1e6).alias(n) for n in names]


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.operators import search

    c = corpus.concepts(spark, sf_dir)
    golden = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.col("text").alias("expected_answer"), F.lit(None).cast("array<string>").alias("must_cite"))
    return evaluate.evaluate(golden, c, search.build_index(c))


@query(f"{EVAL} SELECT qid, {', '.join(f'{micro(n)} AS {n}' for n in (*MEANS, 'reference_support'))}, failing, diagnosis, passed, retrieved FROM d")
def ev_08_evaluate(spark, sf_dir):
    """Benchmark passages as questions; scores by question."""
    got = _evaluated(spark, sf_dir)
    return got.select("qid", *_micro(*MEANS, "reference_support"), F.array_join("failing", ",").alias("failing"), "diagnosis", "passed", F.array_join("retrieved", ",").alias("retrieved"))


def stub_judge(prompts: list[str]) -> list[str]:
    """For tests: the first id is relevant and one that isn't there, answers fit by the length of the question, claims are no JSON where the context has an even length."""
    out = []
    for p in prompts:
        if p.startswith("Context:"):
            out.append("no JSON" if len(p.partition("Answer:\n")[2]) % 2 else '{"claims": [{"claim": "a", "supported": true}, {"claim": "b", "supported": false}, {"claim": "c"}]}')
        elif "Which of these ids" in p:
            out.append('{"relevant": ["' + p.partition("Concepts:\n[")[2].partition("]")[0] + '", "nowhere"]}')
        else:
            out.append('{"score": ' + str(len(p.partition("Question: ")[2].partition("\nAnswer: ")[0]) % 13 / 10) + "}")
    return out


@query(f"{EVAL}, b AS (SELECT CAST(item_id AS VARCHAR) AS qid, text FROM benchmark) SELECT d.qid, {micro('1.0 / len(string_split(retrieved, chr(44)))')} AS context_relevancy, {micro('least(1.0, length(b.text) % 13 / 10.0)')} AS answer_relevancy, 'judge' AS context_by FROM d JOIN b USING (qid) WHERE retrieved <> ''")
def ev_10_judged(spark, sf_dir):
    """Benchmark passages as questions, scored by a stub model with the token scores behind it."""
    from lorekeep.operators import search

    c = corpus.concepts(spark, sf_dir)
    golden = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.col("text").alias("expected_answer"), F.lit(None).cast("array<string>").alias("must_cite"))
    got = evaluate.evaluate(golden, c, search.build_index(c), judge=stub_judge)
    return got.select("qid", *_micro("context_relevancy", "answer_relevancy"), F.col("methods.context_relevancy").alias("context_by"))


@query(f"{EVAL} SELECT {', '.join(f'{micro(f'avg({n})')} AS {n}' for n in MEANS)}, count(*) AS questions, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE diagnosis = 'retrieval') AS retrieval, count(*) FILTER (WHERE diagnosis = 'generation') AS generation, CASE WHEN count(*) > 0 AND count(*) FILTER (WHERE passed) = count(*) THEN 'pass' ELSE 'fail' END AS gate FROM d")
def agg_05_eval_report(spark, sf_dir):
    return evaluate.report(_evaluated(spark, sf_dir)).select(*_micro(*MEANS), "questions", "passed", "retrieval", "generation", "gate")


@query("SELECT CAST(item_id AS VARCHAR) AS qid, CASE WHEN item_id % 2 = 0 THEN 'nowhere' ELSE '' END AS missing, CASE WHEN item_id % 2 = 0 THEN 'retrieval' END AS diagnosis FROM benchmark")
def jn_22_must_cite(spark, sf_dir):
    """Every second question has to cite a concept that isn't there."""
    from lorekeep.operators import search

    c, k = corpus.concepts(spark, sf_dir), F.col("item_id")
    golden = read(spark, sf_dir, "benchmark").select(k.cast("string").alias("id"), F.col("text").alias("question"), F.lit("").alias("expected_answer"), F.when(k % 2 == 0, F.array(F.lit("nowhere"))).alias("must_cite"))
    got = evaluate.evaluate(golden, c, search.build_index(c))
    return got.select("qid", F.array_join("missing", ",").alias("missing"), F.when(F.size("missing") > 0, F.col("diagnosis")).alias("diagnosis"))


@query(
    "WITH u AS (SELECT doc_id AS pos, text, greatest(1, length(text) // 4) AS cost FROM documents WHERE doc_id >= 5 AND doc_id < 55), c AS (SELECT pos, text, CAST(sum(cost) OVER (ORDER BY pos) AS BIGINT) AS tokens_so_far FROM u), k AS (SELECT * FROM c WHERE tokens_so_far <= 20000 OR pos = 5) SELECT pos, md5(text) AS digest, tokens_so_far, (SELECT count(*) FROM documents) - 5 - (SELECT count(*) FROM k) AS remaining FROM k"
)
def win_11_paging(spark, sf_dir):
    units = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")
    return governance.paged(units, offset=5, max_chunks=50, max_tokens=20000).select("pos", F.md5("text").alias("digest"), "tokens_so_far", "remaining")


@query(f"WITH {corpus.SQL} SELECT bundle_id, count(*) AS concepts, count(*) FILTER (WHERE tier = 'human-reviewed') AS human, count(*) FILTER (WHERE tier = 'machine-confirmed') AS machine, count(*) FILTER (WHERE tier = 'unverified') AS unverified, count(DISTINCT resource) AS resources, CAST(sum(length(body)) AS BIGINT) AS chars FROM concepts GROUP BY bundle_id")
def agg_07_bundle_stats(spark, sf_dir):
    return governance.bundle_stats(corpus.concepts(spark, sf_dir))


@query("SELECT event_id AS seq, event_type AS action, CAST(user_id AS VARCHAR) AS actor FROM events WHERE event_id % 5 <> 0 ORDER BY event_id DESC LIMIT 20")
def win_14_audit_log(spark, sf_dir):
    """Events as JSON lines, every fifth of them corrupt."""
    i = F.col("event_id")
    line = F.to_json(F.struct(F.col("ts").cast("string").alias("ts"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("action"), F.lit("c").alias("concept_id"), F.lit("").alias("summary")))
    lines = read(spark, sf_dir, "events").select(i.alias("seq"), F.when(i % 5 == 0, "{broken").otherwise(line).alias("value"))
    return governance.audit_log(lines, 20).select("seq", "action", "actor")


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN length(text) % 3 = 0 THEN 'h' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), '') AS ids FROM conversations")
def sh_01_previous_hits(spark, sf_dir):
    t = read(spark, sf_dir, "conversations")
    hits = t.filter(F.length("text") % 3 == 0).select("conv_id", "turn", F.array(F.concat(F.lit("h"), F.col("turn").cast("string"))).alias("ids"))
    return governance.chat_context(hits, t).select("conv_id", "turn", F.array_join("ids", ",").alias("ids"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.body <> b.body THEN 'changed' ELSE 'unchanged' END AS change FROM (SELECT doc_id, text AS body FROM documents WHERE doc_id % 9 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS body FROM documents WHERE doc_id % 10 <> 1) b ON a.doc_id = b.doc_id")
def jn_18_bundle_diff(spark, sf_dir):
    c = corpus.concepts(spark, sf_dir).withColumn("i", F.expr("cast(substr(id, 5) as bigint)"))
    new = c.filter("i % 10 <> 1").withColumn("body", F.when(F.col("i") % 5 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return governance.diff(c.filter("i % 9 <> 0"), new).select(F.expr("cast(substr(id, 5) as bigint)").alias("doc_id"), "change")


@query("SELECT source AS bundle_id, row_number() OVER (PARTITION BY source ORDER BY lower(t), id) AS pos, '* [' || t || '](' || id || '.md)' AS line FROM (SELECT source, 'doc-' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'doc-' || doc_id ELSE upper(lang) || ' ' || doc_id END AS t FROM documents)")
def snk_04_index_page(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    c = d.select(F.col("source").alias("bundle_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.upper("lang"), F.lit(" "), F.col("doc_id").cast("string"))).alias("title"), F.lit("").alias("description"))
    return governance.index_page(c, by=("bundle_id",)).select("bundle_id", "pos", "line")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str_01_event_windows(spark, sf_dir):
    from lorekeep.streaming.watch import event_states

    return event_states(read(spark, sf_dir, "events")).select("start", "event_type", "n")
