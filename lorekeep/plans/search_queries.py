"""Search, temporal and listing queries over the driver's documents."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import temporal as T
from lorekeep.functions import text as X
from lorekeep.operators import replay, search, temporal
from lorekeep.plans.registry import micro, query, stream_sql, tokens_sql
from lorekeep.sources import corpus

TERMS = "thanedble anea whble"
PHRASE = '"thanedble the, anea"'
EXCLUDING = "thanedble -eriner hation"
FIELDS = [("id", 3), ("title", 3), ("description", 2), ("tags", 2), ("body", 1)]
AT = corpus.AS_OF


def bm25_sql(terms: list[str], by: str = "", keep: str = "") -> str:
    """CTEs up to scored ([by,] id, score)."""
    wanted = ", ".join(f"'{t}'" for t in terms)
    b, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    one = f"ON s.{by} = p.{by}" if by else "ON true"
    df_on = f"ON d.{by} = p.{by} AND d.token = p.token" if by else "ON d.token = p.token"
    tf_sum = f"""WITH {corpus.SQL}, {tokens_sql("concepts", f"{b}id", FIELDS)},
    lens AS (SELECT {b}id, sum(weight) AS dl FROM toks GROUP BY {b}id),
    every AS (SELECT {b}c.id, coalesce(l.dl, 0) AS dl FROM concepts c LEFT JOIN lens l USING ({b}id)),
    stats AS (SELECT {b}count(*) AS n, avg(dl) AS avgdl FROM every{f" GROUP BY {by}" if by else ""}),
    post AS (SELECT {b}id, token, sum(weight) AS tf FROM toks WHERE token IN ({wanted}) GROUP BY {b}id, token),
    dfs AS (SELECT {b}token, count(*) AS df FROM post GROUP BY {b}token),
    scored AS (SELECT {f"p.{by}, " if by else ""}p.id, {micro("sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))")} AS score
      FROM post p JOIN dfs d {df_on} JOIN every e ON e.id = p.id JOIN stats s {one} {keep} GROUP BY {f"p.{by}, " if by else ""}p.id)"""
    return tf_sum.replace(f" {on} ", f" {on} ")


STATUS_SQL = f"""
 win AS (SELECT *, CASE WHEN valid_from > TIMESTAMP '{AT}' THEN 'not_yet_valid' WHEN valid_until + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND < TIMESTAMP '{AT}' THEN 'expired' ELSE 'current' END AS window_state FROM concepts),
 up AS (SELECT old.id, new.id AS by1, new.window_state AS w1, n2.id AS by2, n2.window_state AS w2 FROM win old LEFT JOIN win new ON new.supersedes = old.id LEFT JOIN win n2 ON n2.supersedes = new.id),
 heads AS (SELECT id, CASE WHEN w2 = 'current' THEN by2 WHEN w1 = 'current' THEN by1 ELSE id END AS head FROM up),
 statuses AS (SELECT w.id, CASE WHEN window_state <> 'current' THEN window_state WHEN head <> w.id THEN 'superseded' ELSE 'current' END AS status, CASE WHEN window_state = 'current' AND head <> w.id THEN head END AS superseded_by FROM win w JOIN heads h ON h.id = w.id)"""


def _scored(spark: SparkSession, sf_dir: str, text: str) -> tuple[DataFrame, DataFrame]:
    c = corpus.concepts(spark, sf_dir)
    return c, search.score(c, text)


@query(bm25_sql(["thanedble", "anea", "whble"]) + " SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored ORDER BY score DESC, id LIMIT 20")
def win_01_bm25_top_k(spark, sf_dir):
    return search.top_k(_scored(spark, sf_dir, TERMS)[1], 20)


@query(
    bm25_sql(["thanedble", "anea"]) + f""", {stream_sql("concepts", "id", "body", "seq")}, {stream_sql("concepts", "id", "title", "tit")},
    whole AS (SELECT c.id, ' ' || coalesce(t.s || ' ' || t.s || ' ' || t.s || ' ', '') || c.tags || ' ' || c.tags || ' ' || coalesce(s.s, '') || ' ' AS s FROM concepts c LEFT JOIN tit t ON t.id = c.id LEFT JOIN seq s ON s.id = c.id)
    SELECT scored.id, score FROM scored JOIN whole USING (id) WHERE contains(s, ' thanedble anea ')"""
)
def fn_05_phrase_search(spark, sf_dir):
    return _scored(spark, sf_dir, PHRASE)[1].select("id", search.rounded().alias("score"))


@query(bm25_sql(["thanedble", "hation"], keep="WHERE p.id NOT IN (SELECT id FROM toks WHERE token = 'eriner')") + " SELECT id, score FROM scored")
def flt_08_exclusion(spark, sf_dir):
    return _scored(spark, sf_dir, EXCLUDING)[1].select("id", search.rounded().alias("score"))


@query(
    bm25_sql(["thanedble", "anea", "whble"]) + f", {STATUS_SQL}" + """, ranked AS (SELECT s.id, s.score, t.status, t.superseded_by, CASE t.status WHEN 'current' THEN 0 WHEN 'superseded' THEN 2 ELSE 1 END AS group_rank,
     CASE tier WHEN 'human-reviewed' THEN 3 WHEN 'machine-confirmed' THEN 2 ELSE 1 END AS tr, last_verified FROM scored s JOIN statuses t ON t.id = s.id JOIN concepts c ON c.id = s.id)
    SELECT row_number() OVER w AS rank, id, score, status, superseded_by, group_rank FROM ranked WINDOW w AS (ORDER BY group_rank, score DESC, tr DESC, last_verified DESC NULLS LAST, id) ORDER BY rank LIMIT 60"""
)
def win_03_partition_rank(spark, sf_dir):
    c, s = _scored(spark, sf_dir, TERMS)
    return search.partition_rank(s, c, temporal.statuses(c, F.lit(AT).cast("timestamp")), 60, include_superseded=True)


@query(
    bm25_sql(["thanedble", "anea", "whble"]) + f", {STATUS_SQL}" + """, ranked AS (SELECT s.id, s.score, t.status, t.superseded_by, CASE t.status WHEN 'current' THEN 0 WHEN 'superseded' THEN 2 ELSE 1 END AS group_rank, last_verified
     FROM scored s JOIN statuses t ON t.id = s.id JOIN concepts c ON c.id = s.id WHERE c.type = 'kind 1' AND c.tier = 'machine-confirmed' AND t.status <> 'superseded')
    SELECT row_number() OVER w AS rank, id, score, status, superseded_by, group_rank FROM ranked WINDOW w AS (ORDER BY group_rank, score DESC, last_verified DESC NULLS LAST, id) ORDER BY rank LIMIT 5"""
)
def win_04_filter_before_limit(spark, sf_dir):
    c, s = _scored(spark, sf_dir, TERMS)
    return search.partition_rank(s, c, temporal.statuses(c, F.lit(AT).cast("timestamp")), 5, type_filter="KIND 1", tier_filter="Machine-Confirmed")


@query(bm25_sql(["thanedble", "anea", "whble"]) + f", {STATUS_SQL} SELECT count(*) AS superseded_hidden FROM scored s JOIN statuses t ON t.id = s.id JOIN concepts c ON c.id = s.id WHERE c.type = 'kind 2' AND t.status = 'superseded'")
def agg_13_superseded_hidden(spark, sf_dir):
    c, s = _scored(spark, sf_dir, TERMS)
    return search.superseded_hidden(s, c, temporal.statuses(c, F.lit(AT).cast("timestamp")), type_filter="kind 2")


@query(
    bm25_sql(["thanedble", "anea", "whble"], by="bundle_id") + """, r AS (SELECT bundle_id, id, floor(score * 1e4 + 0.5) / 1e4 AS score, row_number() OVER (PARTITION BY bundle_id ORDER BY score DESC, id) AS bundle_rank FROM scored)
    SELECT bundle_id, id, score, bundle_rank FROM r WHERE bundle_rank <= 5 ORDER BY score DESC, bundle_id, bundle_rank LIMIT 20"""
)
def win_13_cross_bundle_merge(spark, sf_dir):
    return search.merge_bundles(corpus.concepts(spark, sf_dir), TERMS, 5, 20).select("bundle_id", "id", "score", "bundle_rank")


@query(
    f"WITH {corpus.SQL} SELECT id, CAST(sum(s) AS BIGINT) AS score FROM (SELECT id, CASE WHEN contains(lower(id), w) OR contains(lower(title), w) THEN 3 ELSE 0 END + CASE WHEN contains(lower(tags), w) THEN 2 ELSE 0 END + CASE WHEN contains(lower(body), w) THEN 1 ELSE 0 END AS s FROM concepts, (VALUES ('thane'), ('doc-1'), ('en')) q(w)) GROUP BY id HAVING sum(s) > 0 ORDER BY score DESC, id LIMIT 50"
)
def rp_01_substring_rank(spark, sf_dir):
    return search.substring_rank(corpus.concepts(spark, sf_dir), "thane DOC-1 en", 50)


@query(
    f"WITH {corpus.SQL}, {tokens_sql('concepts', 'id', FIELDS)}, p AS (SELECT id, token, sum(weight) AS tf FROM toks GROUP BY id, token) SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, {micro('ln(1 + ((SELECT count(*) FROM concepts) - count(*) + 0.5) / (count(*) + 0.5))')} AS idf FROM p GROUP BY token"
)
def agg_02_term_statistics(spark, sf_dir):
    return search.build_index(corpus.concepts(spark, sf_dir))[1].select("token", "df", "cf", search.rounded("idf").alias("idf"))


@query(
    f"WITH {corpus.SQL}, bundle AS (SELECT * REPLACE (CASE WHEN doc_id % 6 = 2 THEN body || ' zebra added' ELSE body END AS body) FROM concepts WHERE doc_id % 6 <> 1), {tokens_sql('bundle', 'id', FIELDS)}, p AS (SELECT id, token, sum(weight) AS tf FROM toks GROUP BY id, token), n AS (SELECT count(*) AS n FROM bundle) "
    f"SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, {micro('ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5))')} AS idf, (SELECT n FROM n) AS n_docs FROM p GROUP BY token"
)
def syn_07_updated_index(spark, sf_dir):
    """An index of five sixths of the concepts after a sync that added, changed and removed a sixth each: the same as a new one."""
    i = F.expr("cast(substr(id, 5) as bigint)")
    c = corpus.concepts(spark, sf_dir)
    index = search.build_index(c.filter(i % 6 != 0))
    new = c.filter((i % 6).isin(0, 2)).withColumn("body", F.when(i % 6 == 2, F.concat("body", F.lit(" zebra added"))).otherwise(F.col("body")))
    updated = search.compact(search.update_index(index, new, c.filter((i % 6).isin(1, 2)).select("id")))
    return updated[1].select("token", "df", "cf", search.rounded("idf").alias("idf"), "n_docs")


@query(f"WITH {corpus.SQL}, {tokens_sql('concepts', 'id', FIELDS)} SELECT count(DISTINCT id) AS docs, CAST(sum(weight) AS BIGINT) AS total_len, {micro('sum(weight) * 1.0 / (SELECT count(*) FROM concepts)')} AS avgdl FROM toks")
def agg_03_average_length(spark, sf_dir):
    return search.build_index(corpus.concepts(spark, sf_dir))[2].select(F.col("n_docs").alias("docs"), "total_len", search.rounded("avgdl").alias("avgdl"))


@query(
    f"""WITH {corpus.SQL}, {tokens_sql('concepts', 'id', [('body', 1)])}, q AS (SELECT item_id, text FROM benchmark), {tokens_sql('q', 'item_id', [('text', 1)], 'qt')},
    lens AS (SELECT id, sum(weight) AS dl FROM toks GROUP BY id), stats AS (SELECT (SELECT count(*) FROM concepts) AS n, sum(dl) * 1.0 / (SELECT count(*) FROM concepts) AS avgdl FROM lens),
    post AS (SELECT id, token, sum(weight) AS tf FROM toks GROUP BY id, token), dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
    s AS (SELECT item_id, p.id, {micro('sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))')} AS score FROM (SELECT DISTINCT item_id, token FROM qt) w JOIN post p ON p.token = w.token JOIN dfs d ON d.token = w.token JOIN lens l ON l.id = p.id JOIN stats ON true GROUP BY item_id, p.id)
    SELECT item_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3"""
)
def jn_01_query_table(spark, sf_dir):
    """A table of queries (the benchmark items) against the index."""
    index = search.build_index(corpus.concepts(spark, sf_dir), [("body", 1)])
    terms = corpus.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(X.tokens("text"))).alias("token"))
    scored = search.score_with_index(index, terms).withColumn("score", search.rounded())
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")
    return scored.withColumn("rank", rank).filter("rank <= 3").select(F.col("query_id").alias("item_id"), "id", "score", "rank")


WORDS_SQL = "w AS (SELECT item_id, string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ') AS l FROM benchmark), picked AS (SELECT item_id, l[2] AS one, l[5] || ' ' || l[6] || ' ' || l[7] AS phrase, l[15] AS minus FROM w)"


@query(
    f"""WITH {corpus.SQL}, {WORDS_SQL}, {tokens_sql('concepts', 'id', [('title', 2), ('body', 1)])}, {stream_sql('concepts', 'id', 'body', 'seq')}, {stream_sql('concepts', 'id', 'title', 'tit')},
    whole AS (SELECT c.id, ' ' || coalesce(t.s || ' ' || t.s || ' ', '') || coalesce(s.s, '') || ' ' AS s FROM concepts c LEFT JOIN tit t ON t.id = c.id LEFT JOIN seq s ON s.id = c.id),
    {tokens_sql('picked', 'item_id', [('one', 1), ('phrase', 1)], 'qt')}, {tokens_sql('picked', 'item_id', [('minus', 1)], 'mt')}, {stream_sql('picked', 'item_id', 'phrase', 'ph')},
    lens AS (SELECT id, sum(weight) AS dl FROM toks GROUP BY id), stats AS (SELECT (SELECT count(*) FROM concepts) AS n, sum(dl) * 1.0 / (SELECT count(*) FROM concepts) AS avgdl FROM lens),
    post AS (SELECT id, token, sum(weight) AS tf FROM toks GROUP BY id, token), dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
    s AS (SELECT item_id, p.id, {micro('sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))')} AS score FROM (SELECT DISTINCT item_id, token FROM qt) w JOIN post p ON p.token = w.token JOIN dfs d ON d.token = w.token JOIN lens l ON l.id = p.id JOIN stats ON true GROUP BY item_id, p.id)
    SELECT s.item_id, s.id, s.score FROM s JOIN whole USING (id) LEFT JOIN ph ON ph.item_id = s.item_id WHERE (ph.s IS NULL OR contains(whole.s, ' ' || ph.s || ' '))
      AND NOT EXISTS (SELECT 1 FROM mt JOIN post ON post.token = mt.token WHERE mt.item_id = s.item_id AND post.id = s.id)"""
)
def fn_03_phrase_table(spark, sf_dir):
    """A table of queries, each with a quoted phrase and an excluded word of a benchmark passage, against an index with places."""
    index = search.build_index(corpus.concepts(spark, sf_dir), [("title", 2), ("body", 1)], places=True)
    l = F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "), " ")  # noqa: E741
    at = lambda k: F.coalesce(F.get(l, F.lit(k - 1)), F.lit(""))
    text = F.concat(F.lit('"'), F.concat_ws(" ", at(5), at(6), at(7)), F.lit('" '), at(2), F.lit(" -"), at(15))
    asked = corpus.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text"))
    return search.score_queries(index, asked).select(F.col("query_id").alias("item_id"), "id", search.rounded().alias("score"))


@query(f"WITH {corpus.SQL}, {tokens_sql('concepts', 'id', [('body', 1)])} SELECT id, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct, min(token) AS first_token FROM toks GROUP BY id")
def fn_01_tokenize(spark, sf_dir):
    t = corpus.concepts(spark, sf_dir).select("id", X.tokens("body").alias("t")).filter(F.size("t") > 0)
    return t.select("id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_min("t").alias("first_token"))


@query(f"WITH {corpus.SQL}, {STATUS_SQL} SELECT id, status, superseded_by FROM statuses")
def tmp_04_statuses(spark, sf_dir):
    return temporal.statuses(corpus.concepts(spark, sf_dir), F.lit(AT).cast("timestamp")).select("id", "status", "superseded_by")


@query(f"WITH {corpus.SQL}, {STATUS_SQL} SELECT id, head FROM heads")
def tmp_02_chain_heads(spark, sf_dir):
    return temporal.resolve_heads(corpus.concepts(spark, sf_dir), F.lit(AT).cast("timestamp"))


@query(f"WITH {corpus.SQL}, {STATUS_SQL} SELECT c.type, count(*) AS n FROM concepts c JOIN statuses s ON s.id = c.id WHERE s.status = 'current' GROUP BY c.type")
def tmp_06_snapshot(spark, sf_dir):
    return temporal.snapshot(corpus.concepts(spark, sf_dir), F.lit(AT).cast("timestamp")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {corpus.SQL}, days AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-12-18', INTERVAL 13 HOUR)) AS instant),
    w AS (SELECT instant, id, supersedes, CASE WHEN valid_from > instant THEN 'not_yet_valid' WHEN valid_until + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND < instant THEN 'expired' ELSE 'current' END AS state FROM concepts, days),
    h AS (SELECT o.instant, o.id, o.state, CASE WHEN n2.state = 'current' THEN n2.id WHEN n1.state = 'current' THEN n1.id END AS head FROM w o LEFT JOIN w n1 ON n1.instant = o.instant AND n1.supersedes = o.id LEFT JOIN w n2 ON n2.instant = o.instant AND n2.supersedes = n1.id)
    SELECT instant, CASE WHEN state <> 'current' THEN state WHEN head IS NOT NULL THEN 'superseded' ELSE 'current' END AS status, count(*) AS n, count(DISTINCT CASE WHEN state = 'current' THEN head END) AS heads, min(CASE WHEN state = 'current' THEN head END) AS first_head FROM h GROUP BY 1, 2"""
)
def tmp_07_replay(spark, sf_dir):
    """Statuses of all concepts every thirteen hours of a year, from one table of intervals."""
    instants = spark.sql("SELECT explode(sequence(timestamp'2023-12-20', timestamp'2024-12-18', interval 13 hours)) AS instant")
    got = replay.statuses_at(replay.status_intervals(corpus.concepts(spark, sf_dir)), instants)
    return got.groupBy(F.col("instant").cast("timestamp_ntz").alias("instant"), "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("superseded_by").alias("heads"), F.min("superseded_by").alias("first_head"))


@query(f"WITH {corpus.SQL} SELECT a.id AS src, a.supersedes AS dst FROM concepts a JOIN concepts b ON b.id = a.supersedes")
def jn_02_supersession_edges(spark, sf_dir):
    return temporal.edges(corpus.concepts(spark, sf_dir))


@query(f"WITH {corpus.SQL}, o AS (SELECT id, supersedes AS older FROM concepts WHERE supersedes IS NOT NULL UNION ALL SELECT id, 'gone-' || doc_id % 50 FROM concepts WHERE doc_id % 7 = 0) SELECT id, older AS missing FROM o WHERE older NOT IN (SELECT id FROM concepts)")
def jn_03_dangling_supersedes(spark, sf_dir):
    """All concepts; every seventh supersedes one that isn't there too."""
    i = F.expr("cast(substr(id, 5) as bigint)")
    more = F.when(i % 7 == 0, F.array(F.concat(F.lit("gone-"), (i % 50).cast("string")))).otherwise(F.array().cast("array<string>"))
    return temporal.dangling(corpus.concepts(spark, sf_dir).withColumn("supersedes", F.concat(F.coalesce("supersedes", F.array().cast("array<string>")), more)))


@query(f"WITH {corpus.SQL} SELECT tier, count(*) AS n, CASE tier WHEN 'human-reviewed' THEN 'high' WHEN 'machine-confirmed' THEN 'medium' ELSE 'low' END AS bucket FROM concepts GROUP BY tier")
def fn_08_trust_tiers(spark, sf_dir):
    c = corpus.concepts(spark, sf_dir).select(T.trust_tier("verified").alias("tier"))
    return c.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).select("tier", "n", T.trust_bucket("tier").alias("bucket"))


STAMPS_SQL = "s AS (SELECT doc_id, printf('%04d-%02d-%02d', 2000 + doc_id % 40, doc_id % 14, doc_id % 33) || ['', 'T10:20:30Z', 'T10:20:30+02:00', ' 10:20', 'x', 'T23:59:59.123456Z', ' '][doc_id % 7 + 1] AS v FROM documents)"


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, v: a date of each document, some of which there aren't, in seven forms of which one is none."""
    i = F.col("doc_id")
    ends = F.array(*[F.lit(x) for x in ("", "T10:20:30Z", "T10:20:30+02:00", " 10:20", "x", "T23:59:59.123456Z", " ")])
    return corpus.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.format_string("%04d-%02d-%02d", 2000 + i % 40, i % 14, i % 33), F.get(ends, (i % 7).cast("int"))).alias("v"))


@query(
    f"WITH {STAMPS_SQL} " + r"""SELECT doc_id, v, CAST(epoch_us(try_cast(CASE WHEN regexp_matches(trim(v), '^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$') THEN regexp_replace(regexp_replace(trim(v), 'Z$', '+00'), '^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})$', '\1 \2:00') END AS TIMESTAMPTZ)) AS BIGINT) AS micros FROM s"""
)
def fn_10_parse_temporal(spark, sf_dir):
    return stamps(spark, sf_dir).select("doc_id", "v", F.unix_micros(T.parse_temporal("v")).alias("micros"))


@query(
    f"WITH {STAMPS_SQL}, d AS (SELECT doc_id, v, try_cast(trim(v) AS DATE) AS day, regexp_matches(trim(v), '^.{{10}}$') AS date_only FROM s) "
    "SELECT doc_id, date_only, CASE WHEN date_only THEN day + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND ELSE try_cast(left(v, 10) AS DATE) + CASE doc_id % 7 WHEN 1 THEN INTERVAL 37230 SECOND WHEN 2 THEN INTERVAL 30030 SECOND WHEN 3 THEN INTERVAL 37200 SECOND WHEN 5 THEN INTERVAL 86399123456 MICROSECOND END END AS until FROM d"
)
def fn_11_window_end(spark, sf_dir):
    return stamps(spark, sf_dir).select("doc_id", T.is_date_only("v").alias("date_only"), T.window_end("v").cast("timestamp_ntz").alias("until"))


@query(f"WITH {corpus.SQL} SELECT id, type, tier FROM concepts WHERE contains(lower(type), 'd 1') AND contains(lower(body), 'hation') AND tier = 'machine-confirmed' ORDER BY id LIMIT 5 OFFSET 5")
def flt_04_listing_page(spark, sf_dir):
    c = search.filter_listing(corpus.concepts(spark, sf_dir), "D 1", "Hation", "medium")
    return search.page(c.select("id", "type", T.trust_tier("verified").alias("tier")), 2, 5)


@query(f"WITH {corpus.SQL} SELECT id, CASE WHEN trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'untitled' ELSE trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') END AS slug, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS norm FROM concepts")
def fn_06_slugs_and_titles(spark, sf_dir):
    return corpus.concepts(spark, sf_dir).select("id", X.slugify("title").alias("slug"), X.normalize_title("title").alias("norm"))


@query(
    r"""WITH f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '`|\*\*|__', '', 'g'), '^[#>*\-+ ]+', '')) AS flat FROM documents),
    g AS (SELECT doc_id, flat, CASE WHEN length(trim(regexp_extract(flat, '[^.!?]+[.!?]+', 0))) < 20 THEN flat ELSE trim(regexp_extract(flat, '[^.!?]+[.!?]+', 0)) END AS best FROM f)
    SELECT doc_id, CASE WHEN flat = '' THEN 'Draft concept extracted without LLM; needs review' WHEN length(best) <= 200 THEN best ELSE (CASE WHEN regexp_replace(regexp_replace(substr(best, 1, 200), ' [^ ]*$', ''), '[,;:]+$', '') = '' THEN trim(substr(best, 1, 200)) ELSE regexp_replace(regexp_replace(substr(best, 1, 200), ' [^ ]*$', ''), '[,;:]+$', '') END) || '…' END AS description FROM g"""
)
def fn_21_descriptions(spark, sf_dir):
    return corpus.read(spark, sf_dir, "documents").select("doc_id", X.describe("text").alias("description"))


@query(
    "SELECT doc_id, md5(CASE WHEN length(text) <= 3000 THEN text ELSE regexp_replace(CASE WHEN regexp_replace(substr(text, 1, 3000), '\\n[^\\n]*$', '') = '' THEN substr(text, 1, 3000) ELSE regexp_replace(substr(text, 1, 3000), '\\n[^\\n]*$', '') END, '\\s+$', '') || chr(10) || chr(10) || '[... truncated: section body exceeds no-LLM limit ...]' END) AS digest FROM documents"
)
def fn_22_truncate(spark, sf_dir):
    return corpus.read(spark, sf_dir, "documents").select("doc_id", F.md5(X.truncate("text", 3000)).alias("digest"))


@query("SELECT doc_id, CAST(ceil(len(string_split(text, chr(10))) / 5.0) AS BIGINT) AS chunks, sha256(text) AS digest FROM documents")
def fn_33_chunks(spark, sf_dir):
    return corpus.read(spark, sf_dir, "documents").select("doc_id", F.size(X.chunks("text", 5)).cast("long").alias("chunks"), F.sha2("text", 256).alias("digest"))


@query(r"SELECT doc_id, trim(substr(trim(list_extract(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')), 1)), 1, 60)) AS snip FROM documents")
def fn_32_snippets(spark, sf_dir):
    return corpus.read(spark, sf_dir, "documents").select("doc_id", F.trim(X.snippet("text", 60)).alias("snip"))
