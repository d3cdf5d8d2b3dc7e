"""BM25 search over concepts: index tables, scoring, phrases, exclusions, facets, temporal partitions.

An index is three tables: postings (id, dl, token, tf and, for phrases, places), terms (token, df, cf, idf) and corpus statistics. Document frequencies count
every document, also those that a query's filters leave out. Everything is joins on tokens and partial
aggregates; only a query's few terms are literals, and only the top k leave the cluster.
"""

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.functions import temporal as T
from lorekeep.functions import text as X
from lorekeep.work import Workspace, slices, small


WORD, STOPPED = re.compile(r"[^\W_]+"), frozenset(S.STOPWORDS)


@dataclass
class Query:
    terms: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)

    @property
    def wanted(self) -> list[str]:
        """Every term that scores, each once, in order."""
        return list(dict.fromkeys([*self.terms, *(t for p in self.phrases for t in p)]))


def stem_word(w: str) -> str:
    """The stem rules for one word on the driver, for query texts."""
    if len(w) <= 2 or w.endswith("ss") and not w.endswith("sses"):
        return w
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return f"{w[:-3]}i" if len(w) > 4 else w[:-1]
    if len(w) > 3 and w[-1] == "s" and w[-2] not in "su":
        w = w[:-1]
    ending = next((e for e, least in (("ing", 6), ("ed", 5)) if w.endswith(e) and len(w) >= least), "")
    base = w.removesuffix(ending)
    if not ending or len(base) < 3:
        return w
    return base[:-1] if base[-1] == base[-2] and base[-1] not in "lsz" else base


def stems(text: str) -> list[str]:
    import re

    words = re.findall(r"[^\W_]+", text.lower())
    return [stem_word(w) for w in words if w not in S.STOPWORDS]


def parse_query(text: str) -> Query:
    """Quotes make phrases (an open one runs to the end), a leading minus excludes; the rest are terms."""
    import re

    out = Query()
    for i, part in enumerate((text or "").split('"')):
        if i % 2:
            if found := stems(part):
                out.phrases.append(found)
            continue
        for word in re.split(r"\s+", part.strip()):
            (out.excluded if word.startswith("-") else out.terms).extend(stems(word.removeprefix("-")))
    return out


def words_of(stem: str) -> list[str]:
    """Every word that has this stem: stemming takes away at most a plural, an ending and a doubled letter, so few words can."""
    bases = {stem, stem + stem[-1:], stem[:-1], stem + "e"}
    ends = {x + e for x in bases for e in ("", "ing", "ed")}
    return sorted(w for w in {x + p for x in ends for p in ("", "s", "es", "ies")} if w and stem_word(w) == stem)


def _words(name: str) -> Column:
    return X.words(F.array_join("tags", " ") if name == "tags" else name)


def _holding(phrase: list[str]):
    """A function of a stream of words: whether words of the phrase's stems stand next to each other somewhere in it."""
    at = lambda words: lambda i: reduce(and_, [F.get(words, i + k).isin(words_of(t)) for k, t in enumerate(phrase)])
    return lambda words: F.when(F.size(words) >= len(phrase), F.exists(F.sequence(F.lit(0), F.greatest(F.size(words) - len(phrase), F.lit(0))), at(words))).otherwise(False)


#: Stems of words that a task remembers.
STEMS = 400_000


def _count(texts: list[str], weights: list[int], places: bool, seen: dict) -> tuple[int, dict]:
    """Number of words of a document's stream (each field as often as it weighs), and its tokens with their count or their places."""
    at, found = 0, {}
    for text, weight in zip(texts, weights, strict=True):
        tokens = []
        for w in WORD.findall(text):
            t = seen.get(w)
            if t is None:
                if len(seen) >= STEMS:
                    seen.clear()
                t = seen[w] = "" if w in STOPPED else stem_word(w)
            if t:
                tokens.append(t)
        if places:
            for _ in range(weight):
                for t in tokens:
                    found.setdefault(t, []).append(at)
                    at += 1
        else:
            for t, n in Counter(tokens).items():
                found[t] = found.get(t, 0) + n * weight
            at += len(tokens) * weight
    return at, found


def documents(concepts: DataFrame, fields=S.FIELD_WEIGHTS, keys: tuple[str, ...] = ("id",), places: bool = False) -> DataFrame:
    """keys, dl, terms (token, tf[, at]) of each document, counted in Arrow batches: occurrences never become rows. Stop words go before stemming."""
    n, weights = len(keys), [w for _, w in fields]

    def run(batches):
        seen: dict[str, str] = {}
        for batch in slices(batches):
            lengths, cuts, tokens, tf, spots, ends = [], [0], [], [], [], [0]
            for texts in zip(*[c.to_pylist() for c in batch.columns[n:]], strict=True):
                dl, found = _count(texts, weights, places, seen)
                lengths.append(dl)
                tokens += found
                if places:
                    for at in found.values():
                        tf.append(len(at))
                        spots += at
                        ends.append(len(spots))
                else:
                    tf += found.values()
                cuts.append(len(tokens))
            parts = {"token": pa.array(tokens, pa.string()), "tf": pa.array(tf, pa.int64())}
            if places:
                parts["at"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(spots, pa.int32()))
            terms = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(list(parts.values()), list(parts)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(lengths, pa.int64()), terms], [*keys, "dl", "terms"])

    lowered = [F.lower(F.coalesce(F.array_join("tags", " ") if name == "tags" else F.col(name), F.lit(""))).alias(f"f{k}") for k, (name, _) in enumerate(fields)]
    kinds = dict(concepts.dtypes)
    shape = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "dl bigint", f"terms array<struct<token:string,tf:bigint{',at:array<int>' if places else ''}>>"])
    return concepts.select(*keys, *lowered).mapInArrow(run, shape)


def postings(concepts: DataFrame, fields=S.FIELD_WEIGHTS, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, token, tf: weighted counts of each document's stems."""
    return documents(concepts, fields, keys).select(*keys, F.explode("terms").alias("t")).select(*keys, "t.token", "t.tf")


def build_index(concepts: DataFrame, fields=S.FIELD_WEIGHTS, bundle: str | None = None, places: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings with dl, term statistics, corpus statistics), written once to work tables; with `bundle`, statistics are kept for each bundle.

    With `places` postings hold where a token stands in its document's stream (at), for phrases.
    """
    ws = Workspace(concepts.sparkSession, "index")
    by = [bundle] if bundle else []
    docs = ws.keep(documents(concepts, fields, tuple([*by, "id"]), places), "documents")
    rows = docs.select(*by, "id", "dl", F.explode("terms").alias("t")).select(*by, "id", "dl", "t.*")
    corpus = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("total_len")).withColumn("avgdl", F.coalesce(F.try_divide("total_len", "n_docs"), F.lit(0.0)))
    corpus = ws.keep(corpus, "corpus")
    terms = rows.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    terms = terms.join(small(corpus.select(*by, "n_docs")), by) if by else terms.crossJoin(F.broadcast(corpus.select("n_docs")))
    terms = terms.withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return rows, ws.keep(terms, "terms"), corpus


def update_index(index: tuple[DataFrame, DataFrame, DataFrame], new: DataFrame, gone: DataFrame, fields=S.FIELD_WEIGHTS, places: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index after a sync: new are concepts that were added or changed, gone the ids (once each) of those that were there and were changed or removed.

    Only new texts are read. Postings are the old ones without the gone ids and the new ones; term and corpus statistics are changed by the
    difference, a term that no document has any more goes. compact() writes the postings anew when enough such layers lie on them.
    """
    rows, terms, corpus = index
    ws = Workspace(new.sparkSession, "index-delta")
    fresh = ws.keep(documents(new, fields, ("id",), places), "documents")
    added = fresh.select("id", "dl", F.explode("terms").alias("t")).select("id", "dl", "t.*")
    left = ws.keep(rows.join(small(gone.select("id")), "id", "left_semi").select("id", "dl", "token", "tf"), "left")
    moved = added.select("token", F.lit(1).alias("d"), "tf").union(left.select("token", F.lit(-1), -F.col("tf")))
    change = moved.groupBy("token").agg(F.sum("d").alias("d_df"), F.sum("tf").alias("d_cf"))
    old = corpus.first()  # one row
    n_docs = (old["n_docs"] or 0) - gone.count() + fresh.count()
    was = left.groupBy("id").agg(F.first("dl").alias("dl")).agg(F.sum("dl")).first()[0] or 0
    total = (old["total_len"] or 0) - was + (fresh.agg(F.sum("dl")).first()[0] or 0)
    spark = new.sparkSession
    sizes = spark.createDataFrame([(n_docs, total, total / n_docs if n_docs else 0.0)], "n_docs long, total_len long, avgdl double")
    both = terms.select("token", "df", "cf").join(small(change), "token", "full_outer")
    merged = both.select("token", (F.coalesce("df", F.lit(0)) + F.coalesce("d_df", F.lit(0))).alias("df"), (F.coalesce("cf", F.lit(0)) + F.coalesce("d_cf", F.lit(0))).alias("cf")).filter("df > 0")
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    merged = ws.keep(merged.select("token", "df", "cf", F.lit(n_docs).cast("long").alias("n_docs"), idf.alias("idf")), "terms")
    return rows.join(small(gone.select("id")), "id", "left_anti").select(*added.columns).union(added), merged, sizes


def compact(index: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same index with its postings written in one table."""
    rows, terms, corpus = index
    return Workspace(rows.sparkSession, "index-compact").keep(rows, "postings"), terms, corpus


def bm25(tf: Column, dl: Column, avgdl: Column, idf: Column) -> Column:
    return idf * (tf * (S.BM25_K1 + 1)) / (tf + S.BM25_K1 * (1 - S.BM25_B + S.BM25_B * dl / avgdl))


def score(concepts: DataFrame, query: str | Query | None, fields=S.FIELD_WEIGHTS, bundle: str | None = None) -> DataFrame:
    """[bundle,] id, score of every match, unordered: one pass over the texts, one slim row a document.

    Texts aren't stemmed: a document's length is its number of words, and a term's frequency the number of words among
    the few that have the term as their stem. Only lengths and frequencies are kept, in a work table, which serves both the statistics and the scores.
    """
    q = query if isinstance(query, Query) else parse_query(query)
    by = [bundle] if bundle else []
    wanted = q.wanted
    if not wanted:
        return concepts.select(*by, "id", F.lit(0.0).alias("score")).limit(0)
    is_in = lambda term: lambda w: w.isin(words_of(term))

    def measured(streams: Column) -> Column:
        parts = [(F.get(streams, F.lit(i)), weight) for i, (_, weight) in enumerate(fields)]
        total = lambda f: sum(((f(s) * w) for s, w in parts[1:]), f(parts[0][0]) * parts[0][1])
        some = lambda term: reduce(or_, [F.exists(s, is_in(term)) for s, _ in parts])
        keep = F.lit(True)
        for t in q.excluded:
            keep &= ~some(t)
        if q.phrases:
            whole = F.concat(*[F.flatten(F.array_repeat(s, w)) for s, w in parts])
            for p in q.phrases:
                # only a document that has all words of a phrase is looked through for it
                keep &= reduce(and_, [some(t) for t in dict.fromkeys(p)]) & X.let(whole, _holding(p))
        tf = [total(lambda s, t=t: F.size(F.filter(s, is_in(t)))).alias(f"tf{i}") for i, t in enumerate(wanted)]
        return F.struct(total(F.size).alias("dl"), *tf, keep.alias("keep"))

    # bound to a lambda's variable, so that the streams are made once however often they are looked at
    rows = concepts.select(*by, "id", F.transform(F.array(F.array(*[_words(n) for n, _ in fields])), measured)[0].alias("m")).select(*by, "id", "m.*")
    rows = Workspace(concepts.sparkSession, "score").keep(rows, "rows")
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(wanted))])
    hits = rows.filter(reduce(or_, [F.col(f"tf{i}") > 0 for i in range(len(wanted))]) & F.col("keep"))
    joined = hits.join(small(stats), by) if by else hits.crossJoin(F.broadcast(stats))  # one row without bundles
    score_ = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score_ = score_ + F.when(tf > 0, bm25(tf, F.col("dl"), F.col("avgdl"), idf)).otherwise(0.0)
    return joined.select(*by, "id", score_.alias("score"))


def score_with_index(index: tuple[DataFrame, DataFrame, DataFrame], terms: DataFrame) -> DataFrame:
    """query_id, id, score for a table of queries (query_id, token) against a built index: token equi-joins of the wanted tokens' postings."""
    rows, stats, corpus = index
    wanted = terms.select("query_id", "token").distinct()
    known = stats.select("token", "idf").join(small(wanted.select("token").distinct()), "token", "left_semi")
    hits = rows.select("id", "dl", "token", "tf").join(small(wanted.join(known, "token")), "token").crossJoin(F.broadcast(corpus.select("avgdl")))  # one row
    return hits.groupBy("query_id", "id").agg(F.sum(bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"))).alias("score"))


def parse_queries(queries: DataFrame) -> DataFrame:
    """query_id, terms, phrases, excluded of queries (query_id, text), by the rules of parse_query()."""
    parts = F.split(F.coalesce("text", F.lit("")), '"', -1)
    inside = F.filter(F.transform(F.filter(parts, lambda p, i: i % 2 == 1), X.tokens), lambda p: F.size(p) > 0)
    outside = F.flatten(F.transform(F.filter(parts, lambda p, i: i % 2 == 0), lambda p: F.split(X.strip(p), X.SPACE)))
    of = lambda minus: F.flatten(F.transform(F.filter(outside, lambda w: w.startswith("-") == F.lit(minus)), lambda w: X.tokens(F.regexp_replace(w, "^-", ""))))
    return queries.select("query_id", of(False).alias("terms"), inside.alias("phrases"), of(True).alias("excluded"))


def score_queries(index: tuple[DataFrame, DataFrame, DataFrame], queries: DataFrame) -> DataFrame:
    """query_id, id, score of queries with phrases and exclusions (query_id, text) against an index with places: no text is read again.

    A phrase is found by intersection: the places of its tokens, each less the token's own place in the phrase, have one in
    common. A document must have every phrase of a query and no excluded token; those that have one are taken out by an anti-join.
    """
    rows = index[0]
    ws = Workspace(rows.sparkSession, "queries")
    parsed = ws.keep(parse_queries(queries), "parsed")
    wanted = parsed.select("query_id", F.explode(F.array_distinct(F.concat("terms", F.flatten("phrases")))).alias("token"))
    scored = score_with_index(index, wanted)
    phrases = parsed.select("query_id", F.posexplode("phrases").alias("phrase", "tokens")).withColumn("n", F.size("tokens"))
    each = phrases.select("query_id", "phrase", "n", F.posexplode("tokens").alias("k", "token"))
    met = rows.select("id", "token", "at").join(small(each), "token")
    shifted = met.select("query_id", "phrase", "n", "id", F.transform("at", lambda x: x - F.col("k")).alias("starts"))
    held = shifted.groupBy("query_id", "phrase", "n", "id").agg(F.collect_list("starts").alias("all"))  # at most a row a token of the phrase
    common = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0)), F.array_intersect)
    found = held.filter((F.size("all") == F.col("n")) & (F.size(common) > 0)).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("found"))
    needs = small(parsed.select("query_id", F.size("phrases").alias("needs")))
    kept = scored.join(needs, "query_id").join(found, ["query_id", "id"], "left").filter(F.coalesce("found", F.lit(0)) == F.col("needs"))
    banned = rows.select("id", "token").join(small(parsed.select("query_id", F.explode(F.array_distinct("excluded")).alias("token"))), "token").select("query_id", "id").distinct()
    return kept.join(banned, ["query_id", "id"], "left_anti").select("query_id", "id", "score")


def rounded(score_column="score") -> Column:
    """Six decimals, the same in any order of summing."""
    return F.floor(F.col(score_column) * 1e6 + 0.5) / 1e6


def top_k(scored: DataFrame, limit: int = 10) -> DataFrame:
    """Best first, ties by id; a limit of 0 or less gives nothing."""
    best = scored.select("id", rounded().alias("score")).orderBy(F.desc("score"), "id").limit(max(0, limit))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def facets(concepts: DataFrame, type_filter: str | None = None, tier_filter: str | None = None) -> DataFrame:
    """Case-insensitive equality on type and derived tier."""
    out = concepts
    if type_filter is not None:
        out = out.filter(F.lower(F.coalesce("type", F.lit(""))) == type_filter.lower())
    if tier_filter is not None:
        out = out.filter(F.lower(T.trust_tier("verified")) == tier_filter.lower())
    return out


def partition_rank(scored: DataFrame, concepts: DataFrame, statuses: DataFrame, limit: int = 10, include_superseded: bool = False, type_filter: str | None = None, tier_filter: str | None = None) -> DataFrame:
    """Hits in the order current, outside their window, superseded; in each by score, tier, recency, id. Filters come before the limit."""
    kept = facets(concepts, type_filter, tier_filter).select("id", T.tier_rank(T.trust_tier("verified")).alias("tier_rank"), T.parse_temporal("last_verified").alias("verified_at"))
    rows = scored.withColumn("score", rounded()).join(kept, "id").join(statuses.select("id", "status", "superseded_by"), "id")
    rows = rows.withColumn("group_rank", F.when(F.col("status") == "current", 0).when(F.col("status") == "superseded", 2).otherwise(1))
    if not include_superseded:
        rows = rows.filter("group_rank < 2")
    order = [F.col("group_rank"), F.desc("score"), F.desc("tier_rank"), F.col("verified_at").desc_nulls_last(), F.col("id")]
    best = rows.orderBy(*order).limit(max(0, limit))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select("rank", "id", "score", "status", "superseded_by", "group_rank")


def superseded_hidden(scored: DataFrame, concepts: DataFrame, statuses: DataFrame, type_filter: str | None = None, tier_filter: str | None = None) -> DataFrame:
    """How many superseded hits pass the filters, before any limit."""
    kept = facets(concepts, type_filter, tier_filter).select("id")
    return scored.join(kept, "id").join(statuses.filter("status = 'superseded'").select("id"), "id").agg(F.count(F.lit(1)).alias("superseded_hidden"))


def merge_bundles(concepts: DataFrame, query: str, per_bundle: int = 10, limit: int = 10) -> DataFrame:
    """Each bundle's best by its own statistics, scores to 4 decimals, then best first over all; ties by bundle and rank."""
    scored = score(concepts, query, bundle="bundle_id").withColumn("score", rounded())
    rank = F.row_number().over(Window.partitionBy("bundle_id").orderBy(F.desc("score"), "id"))
    kept = scored.withColumn("bundle_rank", rank.cast("long")).filter(F.col("bundle_rank") <= per_bundle).withColumn("score", F.floor(F.col("score") * 1e4 + 0.5) / 1e4)
    return kept.orderBy(F.desc("score"), "bundle_id", "bundle_rank").limit(limit)


def substring_rank(concepts: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The plain scorer: each word counts 3 in id or title, 2 in description or tags, 1 in the body."""
    inside = lambda c, w: F.lower(F.coalesce(c, F.lit(""))).contains(w)
    total = F.lit(0)
    for w in query.lower().split():
        total = total + F.when(inside(F.col("id"), w) | inside(F.col("title"), w), 3).otherwise(0)
        total = total + F.when(inside(F.col("description"), w) | inside(F.array_join("tags", " "), w), 2).otherwise(0)
        total = total + F.when(inside(F.col("body"), w), 1).otherwise(0)
    return concepts.select("id", total.cast("long").alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def filter_listing(concepts: DataFrame, type_contains: str | None = None, q: str | None = None, bucket: str | None = None) -> DataFrame:
    """The listing surfaces' filters: type by substring, text in title, id or body, tier by bucket."""
    out = concepts
    if type_contains:
        out = out.filter(F.lower("type").contains(type_contains.lower()))
    if q:
        out = out.filter(F.lower("title").contains(q.lower()) | F.lower("id").contains(q.lower()) | F.lower("body").contains(q.lower()))
    if bucket:
        out = out.filter(T.trust_bucket(T.trust_tier("verified")) == bucket)
    return out


def page(df: DataFrame, number: int, size: int, order: str = "id") -> DataFrame:
    return df.orderBy(order).offset((number - 1) * size).limit(size)


def get_concept(concepts: DataFrame, statuses: DataFrame, concept_id: str) -> DataFrame:
    """id, title, tier, temporal_status, superseded_by of one concept; no row if it isn't there."""
    one = concepts.filter(F.col("id") == concept_id).select("id", F.coalesce("title", "id").alias("title"), T.trust_tier("verified").alias("tier"))
    return one.join(statuses.select("id", F.col("status").alias("temporal_status"), "superseded_by"), "id")


def search_or_fallback(concepts: DataFrame, query: str, limit: int = 10, type_filter: str | None = None, tier_filter: str | None = None) -> DataFrame:
    """id, score: the engine's best that pass the filters; for a query without a term that it takes, the plain scorer's, filtered after the cut."""
    kept = facets(concepts, type_filter, tier_filter).select("id")
    parsed = parse_query(query)
    if parsed.wanted:
        return top_k(score(concepts, parsed).join(kept, "id"), limit).select("id", "score")
    return substring_rank(concepts, query, limit).join(kept, "id").withColumn("score", F.col("score").cast("double"))


def coerce_limit(value, default: int, least: int = 0, most: int | None = None) -> int:
    """A number of results from any input: what isn't a number is the default, and the rest is clamped."""
    try:
        got = int(value)
    except (TypeError, ValueError):
        got = default
    return max(got, least) if most is None else min(max(got, least), most)


def coerce_bool(value) -> bool:
    """True for true, for numbers but 0, and for 1, true, yes, y and on in any case."""
    return value.strip().lower() in ("1", "true", "yes", "y", "on") if isinstance(value, str) else bool(value)
