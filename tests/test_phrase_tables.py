"""Queries with phrases and exclusions as a table, against the search of one query at a time."""

import random
from collections import Counter

import pytest

from lorekeep import schema as S
from lorekeep.operators import search

QUERIES = [
    "graph", '"knowledge graph"', '"graph graph"', 'node "a graph of nodes" -edge', '"knowledge graph" "edges running"', "-graph node", '"unclosed graph edges', 'graph "" node', "", "the of", '-"node edge" graph', "unknownword graph",
    '"running edges" -nodes', "graph -graph", '"graph graph graph"', None, '"edge, node!"  running',
]


@pytest.fixture(scope="module")
def concepts(spark):
    rng = random.Random(3)
    words = ["graph", "graphs", "node", "nodes", "edge", "edges", "knowledge", "running", "the", "of", "Übung"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(f"c{k}", "T", text(rng.randrange(4)) if k % 5 else None, text(2), ["graph"] if k % 3 == 0 else None, text(rng.choice([0, 3, 30])) if k % 7 else None, *[None] * 11) for k in range(60)]
    return spark.createDataFrame(rows, S.CONCEPT)


def test_a_table_of_queries_finds_what_single_ones_find(spark, concepts):
    index = search.build_index(concepts, places=True)
    table = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, text string")
    got = {(r.query_id, r.id): round(r.score, 9) for r in search.score_queries(index, table).collect()}
    want = {(k, r.id): round(r.score, 9) for k, q in enumerate(QUERIES) for r in search.score(concepts, q).collect()}
    assert got == want and len({k for k, _ in got}) > 8
    parsed = {r.query_id: r for r in search.parse_queries(table).collect()}
    for k, q in enumerate(QUERIES):
        one = search.parse_query(q)
        assert (parsed[k].terms, parsed[k].phrases, parsed[k].excluded) == (one.terms, one.phrases, one.excluded)


def test_postings_are_the_counts_of_the_weighted_stream(spark, concepts):
    want = Counter()
    for r in concepts.collect():
        for name, weight in S.FIELD_WEIGHTS:
            value = " ".join(r.tags or []) if name == "tags" else r[name] or ""
            for t in search.stems(value):
                want[r.id, t] += weight
    assert {(r.id, r.token): r.tf for r in search.postings(concepts).collect()} == dict(want)
    rows, terms, corpus = search.build_index(concepts, places=True)
    assert {(r.id, r.token): r.tf for r in rows.collect()} == dict(want) and all(len(r.at) == r.tf and len(set(r.at)) == r.tf for r in rows.collect())
    assert {r.token: r.df for r in terms.collect()} == dict(Counter(t for _, t in want)) and corpus.first().total_len == sum(want.values())


def test_an_empty_bundle_has_an_empty_index(spark, concepts):
    index = search.build_index(concepts.limit(0), places=True)
    assert index[0].count() == index[1].count() == 0 and index[2].first().avgdl == 0
    assert search.score_queries(index, spark.createDataFrame([(1, '"a graph" x')], "query_id int, text string")).count() == 0


def test_an_index_kept_up_to_date_is_a_new_one(spark, concepts):
    i = "cast(substr(id, 2) as int)"
    changed = concepts.filter(f"{i} % 4 = 1").selectExpr("id", "type", "upper(title) as title", "description", "tags", "concat(coalesce(body, ''), ' fresh words of graphs') as body")
    base = concepts.select("id", "type", "title", "description", "tags", "body")
    added = base.filter(f"{i} % 4 = 0")
    index = search.build_index(base.filter(f"{i} % 4 <> 0"), places=True)
    gone = base.filter(f"{i} % 4 in (1, 2)").select("id")
    got = search.compact(search.update_index(index, changed.unionByName(added), gone, places=True))
    want = search.build_index(base.filter(f"{i} % 4 in (0, 3)").unionByName(changed), places=True)
    facts = lambda x: ({(r.id, r.token): (r.dl, r.tf, r.at) for r in x[0].collect()}, {r.token: (r.df, r.cf, r.n_docs, round(r.idf, 9)) for r in x[1].collect()}, [(r.n_docs, r.total_len, round(r.avgdl, 9)) for r in x[2].collect()])
    assert facts(got) == facts(want)
    table = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, text string")
    hits = lambda x: {(r.query_id, r.id): round(r.score, 9) for r in search.score_queries(x, table).collect()}
    assert hits(got) == hits(want)
    none = search.update_index(got, base.limit(0), base.filter(f"{i} % 4 <> 2").select("id"), places=True)
    assert none[0].count() == none[1].count() == 0 and none[2].first().n_docs == 0
