import itertools
import random

import pytest
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.operators import entity, evaluate, governance, links, search, sections, sync, temporal


def concepts(spark, rows):
    """rows: dicts of concept fields; what is missing is null."""
    names = [c.split()[0] for c in S.CONCEPT.replace("array<struct<by string,at string>>", "x").split(", ")]
    names = spark.createDataFrame([], S.CONCEPT).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], S.CONCEPT)


WORDS = [
    {"id": "alpha", "title": "Knowledge graph", "body": "commonword about bundles"}, {"id": "beta", "title": "Other", "body": "commonword knowledge graph inside"},
    {"id": "epsilon", "title": "Gaps", "body": "commonword graph first and then far away knowledge"}, {"id": "zeta", "title": "Last", "body": "commonword zyxwvterm"},
]


def test_search_ranks_titles_first_and_finds_phrases(spark):
    c = concepts(spark, WORDS)
    ids = lambda q, k=10: [r.id for r in search.top_k(search.score(c, q), k).orderBy("rank").collect()]
    assert ids("knowledge graph")[0] == "alpha"
    assert set(ids('"knowledge graph"')) == {"alpha", "beta"}
    assert ids("zyxwvterm") == ["zeta"] and ids("commonword -zyxwvterm -inside") == ["alpha", "epsilon"]
    assert ids("the") == [] and ids("commonword", 0) == []
    index = search.build_index(c)
    both = search.score_with_index(index, spark.createDataFrame([("q", "knowledg"), ("q", "knowledge"), ("q", "graph")], "query_id string, token string"))
    direct = {r.id: r.score for r in search.score(c, "knowledge graph").collect()}
    assert {r.id: pytest.approx(r.score) for r in both.collect()} == direct


def test_filters_come_before_the_limit(spark):
    c = concepts(spark, [{"id": "notes/a", "type": "Note", "body": "refund " * 10}, {"id": "guides/b", "type": "Guide", "body": "refund", "verified": [("human:x", None)]}])
    st = temporal.statuses(c, F.lit("2026-01-01").cast("timestamp"))
    assert [r.id for r in search.partition_rank(search.score(c, "refund"), c, st, 1).collect()] == ["notes/a"]
    assert [r.id for r in search.partition_rank(search.score(c, "refund"), c, st, 1, type_filter="GUIDE").collect()] == ["guides/b"]


def heads(spark, rows, at):
    c = concepts(spark, rows)
    return {r.id: r.head for r in temporal.resolve_heads(c, F.lit(at).cast("timestamp")).collect()}


def test_chains_windows_and_precedence(spark):
    rows = [{"id": "a"}, {"id": "b", "supersedes": ["a"]}, {"id": "c", "supersedes": ["b"], "valid_from": "2026-01-01"}]
    assert heads(spark, rows, "2026-06-01") == {"a": "c", "b": "c", "c": "c"}
    assert heads(spark, rows, "2025-06-01")["a"] == "b"
    old = [{"id": "a", "valid_until": "2025-01-01"}, {"id": "b", "supersedes": ["a"]}]
    st = {r.id: r.status for r in temporal.statuses(concepts(spark, old), F.lit("2026-01-01").cast("timestamp")).collect()}
    assert st == {"a": "expired", "b": "current"}


def test_heads_are_the_deepest_valid_on_any_path(spark):
    rng = random.Random(8)
    rows = [{"id": f"n{i}", "supersedes": [f"n{j}" for j in range(i) if rng.random() < 0.4] or None, "valid_from": "2030-01-01" if rng.random() < 0.3 else None} for i in range(9)]
    above = {r["id"]: [s["id"] for s in rows if r["id"] in (s["supersedes"] or [])] for r in rows}
    valid = {r["id"] for r in rows if not r["valid_from"]}

    def best(n, depth=0):
        found = [(-depth, n)] if n in valid else []
        return found + list(itertools.chain.from_iterable(best(m, depth + 1) for m in above[n]))

    assert heads(spark, rows, "2026-01-01") == {n: min(best(n))[1] if best(n) else n for n in above}


def test_cycles_end(spark):
    rows = [{"id": "a", "supersedes": ["b"]}, {"id": "b", "supersedes": ["a"]}, {"id": "s", "supersedes": ["s"]}, {"id": "lonely"}]
    assert sorted(r.cycle for r in temporal.cycles(concepts(spark, rows)).collect()) == [["a", "b"], ["s"]]
    c = concepts(spark, rows)
    assert set(r.head for r in temporal.resolve_heads(c, F.lit("2026-01-01").cast("timestamp"), max_rounds=3).collect()) <= {"a", "b", "s", "lonely"}


def test_links_resolve_to_primary_sections_and_directories_shadow(spark):
    c = concepts(spark, [{"id": "alpha/guide", "body": "[Beta](beta.md) [dir](../foo/) [bare](../foo) [out](../../../x) [idx](../index)"}, {"id": "beta/beta"}, {"id": "beta/beta-appendix"}, {"id": "foo"}, {"id": "foo/bar"}])
    got = {(r.target, r.kind, r.concept_id) for r in links.resolve(links.graph_links(c), c).collect()}
    assert got == {("beta.md", "ok", "beta/beta"), ("../foo/", "dir", None), ("../foo", "dir", None), ("../../../x", "dead", None), ("../index", "dead", None)}


def test_traverse_levels(spark):
    c = spark.createDataFrame([("a", "[b](b) [c](c)"), ("b", "[a](a)"), ("c", "")], "id string, body string")
    st = c.select("id", F.lit("current").alias("status"))
    for depth in (1, 3):
        assert {(r.level, r.id) for r in links.traverse(links.raw_links(c), st, "a", depth).collect()} == {(1, "b"), (1, "c")}
    assert links.mermaid(c.select("id", F.col("id").alias("title"), F.lit("current").alias("temporal_status"), F.lit(None).cast("string").alias("superseded_by")), spark.createDataFrame([("a", "b")], "from string, to string"))[-1] == "    n_a --> n_b"


def test_sync_plan(spark):
    now = spark.createDataFrame([("added", "n"), ("changed", "v2"), ("to", "r"), ("same", "s"), ("y", "s1"), ("z", "s1")], "path string, sha256 string")
    old = spark.createDataFrame([("changed", "v1", ["k"]), ("from", "r", ["m"]), ("same", "s", []), ("gone", "g", ["k"]), ("x", "s1", [])], "path string, sha256 string, concepts array<string>")
    plan = sync.plan(now, old)
    got = {r.path: (r.change, r.old_path) for r in plan.collect()}
    assert got == {"added": ("added", None), "changed": ("updated", None), "to": ("renamed", "from"), "same": ("unchanged", None), "gone": ("removed", None), "y": ("renamed", "x"), "z": ("added", None)}
    assert sync.deletable(plan, old).count() == 0  # k is shared with a file that stays
    nxt = {r.path: r.sha256 for r in sync.apply(plan, old, spark.createDataFrame([("added", ["q"])], "path string, concepts array<string>")).collect()}
    assert nxt["changed"] == "v1" and nxt["added"] == "n" and "gone" not in nxt


def test_sections_fences_and_levels(spark):
    text = "intro line\n# One #\nbody\n```\n# not a heading\n```\n### Deep\n"
    got = sections.sections(spark.createDataFrame([("d", 1, text)], "doc_id string, number int, text string")).orderBy("section_no").collect()
    assert [(r.title, r.level, r.text) for r in got] == [("intro line", 0, "intro line"), ("One", 1, "body\n```\n# not a heading\n```"), ("Deep", 3, "")]
    assert got[0].too_small
    drafts = sections.draft(spark.createDataFrame([("d", 1, text)], "doc_id string, number int, text string"), spark.createDataFrame([("d", "x/My File.md")], "doc_id string, path string"), spark.createDataFrame([("my-file/one",)], "id string"), 1)
    assert sorted(r.id for r in drafts.collect()) == ["my-file/intro-line", "my-file/one-2"]


def test_entity_match_order(spark):
    old = concepts(spark, [{"id": "a", "title": "Refund policy for shops", "resource": "r"}, {"id": "b", "title": "Refund policy"}, {"id": "c", "title": "Completely other thing here now"}])
    new = concepts(spark, [{"id": "n1", "title": "refund POLICY", "resource": "r"}, {"id": "n2", "title": "other things here now completely"}, {"id": "n3", "title": "vector only"}])
    va, vb = spark.createDataFrame([("n3", [1.0, 0.0])], "id string, embedding array<double>"), spark.createDataFrame([("b", [0.9, 0.4359])], "id string, embedding array<double>")
    got = {r.id: (r.match, r.reason) for r in entity.match(new, old, va, vb).collect()}
    assert got == {"n1": ("a", "title"), "n2": ("c", "similar_title"), "n3": ("b", "embedding")}


def test_evaluation_runs(spark):
    c = concepts(spark, [{"id": "policies/refunds", "title": "Refunds", "description": "Refunds take five days.", "body": "x"}, {"id": "policies/shipping", "title": "Shipping", "body": "Parcels ship daily."}])
    golden = spark.createDataFrame([("q", "refunds days", "Refunds take five days", ["policies/refunds"])], "id string, question string, expected_answer string, must_cite array<string>")
    r = evaluate.evaluate(golden, c, search.build_index(c)).first()
    assert r.passed and r.diagnosis == "ok" and r.retrieved == ["policies/refunds"] and r.reference_support == 1.0
    assert evaluate.report(evaluate.evaluate(golden, c, search.build_index(c))).first().gate == "pass"


def test_evaluation_takes_apart_what_was_found_only(spark):
    """Texts of concepts that no question found are not cut into tokens, and each task ranks its own rows first."""
    c = concepts(spark, [{"id": f"c{k}", "title": "Refunds" if k < 9 else "Parcels", "body": f"word{k}"} for k in range(30)])
    golden = spark.createDataFrame([("q", "refunds word3", "Refunds", None)], "id string, question string, expected_answer string, must_cite array<string>")
    index = search.build_index(c)
    got = evaluate.evaluate(golden, c, index, 3)
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in evaluate.retrieve(golden, c, index, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert got.first().retrieved == ["c3", "c0", "c1"]


def test_drafts_cut_sections_once(spark):
    """What the ids and the rows are made of is written once, so documents are not cut again for each."""
    text = "intro\n# One\nbody one\n# One\nbody two\n"
    got = sections.draft(spark.createDataFrame([("d", 1, text)], "doc_id string, number int, text string"), spark.createDataFrame([("d", "F.md")], "doc_id string, path string"), spark.createDataFrame([], "id string"), 1)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.body, r.displaced) for r in got.collect()) == [("f/intro", "intro", None), ("f/one", "body one", None), ("f/one-2", "body two", "f/one")]


def test_governed_writes(spark, tmp_path):
    store = governance.Store(spark, str(tmp_path / "bundle"))
    assert store.read().count() == 0
    first = concepts(spark, [{"id": "a", "title": "A", "verified": [("human:x", None)]}])
    none = spark.createDataFrame([], S.FINDING)
    ok = governance.governed_update(store, lambda c: governance.upsert(c, first), "me", "write", "a", lambda c: none)
    assert ok["written"] and store.read().count() == 1
    assert not governance.governed_update(store, lambda c: c, "me", "write", "a", lambda c: none)["written"]
    bad = lambda c: c.filter("title is null").select(F.lit("error").alias("severity"), F.lit(0).alias("rule_seq"), F.lit("E").alias("code"), F.col("id").alias("file"), F.lit("m").alias("message"))
    refused = governance.governed_update(store, lambda c: governance.downgrade(c, "a", title=None), "me", "update", "a", bad)
    assert refused["reason"] == "validation" and store.read().first().title == "A"
    assert governance.governed_update(store, lambda c: governance.downgrade(c, "a", title="B"), "me", "update", "a", bad)["written"]
    row = store.read().first()
    assert row.title == "B" and row.verified is None
    assert spark.read.json(f"{store.root}/_audit").count() == 2


def test_paging_edges(spark):
    units = spark.createDataFrame([(i, "x" * 40) for i in range(5)], "pos long, text string")
    assert governance.paged(units, 0, 10, 1).count() == 1
    assert governance.paged(units, 0, 10, 0).count() == 0
    assert governance.paged(units, 3, 1).first().remaining == 1
    with pytest.raises(ValueError):
        governance.paged(units, 6)


def test_a_judge_with_token_scores_behind_it(spark):
    c = concepts(spark, WORDS)
    golden = spark.createDataFrame([("q1", "knowledge graph?", "a knowledge graph", None), ("q2", "zyxwvterm", "", None), ("q3", "nothing here", "", None)], "id string, question string, expected_answer string, must_cite array<string>")
    plain = {r.qid: r for r in evaluate.evaluate(golden, c, search.build_index(c)).collect()}

    def judge(prompts):
        odd = {"Which of these": '{"relevant": ["alpha", "x"]}', "from 0 to 1": '{"score": 7}'}
        return [next((a for k, a in odd.items() if k in p), '{"claims": [{"supported": true}, {"supported": false}]}' if "alpha" in p else "[]") for p in prompts]

    got = {r.qid: r for r in evaluate.evaluate(golden, c, search.build_index(c), judge=judge).collect()}
    assert got["q1"].context_relevancy == pytest.approx(1 / len(got["q1"].retrieved)) and got["q1"].faithfulness == 0.5 and got["q1"].answer_relevancy == 1.0
    assert got["q2"].faithfulness == plain["q2"].faithfulness and got["q2"].methods.faithfulness == "tokens" and got["q2"].methods.context_relevancy == "judge" and got["q2"].context_relevancy == 0
    assert got["q3"].retrieved == [] and got["q3"].methods.context_relevancy == "tokens" and got["q3"].context_relevancy == 0 and got["q3"].answer_relevancy == 1.0
    broken = {r.qid: r for r in evaluate.evaluate(golden, c, search.build_index(c), judge=lambda p: ["{"] * len(p)).collect()}
    assert all(broken[q][m] == plain[q][m] for q in plain for m in evaluate.JUDGED)
