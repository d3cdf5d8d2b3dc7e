"""Write-back, the sync run, long supersession chains, word forms and small helpers."""

import datetime
import random
from collections import Counter

import pytest

from lorekeep import schema as S
from lorekeep.operators import entity, governance, search, sync, temporal
from lorekeep.sources import frontmatter
from lorekeep.streaming import watch
from lorekeep.work import Workspace, components


def concept(id_, **fields):
    names = [c.split()[0] for c in _columns()]
    return tuple({"id": id_, "type": "Note", "title": id_} .get(n) if n not in fields else fields[n] for n in names)


def _columns():
    out, depth, at = [], 0, 0
    for k, ch in enumerate(S.CONCEPT + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(S.CONCEPT[at:k].strip())
            at = k + 1
    return out


def test_every_word_of_a_stem_is_found():
    rng = random.Random(4)
    words = {"".join(rng.choice("abeils") for _ in range(rng.randint(1, 6))) + rng.choice(["", "s", "es", "ies", "ing", "ings", "ed", "eds", "sses", "nning", "nned", "ll", "lling", "us", "ss"]) for _ in range(4000)}
    by = {}
    for w in words:
        by.setdefault(search.stem_word(w), set()).add(w)
    for stem, found in by.items():
        assert found <= set(search.words_of(stem)), stem


def test_pointer_lock_and_governed_updates(spark, tmp_path):
    store = governance.Store(spark, str(tmp_path / "kb"))
    assert store.read().count() == 0
    store.publish(spark.createDataFrame([concept("a"), concept("b")], S.CONCEPT))
    none = spark.createDataFrame([], S.FINDING)
    set_end = lambda df: governance.downgrade(df, "a", valid_until="2031-01-01")
    run = lambda change: governance.governed_update(store, change, "me", "update", "a", lambda df: none)
    judge = lambda df: df.filter("valid_until is not null").selectExpr("'error' severity", "1 rule_seq", "'E9' code", "id file", "'m' message")
    seen = governance.preview(store, set_end, judge)
    assert seen["changes"] == [("a", "changed")] and [e["file"] for e in seen["errors"]] == ["a"] and store.read().filter("valid_until is not null").count() == 0
    assert run(set_end)["written"] and run(set_end) == {"written": False, "reason": "no change"}  # a window end alone is a change
    assert run(lambda df: entity.mark_reviewed(df, "a", "ann", "2026-01-01T00:00:00Z"))["written"]
    assert store.lock("other") and run(lambda df: df.limit(1)) == {"written": False, "reason": "locked"}
    assert store.locked_for() is not None and not store.lock("third")
    store.unlock()
    assert store.locked_for() is None and store.read().count() == 2
    (tmp_path / "kb" / "_CURRENT").unlink()
    with pytest.raises(FileNotFoundError):
        governance.Store(spark, str(tmp_path / "kb")).read()


def test_one_sync_run(spark, tmp_path):
    store = governance.Store(spark, str(tmp_path / "kb"))
    old = [concept("kept", resource="/k"), concept("gone", resource="/g"), concept("moved", resource="/old"), concept("stale", resource="/u"), concept("skip", resource="/v")]
    store.publish(spark.createDataFrame(old, S.CONCEPT))
    state = spark.createDataFrame([("/k", "1", ["kept"]), ("/g", "2", ["gone"]), ("/old", "3", ["moved"]), ("/u", "4", ["stale"]), ("/v", "5", ["skip"])], "path string, sha256 string, concepts array<string>")
    now = spark.createDataFrame([("/k", "1"), ("/new", "3"), ("/u", "44"), ("/v", "55"), ("/n", "6")], "path string, sha256 string")
    able = spark.createDataFrame([("/u", "create"), ("/v", "too_small"), ("/n", "create")], "path string, status string")

    def ingest(todo):
        paths = sorted(r.path for r in todo.collect())
        fresh = [concept(f"new{p[1:]}", resource=p) for p in paths]
        return spark.createDataFrame(fresh, S.CONCEPT), spark.createDataFrame([(p, [f"new{p[1:]}"]) for p in paths], "path string, concepts array<string>")

    assert store.lock("other") and sync.run_once(store, now, state, ingest, able, "me") == {"ran": False, "reason": "locked"}
    got = sync.run_once(store, now, state, ingest, able, "me", stale_s=-1)  # a stale lock is taken over
    assert got["ran"] and got["changes"] == {"added": 1, "updated": 2, "renamed": 1, "removed": 1, "unchanged": 1}
    assert {(r.id, r.resource) for r in store.read().collect()} == {("kept", "/k"), ("moved", "/new"), ("newu", "/u"), ("skip", "/v"), ("newn", "/n")}
    assert {(r.path, r.sha256, *r.concepts) for r in got["state"].collect()} == {("/k", "1", "kept"), ("/new", "3", "moved"), ("/u", "44", "newu"), ("/v", "5", "skip"), ("/n", "6", "newn")}
    assert store.locked_for() is None


def test_long_chains_and_rings(spark):
    """A chain longer than the rounds, a ring with a tail, and short chains that settle: all as a walk over the whole graph has them."""
    rows = [(f"c{k:03}", [f"c{k - 1:03}"] if k else [], None) for k in range(12)]
    rows += [("r0", ["r2"], None), ("r1", ["r0"], None), ("r2", ["r1"], "2020-01-01"), ("tail", ["r0"], None), ("x", ["y"], None), ("y", ["z"], None), ("z", [], None), ("alone", [], None), ("self", ["self"], None)]
    c = spark.createDataFrame([concept(i, supersedes=s, valid_until=u) for i, s, u in rows], S.CONCEPT)
    at = "timestamp'2026-01-01'"
    from pyspark.sql import functions as F

    few = {r.id: r.head for r in temporal.resolve_heads(c, F.expr(at), max_rounds=3).collect()}
    many = {r.id: r.head for r in temporal.resolve_heads(c, F.expr(at), max_rounds=40).collect()}
    assert few == many and few["c000"] == "c011" and few["z"] == "x" and few["alone"] == "alone" and len(few) == len(rows)
    assert sorted(tuple(r.cycle) for r in temporal.cycles(c).collect()) == [("r0", "r2", "r1"), ("self",)]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "c").collect()
    assert Counter(r.comp for r in got) == {0: 201, 1000: 100}


def test_backlinks_of_trusted_and_linked_concepts(spark):
    """Human-reviewed concepts are no sources, titles count as text, long titles are found, links of either form are not doubled."""
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    human = [("human:x", None)]
    rows = [
        concept("h", title="H page", body="the alpha beta stands", verified=human), concept("t", title="About Alpha Beta", body=""), concept("a", title="Alpha  beta!", body=f"x {long} y"), concept("l", title=long, body="alphabet a"),
        concept("d1", title="D", body="alpha beta [see](/a)"), concept("d2", title="D", body="alpha beta [see](alpha-beta)"), concept("n", title=None, body=None), concept("s", title="abc", body="alpha-beta"),
    ]
    got = {tuple(r) for r in entity.backlinks(spark.createDataFrame(rows, S.CONCEPT)).collect()}
    assert got == {("t", "a"), ("a", "l"), ("s", "a")}
    assert entity.backlinks(spark.createDataFrame(rows[:0], S.CONCEPT)).count() == 0


def test_polling_reads_only_what_changed(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text(f"text {k}")
    empty = spark.createDataFrame([], "path string, sha256 string, size long, mtime_ns long")
    from lorekeep.sources import files

    first = {r.path: r.sha256 for r in watch.poll(spark, [str(tmp_path)], empty, False).collect()}
    assert len(first) == 3
    state = spark.createDataFrame([(r.path, first[r.path], r["size"], r.mtime_ns) for r in files.listing(spark, str(tmp_path)).collect()], "path string, sha256 string, size long, mtime_ns long")
    (tmp_path / "f1.txt").write_text("longer text 1")
    (tmp_path / "f2.txt").unlink()
    got = {r.path: r.sha256 for r in watch.poll(spark, [str(tmp_path)], state, False).collect()}
    assert len(got) == 2 and sum(got[p] == first[p] for p in got) == 1
    assert got == {r.path: r.sha256 for r in watch.poll(spark, [str(tmp_path)], state, True).collect()}


def test_small_helpers():
    odd = b"caf\xe9.md".decode(errors="surrogateescape")
    for path in ("plain.md", "é.md", odd, sync.KEY_PREFIX + "x", sync.KEY_PREFIX + "YQ=="):
        assert sync.decode_key(sync.encode_key(path)) == path
    assert sync.encode_key("é.md") == "é.md" and sync.encode_key(odd).startswith(sync.KEY_PREFIX)
    value = {1: datetime.date(2026, 1, 2), "b": [b"ok", b"\xff", None, 1.5, True], "t": datetime.datetime(2026, 1, 2, 3, 4)}
    assert frontmatter.jsonable(value) == {"1": "2026-01-02", "b": ["ok", {"$binary": "/w=="}, None, 1.5, True], "t": "2026-01-02T03:04:00"}
    assert [search.coerce_limit(v, 10) for v in ("5", None, "x", -3, 7.9)] == [5, 10, 10, 0, 7]
    assert [search.coerce_limit(v, 10, 1, 50) for v in (0, 99, "z")] == [1, 50, 10]
    assert [search.coerce_bool(v) for v in (True, "YES", " on ", "no", 0, 2, None, [1])] == [True, True, True, False, False, True, False, True]


def test_extraction_run(spark):
    """Known sections are left out, matches merged, unusable answers drafted, verdicts applied, mentions linked."""
    from lorekeep.operators import extract

    known = spark.range(1).select(extract.X.source_digest(*[extract.F.lit(x) for x in ("/k", "Known", "known text")])).first()[0]
    old = spark.createDataFrame([concept("k", title="Known", body="known text about gamma ray", source_digest=known), concept("m", title="Same thing", body="x", tags=["z"])], S.CONCEPT)
    rows = [("1", "Known", "known text", "/k"), ("2", "Same thing", "a much longer body", "/s"), ("3", "Gamma ray", "fine words here", "/s"), ("4", "Odd one", "odd text here", "/o"), ("5", "Gamma ray", "another text", "/t")]
    calls = []

    def critic(prompts):
        return ['{"verdict": "fix", "body": "mended"}' if "fine words" in p else '{"verdict": "fail"}' if "another text" in p else '{"verdict": "pass"}' for p in prompts]

    got = {r.id: r for r in extract.run(old, spark.createDataFrame(rows, "section_id string, title string, text string, resource string"), extract.stub_model, "2026-01-01T00:00:00Z", critic=critic).collect()}
    assert set(got) == {"k", "m", "gamma-ray", "odd-one"}  # the second Gamma ray belongs to the first
    assert got["m"].body == "a much longer body" and got["m"].tags == ["a", "stub", "z"] and got["m"].verified[0].by == "critic:model"
    assert got["gamma-ray"].body == "fine words here" and "needs-review" in got["gamma-ray"].tags and got["gamma-ray"].generated.by == "model"  # the last draft is judged
    assert got["odd-one"].body == "odd text here" and "needs-review" in got["odd-one"].tags and got["odd-one"].verified is None
    assert got["k"].body == "known text about gamma ray\n\n## See also\n\n- [Gamma ray](/gamma-ray)\n"

    def failing(prompts):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return prompts

    waits = []
    assert extract.with_retry(failing, sleep=waits.append)(["x"]) == ["x"] and len(waits) == 2 and waits[1] > waits[0]
    with pytest.raises(KeyError):
        extract.with_retry(lambda p: {}["x"], sleep=waits.append)(["x"])
    assert len(waits) == 2
    vectors = extract.embed(spark.createDataFrame([("a", "xy")], "id string, text string"), lambda texts: [[float(len(t))] for t in texts]).collect()
    assert vectors[0].embedding == [2.0]
