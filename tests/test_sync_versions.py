import pytest
from test_more_operators import concept

from lorekeep import schema as S
from lorekeep.operators import governance, sync


def test_runs_follow_each_other(spark, tmp_path):
    """State comes from the store, pages change only with concepts, a failed run is marked and made again, other roots stay untouched."""
    store = governance.Store(spark, str(tmp_path / "kb"))
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, sha256 string")
    able = spark.createDataFrame([("/in/b", "create"), ("/in/a", "create")], "path string, status string")

    def ingest(todo):
        paths = sorted(r.path for r in todo.collect())
        names = [(p, [p.rsplit("/", 1)[1]]) for p in paths]
        return spark.createDataFrame([concept(n[0], resource=p) for p, n in names], S.CONCEPT), spark.createDataFrame(names, "path string, concepts array<string>")

    def lost(todo):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        sync.run_once(store, files(("/in/a", "1")), None, lost, able, "me")
    assert store.holder() is None and store.read().count() == 0
    first = sync.run_once(store, files(("/in/a", "1"), ("/in/b", "2")), None, ingest, able, "me", day="2026-01-01")
    assert first["resumed"] and first["changes"]["added"] == 2
    second = sync.run_once(store, files(("/in/a", "1"), ("/in/b", "2")), None, ingest, able, "me", day="2026-01-02")
    assert not second["resumed"] and second["changes"]["unchanged"] == 2
    roots = spark.createDataFrame([("/other",)], "root string")
    third = sync.run_once(store, files(("/other/c", "3")), None, ingest, able, "me", roots=roots, day="2026-01-03")
    assert third["changes"] == {"added": 1, "updated": 0, "renamed": 0, "removed": 0, "unchanged": 0}
    assert {(r.path, r.sha256, *r.concepts) for r in third["state"].collect()} == {("/in/a", "1", "a"), ("/in/b", "2", "b"), ("/other/c", "3", "c")}
    assert {r.id for r in store.read().collect()} == {"a", "b", "c"}
    log = [(str(r.day), r.seq, r.message) for r in store.beside("log", sync.LOG).orderBy("seq").collect()]
    assert log == [("2026-01-01", 1, "Sync: 2 added, 0 updated, 0 renamed, 0 removed."), ("2026-01-03", 2, "Sync: 1 added, 0 updated, 0 renamed, 0 removed.")]
    assert [r.id for r in store.beside("index", sync.INDEX).orderBy("pos").collect()] == ["a", "b", "c"]
    store.publish(store.read().filter("id <> 'a'"))  # another writer's version takes the tables along
    assert store.beside("state", sync.STATE).count() == 3


def test_only_the_holder_publishes_and_unlocks(spark, tmp_path):
    store = governance.Store(spark, str(tmp_path / "kb"))
    assert store.lock("one") and not store.lock("two")
    store.unlock("two")
    assert store.holder() == "one"
    with pytest.raises(RuntimeError):
        store.publish(spark.createDataFrame([concept("x")], S.CONCEPT), owner="two")
    assert store.read().count() == 0
