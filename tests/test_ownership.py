"""Ownership of added and removed files against a sequential loop over a state."""

import random

import pytest

from lorekeep.operators import sync

STATE = "path string, sha256 string, concepts array<string>"


def loop(planned, state, sources, manifest):
    """What one file after the other does: added ones against the state as it was, removed ones in the order of paths."""
    out = {}
    for path, change, sha in sorted(planned):
        others = {c for p, (_, cs) in state.items() if p != path for c in cs}
        if change == "added":
            mine = sorted(set(sources.get(path, [])) - others)
            named = manifest.get(sha)
            donors = [p for p in ([named] if named else []) + sorted(state) if p != path and p in state and state[p][0] == sha]
            out[path] = ("adopted", mine, None) if mine else ("ingest", [], None) if named is None else ("shared", state[donors[0]][1], donors[0]) if donors else ("stale", [], None)
    left = dict(state)
    for path, change, _ in sorted(planned):
        if change == "removed":
            sharers = [p for p in sorted(left) if p != path and set(left[p][1]) & set(left[path][1])]
            others = {c for p, (_, cs) in left.items() if p != path for c in cs}
            freed = sorted((set(left[path][1]) | set(sources.get(path, []))) - others)
            out[path] = ("kept", [], sharers[0]) if sharers else ("removed", freed, None)
            left.pop(path)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ownership_in_one_plan_is_that_of_the_loop(spark, seed):
    rng = random.Random(seed)
    concepts = [f"c{k}" for k in range(14)]
    state = {f"/s{k:02}": (f"d{rng.randrange(8)}", sorted(set(rng.sample(concepts, rng.randrange(4))))) for k in range(30)}
    added = [(f"/n{k:02}", "added", f"d{rng.randrange(12)}") for k in range(15)]
    removed = [(p, "removed", None) for p in state if rng.random() < 0.5]
    sources = {p: rng.sample(concepts + ["o1", "o2", "o3"], 2) for p in [*state, *[a[0] for a in added]] if rng.random() < 0.4}
    manifest = {f"d{k}": rng.choice([*state, "/gone", "/n03"]) for k in range(12) if k % 4}
    table = spark.createDataFrame([(p, *v) for p, v in state.items()], STATE)
    plan = spark.createDataFrame([*added, *removed], "path string, change string, sha256 string").repartition(3)
    bundle = spark.createDataFrame([(c, p) for p, cs in sources.items() for c in cs] + [("z", None)], "id string, resource string")
    known = spark.createDataFrame(list(manifest.items()), "digest string, path string")
    got = {r.path: (r.outcome, r.concepts, r.by) for r in sync.resolve(plan, table, bundle, known).collect()}
    assert got == loop([*added, *removed], state, sources, manifest)


def test_nothing_to_resolve(spark):
    none = spark.createDataFrame([], "path string, change string, sha256 string")
    empty = spark.createDataFrame([], STATE)
    assert sync.resolve(none, empty, spark.createDataFrame([], "id string, resource string"), spark.createDataFrame([], "digest string, path string")).count() == 0
