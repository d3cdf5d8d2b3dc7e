"""Nested values against a recursive walk."""

import json
import random

from lorekeep.operators import hygiene


def strip(v):
    if isinstance(v, dict):
        return {k: strip(x) for k, x in v.items() if k != "verified"}
    return [strip(x) for x in v] if isinstance(v, list) else v


def sizes(v, depth=0):
    """Nodes, deepest level, characters of texts."""
    inside = [sizes(x, depth + 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else [])]
    return 1 + sum(i[0] for i in inside), max([depth, *[i[1] for i in inside]]), sum(i[2] for i in inside) + (len(v) if isinstance(v, str) else 0)


def made(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.4:
        return rng.choice([None, True, 7, -3, 1.5, "", "text", 'a "quote" \\ ü\n', "verified"])
    if kind < 0.7:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "verified", 'k"ey', "ü"]): made(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_values_without_markers_and_their_sizes(spark):
    rng = random.Random(9)
    values = [made(rng) for _ in range(60)] + [{"verified": {"x": 1}}, [{"verified": 1}], {}, []]
    deep = json.loads("[" * 9 + "]" * 9)
    values += [deep, list(range(200)), "x" * 500, ["y" * 300, "z" * 300]]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(1000, None), (1001, "{broken"), (1002, "")]
    got = {r.id: r for r in hygiene.clean(spark.createDataFrame(rows, "id long, value string").repartition(3), depth=7, nodes=150, chars=450).collect()}
    assert len(got) == len(rows) and all(got[k].refused == "no JSON" and got[k].cleaned is None for k in (1000, 1001, 1002))
    for k, v in enumerate(values):
        nodes, depth, chars = sizes(v)
        why = "too deep" if depth > 7 else "too many items" if nodes > 150 else "too large" if chars > 450 else None
        assert got[k].refused == why
        if why is None:
            assert (got[k].nodes, got[k].depth, got[k].chars) == (nodes, depth, chars) and json.loads(got[k].cleaned) == strip(v)
        else:
            assert got[k].cleaned is None
    assert hygiene.clean(spark.createDataFrame([], "id long, value string")).count() == 0


def test_values_are_put_together_at_once(spark, monkeypatch):
    """No table a level on the way back; marked keys stand first, between others, alone and in each other."""
    kept, keep = [], hygiene.Workspace.keep
    monkeypatch.setattr(hygiene.Workspace, "keep", lambda self, df, name: kept.append(name) or keep(self, df, name))
    rows = [{"verified": 1, "x": [], "y": {}}, {"verified": {"a": 1}}, {"a": {"verified": [1, {"verified": 2}], "w": '"\\'}, "verified": 0, "z": [None, {"verified": 1}, [{"verified": 3, "w": 1}]]}, [[[["verified"]]]], "verified", 7]
    got = {r.id: r.cleaned for r in hygiene.clean(spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(rows)], "id long, value string")).collect()}
    assert {k: json.loads(v) for k, v in got.items()} == {k: strip(v) for k, v in enumerate(rows)}
    assert not [name for name in kept if name.startswith("built")]
