"""Status intervals against statuses at single instants, on chains, branches, hubs and cycles."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.operators import replay, temporal
from lorekeep.work import Workspace


def concepts(spark, rows):
    names = spark.createDataFrame([], S.CONCEPT).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], S.CONCEPT)


@pytest.fixture(scope="module")
def bundle(spark):
    rng = random.Random(11)
    day = lambda: rng.choice([None, None, *[f"2026-01-{d:02}" for d in range(1, 28, 4)], "2026-01-10T12:00:00Z", "nonsense"])
    rows = [{"id": f"n{i:02}", "supersedes": [f"n{j:02}" for j in range(max(0, i - 4), i) if rng.random() < 0.3] or None, "valid_from": day(), "valid_until": day()} for i in range(7)]
    rows += [{"id": "hub"}, *[{"id": f"h{k}", "supersedes": ["hub"], "valid_from": f"2026-01-{k % 25 + 1:02}", "valid_until": f"2026-01-{k % 25 + 3:02}"} for k in range(50)]]
    rows += [{"id": "alone", "valid_until": "2026-01-05"}, {"id": "self", "supersedes": ["self", "missing"]}, {"id": "back", "valid_from": "2026-01-20", "valid_until": "2026-01-10"}]
    return concepts(spark, rows)


def test_intervals_say_what_single_instants_say(spark, bundle):
    intervals = replay.status_intervals(bundle)
    every = intervals.collect()
    for i in {r.id for r in every}:
        mine = sorted((r.opens, r.closes) for r in every if r.id == i)
        assert mine[0][0] == replay.FIRST and mine[-1][1] == replay.LAST and all(a[1] == b[0] for a, b in zip(mine, mine[1:], strict=False))
    times = [datetime(2025, 12, 31), *[datetime(2026, 1, d, h) for d in (1, 5, 9, 10, 17, 26) for h in (0, 12)], datetime(2026, 1, 9, 23, 59, 59, 999999), datetime(2026, 3, 1)]
    instants = spark.createDataFrame([(t,) for t in times], "instant timestamp")
    got = {}
    for r in replay.statuses_at(intervals, instants).collect():
        assert got.setdefault((r.instant, r.id), (r.status, r.superseded_by, r.has_temporal)) and True
    assert len(got) == len(times) * bundle.count()
    own = {r.id: (r.opens, r.closes) for r in replay.windows(bundle).collect()}
    above = {}
    for r in temporal.edges(bundle).collect():
        above.setdefault(r.dst, []).append(r.src)

    def best(i, t):
        found = [(d - 1, h) for x in above.get(i, []) if x != i for d, h in [best(x, t)] if h]
        return min([*found, *([(0, i)] if own[i][0] <= t < own[i][1] else [])], default=(0, None))

    for (at, i), (status, by, _) in got.items():
        t = round((at - datetime(1970, 1, 1)).total_seconds() * 1e6)
        head = best(i, t)[1]
        want = "not_yet_valid" if t < own[i][0] else "expired" if t >= own[i][1] else "superseded" if head != i else "current"
        assert (status, by) == (want, head if want == "superseded" else None)
    t = times[4]
    want = {r.id: (r.status, r.superseded_by, r.has_temporal) for r in temporal.statuses(bundle, F.lit(t.isoformat()).cast("timestamp")).collect()}
    assert {i: v for (at, i), v in got.items() if at == t} == want


def test_cycles_and_empty_bundles(spark):
    rows = [{"id": "a", "supersedes": ["b"]}, {"id": "b", "supersedes": ["a"]}, {"id": "top", "supersedes": ["a"], "valid_from": "2026-01-05"}, {"id": "low"}, {"id": "b2", "supersedes": ["low"]}]
    c = concepts(spark, rows)
    at = spark.createDataFrame([(datetime(2026, 1, 1),), (datetime(2026, 1, 9),)], "instant timestamp")
    got = {(r.instant.day, r.id): r.superseded_by for r in replay.statuses_at(replay.status_intervals(c), at).collect()}
    assert got[1, "a"] is None and got[9, "a"] == "top" and got[1, "low"] == got[9, "low"] == "b2" and got[1, "b"] is None and len(got) == 10
    assert replay.status_intervals(c.limit(0)).count() == 0


def test_the_best_of_overlapping_intervals(spark):
    rng = random.Random(5)
    rows = [(f"i{k % 3}", a := rng.randrange(300), a + rng.randrange(120), rng.randrange(4), f"h{rng.randrange(9)}") for k in range(200)]
    got = replay.best_over_time(spark.createDataFrame(rows, "id string, opens long, closes long, depth int, head string"), Workspace(spark, "best"), "t").collect()
    at = {}
    for r in got:
        for t in range(r.opens, r.closes):
            assert (r.id, t) not in at
            at[r.id, t] = (r.depth, r.head)
    want = {}
    for i, a, b, d, h in rows:
        for t in range(a, b):
            want[i, t] = min(want.get((i, t), (1, "")), (-d, h))
    assert at == {k: (-d, h) for k, (d, h) in want.items()}


def test_instants_are_joined_in_many_tasks(spark, bundle):
    """A small file of intervals stands for a row a concept and instant, so its few tasks are not those of the join."""
    times = spark.sql("SELECT explode(sequence(timestamp'2026-01-01', timestamp'2026-01-20', interval 1 day)) AS instant")
    held = replay.status_intervals(bundle).coalesce(1)
    got = replay.statuses_at(held, times)
    assert got.rdd.getNumPartitions() > 1 and got.count() == 20 * held.select("id").distinct().count()
