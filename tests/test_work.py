"""Places and running sums without a window over a whole group."""

import random
from collections import Counter
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from lorekeep import work
from lorekeep.work import Workspace, numbered, ranked, running


def test_numbered_places_every_row_once(spark):
    rows = [(random.Random(i).choice([None, 1, 1, 1, 2, 5]), f"t{i % 7}") for i in range(500)] + [(1, "same")] * 300
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    got = numbered(df, [F.col("k"), F.col("t")], Workspace(spark, "numbered"), "rows").collect()
    assert sorted(r.n for r in got) == list(range(800)) and Counter((r.k, r.t) for r in got) == Counter(rows)
    assert [(r.k, r.t) for r in sorted(got, key=lambda r: r.n)] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert numbered(df.limit(0), [F.col("k")], Workspace(spark, "numbered"), "none").count() == 0


@pytest.mark.parametrize("step", [2, 3, 1000])
def test_running_sums_in_blocks_of_blocks(spark, step):
    rows = [(g, i, (i * 7 + g) % 11, 1) for g, n in ((0, 40), (1, 1), (2, 9)) for i in range(n)]
    got = running(spark.createDataFrame(rows, "g int, i long, x long, one long").repartition(3), ["g"], "i", ["x", "one"], Workspace(spark, "running"), "r", step).collect()
    for g in range(3):
        mine = sorted((r.i, r.x, r.one) for r in got if r.g == g)
        assert [x for _, x, _ in mine] == list(accumulate(x for h, _, x, _ in rows if h == g)) and [o for *_, o in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize(("size", "by_ranges"), [(1, True), (5, True), (1000, False)])
def test_ranks_of_small_groups_need_no_ranges(spark, monkeypatch, size, by_ranges):
    rows = [(g, f"k{i:02}") for g, n in (("a", 40), ("b", 5), (None, 7), ("c", 1)) for i in range(n)]
    inner, calls = work._ranked_by_ranges, []
    monkeypatch.setattr(work, "_ranked_by_ranges", lambda *a: calls.append(1) or inner(*a))
    got = ranked(spark.createDataFrame(rows, "g string, k string").repartition(3), ["g"], ["k"], "n", size).collect()
    assert sorted((r.g or "", r.k, r.n) for r in got) == sorted((g or "", k, int(k[1:]) + 1) for g, k in rows) and bool(calls) == by_ranges


@pytest.mark.parametrize("size", [1, 5])
def test_ranks_of_all_rows_as_one_group(spark, size):
    """Without a group there is no key to join by; more rows than `size` go by ranges all the same."""
    rows = [(f"k{i // 2:03}", i % 2) for i in range(700)]
    got = ranked(spark.createDataFrame(rows, "k string, i int").repartition(3), [], ["k", "i"], "n", size).collect()
    assert sorted((r.n, r.k, r.i) for r in got) == [(n, k, i) for n, (k, i) in enumerate(rows, 1)]
