"""Titles that many concepts share: sets of tokens are compared once, ids are paired in blocks."""

import random

from lorekeep import work
from lorekeep.operators import entity, search


def brute(rows, others):
    sets = lambda rs: [(i, set(search.stems(t or ""))) for i, t, _ in rs]
    return {(a, b, round(len(x & y) / len(x | y), 9)) for a, x in sets(rows) for b, y in sets(others) if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-12}


def titles(n):
    rng = random.Random(8)
    words = [f"w{k}x" for k in range(12)]
    some = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(40)] + ["", None, "the of"]
    return [(f"c{k:04}", some[0] if k % 3 else rng.choice(some), "") for k in range(n)]


def test_pairs_of_copies_come_in_blocks(spark):
    rows = titles(240)
    c = spark.createDataFrame(rows, "id string, title string, resource string")
    cut = work.blocks(c.fillna("-"), "title", ["id"], "ids", size=16).collect()
    assert max(len(r.ids) for r in cut) < 64 and sorted(x.id for r in cut for x in r.ids) == [r[0] for r in rows]
    got = [(r.a, r.b, round(r.similarity, 9)) for r in entity.jaccard_titles(c, c).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, rows)


def test_sets_are_compared_once(spark):
    """However many ids have a set, its candidates are those of one."""
    rows = titles(240)
    sets = lambda n: spark.createDataFrame(rows[:n], "id string, title string, resource string").select(entity._set("title").alias("set")).filter("set <> ''").distinct()
    got = entity.similar_sets(sets(240), sets(240)).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) <= len({r.a for r in got}) ** 2
    want = {(a, b) for a, b, _ in brute(rows, rows)}
    key = {i: " ".join(sorted(set(search.stems(t or "")))) for i, t, _ in rows}
    assert {(r.a, r.b) for r in got} == {(key[a], key[b]) for a, b in want}


def test_matches_of_copies(spark):
    """The most similar title, the least id of those that have it."""
    rows = titles(240)
    new, old = rows[::2], rows[1::2]
    norm = lambda t: (t or "").strip().lower()
    near = {}
    for a, b, s in sorted(brute(new, old), key=lambda r: (r[0], -r[2], r[1])):
        near.setdefault(a, b)
    want = {}
    for i, t, _ in new:
        same = [b for b, u, _ in old if norm(t) and norm(u) == norm(t)]
        want[i] = (min(same), "title") if same else (near[i], "similar_title") if i in near else (None, None)
    frame = lambda r: spark.createDataFrame(r, "id string, title string, resource string")
    assert {r.id: (r.match, r.reason) for r in entity.match(frame(new), frame(old)).collect()} == want


def test_backlinks_of_copies_and_links(spark, monkeypatch):
    """Many sources and targets of one title, some that link a target by id or all of them by slug."""
    monkeypatch.setattr(entity.blocks, "__defaults__", (8,))
    rows = [(f"d{k:02}", "Hot title", ["Hot title", "[x](/d03)", "[y](hot-title)", "[z](d05.md)"][k % 4] + " text") for k in range(60)]
    got = [tuple(r) for r in entity.backlinks(spark.createDataFrame(rows, "id string, title string, body string")).collect()]
    out = {1: lambda b: b == "d03", 2: lambda b: True, 3: lambda b: b == "d05"}
    want = {(a, b) for k, (a, _, _) in enumerate(rows) for b, _, _ in rows if a != b and not out.get(k % 4, lambda b: False)(b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_runs_of_long_titles_become_no_rows(spark, monkeypatch):
    """Titles of one resource that hold another: only runs that begin a title are exploded, and beginnings come in blocks."""
    cut, inner = [], work.blocks
    monkeypatch.setattr(entity, "blocks", lambda df, key, values, out: cut.append(1) or inner(df, key, values, out, size=4))
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    some = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 1, 2, 2, 3, 5, 8, 300, 900)] + ["a", "ab", "abc", "abcdefghi", ""]
    rows = [(k, f"/r{k % 2}" if k % 7 else "", some[k % len(some)] if k % 3 else f"{some[(k + 5) % len(some)]} {some[k % len(some)]}".strip()) for k in range(56)]
    x, y = (spark.createDataFrame(rows, f"{p}_id int, {p}_res string, {p}_title string").repartition(3) for p in "xy")
    found = entity.contained(x, y)
    got = [(r.x_id, r.y_id) for r in found.collect()]
    want = {(a, b) for a, ra, ta in rows for b, rb, tb in rows if ra and ra == rb and ta and tb and (ta in tb or tb in ta)}
    assert cut and len(got) == len(set(got)) and set(got) == want and len(want) > 60
