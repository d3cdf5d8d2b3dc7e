"""The pipeline's stages judge rows: repeated and missing ids, columns with any names, and brute force for each of the middle stages."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp

CLASHING = "position long, _keep string, _more boolean, _sha string, _row1 long, row string, sha string, id long, n long, key1 string, count long"


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def texts():
    long = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    return [
        (1, long(0)), (2, long(0) + " more"), (2, long(1)), (2, long(1) + " more"), (None, long(2)), (None, long(2) + " more"), (5, long(2) + " again"), (None, long(3)), (7, None), (8, ""), (8, "short"), (9, "short"),
        (3, long(4)), (3, long(4)),
    ]


def table(spark, rows, tmp_path, extra=CLASHING):
    names = [c.split() for c in extra.split(", ")]
    of = {"long": 11, "string": "x", "boolean": True}
    full = [(i, t, "en", "ab"[k % 2], 1, *[of[kind] for _, kind in names]) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(str(tmp_path / "d"))
    return spark.read.parquet(str(tmp_path / "d"))


def test_near_stage_keeps_one_row_of_each_group_and_every_lone_text(spark, tmp_path):
    docs = table(spark, texts(), tmp_path)
    kept = cp.near_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    rows = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect()}, key=str)
    parent = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            x, y = shingles(a[2]), shingles(b[2])
            if x and y and len(x & y) * 10 >= 8 * len(x | y):
                old, new = parent[i], parent[j]
                parent = [new if p == old else p for p in parent]
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[parent[i]].append(r)
    got = Counter((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect())
    assert len(got) == sum(got.values()) == len(groups)
    for g in groups.values():
        mine = [r for r in g if r in got]
        assert len(mine) == 1 and mine[0][:2] == min(r[:2] for r in g)


def test_near_stage_of_plain_ids(spark, tmp_path):
    rows = [(k, t) for k, (_, t) in enumerate(texts()[:12])]
    got = cp.near_stage(spark, table(spark, rows, tmp_path), str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == [0, 2, 4, 7, 8, 9, 10]


@pytest.mark.parametrize("stage", [cp.exact_stage, cp.near_stage, cp.mixing_stage])
def test_columns_may_have_any_names_and_keep_their_values(spark, tmp_path, stage):
    docs = table(spark, texts(), tmp_path)
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()} and out.count() > 0
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_exact_stage_against_brute_force(spark, tmp_path):
    docs = table(spark, texts(), tmp_path)
    best = defaultdict(lambda: -1)
    for r in docs.collect():
        best[r.text or ""] = max(best[r.text or ""], -1 if r.doc_id is None else r.doc_id)
    assert Counter((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in cp.exact_stage(spark, docs, str(tmp_path)).collect()) == Counter(best.items())
