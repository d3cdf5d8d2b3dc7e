"""Operators and queries over all of their rows, against brute force."""

import random
import re
from collections import Counter

from lorekeep import work
from lorekeep.operators import entity, governance, sections
from lorekeep.plans import fixture_queries, graph_queries


def test_backlinks_have_no_longest_title(spark):
    """Titles of 1 to 40 words, in titles and bodies, against a search of each text for each title."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    run = lambda n: [rng.choice(words) for _ in range(n)]
    titles = [run(n) for n in (1, 2, 3, 4, 5, 8, 12, 13, 16, 17, 25, 31, 32, 33, 40)]
    titles = [["alpha", *t] if len(t) < 3 else t for t in titles]
    rows = [(f"t{i}", " ".join(t).title(), " ".join(run(50))) for i, t in enumerate(titles)]
    rows += [(f"b{i}", "Plain", ", ".join(run(9) + t + run(9))) for i, t in enumerate(titles)]
    rows += [(f"x{i}", "Plain", " ".join(run(9) + t[:-1])) for i, t in enumerate(titles)]
    rows += [("in-title", " ".join(["see", *titles[11]]), None), ("linked", "x", f"{' '.join(titles[10])} [it](t10.md)"), ("none", None, None), ("same", " ".join(titles[9]), "")]
    c = spark.createDataFrame(rows, "id string, title string, body string")
    norm = lambda s: re.sub("[^a-z0-9]+", " ", (s or "").lower()).strip()
    want = set()
    for a, ta, ba in rows:
        for b, tb, _ in rows:
            if a != b and len(norm(tb)) >= 4 and f" {norm(tb)} " in f" {norm(f'{ta or str()} {ba or str()}')} " and (a, b) != ("linked", "t10"):
                want.add((a, b))
    got = [(r.source, r.target) for r in entity.backlinks(c).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {("b14", "t14"), ("in-title", "t11"), ("t9", "same")} <= want and ("linked", "t10") not in want


def brute_see_also(rows):
    """(doc_id, section_no, pos, target_no, why) of rows (doc_id, section_no, title, text), as the reference links siblings."""
    out = set()
    for doc in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == doc)
        for i, (no, _, text) in enumerate(mine):
            links = [(n, "mentioned") for n, t, _ in mine if n != no and len((t or "").strip()) >= 4 and re.search(r"(?<!\w)" + re.escape(t.strip()) + r"(?!\w)", text or "", re.I)]
            links += [(mine[k][0], why) for k, why in ((i + 1, "next"), (i - 1, "previous")) if 0 <= k < len(mine)]
            first: dict = {}
            for n, why in links:
                first.setdefault(n, why)
            out |= {(doc, no, k + 1, n, why) for k, (n, why) in enumerate(list(first.items())[:8])}
    return out


def test_see_also_mentions(spark):
    """Mentions before neighbours and at most eight, word ends, case, signs in titles, spaces around them, short titles."""
    titles = ["Alpha beta", "gamma+", " Delta ", "abc", r"end\E(x", "Épée", "Theta", "Iota", "Kappa", "Lambda", "Sigma", "Omega"]
    texts = [" and ".join(titles), "alphabeta, ALPHA BETA", "gamma+ gamma", "deltas", r"a end\E(x, delta", "épée abc", "kappa_ theta1", "Iota", None, "", "xlambda", "Sigma."]
    rows = [(1, k, t, x) for k, (t, x) in enumerate(zip(titles, texts, strict=True))] + [(2, 0, "Alone", "alone, Theta"), (3, 0, "Same", "Same"), (3, 4, "Same", "same")]
    got = [tuple(r) for r in sections.see_also(spark.createDataFrame(rows, "doc_id long, section_no int, title string, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_see_also(rows)
    assert sum(r[:2] == (1, 0) for r in got) == 8 and any(r[4] == "mentioned" for r in got)


def test_see_also_makes_no_rows_of_runs_of_words(spark, monkeypatch):
    """Texts meet their document's titles in place; documents of more titles than an array takes go by rows, with the same result."""
    titles = ["Alpha beta", "gamma+", "Delta rule of law here", "++++", "Same", "Same"]
    texts = ["gamma+ and same", "ALPHA BETA, delta rule of law here", "alpha", "++++ same", "a ++++ b", None]
    rows = [(d, k, t, x) for d in (1, 2) for k, (t, x) in enumerate(zip(titles[: 3 * d], texts[: 3 * d], strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, section_no int, title string, text string")
    by_rows, calls = sections._said_by_rows, []
    monkeypatch.setattr(sections, "_said_by_rows", lambda texts, *more: calls.append(sorted(r[0] for r in texts.select("doc_id").distinct().collect())) or by_rows(texts, *more))
    for most, want in ((1024, []), (4, [[2]]), (0, [[1, 2]])):
        calls.clear()
        monkeypatch.setattr(sections, "TITLES_AT_ONCE", most)
        assert {tuple(r) for r in sections.see_also(df).collect()} == brute_see_also(rows) and calls == want


def test_see_also_query_keeps_titles(spark, tmp_path):
    text = "Top line\nThe gate\nsee rule of law here\nAnd rule of law\nthe gate again, # The gate\n"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    s = sections.sections(graph_queries.pages(spark, str(tmp_path))).select("doc_id", "section_no", "title", "text").collect()
    got = {tuple(r) for r in graph_queries.jn_13_see_also(spark, str(tmp_path)).collect()}
    want = {(d, n, t, why) for d, n, _, t, why in brute_see_also([tuple(r) for r in s])}
    assert got == want and any(r[3] == "mentioned" for r in got)


def test_term_frequencies_of_all_terms(spark, tmp_path):
    """Ids and titles count three times, tags twice, bodies once; no term is left out."""
    texts = {1: "zebra quartz\nzebra onyx", 2: "onyx", 3: "", 4: None}
    spark.createDataFrame([(k, t, "xx", "src1") for k, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    want = Counter()
    for k, t in texts.items():
        for part, weight in ((f"doc {k}", 3), ((t or "").split("\n")[0], 3), ("xx", 2), (t or "", 1)):
            for w in part.split():
                want[f"doc-{k}", w] += weight
    got = [tuple(r) for r in fixture_queries.agg_01_term_frequency(spark, str(tmp_path)).collect()]
    assert {(i, w): n for i, w, n in got} == dict(want) and len(got) == len(want)


def test_index_pages_of_all_bundles(spark, tmp_path, monkeypatch):
    """A hot bundle over many ranges, small ones, a null one, equal titles, no bundle at all and no rows."""
    monkeypatch.setattr(work, "RANGES", 9)
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), f"x/d{k}", rng.choice(["Same", "same", "Title", None, " ", f"T{k % 50}"]), rng.choice(["", "said"])) for k in range(400)] + [("one", "x/only", "Only", None)]
    c = spark.createDataFrame(rows, "bundle_id string, id string, title string, description string")

    def brute(rows):
        shown = [((t if (t or "").strip() else i.split("/")[-1]), i, d) for _, i, t, d in rows]
        return [(k + 1, i, f"* [{t}]({i}.md)" + (f" - {d}" if d else "")) for k, (t, i, d) in enumerate(sorted(shown, key=lambda r: (r[0].lower(), r[1])))]

    want = {(b, *r) for b in {r[0] for r in rows} for r in brute([r for r in rows if r[0] == b])}
    assert {tuple(r) for r in governance.index_page(c, by=("bundle_id",)).collect()} == want and len(want) == len(rows)
    assert sorted(tuple(r) for r in governance.index_page(c).collect()) == brute(rows)
    assert governance.index_page(c.limit(0), by=("bundle_id",)).count() == 0 and governance.index_page(c.limit(0)).count() == 0
    spark.createDataFrame([(k, "", "en", f"src{k % 3}") for k in range(9)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.bundle_id, r.pos) for r in graph_queries.snk_04_index_page(spark, str(tmp_path)).collect()}
    assert got == {(f"src{k}", p) for k in range(3) for p in (1, 2, 3)}
