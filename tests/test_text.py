import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import temporal as T
from lorekeep.functions import text as X
from lorekeep.operators import search


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_stems_are_the_same_on_every_path(spark):
    rng = random.Random(4)
    words = ["classes", "studies", "ties", "ies", "bus", "cats", "running", "walked", "sing", "ed", "bed", "missing", "falling", "toss", "buzzing", "is", "gas", "feeding", "needed", "ss"]
    words += ["".join(rng.choice("aeisdgnlzu") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", X.stem("w").alias("s"), X.tokens("w").alias("t")).collect()
    for r in got:
        assert r.s == search.stem_word(r.w), r.w
        assert r.t == search.stems(r.w), r.w
    assert [search.stem_word(w) for w in words[:8]] == ["class", "studi", "tie", "ie", "bus", "cat", "run", "walk"]


def test_tokens_keep_unicode_and_order(spark):
    assert one(spark, X.tokens("t"), t="The Café_au lait²: running, and RUNNING!") == ["café", "au", "lait²", "run", "run"]
    assert one(spark, X.tokens("t"), t="") == []


def test_query_parsing():
    q = search.parse_query('graph "knowledge graphs" -old "open end')
    assert (q.terms, q.phrases, q.excluded) == (["graph"], [["knowledge", "graph"], ["open", "end"]], ["old"])
    assert search.parse_query("the of").wanted == []


def test_small_functions(spark):
    assert one(spark, X.slugify("t"), t="  Ünder the Hood! ") == "nder-the-hood"
    assert one(spark, X.slugify("t"), t="é") == "untitled"
    assert one(spark, X.normalize_title("t"), t="A -- b  C") == "a b c"
    assert one(spark, X.describe("t"), t="") .startswith("Draft concept")
    assert one(spark, X.describe("t"), t="# Short. " + "word " * 60).endswith("…")
    assert one(spark, X.cosine("a", "b"), a=[1.0, 0.0], b=[0.9, 0.4359]) == pytest.approx(0.9, abs=1e-3)
    assert one(spark, X.cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 1.0]) == 0.0
    assert one(spark, X.title_similarity("a", "b"), a="Running Shoes", b="shoe run") == 1.0
    assert one(spark, X.title_similarity("a", "b"), a="", b="x") == 0.0
    assert one(spark, X.truncate("t", 10), t="line one\nline two").startswith("line one\n\n[...")
    assert one(spark, X.link_targets("t"), t='[a](b.md "T") ![i](p.png) [c](<d e.md>) [a](b.md)') == ["b.md", "d e.md"]
    assert one(spark, X.id_target("i", "t"), i="x/y", t="../../z.md#s") == "z"
    assert one(spark, X.id_target("i", "t"), i="x/y", t="https://z") is None
    assert one(spark, X.strip_code("t"), t="a `[x](y)` b\n```\n[z](w)\n```\n") == "a  b\n\n"
    assert one(spark, X.footnote_refs("t"), t="[^b] [^a] [^b]\n[^a]: d") == ["b", "a"]
    assert one(spark, X.sanitize("t"), t='<p onclick="x()">javascript:a<script>b</script></p>') == "<p>a</p>"
    assert one(spark, X.valid_citations("t", F.array(F.lit("a"))), t="x [a] y [b]") == "x [a] y b"
    assert X.decode_continuation(X.encode_continuation(7)) == 7
    with pytest.raises(ValueError):
        X.decode_continuation("nonsense")


def test_time(spark):
    bad = ["2026-13-99", "2026-02-30", "123", "yes", "x" * 101, "", "2026"]
    rows = spark.createDataFrame([(v,) for v in bad], "v string")
    assert rows.filter(T.parse_temporal("v").isNotNull()).count() == 0
    rows = spark.createDataFrame([("2026-01-01", "2026-12-31", t) for t in ("2026-01-01T00:00:00", "2026-12-31T23:59:59", "2025-12-31T23:59:00", "2027-01-01T00:00:00")], "f string, u string, at string")
    assert [r.s for r in rows.select(T.window_status("f", "u", F.col("at").cast("timestamp")).alias("s")).collect()] == ["current", "current", "not_yet_valid", "expired"]
    many = spark.createDataFrame([([" a ", "", None] + ["b"] * 497,)], "s array<string>").select(T.normalize_supersedes("s").alias("x")).first().x
    assert many == ["a"] + ["b"] * 97


def test_names_fit_into_files(spark):
    rows = [("Notes/Hello World",), ("a\\B//c",), ("x" * 300 + "/" + "y" * 300,), ("",)]
    got = [r.s for r in spark.createDataFrame(rows, "p string").select(X.slug_id("p").alias("s")).collect()]
    assert got == ["notes/hello-world", "a/b/untitled/c", "x" * 252 + "/" + "y" * 252, "untitled"]
    ids = spark.createDataFrame([("n/" + "y" * 252, 12), ("short", 2)], "b string, n int").select(X.suffixed_id("b", "n").alias("s")).collect()
    assert [r.s for r in ids] == ["n/" + "y" * 249 + "-12", "short-2"]
