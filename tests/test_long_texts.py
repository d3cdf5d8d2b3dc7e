"""Texts longer than any limit of a scan."""

import pyarrow as pa
from pyspark.sql import functions as F

from lorekeep import work
from lorekeep.functions import text as X
from lorekeep.operators import search, validate


def test_links_far_inside_a_text(spark):
    row = spark.range(1).select(F.concat(F.repeat(F.lit("x [ "), F.lit(300_000)), F.lit("[a](b.md)")).alias("t"))
    assert row.select(X.link_targets("t").alias("l")).first().l == ["b.md"]


def test_an_index_of_over_a_million_characters_reaches_all_concepts(spark):
    head = "---\ntype: Note\ntitle: T\ndescription: D\n---\n"
    docs = spark.range(1500).select(F.concat(F.lit("p" * 700), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.lit(head).alias("text"))
    index = docs.agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("* [x]("), "path", F.lit(")")))), "\n").alias("text")).select(F.lit("index.md").alias("path"), "text")
    assert index.first().text.__len__() > 1_000_000
    assert validate.check(docs.union(index), "2026-06-01 00:00:00").count() == 0


def test_batches_are_cut_by_their_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * 10_000] * 1000)], ["k", "t"])
    got = list(work.slices([batch, batch.slice(0, 0)], 1 << 20))
    assert max(b.nbytes for b in got) <= 1 << 20 and [k for b in got for k in b.column(0).to_pylist()] == list(range(1000))
    assert [b.num_rows for b in work.slices([batch.slice(0, 3)], 10)] == [1, 1, 1]


def test_terms_are_counted_in_slices(monkeypatch):
    """The most texts that are objects at one time, of a batch of 4,000 long ones."""
    seen = []
    monkeypatch.setattr(search, "_count", lambda texts, weights, places, cache: seen.append(1) or (1, {"t": 1}))
    run = {}
    frame = type("Frame", (), {"dtypes": [("id", "string")], "select": lambda self, *c: self, "mapInArrow": lambda self, f, shape: run.update(f=f)})()
    monkeypatch.setattr(search, "F", type("F", (), {"__getattr__": lambda self, n: lambda *a, **k: self, "alias": lambda self, n: self})())
    search.documents(frame, [("body", 1)])
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(4000))), pa.array(["word " * 500] * 4000)], ["id", "f0"])
    sizes = [b.num_rows for b in run["f"]([batch])]
    assert sum(sizes) == len(seen) == 4000 and max(sizes) < 500
