"""The pipeline's mixing stage on ids that are null or repeated."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from lorekeep.llm import mixing


def test_mixing_stage_expands_each_row_from_itself(spark, tmp_path):
    """Null ids with unique texts and one id on texts of one source: each text as often as its own row is read."""
    text = lambda k, n: " ".join([f"t{k}"] * n)
    rows = [(None, text(k, k + 1), "en", "abc"[k % 3], 1) for k in range(12)]
    rows += [(7, text(k, k), "en", "a" if k < 60 else "b", 1) for k in range(20, 90)]
    rows += [(k, text(k, k % 9 + 1), "en", "abc"[k % 3], 1) for k in range(100, 200)]
    rows += [(7, None, "en", "a", 1), (None, "", "en", "c", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    mixed = mixing.mix(spark, docs.withColumn("key", F.col("text")), carry=("key",)).collect()
    want = Counter({r.key: -(-r.taken // r.size) for r in mixed if r.taken})
    assert len(mixed) == len(rows) and any(r.doc_id == 7 and r.size and not r.taken for r in mixed)
    out = cp.mixing_stage(spark, docs, str(tmp_path))
    got = out.collect()
    assert out.columns == docs.columns and Counter(r.text for r in got) == want
    assert Counter(r.doc_id for r in got)[None] == sum(n for t, n in want.items() if int(t.split()[0][1:]) < 12) > 0
    assert {tuple(r) for r in got} <= set(rows)
