"""Faults found in earlier rounds: repeated ids in the language sample, wide ids in sharding, huge canvases, batches sent twice."""

import struct
import zlib
from collections import Counter

import pytest

from lorekeep.llm import exact_dedup, gif, language, sharding


@pytest.mark.parametrize("one", [7, 8, None])
def test_a_language_whose_rows_share_one_id_is_learned(spark, one):
    rows = [(one, f"bonjour monde numero {chr(97 + k % 26)}{chr(97 + k // 26)}ette", "fr") for k in range(200)]
    rows += [(k, f"guten tag welt {chr(97 + k % 26)}ung", "de") for k in range(100, 160)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs=20)
    learned = zlib.crc32(("" if one is None else str(one)).encode()) % 3 != 1
    assert model.langs == (["de", "fr"] if learned else ["de"])
    if learned:
        assert "bonjour" in model.words and model.predict("bonjour monde", {})[0] == "fr"
        endings = {w for w in model.words if w.endswith("ette")}
        assert 5 < len(endings) < 60  # about docs of them, neither all nor none


def test_sharding_of_ids_at_both_ends_of_the_range(spark):
    rows = [(i, f"text {k} " * (k % 7 + 1), "en", "a") for k, i in enumerate([-(2**63), 2**63 - 1, 0, None, *range(1, 60), 2**62])]
    got = sharding.shard(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 4).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert len(load) == 4 and max(load.values()) - min(load.values()) < 0.2 * sum(load.values()) / 4


def test_a_header_larger_than_memory_is_a_fault_of_the_file(spark):
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    frame = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x01\x44\x00\x3b"
    fine = gif.encode(gif.pad(b"text"))
    rows = gif.frames(spark.createDataFrame([(1, bytearray(huge)), (2, bytearray(frame)), (3, bytearray(fine))], "doc_id long, media binary")).collect()
    assert {r.doc_id: r.error for r in rows} == {1: "a canvas of 65535 x 65535", 2: "a frame of 65535 x 65535", 3: None}


def test_a_batch_sent_twice_counts_once_and_the_anti_join_decides(spark, tmp_path, monkeypatch):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=3)
    facts = lambda: Counter((r.keep_id, r.group_size) for r in index.facts().collect())
    exact_dedup.add_batch(index, docs([(1, "a"), (2, "a"), (3, "b")]), "one")
    second = docs([(9, "a"), (4, "c"), (5, "c")])
    assert exact_dedup.add_batch(index, second, "two").count() == 1
    assert facts() == Counter([(9, 3), (3, 1), (5, 2)])
    assert exact_dedup.add_batch(index, second, "two").count() == 1 and facts() == Counter([(9, 3), (3, 1), (5, 2)])
    # a failure between the two writes: entries are there, updates aren't
    third = docs([(20, "b"), (21, "d")])
    add, calls = index._add, []
    monkeypatch.setattr(index, "_add", lambda *a: calls.append(a[0]) or (add(*a) if len(calls) == 1 else 1 / 0))
    with pytest.raises(ZeroDivisionError):
        exact_dedup.add_batch(index, third, "three")
    monkeypatch.setattr(index, "_add", add)
    exact_dedup.add_batch(index, third, "three")
    assert facts() == Counter([(9, 3), (20, 2), (5, 2), (21, 1)])
    index.drop()
    # with the anti-join broken either way the result is wrong
    rows = docs([(k, f"t{k % 4}") for k in range(40)])
    sound = Counter(tuple(r) for r in exact_dedup.dedup(spark, rows).collect())
    for broken in (lambda self, groups, batch=None: groups, lambda self, groups, batch=None: groups.limit(0)):
        monkeypatch.setattr(exact_dedup.DigestIndex, "fresh", broken)
        assert Counter(tuple(r) for r in exact_dedup.dedup(spark, rows).collect()) != sound
