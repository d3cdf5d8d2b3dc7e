"""Each labelled language is learned, whatever the vocabulary of the others."""

import zlib

from lorekeep.llm import language


def test_every_language_keeps_its_own_words(spark, monkeypatch):
    """Twelve languages with many frequent words, one of few words that each occur once: no word of a sampled document is left out."""
    name = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    rows = [(k * 40 + i, " ".join(f"w{name(k)}{name(j)} " * (60 - j) for j in range(40)), f"l{k:02}") for k in range(12) for i in range(8)]
    rows += [(9000 + i, f"rare{name(i)}", "few") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(d)
    assert model.langs == sorted({r[2] for r in rows})
    per = {}
    monkeypatch.setattr(language, "Model", lambda counts: per.update(counts))
    language.train(d)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert {lang: set(words) for lang, words in per.items()} == {lang: {w for _, t, x in learned if x == lang for w in t.split()} for lang in model.langs}
