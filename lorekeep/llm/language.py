"""Language identification by words first, with backoff to ever shorter character n-grams.

Method. Each language keeps log frequencies of the words seen in training and of the character
n-grams (5 to 1 characters, with word ends marked) of those words. A known word counts by its log
frequency in each language; an unseen word by its n-grams of the greatest length of which at least
half are known, else of the next shorter length. The evidence of all words of the whole text is added.

Letters are those of Unicode category L: numerals such as a half, a superscript two or a Roman eight aren't.

Defined cases. Null text, or text without a letter: `und`, score 0. Rows of training data with null
lang or null text are left out. With no training rows each text is `und`. Ties go to the language first in
code-point order. One id on many rows, or none, is no reason to take or leave them together. Repeated rows get equal results; other columns are ignored, whatever their names.
"""

import math
import re
from collections import Counter, defaultdict
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import sample_key, small

#: Letters and numerals; pieces() keeps the letters.
WORDLIKE = re.compile(r"[^\W\d_]+")
#: The fit reads about this many documents of each language, chosen by a hash of id and text, and all words of them.
TRAIN_DOCS, LONGEST, CACHE = 500, 5, 400_000


def pieces(word: str) -> list[str]:
    """The runs of letters in a word of letters and numerals."""
    return [word] if word.isalpha() else ["".join(run) for letters, run in groupby(word, str.isalpha) if letters]


class Model:
    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        self.words: dict[str, tuple] = {}
        self.grams: list[dict[str, tuple]] = [{} for _ in range(LONGEST + 1)]
        if not self.langs:
            return
        self.words = self._table({lang: counts[lang] for lang in self.langs})
        for n in range(1, LONGEST + 1):
            by = {lang: Counter() for lang in self.langs}
            for lang in self.langs:
                for word, count in counts[lang].items():
                    for g in self._cut(word, n):
                        by[lang][g] += count
            self.grams[n] = self._table(by)

    @staticmethod
    def _cut(word: str, n: int) -> list[str]:
        marked = f"<{word}>"
        return [marked[i : i + n] for i in range(max(1, len(marked) - n + 1))]

    def _table(self, counts: dict[str, Counter]) -> dict[str, tuple]:
        keys = sorted(set().union(*counts.values()))
        total = {lang: sum(c.values()) + 0.5 * len(keys) for lang, c in counts.items()}
        return {k: tuple(math.log((counts[lang][k] + 0.5) / total[lang]) for lang in self.langs) for k in keys}

    def evidence(self, word: str) -> tuple:
        """Log frequencies of the word in each language, in the order of langs."""
        if word in self.words:
            return self.words[word]
        for n in range(LONGEST, 0, -1):
            cut = self._cut(word, n)
            known = [self.grams[n][g] for g in cut if g in self.grams[n]]
            if known and (2 * len(known) >= len(cut) or n == 1):
                return tuple(sum(x) / len(known) for x in zip(*known, strict=True))
        return (0.0,) * len(self.langs)

    def predict(self, text: str | None, seen: dict) -> tuple[str, float]:
        """seen: evidence of earlier words (empty for words without a letter), kept by the caller and emptied when full."""
        if not self.langs:
            return "und", 0.0
        total, read = [0.0] * len(self.langs), 0
        for word, count in Counter(WORDLIKE.findall((text or "").lower())).items():
            got = seen.get(word)
            if got is None:
                if len(seen) >= CACHE:
                    seen.clear()
                got = seen[word] = tuple(map(sum, zip(*map(self.evidence, pieces(word)), strict=True)))
            if got:
                read += count
            for i, x in enumerate(got):
                total[i] += count * x
        if not read:
            return "und", 0.0
        best = max(range(len(total)), key=lambda i: (total[i], -i))
        scale = min(1.0, 20 / read)
        return self.langs[best], 1 / sum(math.exp(max(-700.0, (x - total[best]) * scale)) for x in total)


def train(documents: DataFrame, docs: int = TRAIN_DOCS) -> Model:
    able = documents.filter((sample_key() != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    share = able.groupBy("lang").agg((F.lit(float(docs)) / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)  # rows of one id are taken or left one by one
    taken = able.join(small(share), "lang").filter(place < F.col("share"))
    words = taken.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, word, n in words.groupBy("lang", "word").count().toLocalIterator():  # as many as the sample has words
        counts[lang][word] = n
    return Model(counts)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        seen: dict = {}
        for batch in batches:
            found = [model.predict(t, seen) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (sample_key() == 1).alias("held_out"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame, docs: int = TRAIN_DOCS) -> DataFrame:
    return predict(documents, train(documents, docs))
