"""Packing of token sequences by exact complements, then best fit.

Method. Texts are encoded, ended by one id 0, and cut where longer than a sequence. Only the histogram of
piece lengths (at most `limit` numbers) reaches the driver. There, from the longest length down, what a piece
leaves free is looked up among the lengths and in an index of the sums of two and of three lengths, and a
combination that fills it exactly is used as often as its lengths are there; the rest is placed best fit, longest
first. The plan says for each length which ranks go to which sequences; pieces get their rank among
those of their length by a bucketed prefix sum, so one length may hold any share of the pieces.

Defined cases. Null and empty texts are the single id 0. Repeated rows are packed once each. Null ids are kept. Columns besides
doc_id and text are ignored. An empty table gives an empty result. Special strings in texts are handled as the library does by default.
"""

import re
import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import Workspace, prefix_sum

LIMIT, CACHE = 2048, 300_000

#: Characters for which Python's rules are those of the tokenizer file: Latin letters, ASCII, general punctuation. Other texts go to the library whole.
OTHER = re.compile(r"[^\x00-\x1b\x20-\x84\x86-įı-ſ‐-‧]|<\|")
_L, _N = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼½¾"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Words to their ids as little-endian 32-bit bytes, remembered; the older half goes when full."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        found = self.old.get(word)
        if found is None:
            letters = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))
            found = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(letters))
        self[word] = found
        return found

    def ids(self, text: str | None) -> bytes:
        """The ids of a text and the closing 0, four bytes each."""
        if not text:
            return bytes(4)
        if OTHER.search(text):
            return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids) + bytes(4)
        return b"".join(map(self.__getitem__, PIECES.findall(text.lower()))) + bytes(4)


def pieces(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text)
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Sums:
    """The sums of one, two and three lengths that are there often enough, found by sum.

    For each sum the index holds the larger part at which a pair or a triple was last found. Lengths only
    run out, so what lies above that part stays impossible, and a sum is walked through once in all.
    """

    def __init__(self, left: dict[int, int], limit: int):
        self.left = left
        self.pairs, self.triples = list(range(limit + 1)), list(range(limit + 1))

    def _there(self, *lengths: int) -> bool:
        return all(self.left.get(x, 0) >= lengths.count(x) for x in lengths)

    def pair(self, total: int) -> list[int] | None:
        """The pair with the longest part."""
        a = min(self.pairs[total], total - 1)
        while 2 * a >= total and a > 0 and not self._there(a, total - a):
            a -= 1
        self.pairs[total] = a
        return [a, total - a] if 2 * a >= total and a > 0 else None

    def triple(self, total: int) -> list[int] | None:
        """The triple with the longest part."""
        a = min(self.triples[total], total - 2)
        while 3 * a >= total and a > 0:
            if self.left.get(a) and (found := self._rest(a, total - a)):
                self.triples[total] = a
                return [a, *found]
            a -= 1
        self.triples[total] = a
        return None

    def _rest(self, a: int, total: int) -> list[int] | None:
        """A pair of this sum, of parts up to a, that is there beside a."""
        found = self.pair(total)
        if found is None:
            return None
        for b in range(min(a, found[0]), (total - 1) // 2, -1):  # the indexed pair, or one below it
            if self._there(a, b, total - b):
                return [b, total - b]
        return None

    def filling(self, gap: int) -> list[int] | None:
        """One, two or three lengths that fill the gap exactly."""
        return [gap] if self.left.get(gap) else self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[int]]]:
    """(times, lengths) of the sequences. The number of entries is bounded by the lengths, not by the pieces."""
    left = {x: n for x, n in counts.items() if n}
    order = sorted(left, reverse=True)
    out: list[tuple[int, list[int]]] = []
    rest: dict[int, int] = {}
    sums = Sums(left, limit)
    for x in order:
        while left[x]:
            if x == limit:
                found = []
            else:
                left[x] -= 1
                found = sums.filling(limit - x)
                left[x] += 1
            if found is None:
                rest[x], left[x] = left[x], 0
                break
            each = [x, *found]
            times = min(left[y] // each.count(y) for y in each)
            for y in each:
                left[y] -= times
            out.append((times, each))
    open_: dict[int, list[list]] = defaultdict(list)  # free space -> [times, lengths]
    for x in sorted(rest, reverse=True):
        todo = rest[x]
        while todo:
            free = min((g for g in open_ if g >= x and open_[g]), default=None)
            if free is None:
                fit = limit // x
                for size in (fit, todo % fit):
                    times = todo // size if size else 0
                    if times:
                        open_[limit - size * x].append([times, [x] * size])
                        todo -= times * size
                    if not todo:
                        break
                break
            entry = open_[free][-1]
            times = min(entry[0], todo)
            entry[0] -= times
            if not entry[0]:
                open_[free].pop()
            open_[free - x].append([times, [*entry[1], x]])
            todo -= times
    return out + [(times, lengths) for entries in open_.values() for times, lengths in entries]


def places(planned: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, sequence of the first rank, offset) for each place of each entry."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for times, lengths in planned:
        offset = 0
        for x in lengths:
            out.append((x, rank[x], rank[x] + times, sequence, offset))
            rank[x] += times
            offset += x
        sequence += times
    return out


def pack(spark: SparkSession, documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    ws = Workspace(spark, "pack")
    cut = ws.keep(pieces(documents, path, limit), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    table = spark.createDataFrame(places(plan(counts, limit)), "plan_length long, from_rank long, to_rank long, sequence long, offset long")
    ranked = prefix_sum(cut.withColumn("one", F.lit(1).cast("long")), ["length"], ["doc_id", "piece", "ids_crc32"], "one", "rank")
    match = (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    joined = ranked.join(F.broadcast(table), match)  # bounded by the number of lengths, not by the pieces
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset")
