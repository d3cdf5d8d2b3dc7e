"""SimHash fingerprints, and the search for all within a Hamming radius by permuted block tables.

Method. Terms are a text's words (A-Z lower-cased) and pairs of neighbours; a term's weight grows with the logarithm of how often it is
there, and its hash votes for or against each of 128 bits. The votes are whole numbers, so a text has one fingerprint
wherever it is computed. For the search the bits are cut into radius + KEPT blocks: two fingerprints within the radius agree in
KEPT of them, so there is a table for each choice of KEPT blocks, whose key is these blocks' bits. Fingerprints that share a
key are compared, a pair in the first of the tables that it shares. Equal fingerprints are one row with a number of documents;
a key that many fingerprints share is cut into parts, and parts are compared as matrices, so no pair becomes a row.

Neighbours in order. edits() sorts documents by id in ranges, so that texts are moved once and each is read next to its follower; only
the first and last document of a range are set aside and joined to the next range.

Defined cases. A null text is empty; a text without words has fingerprint 0. Null ids come first, as Spark sorts. Rows with one id are
ordered by a hash of their texts, rows alike in both in any order (they give equal results but for the one that comes last, whose next text
differs). The next of the last document is the first, of a single one itself. An empty table gives no rows. Other columns
are ignored, whatever their names.
"""

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import Workspace, small

BITS, RADIUS, KEPT = 128, 3, 2
#: Words whose hash a task remembers; terms that vote at once; fingerprints in a part of a key; share of rows that ask (id divisible by it).
CACHE, TERMS, PART, ASKS = 400_000, 8192, 4096, 100
EDIT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, hi long, lo long"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Fingerprints of texts as Python integers of BITS bits; one for each task."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def _words(self, text: str) -> np.ndarray:
        words, seen = text.encode("utf-8", "surrogatepass").lower().split(), self.seen
        if len(seen) > CACHE:
            seen.clear()
        for w in set(words):
            if w not in seen:
                seen[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))

    def votes(self, text: str) -> np.ndarray:
        words = self._words(text)
        total = np.zeros(BITS)
        pairs = _mixed(words[:-1] + (words[1:] << np.uint64(1)) + np.uint64(1)) if len(words) > 1 else words[:0]
        terms, counts = np.unique(np.concatenate([words, pairs]), return_counts=True)
        weights = np.rint(16 * (1 + np.log2(counts)))
        for at in range(0, len(terms), TERMS):
            t = terms[at : at + TERMS]
            wide = np.stack([_mixed(t), _mixed(t + np.uint64(0x9E3779B97F4A7C15))], 1)
            bits = np.unpackbits(wide.view(np.uint8).reshape(len(t), -1), axis=1)
            total += weights[at : at + TERMS] @ (bits.astype(np.float64) * 2 - 1)
        return total

    def fingerprint(self, text: str | None) -> int:
        return int.from_bytes(np.packbits(self.votes(text or "") > 0).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    """The share of bits in which two fingerprints agree."""
    return 1 - (a ^ b).bit_count() / BITS


def _halves(fp: int) -> tuple[int, int]:
    return tuple(int.from_bytes((fp >> s & (1 << 64) - 1).to_bytes(8, "big"), "big", signed=True) for s in (64, 0))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), hi and lo (its halves) of every document."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            found = [hasher.fingerprint(t) for t in batch.column(1).to_pylist()]
            hi, lo = zip(*map(_halves, found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{f:032x}" for f in found], pa.string()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["doc_id", "fingerprint", "hi", "lo"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, hi long, lo long")


def edit(text: str, following: str) -> str:
    """text with its last quarter replaced by as much from the start of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _row(hasher: Hasher, doc_id, text: str, own: int, following: str, its: int) -> tuple:
    edited = edit(text, following)
    fp = hasher.fingerprint(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), f"{own:032x}", f"{fp:032x}", likeness(own, fp), likeness(own, its), *_halves(own))


def _batch(rows: list[tuple], edges: list[tuple] = ()) -> pa.RecordBatch:
    """Result rows, and rows set aside as (range, place, doc_id, text)."""
    shape = [("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("hi", pa.int64()), ("lo", pa.int64())]
    full = [(*r, None, None, None) for r in rows] + [(e[2], *[None] * 8, e[0], e[1], e[3]) for e in edges]
    columns = list(zip(*full, strict=True)) or [()] * 12
    kinds = [k for _, k in shape] + [pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [n for n, _ in shape] + ["part", "place", "edge"])


def _neighbours(batches):
    """A sorted range: each document with the one after it; its first and last one are set aside."""
    hasher, part, last = Hasher(), TaskContext.get().partitionId(), None
    for batch in batches:
        rows, edges = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            now = (doc_id, text, hasher.fingerprint(text))
            if last:
                rows.append(_row(hasher, *last, *now[1:]))
            else:
                edges.append((part, "first", doc_id, text))
            last = now
        yield _batch(rows, edges)
    if last:
        yield _batch([], [(part, "last", last[0], last[1])])


def _over_edges(batches):
    """Last documents of ranges (doc_id, edge) with the text that follows."""
    hasher = Hasher()
    for batch in batches:
        ids, texts, following = (c.to_pylist() for c in batch.columns)
        yield _batch([_row(hasher, i, t, hasher.fingerprint(t), f, hasher.fingerprint(f)) for i, t, f in zip(ids, texts, following, strict=True)]).select(range(9))


def edits(spark: SparkSession, documents: DataFrame, ws: Workspace) -> DataFrame:
    """Each document with its fingerprint and those of its edited text and of its follower."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", "_h", "_read"]
    ranged = slim.withColumns({"_h": F.xxhash64("text"), "_read": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    found = ws.keep(ranged.select("doc_id", "text").mapInArrow(_neighbours, f"{EDIT}, part int, place string, edge string"), "found")
    parts = sorted(r.part for r in found.filter("place = 'first'").select("part").collect())  # a row a range
    follows = spark.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "part int, next int")
    first = found.filter("place = 'first'").select(F.col("part").alias("next"), F.col("edge").alias("following"))
    last = found.filter("place = 'last'").select("part", "doc_id", "edge").join(follows, "part").join(first, "next")
    names = [c.split()[0] for c in EDIT.split(", ")]
    over = last.select("doc_id", "edge", "following").mapInArrow(_over_edges, EDIT)
    return found.filter("place is null").select(*names).unionByName(over)


def block_tables(radius: int, kept: int = KEPT) -> list[tuple[int, int]]:
    """The bits (of the high and the low half, as signed longs) that the key of each table has."""
    n = radius + kept
    cuts = [BITS * k // n for k in range(n + 1)]
    block = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [_halves(sum(chosen)) for chosen in combinations(block, kept)]


def _count(radius: int, tables: list[tuple[int, int]]):
    masks = np.array(tables, np.int64)

    def run(batches):
        for batch in batches:
            found: dict[tuple[int, int], int] = {}
            for t, qh, ql, ch, cl, docs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ch, cl, docs = np.array(ch, np.int64), np.array(cl, np.int64), np.array(docs, np.int64)
                for h, low in zip(qh, ql, strict=True):
                    xh, xl = ch ^ h, cl ^ low
                    near = np.flatnonzero(np.bitwise_count(xh.view(np.uint64)).astype(int) + np.bitwise_count(xl.view(np.uint64)) <= radius)
                    earlier = ((xh[near, None] & masks[None, :t, 0]) | (xl[near, None] & masks[None, :t, 1]) == 0).any(1)
                    found[h, low] = found.get((h, low), 0) + int(docs[near[~earlier]].sum())
            hi, lo = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(list(found.values()), pa.int64())], ["hi", "lo", "n"])

    return run


def within(table: DataFrame, queries: DataFrame, ws: Workspace, radius: int = RADIUS, kept: int = KEPT) -> DataFrame:
    """hi, lo, n of each query (hi, lo): how many documents of the table (hi, lo, docs) have a fingerprint within the radius."""
    tables, keys = block_tables(radius, kept), ["t", "k1", "k2"]
    made = F.array(*[F.struct(F.lit(t).alias("t"), F.col("hi").bitwiseAND(F.lit(a)).alias("k1"), F.col("lo").bitwiseAND(F.lit(b)).alias("k2")) for t, (a, b) in enumerate(tables)])
    keyed = lambda df: df.select("*", F.explode(made).alias("k")).select(*df.columns, "k.*")
    asked = ws.keep(keyed(queries), "asked")
    met = ws.keep(keyed(table).join(small(asked.select(*keys).distinct()), keys, "left_semi"), "met")

    def parts(df, *collected):
        many = df.groupBy(*keys).count().filter(F.col("count") > PART).select(*keys, F.ceil(F.col("count") / PART).alias("parts"))
        cut = df.join(small(many), keys, "left").withColumn("part", F.pmod(F.xxhash64("hi", "lo"), F.coalesce("parts", F.lit(1))))
        return cut.groupBy(*keys, "part").agg(F.collect_list(F.struct(*collected)).alias("r")).drop("part")

    sides = parts(asked, "hi", "lo").withColumnRenamed("r", "q").join(parts(met, "hi", "lo", "docs"), keys)
    counted = sides.select("t", "q.hi", "q.lo", F.col("r.hi").alias("ch"), F.col("r.lo").alias("cl"), "r.docs").mapInArrow(_count(radius, tables), "hi long, lo long, n long")
    return counted.groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def compare(spark: SparkSession, documents: DataFrame, radius: int = RADIUS, asks: int = ASKS) -> DataFrame:
    """edits() with n_near: the number of documents whose fingerprint is within the radius, for documents whose id is divisible by asks."""
    ws = Workspace(spark, "fingerprints")
    rows = ws.keep(edits(spark, documents, ws), "rows")
    asking = F.coalesce(F.col("doc_id") % asks == 0, F.lit(False))
    table = ws.keep(rows.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("docs"), F.max(asking).alias("asks")), "table")
    near = within(table.select("hi", "lo", "docs"), table.filter("asks").select("hi", "lo"), ws, radius)
    near = small(ws.keep(near.withColumnRenamed("n", "n_near"), "near"))
    told = rows.filter(asking).join(near, ["hi", "lo"], "left").unionByName(rows.filter(~asking).withColumn("n_near", F.lit(None).cast("long")))
    return told.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")
