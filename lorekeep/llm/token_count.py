"""Token counts of a byte-fallback pair-merging vocabulary, without emitting identifiers.

Method. White space becomes U+2581, one is put in front of a non-empty text, and the text is cut where
a run of them begins (no entry of the vocabulary has one after another character, which is checked).
In a chunk all characters are linked symbols; a heap gives the adjacent pair whose union has the
lowest rank, leftmost first, until none is left. The count is the number of symbols less that of
merges; a character outside the vocabulary that stays alone counts as its UTF-8 bytes.

Defined cases. Null or empty text: 0 bytes, 0 tokens. Very long texts without white space take n log n steps.
Repeated rows get equal results; null ids stay null; columns besides doc_id and text are ignored.
"""

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
LIMIT, CACHE = 4096, 400_000


class Merger:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.rank):
            raise ValueError("the vocabulary joins words; chunks can't be counted apart")

    def count(self, chunk: str) -> int:
        rank = self.rank
        n = len(chunk)
        symbols = list(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(chunk[i : i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heapify(heap)
        merges = 0
        while heap:
            r, i, length = heappop(heap)
            left = symbols[i]
            j = after[i]
            if left is None or j >= n or len(left) + len(symbols[j]) != length:
                continue
            joined = symbols[i] = left + symbols[j]
            symbols[j] = None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                both = joined + symbols[k]
                r = rank.get(both)
                if r is not None:
                    heappush(heap, (r, i, len(both)))
            h = before[i]
            if h >= 0:
                both = symbols[h] + joined
                r = rank.get(both)
                if r is not None:
                    heappush(heap, (r, h, len(both)))
        return n - merges + sum(len(c.encode()) - 1 for c in symbols if c is not None and c not in rank)


class Counts(dict):
    """Chunks counted so far; the older half goes when it is full."""

    def __init__(self, merger: Merger):
        self.merger, self.old = merger, {}

    def __missing__(self, chunk: str) -> int:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        found = self.old.get(chunk)
        found = self[chunk] = self.merger.count(chunk) if found is None else found
        return found

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, CHUNK.findall(SPACE + text.replace(" ", SPACE))))


#: Text that a normaliser, a user-defined piece or another treatment of spaces would change.
PROBE = " ﬁ ① Ａ\u3000é e\u0301\t\n  <s></s><unk> <0x41> \u200b▁▁x İ½ 𠮷 "


def checked(path: str) -> None:
    """Raise ValueError for a vocabulary whose library does more than merge."""
    from sentencepiece import SentencePieceProcessor

    if Counts(Merger(path)).text(PROBE) != len(SentencePieceProcessor(model_file=path).encode(PROBE)):
        raise ValueError(f"{path} normalises texts or has pieces of its own; counts would differ")


def count_tokens(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document. path: the vocabulary's file on every machine."""
    checked(path)

    def run(batches):
        counts = Counts(Merger(path))
        for batch in batches:
            texts = batch.column(1)
            n = pa.array([counts.text(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col("text").cast("string")
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
