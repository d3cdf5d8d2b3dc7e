"""Exact n-gram Jaccard join by signature trees, with components instead of pairs.

Method. A document is the set of 64-bit hashes of its word shingles. In a block of candidates a signature tree is
built: leaves are documents with a bitmap of their shingles, inner nodes hold the OR of the bitmaps below and the
range of sizes, and the tree is traversed against itself, dropping pairs of nodes whose largest possible
overlap is too small. What is left is checked on the whole sets, unless the two are already known to be connected.
A tree over a whole corpus would prune nothing, its upper bitmaps being full, so blocks come first.

Blocks. All sets are put in one order, rare shingles first; sets that reach the threshold share one of their first
n - ceil(threshold * n) + 1. The order: hashes below a cut (SPREAD times the share that may differ), by the number of
documents that have them; then the others by hash. Numbers of documents are counted exactly, by hash, for the hashes below the cut;
one that a batch holds HOT times counts as the most frequent without being counted. A shingle of one document only takes its place in the
order and meets nothing, so documents that merely share passages meet nowhere. Documents that meet are held
against each other's size, the places of the shingle in both orders, and 512 parity bits of each set, whose Hamming
distance is at most the number of shingles in which two sets differ. The order decides only how many candidates there are, never which links are found.

Skew. Equal sets are one representative. Of a bucket over FEW documents a batch sends FEW + 1
(all become star edges where they are, as does a bucket over FEW in all). Blocks over TILE documents are cut into tiles that share
a few pivots; after linking inside tiles only tiles of different components meet, so a group of
copies that is connected costs as much as its tiles. No pair of documents is dropped for its number.

Defined cases. Null or empty texts, or texts of white space, have the empty set and link with nothing
(component_id is their own id). A text with fewer words than a shingle is one shingle. Rows that share a
doc_id are one vertex, with the links of each; a null doc_id is linked only through an equal set. Columns besides doc_id and text are ignored.
Two different shingles share a hash with probability 2^-64; two sets a digest with 2^-128.
"""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import Workspace, components, small

TILE, TILE_SHINGLES, PIVOTS, FAN, FEW = 256, 4_000_000, 8, 4, 32
#: Hashes are counted up to SPREAD times the share of a set that may differ; of HOT in a batch only the hash is sent.
SPREAD, HOT = 2.5, 64
#: Bytes and rows hashed at once; shingles sent at once; entries of one part of an exchange.
BLOCK, ROWS, FLUSH, PART = 1 << 20, 1024, 1_000_000, 2_000_000
#: Levels of the order: by the logarithm of the number of documents, hot hashes, hashes that aren't counted.
TOP, LAST = 250, 255

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP = [_U(int(x) | 1) for x in _RNG.integers(1, 1 << 63, 64, dtype=np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RADIX = int(_STEP[0])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


@cache
def _powers(inverse: bool) -> np.ndarray:
    """Powers 0..BLOCK of the radix modulo 2^64, or of its inverse."""
    step = pow(_RADIX, -1, 1 << 64) if inverse else _RADIX
    return np.cumprod(np.concatenate([[_U(1)], np.full(BLOCK, step, _U)]), dtype=_U)


def _spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and polynomial of each word of data; words end at cuts too."""
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts], last[cuts - 1] = word[cuts], word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    upto = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * _powers(False)[: len(data)], out=upto[1:])
    return starts, ends, (upto[ends] - upto[starts]) * _powers(True)[starts]


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of data, whose A-Z count as a-z. Long data is taken in blocks; a word may span any number of them."""
    parts, held, length = [], 0, 0
    view = np.frombuffer(data, np.uint8)
    for at in range(0, len(view), BLOCK):
        block = view[at : at + BLOCK]
        starts, ends, values = _spans(block, np.zeros(0, np.int64))
        sizes = (ends - starts).astype(_U)
        if length:  # the last block ended inside a word
            if len(starts) and starts[0] == 0:
                values[0] = _U((held + pow(_RADIX, length, 1 << 64) * int(values[0])) % (1 << 64))
                sizes[0] += _U(length)
            else:
                parts.append(_finish(np.array([held], _U), np.array([length], _U)))
        length = 0
        if len(ends) and ends[-1] == len(block):
            held, length = int(values[-1]), int(sizes[-1])
            values, sizes = values[:-1], sizes[:-1]
        parts.append(_finish(values, sizes))
    if length:
        parts.append(_finish(np.array([held], _U), np.array([length], _U)))
    return np.concatenate(parts) if parts else np.zeros(0, _U)


def _finish(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mixed(values + sizes * _STEP[1])


def _shingled(words: np.ndarray, take: int) -> np.ndarray:
    """Hashes of every run of take words."""
    n = len(words) - take + 1
    total = np.full(n, _STEP[40 + take % 20] * _U(take))
    for k in range(take):
        total += words[k : n + k] * _STEP[2 + k % 32]
    return mixed(total)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    with np.errstate(over="ignore"):
        words = word_hashes(b"" if text is None else text)
        return np.unique(_shingled(words, min(shingle, len(words)))) if len(words) else words


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[list[np.ndarray]]:
    """shingle_set of each text, in lists of at most ROWS texts and about BLOCK bytes."""
    if not len(texts):
        return
    texts = texts.cast(pa.binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = min(row + ROWS, int(np.searchsorted(ends, ends[row] + BLOCK, "right")) - 1)
        if stop <= row:
            yield [shingle_set(data[ends[row] : ends[row + 1]], shingle)]
            row += 1
        else:
            yield _chunk(data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row], shingle)
            row = stop


def _chunk(data: np.ndarray, bounds: np.ndarray, shingle: int) -> list[np.ndarray]:
    sets = [np.zeros(0, _U)] * (len(bounds) - 1)
    with np.errstate(over="ignore"):
        starts, ends, values = _spans(data, bounds)
        if not len(starts):
            return sets
        words = _finish(values, (ends - starts).astype(_U))
        at = np.searchsorted(starts, bounds)  # words before each document
        count = np.diff(at)
        if len(words) >= shingle:
            runs = _shingled(words, shingle)
            for i in np.flatnonzero(count >= shingle).tolist():
                found = np.sort(runs[at[i] : at[i + 1] - shingle + 1])
                sets[i] = found if len(found) < 2 else found[np.concatenate([[True], found[1:] != found[:-1]])]
        for take in range(1, shingle):
            for i in np.flatnonzero(count == take).tolist():
                sets[i] = _shingled(words[at[i] : at[i + 1]], take)
    return sets


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of consecutive runs of values."""
    upto = np.zeros(len(values) + 1, _U)
    np.cumsum(values, out=upto[1:])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """512 bits a set, as rows of 64 bytes: whether an odd number of its hashes fall on a bit."""
    sizes = np.array([len(s) for s in sets])
    where = np.repeat(np.arange(len(sets)) * 512, sizes) + (np.concatenate(sets) >> _U(55)).astype(np.int64)
    return np.packbits((np.bincount(where, minlength=512 * len(sets)) & 1).astype(bool).reshape(-1, 512), axis=1)


def may_link(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these parities and sizes may reach the threshold."""
    apart = np.bitwise_count(x.view(_U).reshape(-1, 8) ^ y.view(_U).reshape(-1, 8)).sum(1, dtype=np.int64)
    return apart * (100 + percent) <= (100 - percent) * (nx + ny)


def _signed(x) -> np.ndarray:
    return np.asarray(x, _U).view(np.int64)


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    """A part for each 64-bit value."""
    with np.errstate(over="ignore"):
        return ((mixed(x.view(_U)) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _facts(sets: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Size, two digests, and a key made of id and digests, of each set."""
    sizes = np.array([len(s) for s in sets])
    found = np.concatenate(sets)
    with np.errstate(over="ignore"):
        d1, d2 = (_sums(mixed(found ^ _STEP[k]), sizes) for k in (60, 61))
        return sizes, d1, d2, mixed(mixed(d1 + ids.view(_U) * _STEP[62]) ^ d2)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy().astype(np.int64)


def describe(documents: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n (size of the set), d1 and d2 (its digest), key (of id and digest), parity."""
    names = ["doc_id", "n", "d1", "d2", "key", "parity"]

    def run(batches):
        for batch in batches:
            row = 0
            for sets in shingle_sets(batch.column(1), shingle):
                column = batch.column(0).slice(row, len(sets))
                row += len(sets)
                n, d1, d2, key = _facts(sets, _ids(column))
                bits = parities(sets)
                parity = pa.Array.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer(np.arange(0, 64 * len(sets) + 1, 64, dtype=np.int32)), pa.py_buffer(bits.tobytes())])
                yield pa.RecordBatch.from_arrays([column, pa.array(n, pa.int64()), *(pa.array(_signed(x)) for x in (d1, d2, key)), parity], names)

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, key long, parity binary")


#: Rows of the exchanges. Kinds: shingles to count; hot hashes; documents (nodes, sizes, counted shingles); places in the order (levels).
_SENT = "part long, kind int, a binary, b binary, c binary"
_COUNT, _MARK, _DOC, _PLACE = range(4)


def _batch(rows: list[tuple], columns: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [c.split() for c in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(names)], [n for n, _ in names])


def _dealt(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(part, its rows of each column) of every part there is."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, int)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield (int(part[a]), *(c[a:b] for c in columns))


def _placed(nodes: np.ndarray, hashes: np.ndarray, levels: np.ndarray, parts: int) -> list[tuple]:
    return [(p, _PLACE, h.tobytes(), d.tobytes(), v.tobytes()) for p, h, d, v in _dealt(_part(nodes, parts), hashes, nodes, levels)]


def send(texts: DataFrame, shingle: int, percent: int, parts: int) -> DataFrame:
    """What documents (doc_id, twin, text) send to be counted and placed. Documents of a doubled id (twin) go by their key."""
    cut = _U(min((1 << 64) - 1, int(SPREAD * (100 - percent) / 100 * (1 << 64))))
    below = lambda s: int(np.searchsorted(s, cut))

    def flush(sets: list[np.ndarray], nodes: np.ndarray) -> pa.RecordBatch:
        size, low = np.array([len(s) for s in sets]), np.array([below(s) for s in sets])
        first = size + percent * size // -100 + 1
        rows = [(p, _DOC, d.tobytes(), n.tobytes(), c.tobytes()) for p, d, n, c in _dealt(_part(nodes, parts), nodes, size, low)]
        late = [s[k : max(k, t)] for s, k, t in zip(sets, low.tolist(), first.tolist(), strict=True)]
        hashes, owner = np.concatenate(late), np.repeat(nodes, [len(x) for x in late])
        rows += _placed(owner, hashes, np.full(len(hashes), LAST, np.uint8), parts)
        hashes, owner = np.concatenate([s[:k] for s, k in zip(sets, low.tolist(), strict=True)]), np.repeat(nodes, low)
        order = np.argsort(hashes)
        hashes, owner = hashes[order], owner[order]
        start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, int)
        times = np.diff(np.append(start, len(hashes)))
        rows += [(p, _MARK, h.tobytes(), b"", b"") for p, h in _dealt(_part(hashes[start[times >= HOT]], parts), hashes[start[times >= HOT]])]
        hot = np.repeat(times >= HOT, times)
        rows += _placed(owner[hot], hashes[hot], np.full(int(hot.sum()), TOP, np.uint8), parts)
        for p, h, d in _dealt(_part(hashes[~hot], parts), hashes[~hot], owner[~hot]):
            who, index = np.unique(d, return_inverse=True)
            rows.append((p, _COUNT, h.tobytes(), who.tobytes(), index.astype(np.uint16 if len(who) <= 1 << 16 else np.uint32).tobytes()))
        return _batch(rows, _SENT)

    def run(batches):
        held, nodes, n = [], [], 0
        for batch in batches:
            row = 0
            for sets in shingle_sets(batch.column(2), shingle):
                ids, twin = _ids(batch.column(0).slice(row, len(sets))), batch.column(1).slice(row, len(sets)).to_numpy(zero_copy_only=False).astype(bool)
                row += len(sets)
                node = np.where(twin, _signed(_facts(sets, ids)[3]), ids) if twin.any() else ids
                there = [i for i, s in enumerate(sets) if len(s)]
                held += [sets[i] for i in there]
                nodes.append(node[there])
                n += sum(len(s) for s in sets)
                if n >= FLUSH:
                    yield flush(held, np.concatenate(nodes))
                    held, nodes, n = [], [], 0
        if held:
            yield flush(held, np.concatenate(nodes))

    return texts.select("doc_id", "twin", "text").mapInArrow(run, _SENT)


def _runs(batches) -> Iterator[list[tuple]]:
    """Rows of batches sorted by their first column, by runs of it."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _join(parts, kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def _by_part(sent: DataFrame, parts: int) -> DataFrame:
    return sent.repartition(parts, "part").sortWithinPartitions("part")


def levels(sent: DataFrame, parts: int) -> DataFrame:
    """The places of shingles that more than one document has, instead of those that were to be counted."""

    def run(batches):
        for rows in _runs(batches):
            on = [r for r in rows if r[1] in (_DOC, _PLACE)]
            for k in range(0, len(on), 512):
                yield _batch(on[k : k + 512], _SENT)
            some = [r for r in rows if r[1] == _COUNT]
            if not some:
                continue
            hashes = _join([r[2] for r in some], _U)
            nodes = np.concatenate([(who := _join([r[3]], np.int64))[_join([r[4]], np.uint16 if len(who) <= 1 << 16 else np.uint32)] for r in some])
            order = np.argsort(hashes)
            hashes, nodes = hashes[order], nodes[order]
            first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            start = np.flatnonzero(first)
            times = np.diff(np.append(start, len(hashes)))
            level = np.minimum(TOP - 1, 8 * np.log2(times)).astype(np.uint8)
            level[np.isin(hashes[start], _join([r[2] for r in rows if r[1] == _MARK], _U))] = TOP
            each = np.repeat(level, times)
            more = each > 0
            if more.any():
                yield _batch(_placed(nodes[more], hashes[more], each[more], parts), _SENT)

    return _by_part(sent, parts).mapInArrow(run, _SENT)


#: Signatures of an exchange: hashes, nodes, (size, place) of each; or star edges.
_PACK = "part long, sigs binary, docs binary, facts binary, ends binary"


def first_places(nodes: np.ndarray, size: np.ndarray, counted: np.ndarray, hashes: np.ndarray, owner: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """(hash, node, size, place) of the shared shingles among the first of each node. nodes, size, counted: a row a node; the others a row a place."""
    nodes, one = np.unique(nodes, return_index=True)
    size, counted = size[one], counted[one]
    order = np.lexsort((hashes, level, owner))
    hashes, owner, level = hashes[order], owner[order], level[order]
    if len(hashes):
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])
        hashes, owner, level = hashes[new], owner[new], level[new]
    at = np.searchsorted(nodes, owner)
    shared = np.bincount(at[level < LAST], minlength=len(nodes))
    start = np.searchsorted(owner, nodes)
    place = np.arange(len(owner)) - start[at] + (counted - shared)[at]
    keep = place < (size + percent * size // -100 + 1)[at]
    return hashes[keep], owner[keep], size[at[keep]], place[keep]


def _meet(sigs: np.ndarray, docs: np.ndarray, facts: np.ndarray, percent: int, forward: bool) -> tuple[np.ndarray, ...]:
    """Of documents with equal signatures: (signatures, documents and facts to send on, star edges of large buckets, pairs of small ones).

    With forward, small buckets are sent on whole and of large ones FEW + 1 documents; pairs are left to the receiver.
    """
    order = np.lexsort((docs, sigs))
    sigs, docs, facts = sigs[order], docs[order], facts[order]
    none = np.zeros((0, 2), np.int64)
    if not len(sigs):
        return sigs, docs, facts, none, none
    new = np.concatenate([[True], (sigs[1:] != sigs[:-1]) | (docs[1:] != docs[:-1])])
    sigs, docs, facts = sigs[new], docs[new], facts[new]
    first = np.concatenate([[True], sigs[1:] != sigs[:-1]])
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(sigs)))
    large = np.repeat(size > FEW, size)
    hub = np.repeat(docs[start], size)
    star = np.unique(np.stack([hub, docs], 1)[large & ~first], axis=0) if large.any() else none
    if forward:
        kept = ~large | (np.arange(len(sigs)) - np.repeat(start, size) <= FEW)  # enough to show that it is large
        return sigs[kept], docs[kept], facts[kept], star, none
    pairs = [none]
    for m in np.unique(size[(size > 1) & (size <= FEW)]).tolist():
        rows = start[size == m][:, None] + np.arange(m)
        i, j = np.triu_indices(m, 1)
        i, j = rows[:, i].ravel(), rows[:, j].ravel()
        (ni, pi), (nj, pj) = facts[i].T, facts[j].T
        # where two sets meet first, all places before are shingles of one of them only
        able = ((pi + pj) * (100 + percent) <= (100 - percent) * (ni + nj)) & (100 * ni >= percent * nj) & (100 * nj >= percent * ni)
        pairs.append(np.stack([docs[i[able]], docs[j[able]]], 1))
    return sigs, docs, facts, star, np.unique(np.concatenate(pairs), axis=0)


def place(levelled: DataFrame, percent: int, parts: int) -> DataFrame:
    """Signatures of documents by part; star edges of equal ones go along."""

    def run(batches):
        for rows in _runs(batches):
            some, at = [r for r in rows if r[1] == _DOC], [r for r in rows if r[1] == _PLACE]
            nodes, size, counted = (_join([r[k] for r in some], np.int64) for k in (2, 3, 4))
            sigs, docs, n, where = first_places(nodes, size, counted, _join([r[2] for r in at], _U), _join([r[3] for r in at], np.int64), _join([r[4] for r in at], np.uint8), percent)
            sigs, docs, facts, star, _ = _meet(sigs, docs, np.stack([n, where], 1).astype(np.int64), percent, True)
            out = [(p, s.tobytes(), d.tobytes(), f.astype(np.uint32).tobytes(), b"") for p, s, d, f in _dealt(_part(sigs, parts), sigs, docs, facts)]
            for k in range(0, len(star), 4096):
                out.append((int(star[k, 0] + star[k, 1]) % parts, b"", b"", b"", star[k : k + 4096].tobytes()))
            for k in range(0, len(out), 512):
                yield _batch(out[k : k + 512], _PACK)

    return _by_part(levelled, parts).mapInArrow(run, _PACK)


def _pairs(edges: np.ndarray, *more) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(edges[:, 0])), pa.array(np.ascontiguousarray(edges[:, 1])), *more]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "sure"][: len(columns)])


def meeting(packed: DataFrame, percent: int, parts: int) -> DataFrame:
    """(a, b, sure): pairs of documents that meet and may link; of large buckets, edges that connect them all, marked sure."""

    def run(batches):
        for rows in _runs(batches):
            facts, ends = _join([r[3] for r in rows], np.uint32).reshape(-1, 2).astype(np.int64), _join([r[4] for r in rows], np.int64).reshape(-1, 2)
            _, _, _, star, pairs = _meet(_join([r[1] for r in rows], _U), _join([r[2] for r in rows], np.int64), facts, percent, False)
            for edges, sure in ((np.unique(np.concatenate([star, ends]), axis=0), True), (pairs, False)):
                for k in range(0, len(edges), 100_000):
                    part = edges[k : k + 100_000]
                    yield _pairs(part, pa.array(np.full(len(part), sure)))

    return _by_part(packed, parts).mapInArrow(run, "a long, b long, sure boolean")


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose parities allow a link, and the sure ones. nodes: node, n, parity."""

    def run(batches):
        for batch in batches:
            a, b, na, nb = (c.to_numpy() for c in batch.columns[:4])
            x, y = (_join(batch.column(k).to_pylist(), np.uint8) for k in (4, 5))
            keep = may_link(x, y, na, nb, percent)
            if keep.any():
                yield _pairs(np.stack([a[keep], b[keep]], 1))

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("parity").alias("xa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("xb"))
    full = pairs.filter("not sure").select("a", "b").join(left, "a").join(right, "b")
    return full.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long").union(pairs.filter("sure").select("a", "b"))


class Tree:
    """Signature tree over sets: level 0 is the documents, each level above joins FAN nodes of the one below."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, percent: int):
        self.percent = percent
        size = np.array([len(s) for s in sets])
        bits = min(16, max(8, int(2 * size.max() - 1).bit_length()))
        maps = np.zeros((len(sets), 1 << bits), bool)
        for i, s in enumerate(sets):
            maps[i, (s >> _U(64 - bits)).astype(np.int64)] = True
        spill = size - maps.sum(1)
        level = {"or": np.packbits(maps, axis=1).view(np.uint64), "lo": size, "hi": size, "spill": spill, "l0": labels, "l1": labels}
        self.levels = [level]
        while len(level["lo"]) > FAN:
            at = np.arange(0, len(level["lo"]), FAN)
            ways = {"or": np.bitwise_or, "lo": np.minimum, "hi": np.maximum, "spill": np.maximum, "l0": np.minimum, "l1": np.maximum}
            level = {k: f.reduceat(level[k], at, axis=0) for k, f in ways.items()}
            self.levels.append(level)

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether documents below nodes a and b may link and aren't known to be connected."""
        x, p = self.levels[level], self.percent
        keep = (100 * x["hi"][a] >= p * x["lo"][b]) & (100 * x["hi"][b] >= p * x["lo"][a])
        keep &= (x["l0"][a] != x["l1"][b]) | (x["l1"][a] != x["l0"][b])
        for k in range(0, len(a), 2048):
            s = slice(k, k + 2048)
            i, j = a[s], b[s]
            overlap = np.bitwise_count(x["or"][i] & x["or"][j]).sum(1, dtype=np.int64) + np.minimum(x["spill"][i], x["spill"][j])
            overlap = np.minimum(overlap, np.minimum(x["hi"][i], x["hi"][j]))
            keep[s] &= overlap * (100 + p) >= p * (x["lo"][i] + x["lo"][j])
        return keep

    def candidates(self) -> np.ndarray:
        """Pairs of documents that the dual traversal leaves, near ones first."""
        top = len(self.levels) - 1
        a, b = np.triu_indices(len(self.levels[top]["lo"]))
        for level in range(top, -1, -1):
            n = len(self.levels[level]["lo"])
            if level < top:
                grid = np.arange(FAN)
                a = (a[:, None, None] * FAN + grid[:, None] + 0 * grid).reshape(-1)
                b = (b[:, None, None] * FAN + grid[None] + 0 * grid[:, None]).reshape(-1)
                inside = (a < n) & (b < n) & (a <= b)
                a, b = a[inside], b[inside]
            if level == 0:
                a, b = a[a < b], b[a < b]
            keep = self.possible(level, a, b)
            a, b = a[keep], b[keep]
        order = np.argsort(b - a, kind="stable")
        return np.stack([a[order], b[order]], 1)


def linked(ids: list[int], labels: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges of a forest that connects what links among these documents, given that equal labels are connected."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), int(sets[i][0]) if len(sets[i]) else 0, ids[i]))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    known, mark = {}, [labels[i] for i in order]
    label = np.array([known.setdefault(x, len(known)) for x in mark])
    parent = list(range(len(known)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges = []
    for i, j in Tree(sets, label, percent).candidates().tolist():
        x, y = top(label[i]), top(label[j])
        if x == y:
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[max(x, y)] = min(x, y)
            edges.append((ids[i], ids[j]))
    return edges


def link_units(texts: DataFrame, wanted: DataFrame, shingle: int, percent: int, partitions: int) -> DataFrame:
    """Forest edges inside each unit of wanted (unit array<long>, node, label, doc_id). texts: doc_id, twin, text."""

    def sets(batches):
        """(unit, node, label, set) of each row."""
        for batch in batches:
            units, nodes, labels, ids = (c.to_numpy() for c in batch.columns[:4])
            row = 0
            for found in shingle_sets(batch.column(5), shingle):
                these = slice(row, row + len(found))
                row += len(found)
                twin = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)[these]
                mine = np.where(twin, _signed(_facts(found, ids[these])[3]), ids[these]) == nodes[these]
                for k in np.flatnonzero(mine).tolist():
                    yield int(units[these][k]), int(nodes[these][k]), int(labels[these][k]), found[k]

    def run(batches):
        held: list[tuple] = []

        def edges():
            one = {r[1]: r for r in held}  # rows repeated under one id are one
            return linked(list(one), [r[2] for r in one.values()], [r[3] for r in one.values()], percent)

        out: list[tuple[int, int]] = []
        for row in sets(batches):
            if held and held[0][0] != row[0]:
                out += edges()
                held = []
                if len(out) > 10_000:
                    yield _pairs(np.array(out, np.int64))
                    out = []
            held.append(row)
        out += edges() if held else []
        if out:
            yield _pairs(np.array(out, np.int64))

    each = texts.join(wanted, "doc_id").select(F.explode("unit").alias("unit"), "node", "label", "doc_id", "twin", "text")
    return each.repartition(partitions, "unit").sortWithinPartitions("unit", "node").mapInArrow(run, "a long, b long")


def _second_round(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Units for pairs of tiles of a block that hold different components: (unit, node, label, doc_id). members: block, node, doc_id, n of large blocks."""
    rows = members.join(small(labels.select("node", F.col("comp").alias("label"))), "node", "left").withColumn("label", F.coalesce("label", "node"))
    per = rows.groupBy("block", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    per = per.withColumn("w", F.ceil(F.greatest(F.col("c") / TILE, F.col("s") / TILE_SHINGLES)))
    light = lambda c: F.sum(F.when(F.col("w") <= 1, F.col(c)).otherwise(0))
    many = per.groupBy("block").agg(F.count(F.lit(1)).alias("labels"), F.ceil(F.greatest(light("c") / TILE, light("s") / TILE_SHINGLES, F.lit(1))).alias("rest"))
    rows = rows.join(small(many.filter("labels > 1")), "block").join(small(per.select("block", "label", "w")), ["block", "label"])
    alone = F.col("w") > 1
    ordinal = lambda c, n: F.pmod(F.xxhash64(c, F.lit(7)), n)
    rows = rows.withColumn("owner", F.when(alone, F.col("label"))).withColumn("tile", F.when(alone, ordinal("node", F.col("w"))).otherwise(ordinal("label", F.col("rest"))))
    rows = rows.withColumn("tile", F.xxhash64("block", F.coalesce("owner", F.lit(-1)), F.col("owner").isNull(), "tile"))
    tiles = rows.groupBy("block", "tile").agg(F.first("owner").alias("owner"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = tiles.alias("x"), tiles.alias("y")
    meet = (F.col("x.block") == F.col("y.block")) & (F.col("x.tile") <= F.col("y.tile")) & ~F.coalesce(F.col("x.owner") == F.col("y.owner"), F.lit(False))
    meet &= (F.col("x.hi") * 100 >= F.col("y.lo") * percent) & (F.col("y.hi") * 100 >= F.col("x.lo") * percent)
    pairs = x.join(y, meet).select(F.col("x.block").alias("block"), F.xxhash64("x.block", "x.tile", "y.tile").alias("unit"), F.array_distinct(F.array("x.tile", "y.tile")).alias("both"))
    units = pairs.select("block", "unit", F.explode("both").alias("tile"))
    return rows.join(small(units), ["block", "tile"]).groupBy("node", "label", "doc_id").agg(F.collect_set("unit").alias("unit")).select("unit", "node", "label", "doc_id")


def link(spark: SparkSession, documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; links are 100 * intersection >= percent * union."""
    ws = Workspace(spark, "near-dup")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_sets = ws.keep(describe(documents, shingle), "sets")
    equal = all_sets.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1 and rep is not null")
    named = all_sets.join(small(ws.keep(equal.drop("c"), "equal")), ["d1", "d2"], "left")
    able = named.filter("doc_id is not null and n > 0")
    # rows an id has, and those of them that stand for their set; only ids to leave out, or that more than one row has, are told to the texts
    ids = able.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.expr("rep is null or rep = doc_id"), 1)).alias("own"))
    told = small(ws.keep(ids.filter("own = 0 or rows > 1").select("doc_id", F.expr("own = 0").alias("out"), F.expr("rows > 1").alias("twin")), "told"))
    with_told = lambda df: df.join(told, "doc_id", "left").filter("out is null or not out").withColumn("twin", F.coalesce("twin", F.lit(False)))
    nodes = with_told(able).select("doc_id", F.when(F.col("twin"), F.col("key")).otherwise(F.col("doc_id")).alias("node"), "twin", "n", "parity")
    nodes = ws.keep(nodes.filter("not twin").union(nodes.filter("twin").dropDuplicates(["node"])), "nodes")
    texts = with_told(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null"))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    parts = max(2 * partitions, int(total * min(1, SPREAD * (100 - percent) / 100)) // PART + 1)
    met = meeting(place(levels(send(texts, shingle, percent, parts), parts), percent, parts), percent, parts)
    pairs = ws.keep(met.groupBy("a", "b").agg(F.max("sure").alias("sure")), "met")
    edges = ws.keep(plausible(pairs, nodes, percent), "edges")
    blocks = components(edges, ws, "blocks").withColumnRenamed("comp", "block")
    members = ws.keep(nodes.select("node", "doc_id", "n").join(small(blocks), "node"), "members")
    wide = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_SHINGLES)).cast("long")
    tiles = ws.keep(members.groupBy("block").agg(wide.alias("tiles"), F.count(F.lit(1)).alias("c")), "tiles")
    placed = members.join(small(tiles), "block")
    pivot = (F.col("tiles") > 1) & (F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("c") / PIVOTS)) == 0)
    tile = lambda t: F.when(F.col("tiles") == 1, F.col("block")).otherwise(F.xxhash64("block", t))
    unit = F.when(pivot, F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), tile)).otherwise(F.array(tile(F.pmod(F.xxhash64("node"), F.col("tiles")))))
    wanted = small(ws.keep(placed.select(unit.alias("unit"), "node", F.col("node").alias("label"), "doc_id"), "units"))
    links = ws.keep(link_units(texts, wanted, shingle, percent, parts), "links")
    large = placed.filter("tiles > 1").select("block", "node", "doc_id", "n")
    if large.limit(1).count():
        labels = components(links, ws, "tiles")
        again = ws.keep(_second_round(large, labels, percent), "again")
        if again.limit(1).count():
            links = links.union(ws.keep(link_units(texts, small(again), shingle, percent, parts), "links2"))
    twins = nodes.filter("twin").select("node", F.col("doc_id").alias("id"))
    if twins.limit(1).count():  # an id on several sets has the links of each
        twins = small(twins)
        for end in ("a", "b"):
            links = links.join(twins.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("id", end)).drop("id").select("a", "b")
        links = links.union(able.filter("rep <> doc_id").join(small(ids.filter("rows > 1 and own > 0").select("doc_id")), "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = small(components(links, ws, "found").withColumnRenamed("node", "rep2"))
    out = named.withColumn("rep2", F.coalesce("rep", "doc_id")).join(found, "rep2", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep2").alias("component_id"))
