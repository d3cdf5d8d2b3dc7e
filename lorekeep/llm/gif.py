"""GIF as a lossless carrier of bytes, and a full decoder: LZW, palettes, disposal, transparency, timed frames.

Method. encode() lays a payload out as rows of WIDTH 8-bit samples under an identity grey palette, in
frames of at most ROWS rows, each LZW-coded with growing code widths and clear codes, shown for DELAY
hundredths of a second and left in place. decode() reads any GIF87a/89a: global and local palettes,
interlaced rows, deferred clear codes, disposal 1 to 3 and transparent samples, and gives for each frame its time, its
samples and the composed canvas. A colour histogram of 8 bands a channel is stored for each frame.

Defined cases. Null text counts as empty; an empty payload becomes 192 spaces. Very long texts become many frames,
coded and read back one at a time. Equal texts give equal bytes. A broken file raises ValueError in decode(), where the fault is; frames() gives
the frames before it and one row with the error's text. A canvas or frame of over SAMPLES samples is such a fault (a parameter; nothing that encode() writes comes near).
Columns besides doc_id and text are ignored; repeated rows and null ids are kept row by row.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, ROWS, DELAY, UNIT, BANDS = 64, 96, 10, 192, 8
#: Frames sent at once by frames(). Samples of a canvas or frame that decode() takes on, whatever a file's header asks for.
FLUSH, SAMPLES = 32, 1 << 26
CLEAR, END, FULL = 256, 257, 4096


def _schedule(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code, and the bits before each: the decoder has 2**bits + 2 entries at first and adds one with each code but the first."""
    known = (1 << bits) + 1 + np.arange(RUN + 1)
    width = np.clip(np.ceil(np.log2(known + 1)).astype(np.int64), bits + 1, 12)
    return width, np.cumsum(width) - width


#: Codes looked at in one step; more than the 12-bit tables of any code size hold, so that widths are 12 at the end.
RUN = 4608
SCHEDULES = {bits: _schedule(bits) for bits in range(1, 12)}
PLACES = np.arange(12)


def lzw_codes(samples: bytes) -> list[list[int]]:
    """Runs of codes, each to be preceded by a clear code."""
    runs, codes = [], []
    table: dict[int, int] = {}
    get, fresh = table.get, 258
    prefix = samples[0]
    add = codes.append
    for b in samples[1:]:
        key = prefix << 8 | b
        known = get(key)
        if known is not None:
            prefix = known
            continue
        add(prefix)
        prefix = b
        if fresh < FULL:
            table[key] = fresh
            fresh += 1
        else:
            runs.append(codes)
            codes, fresh = [], 258
            add = codes.append
            table.clear()
    add(prefix)
    runs.append(codes)
    return runs


def lzw_encode(samples: bytes) -> bytes:
    flat, wide, last = [], [], np.array([9])
    widths = SCHEDULES[8][0]
    for run in lzw_codes(samples):
        n = len(run)
        flat += [[CLEAR], run]
        wide += [last, widths[:n]]
        last = widths[n : n + 1]  # of the code that follows the run
    code = np.fromiter(chain(*flat, [END]), np.int32)
    width = np.concatenate([*wide, last])
    bits = (code[:, None] >> PLACES & 1).astype(np.uint8)
    return np.packbits(bits[width[:, None] > PLACES], bitorder="little").tobytes()


def _codes(padded: np.ndarray, offsets: np.ndarray, width) -> np.ndarray:
    byte = offsets >> 3
    return (padded[byte] | padded[byte + 1] << 8 | padded[byte + 2] << 16) >> (offsets & 7) & (1 << width) - 1


def lzw_decode(data: bytes, bits: int, wanted: int) -> bytes:
    """Up to `wanted` samples. Codes after a full table keep 12 bits until a clear code comes."""
    if not 2 <= bits <= 8:
        raise ValueError(f"code size {bits}")
    clear, size = 1 << bits, len(data) * 8
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int32)
    widths, before = SCHEDULES[bits]
    out, got, at, state = [], 0, 0, None
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    while at < size and got < wanted:
        if state is None:
            table, last = base.copy(), None
            width = widths[: min(RUN, int(np.searchsorted(before + widths, size - at, "right")))]
            offsets = at + before[: len(width)]
        else:  # a table that stays full: 12-bit codes go on
            table, last = state
            width = np.full(min(RUN, (size - at) // 12), 12)
            offsets = at + 12 * np.arange(len(width))
        if not len(width):
            break
        codes = _codes(padded, offsets, width)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(stops[0]) if len(stops) else len(codes)
        for code in codes[:stop].tolist():
            known = len(table)
            if last is None:
                if code >= clear:
                    raise ValueError("a code before its entry")
                last = table[code]
            elif code < known:
                entry = table[code]
                if known < FULL:
                    table.append(last + entry[:1])
                last = entry
            elif code == known:
                last += last[:1]
                table.append(last)
            else:
                raise ValueError("a code before its entry")
            out.append(last)
        got = sum(map(len, out)) if len(out) > wanted // FULL else 0
        if not len(stops):
            at, state = int(offsets[-1] + width[-1]), (table, last)
        elif codes[stop] == clear:
            at, state = int(offsets[stop] + width[stop]), None
        else:
            break
    return b"".join(out)[:wanted]


_PALETTE = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """payload: a positive multiple of width bytes."""
    height = len(payload) // width
    parts = [b"GIF89a", struct.pack("<HHBBB", width, min(height, rows), 0xF7, 0, 0), _PALETTE]
    for top in range(0, height, rows):
        piece = payload[top * width : (top + rows) * width]
        coded = lzw_encode(piece)
        parts += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(piece) // width, 0), b"\x08"]
        for i in range(0, len(coded), 255):
            block = coded[i : i + 255]
            parts += [bytes([len(block)]), block]
        parts.append(b"\0")
    return b"".join([*parts, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def decode(data: bytes) -> Iterator[dict]:
    """Frames in order, one at a time: start and delay in hundredths of a second, left, top, samples (indices), disposal and canvas (height x width x 4, after drawing; it changes with the next frame)."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        yield from _decode(data)
    except (IndexError, struct.error, MemoryError) as e:
        raise ValueError("cut short") from e


def _decode(data: bytes) -> Iterator[dict]:
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    common = np.zeros((0, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    if wide * high > SAMPLES:
        raise ValueError(f"a canvas of {wide} x {high}")
    canvas = np.zeros((high, wide, 4), np.uint8)
    start = 0
    delay, disposal, clear = 0, 0, None
    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            body, after = _blocks(data, at + 2)
            if data[at + 1] == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = bits >> 2 & 7, index if bits & 1 else None
            at = after
            continue
        if kind != 0x2C:
            raise ValueError(f"block {kind:#x}")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if local & 0x80:
            n = 2 << (local & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if w * h > SAMPLES:
            raise ValueError(f"a frame of {w} x {h}")
        bits = data[at]
        coded, at = _blocks(data, at + 1)
        raw = lzw_decode(coded, bits, w * h)
        samples = np.zeros(w * h, np.uint8)
        samples[: len(raw)] = np.frombuffer(raw, np.uint8)
        samples = samples.reshape(h, w)
        if local & 0x40:
            rows = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(samples)
            plain[rows] = samples
            samples = plain
        kept = canvas.copy() if disposal == 3 else None
        region = canvas[top : top + h, left : left + w]
        seen = samples[: region.shape[0], : region.shape[1]]
        table = np.zeros((256, 3), np.uint8)
        table[: len(palette)] = palette
        shown = seen != clear
        if clear is None:
            region[..., :3], region[..., 3] = table[seen], 255
        else:
            region[shown] = np.concatenate([table[seen[shown]], np.full((int(shown.sum()), 1), 255, np.uint8)], 1)
        yield {"start": start, "delay": delay, "left": left, "top": top, "disposal": disposal, "samples": samples, "canvas": canvas}
        start += delay
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif disposal == 3:
            canvas = kept
        delay, disposal, clear = 0, 0, None


def histogram(canvas: np.ndarray, bands: int = BANDS) -> list[int]:
    """Counts of bands of red, green and blue of the samples that are not transparent."""
    flat = canvas.reshape(-1, 4)
    if not flat[:, 3].all():
        flat = flat[flat[:, 3] > 0]
    band = (np.arange(256) * bands // 256).astype(np.int64)
    return np.concatenate([np.bincount(band, np.bincount(flat[:, c], minlength=256), bands) for c in range(3)]).astype(np.int64).tolist()


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + b" " * (-len(raw) % unit or (0 if raw else unit))


def shown(frame: dict) -> bytes:
    """What the composed canvas shows in the frame's own rectangle, red channel."""
    high, wide = frame["samples"].shape
    return frame["canvas"][frame["top"] : frame["top"] + high, frame["left"] : frame["left"] + wide, 0].tobytes()


def read_back(frames: Iterable[dict]) -> bytes:
    """The payload as the frames show it."""
    return b"".join(map(shown, frames))


def describe(raw: bytes) -> tuple:
    """The digest columns of a text; the stored form is read back frame by frame."""
    media = encode(pad(raw))
    digest, back, tail, count, end, hist = hashlib.sha256(), 0, b"", 0, 0, np.zeros(BANDS, np.int64)
    for f in decode(media):
        part = shown(f)
        digest.update(part)
        back, tail, count, end = back + len(part), (tail + part)[-16:], count + 1, f["start"] + f["delay"]
        hist += histogram(f["canvas"][: f["samples"].shape[0]])[:BANDS]
    feature = f"frames={count};centiseconds={end};grey={','.join(map(str, hist.tolist()))}"
    return len(raw), back, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(documents: DataFrame) -> DataFrame:
    """doc_id and the digest columns of each document's text kept as a GIF."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in COLUMNS.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [describe(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {COLUMNS}")


def store(documents: DataFrame) -> DataFrame:
    """doc_id and media: each text as GIF bytes."""

    def run(batches):
        for batch in batches:
            media = [encode(pad(t or b"")) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def frames(media: DataFrame) -> DataFrame:
    """One row a frame of each file of media (doc_id, media): times, geometry, disposal, canvas as RGBA bytes, histograms; a broken file has a row with its error after the frames before the fault."""
    shape = "doc_id long, frame int, start_cs int, delay_cs int, width int, height int, disposal int, rgba binary, red array<long>, green array<long>, blue array<long>, error string"

    names = [c.split()[0] for c in shape.split(", ")]
    kinds = [pa.int64(), *[pa.int32()] * 6, pa.binary(), *[pa.list_(pa.int64())] * 3, pa.string()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    def run(batches):
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, error, k = [], None, -1
                try:
                    for k, f in enumerate(decode(data or b"")):
                        h = histogram(f["canvas"])
                        rows.append((doc, k, f["start"], f["delay"], f["samples"].shape[1], f["samples"].shape[0], f["disposal"], f["canvas"].tobytes(), h[:BANDS], h[BANDS : 2 * BANDS], h[2 * BANDS :], None))
                        if len(rows) >= FLUSH:
                            yield batch_of(rows)
                            rows = []
                    error = "no frame" if k < 0 else None
                except ValueError as e:
                    error = str(e)
                if error:
                    rows.append((doc, *[None] * 10, error))
                if rows:
                    yield batch_of(rows)

    return media.select("doc_id", "media").mapInArrow(run, shape)
