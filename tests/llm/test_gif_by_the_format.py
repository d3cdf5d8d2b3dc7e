"""op10's stored form and feature against a plain reading of the format: one code after the other, one bit string."""

import hashlib
import struct

from lorekeep.llm import gif


def plain_lzw(data: bytes, bits: int) -> bytes:
    clear, stop = 1 << bits, (1 << bits) + 1
    stream, at, width = int.from_bytes(data, "little"), 0, bits + 1
    table, last, out = {i: bytes([i]) for i in range(clear)}, None, []
    while at + width <= 8 * len(data):
        code = stream >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, last, width = {i: bytes([i]) for i in range(clear)}, None, bits + 1
            continue
        if code == stop:
            break
        entry = table.get(code) or last + last[:1]
        out.append(entry)
        if last is not None and len(table) + 2 < 4096:
            table[len(table) + 2] = last + entry[:1]
            if len(table) + 2 == 1 << width and width < 12:
                width += 1
        last = entry
    return b"".join(out)


def plain_frames(media: bytes):
    """(width, height, delay, samples) of each frame; the palette must be the identity."""
    assert media[:6] == b"GIF89a" and media[13:781] == bytes(v for i in range(256) for v in (i, i, i)) and media[10] == 0xF7
    at, delay = 781, 0
    while media[at] != 0x3B:
        if media[at] == 0x21:
            assert media[at + 1 : at + 3] == b"\xf9\x04" and media[at + 7] == 0
            delay = struct.unpack_from("<H", media, at + 4)[0]
            at += 8
            continue
        assert media[at] == 0x2C
        left, top, wide, high, flags = struct.unpack_from("<HHHHB", media, at + 1)
        assert (left, top, flags) == (0, 0, 0)
        bits, at, parts = media[at + 10], at + 11, []
        while n := media[at]:
            parts.append(media[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        yield wide, high, delay, plain_lzw(b"".join(parts), bits)
    assert at == len(media) - 1


def test_digests_are_those_of_a_plain_reading(spark):
    texts = ["", "short", "ä€😀" * 100, "ab" * 9000, " ".join(f"word{i * 7919 % 5000}" for i in range(9000)), bytes(range(32, 127)).decode() * 300, "\x00\x01" * 500, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    media = {r.doc_id: bytes(r.media) for r in gif.store(docs).collect()}
    for r in gif.digests(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        found = list(plain_frames(media[r.doc_id]))
        assert b"".join(f[3] for f in found) == payload and all(len(f[3]) == f[0] * f[1] and f[0] == 64 for f in found)
        assert (r.media_bytes, r.media_sha256) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())
        bands = [sum(b // 32 == k for b in payload) for k in range(8)]
        assert r.feature == f"frames={len(found)};centiseconds={sum(f[2] for f in found)};grey={','.join(map(str, bands))}"
        assert len(found) == -(-len(payload) // (64 * 96))
