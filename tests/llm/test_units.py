"""Parts of the training-data operators that need no Spark."""

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lorekeep.llm import gif, language, near_dup, packing, quality, sharding, token_count

tokenizers = pytest.importorskip("public_tokenizers")
RNG = random.Random(12)
ODD = ["", " ", "a  b", "  lead and trail  ", "ａ①é\t\n<s>x</s>日本𠮷 ▁▁ a", "x\x00y", "It's 12 ½ ²³ x_y 'S ÇA É\xa0ñ \x85 “q” Σίσυφος <|endoftext|> İi", "word" * 5000, "ab " * 3000, "     "]


def some_texts(n=60):
    parts = ["the", "tion", "über", "é", "Straße", "12", "it's", "%%%", "\n", "  ", "日本", "x_y", "queue", "don't", "…"]
    return ODD + ["".join(RNG.choice(parts) + RNG.choice(["", " "]) for _ in range(RNG.randint(1, 60))) for _ in range(n)]


def test_token_counts_equal_the_library():
    from sentencepiece import SentencePieceProcessor

    path = tokenizers.path("piece_bpe_32k.model")
    counts, library = token_count.Counts(token_count.Merger(path)), SentencePieceProcessor(model_file=path)
    for text in some_texts():
        assert counts.text(text) == len(library.encode(text)), text[:60]
    assert counts.text(None) == 0


def test_packing_ids_equal_the_library():
    encoder = packing.Encoder(tokenizers.path("word_bpe_49k.json"))
    for text in some_texts():
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), np.uint32).tolist() == [*want, 0], text[:60]
    assert encoder.ids(None) == bytes(4)


def test_plans_hold_every_piece_once_and_are_tight():
    for _ in range(30):
        limit = RNG.choice([16, 100, 2048])
        counts = Counter(RNG.choices(range(1, limit + 1), k=RNG.randint(1, 400)))
        planned = packing.plan(counts, limit)
        held = Counter()
        for times, lengths in planned:
            assert sum(lengths) <= limit and times > 0
            for x in lengths:
                held[x] += times
        assert held == counts
        used, least = sum(t for t, _ in planned), math.ceil(sum(x * n for x, n in counts.items()) / limit)
        assert used <= max(least + 2, least * 1.35)
        spans = sorted((x, a, b) for x, a, b, _, _ in packing.places(planned))
        for x in counts:
            mine = [(a, b) for y, a, b in spans if y == x]
            assert [a for a, _ in mine] == [0, *[b for _, b in mine[:-1]]] and mine[-1][1] == counts[x]
    assert packing.plan({}, 10) == []
    assert packing.plan({10: 5}, 10) == [(5, [10])]
    assert packing.plan({6: 1, 3: 1, 1: 1}, 10) == [(1, [6, 3, 1])]


def test_gif_round_trips_and_rules():
    for n in (0, 1, 191, 192, 193, 6144, 6145, 40_000):
        for raw in (os.urandom(n), bytes(n), b"ab" * (n // 2)):
            payload = gif.pad(raw)
            assert len(payload) % 192 == 0 and payload and payload.startswith(raw)
            assert gif.read_back(gif.decode(gif.encode(payload))) == payload
    data = os.urandom(50_000)
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data
    whole = gif.encode(gif.pad(b"some text " * 900))
    for broken in (b"GIF89a", b"no gif", whole[:-200], whole[:900], *(whole.replace(b"\x00\x08", b"\x00" + bytes([size])) for size in (0, 1, 9, 12, 200))):
        with pytest.raises(ValueError):
            list(gif.decode(broken))
    with pytest.raises(ValueError):
        gif.lzw_decode(bytes([0xFF] * 9), 8, 9)


def hand_made(frames, size=(2, 2), palette=bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])):
    """frames: (indices, delay, disposal, clear index or None, interlaced)."""
    w, h = size
    out = b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes([0x81, 0, 0]) + palette
    for samples, delay, disposal, clear, woven in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + delay.to_bytes(2, "little") + bytes([clear or 0, 0])
        out += b"\x2c" + bytes(4) + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes([0x40 if woven else 0, 2])
        bits = "".join(format(c, "03b")[::-1] for s in samples for c in (4, s)) + "101"  # a clear code before each sample: literal codes only
        raw = bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
        out += bytes([len(raw)]) + raw + b"\0"
    return out + b"\x3b"


def kept(data):
    return [f | {"canvas": f["canvas"].copy()} for f in gif.decode(data)]


def test_gif_disposal_transparency_interlace_and_times():
    got = kept(hand_made([([1, 1, 1, 1], 5, 1, None, False), ([2, 0, 0, 2], 7, 3, 0, False), ([0, 3, 0, 0], 1, 2, 0, False), ([0, 0, 0, 3], 1, 1, 0, False)]))
    look = lambda f: ["".join("-krgb"[0 if p[3] == 0 else 1 + (0 if not p[:3].any() else 1 + int(p[:3].argmax()))] for p in row) for row in f["canvas"]]
    assert [look(f) for f in got] == [["rr", "rr"], ["gr", "rg"], ["rb", "rr"], ["--", "-b"]]
    assert [(f["start"], f["delay"]) for f in got] == [(0, 5), (5, 7), (12, 1), (13, 1)]
    assert gif.histogram(got[3]["canvas"], 2) == [1, 0, 1, 0, 0, 1]
    woven = kept(hand_made([([0, 1, 2, 3], 0, 0, None, True)], size=(1, 4)))[0]
    assert woven["samples"].ravel().tolist() == [0, 2, 1, 3]


def test_shingles_and_bitmaps():
    def words(t, k):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    vocabulary = [f"w{i}" for i in range(90)]
    texts = [" ".join(RNG.choice(vocabulary) for _ in range(RNG.choice([0, 1, 2, 4, 9, 15, 60]))) for _ in range(60)]
    texts += [" ".join(RNG.choice(vocabulary) if RNG.random() < 0.03 else w for w in t.split()) for t in texts]
    for k, percent in ((3, 90), (5, 80), (2, 50)):
        sets, hashed = [words(t, k) for t in texts], [near_dup.shingle_set(t.encode(), k) for t in texts]
        assert [len(s) for s in sets] == [len(h) for h in hashed]
        nodes, size = np.arange(len(texts)), np.array([len(h) for h in hashed])
        seen = Counter(h for s in hashed for h in s.tolist())
        for cut in (1 << 64, 1 << 63, 0):  # hashes below it are counted, of the others the first ones are sent as they are
            counted = np.array([sum(int(x) < cut for x in h) for h in hashed])
            rows = [(x, i, min(seen[x], 9) if x < cut else near_dup.LAST) for i, h in enumerate(hashed) for x in h.tolist() if x >= cut or seen[x] > 1]
            sigs, owner, _, place = near_dup.first_places(nodes, size, counted, np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.uint8), percent)
            first = [dict(zip(sigs[owner == i].tolist(), place[owner == i].tolist(), strict=True)) for i in nodes]
            bits = near_dup.parities(hashed)
            for i in range(len(texts)):
                for j in range(i):
                    if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                        both = first[i].keys() & first[j].keys()
                        assert both and min(first[i][x] + first[j][x] for x in both) <= len(sets[i] ^ sets[j])
                        assert near_dup.may_link(bits[i], bits[j], size[i : i + 1], size[j : j + 1], percent).all()
    assert len(near_dup.word_hashes(b"a " * 3_000_000)) == 3_000_000
    odd = [None, "", " ", "A b", "a B c d e f", "x" * (2 * near_dup.BLOCK + 5) + " y", " ".join(["w1"] * 900_000), "é\u00a0b c\td\x0be"] + texts + ["one"] * 3000
    for k in (1, 3, 5):
        got = [s for part in near_dup.shingle_sets(pa.array(odd).slice(1), k) for s in part]
        assert all(np.array_equal(s, near_dup.shingle_set((t or "").encode(), k)) for s, t in zip(got, odd[1:], strict=True))
    long = ("z" * (near_dup.BLOCK - 1) + " end").encode()
    assert near_dup.word_hashes(long)[1] == near_dup.word_hashes(b"END")[0] and near_dup.word_hashes(b"x" + long)[1] == near_dup.word_hashes(b"end")[0]


def test_trees_find_all_components():
    for percent in (60, 90):
        base = [np.unique(np.array([RNG.getrandbits(64) for _ in range(60)], np.uint64)) for _ in range(12)]
        sets = [np.unique(np.concatenate([b[RNG.randint(0, 8) :], np.array([RNG.getrandbits(64) for _ in range(RNG.randint(0, 6))], np.uint64)])) for b in base for _ in range(6)]
        ids = list(range(len(sets)))
        join = lambda pairs: _components(ids, pairs)
        want = join([(i, j) for i in ids for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))])
        assert join(near_dup.linked(ids, ids, sets, percent)) == want


def _components(ids, pairs):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in ids]


def test_quality_learns_and_reads_whole_texts():
    clean = [" ".join(RNG.choice(["the", "erre", "tion", "with"]) for _ in range(RNG.randint(5, 200))) for _ in range(300)]
    junk = ["".join(f"{w}%%% " for w in t.split()) for t in clean[:150]]
    model = quality.fit([(t.encode(), 1) for t in clean[:200]] + [(t.encode(), 0) for t in junk[:100]])
    score = lambda t: float(quality.head(model, quality.pool(model, t.encode())[None])[0])
    assert np.mean([score(t) >= 0.5 for t in clean[200:]]) > 0.9 and np.mean([score(t) < 0.5 for t in junk[100:]]) > 0.9
    assert 0 <= score("") <= 1
    whole = quality.pool(model, b"a" * 200_000 + b"%%% x%%% " * 3)
    assert not np.allclose(whole, quality.pool(model, b"a" * 200_000))
    assert float(quality.head(quality.fit([]), quality.pool(model, b"x")[None])[0]) == 0.5


def test_language_backs_off():
    model = language.Model({"de": Counter({"und": 9, "schule": 3, "schön": 2}), "en": Counter({"the": 9, "school": 3, "and": 4})})
    assert model.predict("the school and the", {})[0] == "en" and model.predict("schulen und", {})[0] == "de"
    assert model.predict("schulung", {})[0] == "de"
    for text in (None, "", "123 !?", "½ ²", "Ⅷ ① ٣"):
        assert model.predict(text, {}) == ("und", 0.0)
    assert model.predict("½the²and", {}) == model.predict("the and", {})
    assert 0 < model.predict("qqq", {})[1] <= 1
    assert language.Model({}).predict("abc", {}) == ("und", 0.0)


def test_language_scores_equal_brute_force():
    counts = {lang: Counter({"".join(RNG.choice(letters) for _ in range(RNG.randint(1, 7))): RNG.randint(1, 9) for _ in range(40)}) for lang, letters in (("aa", "abcde"), ("bb", "bcdef"), ("cc", "cdefgé"))}
    model, langs = language.Model(counts), sorted(counts)

    def frequency(tables, item):
        every = set().union(*tables.values())
        return [math.log((tables[x].get(item, 0) + 0.5) / (sum(tables[x].values()) + 0.5 * len(every))) for x in langs] if item in every else None

    def grams(n):
        out = {x: Counter() for x in langs}
        for x in langs:
            for word, count in counts[x].items():
                marked = f"<{word}>"
                for i in range(max(1, len(marked) - n + 1)):
                    out[x][marked[i : i + n]] += count
        return out

    def evidence(word):
        if found := frequency(counts, word):
            return found
        for n in (5, 4, 3, 2, 1):
            marked = f"<{word}>"
            cut = [marked[i : i + n] for i in range(max(1, len(marked) - n + 1))]
            known = [f for g in cut if (f := frequency(grams(n), g))]
            if known and (2 * len(known) >= len(cut) or n == 1):
                return [sum(x) / len(known) for x in zip(*known, strict=True)]
        return [0.0] * 3

    for text in ("abcde bcd", "cé", "zzz", "Defg ab ab fed", "abc " * 30, "beef cafe dead fade"):
        total = [sum(x) for x in zip(*map(evidence, text.lower().split()), strict=True)]
        best = max(range(3), key=lambda i: (total[i], -i))
        scale = min(1.0, 20 / len(text.split()))
        lang, score = model.predict(text, {})
        assert lang == langs[best] and score == pytest.approx(1 / sum(math.exp((x - total[best]) * scale) for x in total))


def test_quality_pool_equals_brute_force():
    rng = np.random.default_rng(1)
    model = quality.fit([]) | {"b": rng.normal(0, 1, quality.FILTERS).astype(np.float32)}
    for n in (0, 1, 7, 8, 9, 300, 70_000):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        ids = [*data, *[256] * (4 * max(2, -(-n // 4)) - n)]
        spans = []
        for chunk in range(len(ids) // 4 - 1):
            e = model["emb"][ids[4 * chunk : 4 * chunk + 8]].reshape(2, -1)
            if chunk % 64 == 0:
                spans.append([])
            spans[-1].append(e[0] @ model["w0"] + e[1] @ model["w1"] + model["b"])
        act = np.array([np.maximum(np.max(s, axis=0), 0) for s in spans])
        assert np.allclose(quality.pool(model, data), np.concatenate([act.mean(0), act.max(0)]), rtol=1e-3, atol=1e-4)


def test_heavy_groups_are_dealt_evenly():
    where, left = sharding.even_targets([50, 10, 10], 160.0, 4)
    assert where == [0, 1, 2] and left[0] == 0 and sum(left) == pytest.approx(90) and max(left) - min(left[1:3]) <= 10.001
