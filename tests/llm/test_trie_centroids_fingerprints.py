"""Conversation trie, centroids and fingerprints against brute force, with nulls, ties, repeats, clashing columns and no rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lorekeep.llm import centroids, fingerprints, trie
from lorekeep.llm.common import Workspace

TURNS = "conv_id long, turn long, role string, text string, depth long, key string, n_convs int"


def conversations():
    rng = random.Random(1)
    out = []
    for c in [*range(-7, 60), 90, 2**62]:
        for t in range(rng.choice([0, 1, 2, 3, 9])):
            out.append((c, t, rng.choice(["user", None, "assistant"]), rng.choice(["a", "b", None, "", "ä" * rng.randrange(3)])))
    out += [(7, None, "user", "first"), (7, None, "user", "first"), (7, 1, "x", "tie"), (7, 1, "x", "tie"), (None, 0, "user", "of nobody")]
    out += [(c, t, "user", f"long {t}") for c in (100, 105, 106, 110) for t in range(40 + c % 7)]  # deep and shared
    out += [(c, 0, "user", "hot") for c in range(200, 240)]
    return [(*r, 5, "k", 3) for r in out]


CONVERSATIONS = conversations()


def brute(rows, rebuild=True):
    key = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()[:16]
    raw = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            raw[c].append(((turn is not None, turn or 0, key(role or "", text or "")), (role or "", text or "")))
    own = {c: [t for _, t in sorted(x)] for c, x in raw.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = int(abs(c) // 5 * 5) * (1 if c >= 0 else -1)
        made[c] = tuple((own.get(base, [])[:h] if rebuild else []) + turns[h:])
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids = Counter(n[:-1] for n in nodes if n)
    out = Counter()
    leaves, saved = Counter(), Counter()
    for n, who in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(who) - 1) * (len(n[-1][1].encode()) if n else 0)
    for n, who in nodes.items():
        ends = ",".join(str(c) for c in sorted(who) if len(made[c]) == len(n))
        out[min(who), len(n), min(nodes[n[:-1]]) if n else None, len(who), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


FACTS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie(spark, monkeypatch, rebuild):
    monkeypatch.setattr(trie, "CHUNK", 3)
    df = spark.createDataFrame(CONVERSATIONS, TURNS).repartition(3)
    got = trie.conversation_trie(spark, df, rebuild).collect()
    assert Counter(tuple(r[f] for f in FACTS) for r in got) == brute(CONVERSATIONS, rebuild)
    # positions are a preorder: gapless, a subtree is what lies between position and end, and children lie inside
    by = sorted(got, key=lambda r: r.position)
    assert [r.position for r in by] == list(range(len(by))) and by[0].depth == 0 and by[0].end == len(by) - 1
    for r in by:
        inside = by[r.position : r.end + 1]
        assert all(x.depth > r.depth for x in inside[1:]) and (r.end + 1 == len(by) or by[r.end + 1].depth <= r.depth)
        assert sum(x.depth == r.depth + 1 for x in inside) == r.n_children
    if rebuild:
        con = duckdb.connect()
        con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
        assert Counter(con.execute(f"SELECT {', '.join(FACTS)} FROM ({trie.ORACLE_SQL})").fetchall()) == brute(CONVERSATIONS)


def test_trie_of_nothing_of_one_and_with_texts(spark):
    df = spark.createDataFrame(CONVERSATIONS, TURNS)
    assert trie.conversation_trie(spark, df.limit(0)).count() == 0
    one = trie.conversation_trie(spark, df.filter("conv_id = 100"), False)
    assert Counter(tuple(r[f] for f in FACTS) for r in one.collect()) == brute([r for r in CONVERSATIONS if r[0] == 100], False)
    named = one.join(trie.texts(df), "key", "left").orderBy("position").collect()
    assert [r.text for r in named] == [None, *[f"long {t}" for t in range(42)]]


def test_prefix_sums_of_a_long_conversation_in_blocks(spark, monkeypatch):
    whole = trie.running
    monkeypatch.setattr(trie, "running", lambda *a: whole(*a, step=4))
    got = trie.conversation_trie(spark, spark.createDataFrame(CONVERSATIONS, TURNS)).collect()
    assert Counter(tuple(r[f] for f in FACTS) for r in got) == brute(CONVERSATIONS)


def vectors():
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 0, 1]) / rng.choice([2, 3, 256]) for _ in range(6)]) for i in range(300)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[9][1]), (400, None), (401, []), (402, [1.0] * 5), (403, [None] + [0.5] * 5), (404, [float("nan")] + [0.5] * 5), (405, [float("-inf")] + [0.5] * 5)]
    rows += [(500 + i, rows[17][1]) for i in range(150)] + [(700, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0]), (701, [524_288.0] * 6)]
    return [(*r, 3, 4) for r in rows]


def kmeans(rows, k, rounds):
    import math

    kept = [(i, [math.floor(max(-(2**27), min(2**27, 256 * x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        cents = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(cents)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inside = Counter()
    for _, c, d in found:
        inside[c] += d
    return Counter((i, c, d, inside[c], sum(inside.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in found)


@pytest.mark.parametrize(("k", "rounds"), [(7, 5), (1, 1), (12, 0)])
def test_centroids(spark, k, rounds):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, distance int").repartition(4)
    got = centroids.cluster(spark, df, clusters=k, rounds=rounds, dims=6)
    assert Counter(tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == kmeans(rows, k, rounds)


def test_centroids_of_few_and_no_vectors(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, cluster int, distance int")
    few = [r for r in vectors() if r[0] in (1, 2)]
    assert Counter(tuple(r) for r in centroids.cluster(spark, df.filter("vec_id in (1, 2)"), dims=6).collect()) == kmeans(few, 40, 5)
    assert centroids.cluster(spark, df.limit(0), dims=6).count() == 0


def test_scan_stops_only_strictly_beyond_twice_the_distance():
    """Far fewer distances than vectors x centroids, and ties at exactly twice the distance still go to the smaller number."""
    cents = np.array([[4], [0], [100], [200]], np.int64)
    won, got = centroids.Scan(cents).nearest(np.array([[2], [2], [1], [150]]), np.array([1, 0, 0, 3]))
    assert won.tolist() == [0, 0, 1, 2] and got.tolist() == [4, 4, 1, 2500]


def documents():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(150)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i * 10, text(rng.choice([1, 5, 60, 300]))) for i in range(80)]
    rows += [(2000 + i, rows[3][1]) for i in range(30)] + [(3000 + i, rows[-1][1] + " end") for i in range(5)]
    rows += [(None, "no id"), (None, None), (100, "twice"), (100, "twice"), (100, "other"), (9000, ""), (9001, "\t \n"), (9100, "ß€😀" * 50), (9200, "long " * 40_000)]
    return [(*r, 1, "x") for r in rows]


DOCS = documents()
SHAPE = "doc_id long, text string, n_chars int, fingerprint string"


def test_fingerprints(spark):
    df = spark.createDataFrame(DOCS, SHAPE).repartition(5)
    got = fingerprints.compare(spark, df, radius=9).collect()
    hasher = fingerprints.Hasher()
    fp = {t: hasher.fingerprint(t) for t in {r[1] or "" for r in DOCS}}
    assert Counter((r.doc_id, r.n_chars, r.fingerprint) for r in got) == Counter((i, len(t or ""), f"{fp[t or '']:032x}") for i, t, *_ in DOCS)
    # rows of one id may stand in any order of their texts, so followers are those of the next id or of the same one
    order = sorted({r[0] for r in DOCS}, key=lambda i: (i is not None, i or 0))
    texts = defaultdict(list)
    for i, t, *_ in DOCS:
        texts[i].append(t or "")
    for r in got:
        nexts = texts[order[(order.index(r.doc_id) + 1) % len(order)]] + (texts[r.doc_id] if len(texts[r.doc_id]) > 1 else [])
        fits = []
        for own in texts[r.doc_id]:
            for t in nexts:
                e = fingerprints.edit(own, t)
                e_fp = hasher.fingerprint(e)
                fits.append((len(own), hashlib.sha256(e.encode()).hexdigest(), f"{e_fp:032x}", 1 - (fp[own] ^ e_fp).bit_count() / 128, 1 - (fp[own] ^ fp[t]).bit_count() / 128))
        assert (r.n_chars, r.edited_sha256, r.edited_fingerprint, r.near_edited, r.near_next) in fits
    for r in got:
        near = sum((fp[t or ""] ^ int(r.fingerprint, 16)).bit_count() <= 9 for _, t, *_ in DOCS)
        assert r.n_near == (near if r.doc_id is not None and r.doc_id % 100 == 0 else None)
    assert fp[""] == fp["\t \n"] == 0 and max(r.n_near or 0 for r in got) > 30
    assert fingerprints.compare(spark, df.limit(0)).count() == 0
    one = fingerprints.compare(spark, df.filter("doc_id = 9100")).first()
    assert one.near_next == 1 and one.n_near == 1 and one.edited_sha256 == hashlib.sha256(fingerprints.edit("ß€😀" * 50, "ß€😀" * 50).encode()).hexdigest()


@pytest.mark.parametrize(("radius", "kept"), [(3, 2), (5, 1), (0, 2)])
def test_block_tables_find_all_within_the_radius(spark, monkeypatch, radius, kept):
    monkeypatch.setattr(fingerprints, "PART", 20)
    rng = random.Random(radius)
    middle = [rng.getrandbits(128) for _ in range(4)]
    made = {m ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(8))) for m in middle for _ in range(90)} | {rng.getrandbits(128) for _ in range(100)}
    rows = [(*fingerprints._halves(f), rng.randrange(1, 4)) for f in sorted(made)]
    table = spark.createDataFrame(rows, "hi long, lo long, docs long")
    got = {(r.hi, r.lo): r.n for r in fingerprints.within(table, table.select("hi", "lo").filter("docs < 3"), Workspace(spark, "within"), radius, kept).collect()}
    whole = lambda r: (r[0] % 2**64) << 64 | r[1] % 2**64
    assert got == {r[:2]: sum(x[2] for x in rows if (whole(r) ^ whole(x)).bit_count() <= radius) for r in rows if r[2] < 3}
    assert fingerprints.within(table, table.limit(0).select("hi", "lo"), Workspace(spark, "within"), radius, kept).count() == 0


def test_likeness_tells_edited_texts_from_other_ones():
    rng = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(60)]
    hasher = fingerprints.Hasher()
    fp = [hasher.fingerprint(t) for t in texts]
    for k, t in enumerate(texts):
        n = (k + 1) % 60
        assert fingerprints.likeness(fp[k], hasher.fingerprint(fingerprints.edit(t, texts[n]))) > 0.62 > fingerprints.likeness(fp[k], fp[n]) - 0.04
