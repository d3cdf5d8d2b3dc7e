"""The operators through Spark on rows with nulls, ties, repeats, clashing columns and none at all, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import exact_dedup, gif, language, mixing, near_dup, packing, quality, sharding, token_count, url_rules

tokenizers = pytest.importorskip("public_tokenizers")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, label string"
RNG = random.Random(3)
V = [f"w{i}" for i in range(200)]


def rows():
    out = []
    for i in range(90):
        base = [RNG.choice(V) for _ in range(RNG.choice([1, 4, 12, 40, 300]))]
        out.append((i, " ".join(base), RNG.choice(["de", "en", None]), "hot" if i % 3 else RNG.choice(["a", "b", None]), 1, 7, 3, "x"))
    near = out[4][1].split()
    for i in range(90, 130):
        copy = list(near if i % 2 else out[9][1].split())
        copy[RNG.randrange(len(copy))] = RNG.choice(V)
        out.append((i, " ".join(copy), "en", "hot", None, None, None, None))
    out += [(130, None, None, None, None, None, None, None), (131, "", "en", "a", None, None, None, None), (132, " \t", "de", "a", None, None, None, None), (None, out[0][1], None, "b", None, None, None, None), (133, out[0][1], "en", "a", 1, 1, 1, ""), (134, out[0][1], "en", "a", 1, 1, 1, ""), out[5], (135, "long " * 20_000, "en", "c", 1, 1, 1, "")]
    return out


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SHAPE).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 90, 2)] + [(None, 1, 0), (2, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held(r.doc_id) for r in got)
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_of_null_and_very_long_texts(spark):
    rows = [(i, None) for i in range(6)] + [(7, "x" * 300_000), (8, "good text " * 30_000), (9, ""), (10, "é" * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i > 5), 0) for i in range(11)], "doc_id long, quality int, toxic int")
    assert any(not held(i) and i in (7, 8) for i in (7, 8))
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values()) and len({got[i] for i in (*range(6), 9)}) == 1
    assert len({r.score for r in quality.classify(docs.filter("text is null"), labels).collect()}) == 1


def test_mixing(spark, docs, empty):
    got = mixing.mix(spark, docs).collect()
    size = lambda t: len((t or "").split())
    by = defaultdict(int)
    for r in ROWS:
        by[r[3]] += size(r[1])
    total, weight = sum(by.values()), {s: k % 3 + 1 for k, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    target, open_ = {}, dict(weight)
    while True:
        left = total - sum(target.values())
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] > 3 * by[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * by[s]
            open_.pop(s)
    taken = defaultdict(int)
    for r in got:
        assert r.size * 3 >= r.taken >= 0 and r.source_size == by[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in by:
        assert abs(taken[s] - target[s]) <= 1
    again = Counter((r.doc_id, r.size, r.taken, r.position) for r in mixing.mix(spark, docs.repartition(2)).collect())
    assert again == Counter((r.doc_id, r.size, r.taken, r.position) for r in got)
    read = mixing.copies(mixing.mix(spark, docs)).collect()
    assert sum(r.words for r in read) == sum(r.taken for r in got) and all(0 <= r.position <= 1 for r in read)
    assert mixing.mix(spark, empty).count() == 0


def test_token_counts(docs, empty):
    from sentencepiece import SentencePieceProcessor

    path = tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in ROWS)
    got = token_count.count_tokens(docs, path).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert token_count.count_tokens(empty, path).count() == 0


def test_language(docs, empty):
    got = language.identify(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    assert all(0 <= r.score <= 1 and r.lang_pred in ("de", "en", "und") and r.held_out == held(r.doc_id) for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (130, 131, 132)} == {"und"}
    assert language.identify(empty).count() == 0


@pytest.mark.parametrize(("shingle", "percent", "tile", "few"), [(3, 90, 256, 48), (5, 80, 8, 2)])
def test_near_duplicates(spark, docs, empty, monkeypatch, shingle, percent, tile, few):
    monkeypatch.setattr(near_dup, "TILE", tile)
    monkeypatch.setattr(near_dup, "FEW", few)
    monkeypatch.setattr(near_dup, "PIVOTS", 2)

    def words(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else [])

    sets = {r[0]: words(r[1]) for r in ROWS if r[0] is not None}
    comp = {i: i for i in sets}
    changed = True
    near = [(i, j) for i in sets for j in sets if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in near:
            low = min(comp[i], comp[j])
            if comp[i] != low or comp[j] != low:
                comp[i] = comp[j] = low
                changed = True
    want = Counter((r[0], len(words(r[1])), 0 if r[0] is None else comp[r[0]]) for r in ROWS)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.link(spark, docs, shingle, percent).collect()) == want
    if tile == 256:
        assert near_dup.link(spark, empty, shingle, percent).count() == 0


@pytest.mark.parametrize("hot", [64, 2])
def test_near_duplicates_of_repeated_ids(spark, monkeypatch, hot):
    """Rows of one id are one vertex with the links of each text; hot shingles aren't counted and lose nothing."""
    monkeypatch.setattr(near_dup, "HOT", hot)
    text = [" ".join(f"t{k}x{i}" for i in range(40)) for k in range(6)]
    near = lambda k: text[k] + " more"
    rows = [(10, text[0]), (10, text[1]), (10, text[1]), (11, near(0)), (12, near(1)), (13, text[2]), (14, near(2)), (14, text[3]), (15, text[3]), (16, text[4]), (16, None), (17, near(4)), (18, text[5]), (None, near(5)), (3, near(1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = {10: 3, 11: 3, 12: 3, 3: 3, 13: 13, 14: 13, 15: 13, 16: 16, 17: 16, 18: 18, None: None}
    assert Counter((r.doc_id, r.component_id) for r in near_dup.link(spark, docs, 3, 80).collect()) == Counter((i, 16 if i == 16 else want[i]) for i, _ in rows)


def test_sharding(spark, docs, empty):
    got = sharding.shard(spark, docs, 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    load, slots, place = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        place[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(p) == 1 for p in place.values())
    rest = [n for s, n in load.items() if s not in place[zlib.crc32(ROWS[-1][1].encode()), 100_001]]  # the long one fills a shard
    assert len(rest) == 3
    assert max(rest) - min(rest) <= 2_500
    assert sharding.shard(spark, empty, 4).count() == 0


def test_sharding_is_even_through_the_tree(spark):
    """Of 900 texts some are a tenth of a shard: all go through the tree, and shards differ by less than one of them."""
    rng = random.Random(5)
    rows = [(i, "x" * rng.choice([10, 200, 900, 12_000]) + str(i), rng.choice(["de", "en"]), rng.choice("abc")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    groups = sharding.points(sharding.measured(docs))
    total = groups.agg(F.sum("weight")).first()[0]
    assert groups.agg(F.max("weight")).first()[0] * sharding.HEAVY * 8 < total * 2
    load = [r["sum(size)"] for r in sharding.shard(spark, docs, 8).groupBy("shard").sum("size").collect()]
    assert len(load) == 8 and max(load) - min(load) < 0.04 * total / 8


def test_packing(spark, docs, empty):
    path = tokenizers.path("word_bpe_49k.json")
    encoder = packing.Encoder(path)
    want = Counter()
    for r in ROWS:
        ids = np.array([*encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[r[0], k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    got = packing.pack(spark, docs, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    full = defaultdict(list)
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(full) <= -(-sum(r.length for r in got) // 2048) + 2
    assert packing.pack(spark, empty, path).count() == 0


@pytest.mark.parametrize("hot", [64, 1000])
def test_exact_dedup(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    tables = len(spark.catalog.listTables())
    got = exact_dedup.dedup(spark, docs).collect()
    assert len(spark.catalog.listTables()) == tables
    groups = defaultdict(list)
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    for r in got:
        assert r.text_sha256 == next(hashlib.sha256(t.encode()).hexdigest() for t, g in groups.items() if r.doc_id in g and max(x for x in g if x is not None) == r.keep_id)
    assert sum(r.kept for r in got) == len(groups) and len(got) == len(ROWS)
    assert Counter(r.group_size for r in got) == Counter(len(groups[r[1] or ""]) for r in ROWS)
    assert exact_dedup.dedup(spark, empty).count() == 0


def test_digest_index_lasts_over_batches(spark, docs, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    first = exact_dedup.add_batch(index, docs.filter("doc_id < 60 or doc_id is null"))
    n = first.count()
    assert index.table().count() == n
    assert exact_dedup.add_batch(index, docs.filter("doc_id < 60 or doc_id is null")).count() == 0
    assert exact_dedup.add_batch(index, docs).count() + n == index.table().count() == len({r[1] or "" for r in ROWS})
    plan = docs.transform(exact_dedup.digests).join(index.table().hint("merge"), "digest")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    index.drop()
    older = exact_dedup.DigestIndex(spark, str(tmp_path / "older"), buckets=2)
    exact_dedup.dedup(spark, spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), older).count()
    got = exact_dedup.dedup(spark, spark.createDataFrame([(9, "b"), (8, "b"), (8, "c"), (8, "c")], "doc_id long, text string"), older)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == [(8, 8, 2, False), (8, 8, 2, True), (8, 9, 3, False), (9, 9, 3, True)]
    older.drop()
    assert not spark.catalog.tableExists(older.name)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://X.Example.ORG/es/a?b", "http://example.org/en/123#x", "http://badexample.org/es/", "https://a.com/fr/1/de/", "https://a.com/de/", "http://com/de/", "http://org", "http://org/", "http://a.net:80/fr/", "x://example.org?/es/", "http://a.org/http://b.com/de/", "http://example.org/es", "http://a.b.com/de/", "http://a.b.com/de/"]
    pages = spark.createDataFrame([(k if k else None, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")

    def judge(url):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else None
        if rest is None:
            return "", "", None, "allow"
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:end].lower(), rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [(len(h + p), v, h + p) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[2], max(fit)[1]) if fit else (host, path, None, "allow")

    got = url_rules.judge(pages, url_rules.rule_table(spark))
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == Counter((k if k else None, *judge(u)) for k, u in enumerate(urls))
    assert "Python" not in got._jdf.queryExecution().toString()
    assert url_rules.judge(pages.limit(0), url_rules.rule_table(spark)).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, url_rules.rule_table(spark).limit(0)).collect()} == {"allow"}


def test_gif(docs, empty):
    got = gif.digests(docs).collect()
    for r in got:
        text = "" if r.doc_id == 130 else next(x[1] or "" for x in ROWS if x[0] == r.doc_id)
        payload = gif.pad(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    frames = gif.frames(gif.store(docs.filter("doc_id < 3 or doc_id = 135")))
    assert frames.filter("error is not null").count() == 0 and frames.filter("doc_id = 135").count() == 17
    assert frames.filter("doc_id = 135").agg(F.max(F.col("start_cs") + F.col("delay_cs"))).first()[0] == 170
    broken = docs.sparkSession.createDataFrame([(1, bytearray(b"GIF89a"))], "doc_id long, media binary")
    assert gif.frames(broken).first().error
    assert gif.digests(empty).count() == 0


def test_pipeline(spark, tmp_path):
    """Stages against brute force over small tables; the classifier's own verdicts are taken as given."""
    import corpus_pipeline as cp

    d = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4]) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 130)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"] and cp.ORACLE_SQL is None
    step = docs
    before = None
    for k, (_, stage) in enumerate(cp.STAGES):
        before, out = step, stage(spark, step, sf)
        out.write.parquet(str(tmp_path / f"s{k}"))
        step = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < 4:
            assert step.columns == docs.columns
        if k == 0:
            stays = Counter(r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").collect())
            assert Counter(r.doc_id for r in step.collect()) == stays
        if k == 1:
            best = defaultdict(lambda: -1)
            for r in before.collect():
                best[r.text or ""] = max(best[r.text or ""], -1 if r.doc_id is None else r.doc_id)
            assert Counter(-1 if r.doc_id is None else r.doc_id for r in step.collect()) == Counter(best.values())
        if k == 2:
            link = {r.doc_id: r.component_id for r in near_dup.link(spark, before, 5, 80).collect()}
            assert Counter(r.doc_id for r in step.collect() if r.doc_id is not None) == Counter(i for i, c in link.items() if i == c)
        if k == 3:
            want = Counter({r.doc_id: -(-r.taken // r.size) for r in mixing.mix(spark, before).collect() if r.taken})
            assert Counter(r.doc_id for r in step.collect()) == want
    assert step.agg(F.sum("length")).first()[0] > 0
    assert cp.run(spark, sf).count() == step.count()
