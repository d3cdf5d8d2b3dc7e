import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import validate
from lorekeep.sources import files, frontmatter
from lorekeep.streaming import watch


def test_decode_ladder():
    assert files.decode("é".encode("utf-8-sig")) == "é" and files.decode("héllo".encode("utf-16")) == "héllo"
    assert files.decode("hello world".encode("utf-16-le")) == "hello world" and files.decode(b"caf\xe9") == "café"
    with pytest.raises(ValueError):
        files.decode(bytes(range(1, 9)) * 50)


def test_frontmatter_shapes():
    assert frontmatter.parse("---\ntype: X\nd: 2026-01-01\nbad: 2026-13-99\n---\nB") == ("ok", '{"type": "X", "d": {"$date": "2026-01-01"}, "bad": "2026-13-99"}', "B")
    assert frontmatter.parse("---\nk: |\n  ---\n---\nB")[0] == "ok"
    assert [frontmatter.parse(t)[0] for t in ("no", "---\n- a\n---\n", "---\n[x\n---\n", "---\nopen")] == ["none", "other", "bad", "none"]
    again = frontmatter.serialize(frontmatter.parse("---\nb: 1\na: 2026-01-01\n---\nB")[1], "B")
    assert again == "---\nb: 1\na: 2026-01-01\n---\nB"


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_readers():
    assert files.parse("a.csv", b"\xef\xbb\xbfa,b\n,\n1,2\n")[0]["text"] == "| a | b |\n| 1 | 2 |"
    assert files.pipe_tables("x\n| a | b |\n|---|---|\n| 1 | 2 |\n\n| c |") == [[["a", "b"], ["1", "2"]], [["c"]]]
    assert files.parse("a.png", b"")[0]["needs_ocr"]
    assert files.parse("a.md", b"---\nx: 1\n...\nbody\r\nmore")[0]["text"] == "body\nmore"
    docs = files.parse("e.zip", archive([(f"My Page {'a' * 32}.md", "see https://www.notion.so/x1, ok"), ("t.csv", "a,b")]))
    assert [(d["title"], d["resource"]) for d in docs] == [("My Page", "https://www.notion.so/x1"), ("t", None)]
    plain = files.parse("p.zip", archive([("b.txt", "two"), ("a.txt", "one"), ("bad.bin", b"\x00")]))
    assert [(p["number"], p["text"]) for p in plain] == [(1, "[a.txt]\none"), (2, "[b.txt]\ntwo")]
    with pytest.raises(ValueError):
        files.members(archive([("../x", "y")]))
    sheet = archive([
        ("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>'),
        ("xl/worksheets/s.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>'),
    ])
    assert files.parse("a.xlsx", sheet)[0]["text"] == "## S\n| k |  | 3 |"


def test_bundle_and_errors_as_rows(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb/a.md").write_text("---\ntype: Note\ntags: one\nverified: {by: 'human:x'}\nsupersedes: b\n---\nBody")
    (tmp_path / "kb/index.md").write_text("* [a](a)")
    r = files.read_bundle(spark, str(tmp_path)).first()
    assert (r.id, r.tags, r.verified[0].by, r.supersedes, r.body) == ("kb/a", ["one"], "human:x", ["b"], "Body")
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    got = {p.path.split("/")[-1]: p.error for p in files.parse_files(files.scan(spark, str(tmp_path))).collect()}
    assert got["a.md"] is None and "no reader" in got["x.pdf"]
    state = spark.createDataFrame([], "path string, sha256 string, concepts array<string>, size long, mtime_ns long")
    assert watch.poll(spark, [str(tmp_path)], state, verify=False).count() == 2
    assert files.bundles(files.listing(spark, str(tmp_path)), str(tmp_path)).first().bundle_id == "kb"


def test_rules_in_order_of_code(spark):
    rows = [
        ("index.md", "---\nokf_version: '0.2'\nextra: 1\n---\n* [a](a.md)"), ("sub/index.md", "---\nx: 1\n---\n"), ("log.md", "## 2026-01-01\n## 2026-02-30\n## 2026-01-02\n"),
        ("a.md", "---\ntype: Note\ntitle: T\ndescription: D\nsources: x\nsupersedes: [b, 3]\nstatus: draft\n---\n# Citations\n\n- one"),
        ("b.md", "---\ntype: Note\ntitle: T\ndescription: D\nsupersedes: a\nsources: [{id: s, resource: r}, {id: s, resource: r}]\n---\n`[x](nowhere.md)`"),
    ]
    found = validate.check(spark.createDataFrame(rows, "path string, text string"), "2026-06-01").orderBy("rule_seq", "file").collect()
    assert [(r.code, r.file) for r in found] == [("E003", "index.md"), ("E003", "sub/index.md"), ("E004", "log.md"), ("W002", "b.md"), ("W016", "a.md"), ("W019", "a.md"), ("W011", "a.md"), ("W012", "a.md"), ("W013", "log.md"), ("W015", "b.md")]


def test_event_windows_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = watch.event_states(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_type, r.n, r.total) for r in spark.table("windows").collect()} == {("a", 2, 3.0), ("b", 1, 4.0)}


def test_export_addresses_and_titles():
    """An address ends where Markdown's brackets do; the suffix of a title may follow any white space."""
    assert files.export_url("[t](https://notion.so/a)[u](https://notion.so/b)") == "https://notion.so/a"
    assert files.export_url("<https://www.notion.so/x-1>. See") == "https://www.notion.so/x-1" and files.export_url('at "https://notion.so/y".') == "https://notion.so/y" and files.export_url("none") is None
    hash_ = "0123456789abcdef" * 2
    assert files.export_title(f"My Page\t {hash_}.md") == "My Page" and files.export_title(f"a/ {hash_}.md") == f" {hash_}" and files.export_title("plain.md") == "plain"


def test_plain_blocks_are_read_as_by_the_python_scanner():
    """Blocks without signs of their own go to the scanner in C; it gives the same values and refuses the same blocks."""
    import random

    import yaml

    from lorekeep.sources import frontmatter

    rng = random.Random(7)
    bits = ["a: ", "b:", "- ", "\n", "  ", "key: v", "'", "''", "2024-01-01", "2026-13-99", "1:30", "---", "...", " :", "null", "yes", "12.5e3", "x: y: z", "\n- s: 1\n  t: 2", "\nq:\n- a\n", "07", ".inf"]

    def got(text, plain):
        try:
            return repr(yaml.load(text, frontmatter._loader(plain)))  # noqa: S506
        except (yaml.YAMLError, ValueError):
            return None

    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    assert all(frontmatter._PLAIN.fullmatch(t) for t in texts) and not any(frontmatter._PLAIN.fullmatch(t) for t in ("a: [b]", "a: \t", "a: é", "a: #", "a: &x b", 'a: "b"', "a: |"))
    assert [got(t, True) for t in texts] == [got(t, False) for t in texts]
