"""Readers of document files: text in any of the usual encodings, CSV, XLSX, archives, exports, images, PDF by plug-in.

Files come as (path, content) rows of the binaryFile source, and each becomes pages or an error row; a bad file never
fails the job. Archives are opened in memory under caps.
"""

import io
import json
import re
import zipfile
from collections.abc import Callable
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.sources import frontmatter
from lorekeep.work import slices

MAX_ARCHIVE, MAX_MEMBERS, SAMPLE = 512 << 20, 100_000, 8192
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".tif", ".tiff", ".bmp")
TEXTS = (".md", ".markdown", ".txt", ".rst", ".text", "")
PAGES = "path string, doc string, number int, text string, tables string, needs_ocr boolean, title string, resource string, error string"


def decode(raw: bytes) -> str:
    """By mark, by the pattern of zero bytes, as UTF-8, else as cp1252. Binary data raises ValueError."""
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw.decode("utf-8-sig")
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16")
    head = raw[:SAMPLE]
    if len(head) >= 4:
        half = max(1, len(head) // 2)
        even, odd = head[::2].count(0) / half, head[1::2].count(0) / half
        for share, other, name in ((odd, even, "utf-16-le"), (even, odd, "utf-16-be")):
            if share >= 0.3 and share > 3 * other:
                return raw[: len(raw) // 2 * 2].decode(name)
    control = sum(b < 32 and b not in (9, 10, 12, 13, 27) for b in head)
    if head and control / len(head) > 0.05:
        raise ValueError("binary content")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1252", errors="replace")


def pipe_tables(text: str) -> list[list[list[str]]]:
    """Runs of lines that begin and end with a bar; separator rows are left out."""
    tables, rows = [], []
    for line in [*text.splitlines(), ""]:
        line = line.strip()
        if len(line) > 1 and line[0] == line[-1] == "|":
            cells = [c.strip() for c in line[1:-1].split("|")]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                rows.append(cells)
        elif rows:
            tables.append(rows)
            rows = []
    return tables


def text_pages(path: str, raw: bytes) -> list[dict]:
    text = re.sub(r"\r\n?", "\n", decode(raw))
    if path.lower().endswith((".md", ".markdown")):
        text = without_source_frontmatter(text)
    return [{"number": 1, "text": text, "tables": pipe_tables(text)}]


def without_source_frontmatter(text: str) -> str:
    """A leading YAML mapping goes; here it may close with three dots too."""
    lines = text.split("\n")
    if lines[0].strip() != "---":
        return text
    for i, line in enumerate(lines[1:], 1):
        if line.rstrip() in ("---", "..."):
            try:
                value = frontmatter.load_yaml("\n".join(lines[1:i]))
            except Exception:  # noqa: BLE001  any YAML error: it was no frontmatter
                return text
            return "\n".join(lines[i + 1 :]) if isinstance(value, dict) else text
    return text


def csv_pages(path: str, raw: bytes) -> list[dict]:
    import csv

    rows = [r for r in csv.reader(io.StringIO(raw.decode("utf-8-sig"))) if any(c.strip() for c in r)]
    return [{"number": 1, "text": "\n".join(f"| {' | '.join(r)} |" for r in rows), "tables": [rows] if rows else []}]


def xlsx_pages(path: str, raw: bytes) -> list[dict]:
    """One page a sheet, read from the package's XML: shared strings, inline strings and values."""
    from xml.etree import ElementTree

    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    z = zipfile.ZipFile(io.BytesIO(raw))
    names = set(z.namelist())
    words = []
    if "xl/sharedStrings.xml" in names:
        words = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    pages = []
    for k, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", ns), 1):
        target = targets[sheet.get(rel)].lstrip("/")
        rows = []
        for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).findall("m:sheetData/m:row", ns):
            cells: list[str] = []
            for c in row.findall("m:c", ns):
                at = 0
                for letter in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                    at = at * 26 + ord(letter) - 64
                cells += [""] * (max(at, len(cells) + 1) - len(cells))
                value = c.find("m:v", ns)
                inline = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                shown = words[int(value.text)] if c.get("t") == "s" and value is not None else inline if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                cells[(at or len(cells)) - 1] = shown
            if any(c.strip() for c in cells):
                rows.append(cells)
        body = "\n".join([f"## {sheet.get('name')}", *[f"| {' | '.join(r)} |" for r in rows]])
        pages.append({"number": k, "text": body, "tables": [rows] if rows else []})
    return pages


def members(raw: bytes) -> list[tuple[str, bytes]]:
    """Members of an archive in order of name: no links, nothing that leaves it, the last of equal names; over the caps it raises."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    infos = [i for i in z.infolist() if not i.is_dir() and (i.external_attr >> 16) & 0o170000 != 0o120000]
    if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_ARCHIVE:
        raise ValueError("archive over its caps")
    safe = {}
    for i in infos:
        p = PurePosixPath(i.filename.replace("\\", "/"))
        if p.is_absolute() or ".." in p.parts or re.match(r"^[A-Za-z]:", i.filename):
            raise ValueError(f"unsafe member {i.filename!r}")
        safe[str(p)] = i
    return [(name, z.read(safe[name])) for name in sorted(safe)]


def zip_pages(path: str, raw: bytes, depth: int = 0) -> list[dict]:
    """All members' pages, renumbered; archives inside are opened once; a bad member is left out."""
    pages = []
    for name, data in members(raw):
        try:
            found = zip_pages(name, data, depth + 1) if name.lower().endswith(".zip") and depth == 0 else parse(name, data)
        except Exception:  # noqa: BLE001, S112  errors are data
            continue
        pages += [p | {"number": len(pages) + k, "text": f"[{name}]\n{p['text']}"} for k, p in enumerate(found, 1)]
    return pages


def is_export(names: list[str]) -> bool:
    return any(n.lower().endswith(".md") for n in names)


def export_title(name: str) -> str:
    stem = PurePosixPath(name).stem
    return re.sub(r"\s+[0-9a-f]{32}$", "", stem).strip() or stem


def export_url(text: str) -> str | None:
    found = re.search(r"https?://(?:www\.)?notion\.so/[^\s)>\]]+", text)
    return found[0].rstrip(".,;:!?'\"") if found else None


def export_documents(raw: bytes) -> list[dict]:
    """One document a page of an export: Markdown, then text, then CSV."""
    files, docs = members(raw), []
    for suffix in (".md", ".txt", ".csv"):
        for name, data in files:
            if name.lower().endswith(suffix):
                try:
                    found = parse(name, data)
                except Exception:  # noqa: BLE001, S112
                    continue
                docs += [p | {"doc": name, "title": export_title(name), "resource": export_url(p["text"])} for p in found]
    return docs


def parse(path: str, raw: bytes, converters: dict[str, Callable] | None = None) -> list[dict]:
    suffix = PurePosixPath(path).suffix.lower()
    if converters and suffix in converters:
        return converters[suffix](path, raw)
    if suffix in IMAGES:
        return [{"number": 1, "text": "", "tables": [], "needs_ocr": True}]
    if suffix == ".csv":
        return csv_pages(path, raw)
    if suffix == ".xlsx":
        return xlsx_pages(path, raw)
    if suffix == ".zip":
        return export_documents(raw) if is_export([n for n, _ in members(raw)]) else zip_pages(path, raw)
    if suffix in TEXTS:
        return text_pages(path, raw)
    raise ValueError(f"no reader for {suffix}")


def parse_files(files: DataFrame, converters: dict[str, Callable] | None = None) -> DataFrame:
    """Pages of files (path, content). converters: suffix -> function of (path, bytes) giving pages, for formats with outside readers (PDF, DOCX, PPTX)."""
    names = [c.split()[0] for c in PAGES.split(", ")]

    def run(batches):
        for batch in slices(batches):
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = parse(path, raw or b"", converters)
                    rows = [(path, p.get("doc", path), p["number"], p["text"], json.dumps(p.get("tables") or []), p.get("needs_ocr", False), p.get("title"), p.get("resource"), None) for p in rows]
                except Exception as e:  # noqa: BLE001  errors are data
                    rows = [(path, path, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(run, PAGES)


def route(path):
    """ocr for images, else parse."""
    return F.when(F.lower(path).rlike(r"\.(png|jpe?g|gif|webp|tiff?|bmp)$"), "ocr").otherwise("parse")


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, size, mtime_ns below root, without contents: the scan prunes them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return raw.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def scan(spark: SparkSession, root: str, pattern: str = "*", exclude: str | None = None) -> DataFrame:
    """path, content, sha256, size of files below root; the bundle's own folder and reserved names are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    raw = raw.filter(~F.lower(F.element_at(F.split("path", "/"), -1)).isin(*S.RESERVED))
    if exclude:
        raw = raw.filter(~F.regexp_replace("path", "^file:/*", "/").startswith(f"{exclude.rstrip('/')}/"))
    return raw.select("path", "content", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def read_bundle(spark: SparkSession, root: str) -> DataFrame:
    """Concepts of a folder of Markdown files; ids are paths below root without .md."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(base)}/", "")
    rows = raw.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text")).filter(~F.lower(F.element_at(F.split("path", "/"), -1)).isin(*S.RESERVED))
    return frontmatter.typed(frontmatter.parse_files(rows))


def bundles(listing_: DataFrame, root: str) -> DataFrame:
    """bundle_id, files of each folder below root that holds an index.md."""
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(root.rstrip('/'))}/", "")
    rows = listing_.select(F.regexp_extract(rel, "^([^/]+)/", 1).alias("bundle_id"), rel.alias("rel")).filter("bundle_id <> ''")
    return rows.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("files"), F.max((F.col("rel") == F.concat("bundle_id", F.lit("/index.md"))).cast("int")).alias("_i")).filter("_i = 1").drop("_i")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON list, or of the list under `questions`."""
    one = "id string, question string, expected_answer string, must_cite array<string>, tags array<string>"
    raw = spark.read.option("wholetext", True).text(path)
    many = F.coalesce(F.from_json("value", f"struct<questions:array<struct<{one.replace(' ', ':').replace(',:', ',')}>>>")["questions"], F.from_json("value", f"array<struct<{one.replace(' ', ':').replace(',:', ',')}>>"))
    return raw.select(F.explode(many).alias("q")).select("q.*")


def save_sync_state(state: DataFrame, path: str, shards: int = 16) -> None:
    """Write a state (path, sha256, concepts, size, mtime_ns) as JSON objects of the form that sync_state() reads, one a shard of its paths."""
    entry = F.struct("sha256", "concepts", "size", "mtime_ns")
    cut = state.groupBy(F.pmod(F.xxhash64("path"), F.lit(shards)).alias("shard")).agg(F.map_from_entries(F.collect_list(F.struct("path", entry))).alias("sources"))
    cut.select("shard", F.to_json(F.struct(F.lit(1).alias("version"), F.lit(False).alias("incomplete"), "sources")).alias("value")).repartition(shards, "shard").write.partitionBy("shard").text(path)


def sync_state(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, concepts, size, mtime_ns of a JSON state, in one file or many; a corrupt one is empty."""
    kind = "struct<version:int,incomplete:boolean,sources:map<string,struct<sha256:string,concepts:array<string>,size:bigint,mtime_ns:bigint>>>"
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", kind).alias("s"))
    return raw.select(F.explode("s.sources").alias("path", "r")).select("path", "r.*")
