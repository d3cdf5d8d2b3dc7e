"""Governed writes, snapshots, diffs, provenance, audit, activity, paging and bundle statistics.

A bundle is a folder of versions (Parquet) with a pointer file _CURRENT. A write builds the next version, validates
it, and publishes by replacing the pointer; readers resolve the pointer once. Paths go through Hadoop's file system.
"""

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.functions import temporal as T
from lorekeep.functions import text as X
from lorekeep.work import ranked



class Store:
    """Versioned concepts under a root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _version(self) -> str | None:
        current = self._text("_CURRENT")
        if current is None and self._fs.exists(self._path(self.root)) and any(s.getPath().getName().startswith("v-") for s in self._fs.listStatus(self._path(self.root))):
            raise FileNotFoundError(f"{self.root} has versions but no pointer to one")
        return current

    def read(self) -> DataFrame:
        """The published version; empty before the first."""
        v = self._version()
        return self.spark.read.schema(S.CONCEPT).parquet(f"{self.root}/{v}") if v else self.spark.createDataFrame([], S.CONCEPT)

    def beside(self, name: str, kind: str) -> DataFrame:
        """A table that was published with the concepts of the current version; empty if none was. kind: its schema."""
        v = self._version()
        there = v and self._fs.exists(self._path(f"{self.root}/{v}/_{name}"))
        return self.spark.read.schema(kind).parquet(f"{self.root}/{v}/_{name}") if there else self.spark.createDataFrame([], kind)

    def publish(self, concepts: DataFrame, beside: dict | None = None, owner: str | None = None) -> str:
        """Make concepts the next version, with tables beside them (sync state, index, log): readers see all of it or nothing.

        A table may be a function of the concepts as they were written. Tables that aren't given are taken over from the current version. With owner, nothing is published unless the lock is still its own.
        """
        v, old, new = f"v-{uuid.uuid4().hex}", self._version(), beside or {}
        concepts.write.parquet(f"{self.root}/{v}")
        for name, table in new.items():
            made = table(self.spark.read.schema(concepts.schema).parquet(f"{self.root}/{v}")) if callable(table) else table
            made.write.parquet(f"{self.root}/{v}/_{name}")
        for name in () if old is None else (s.getPath().getName()[1:] for s in self._fs.listStatus(self._path(f"{self.root}/{old}")) if s.isDirectory() and s.getPath().getName().startswith("_")):
            if name not in new:
                self.spark.read.parquet(f"{self.root}/{old}/_{name}").write.parquet(f"{self.root}/{v}/_{name}")
        if owner is not None and self.holder() != owner:
            self._fs.delete(self._path(f"{self.root}/{v}"), True)
            raise RuntimeError(f"the lock of {self.root} isn't held by {owner} any more")
        tmp, to = self._path(f"{self.root}/_CURRENT.{v}"), self._path(f"{self.root}/_CURRENT")
        out = self._fs.create(tmp, True)
        out.write(bytearray(v.encode()))
        out.close()
        jvm = self.spark._jvm
        replace = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        replace[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(tmp), self._fs.makeQualified(to), replace)  # readers see the old pointer or the new one
        return v

    def lock(self, owner: str) -> bool:
        """Take the single writer's lock; False if another holds it."""
        try:
            out = self._fs.create(self._path(f"{self.root}/_LOCK"), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(owner.encode()))
        out.close()
        return True

    def unlock(self, owner: str | None = None) -> None:
        """Give the lock back; with owner only if it is its own."""
        if owner is None or self.holder() == owner:
            self._fs.delete(self._path(f"{self.root}/_LOCK"), False)

    def holder(self) -> str | None:
        """Who holds the lock."""
        return self._text("_LOCK")

    def _text(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def mark(self, name: str) -> bool:
        """Leave a mark that lasts until unmark(); False if it was there already."""
        return bool(self._fs.createNewFile(self._path(f"{self.root}/_MARK_{name}")))

    def unmark(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/_MARK_{name}"), False)

    def locked_for(self) -> float | None:
        """Seconds since the lock was taken or touched; None without a lock."""
        p = self._path(f"{self.root}/_LOCK")
        return max(0.0, datetime.now(UTC).timestamp() - self._fs.getFileStatus(p).getModificationTime() / 1000) if self._fs.exists(p) else None

    def touch(self) -> None:
        now = int(datetime.now(UTC).timestamp() * 1000)
        self._fs.setTimes(self._path(f"{self.root}/_LOCK"), now, now)

    def audit(self, actor: str, action: str, concept_id: str, summary: str, ts: str | None = None) -> None:
        row = [(ts or datetime.now(UTC).isoformat(timespec="seconds"), actor, action, concept_id, summary)]
        self.spark.createDataFrame(row, "ts string, actor string, action string, concept_id string, summary string").coalesce(1).write.mode("append").json(f"{self.root}/_audit")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same id."""
    return old.join(new.select("id"), "id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete(concepts: DataFrame, ids: DataFrame) -> DataFrame:
    return concepts.join(ids.select("id"), "id", "left_anti")


def insert_only(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next version and the ids that were refused because they exist."""
    refused = new.join(old.select("id"), "id", "left_semi").select("id")
    return old.unionByName(new.join(old.select("id"), "id", "left_anti").select(*old.columns)), refused


def new_errors(before: DataFrame, after: DataFrame) -> DataFrame:
    """Validation errors that a change brings."""
    keys = ["code", "file", "message"]
    return after.filter("severity = 'error'").join(before.filter("severity = 'error'").select(*keys), keys, "left_anti")


def governed_update(store: Store, change, actor: str, action: str, concept_id: str, validate, summary: str = "") -> dict:
    """change: concepts -> concepts, under the writer's lock. Published and audited only if validation shows no new error; nothing is written for a change that changes nothing."""
    if not store.lock(actor):
        return {"written": False, "reason": "locked"}
    try:
        return _update(store, change, actor, action, concept_id, validate, summary)
    finally:
        store.unlock()


def _update(store: Store, change, actor: str, action: str, concept_id: str, validate, summary: str) -> dict:
    before = store.read()
    after = change(before)
    if not diff(before, after).filter("change <> 'unchanged'").limit(1).count():
        return {"written": False, "reason": "no change"}
    bad = new_errors(validate(before), validate(after)).orderBy("code", "file").limit(50).collect()
    if bad:
        return {"written": False, "reason": "validation", "errors": [r.asDict() for r in bad]}
    version = store.publish(after)
    store.audit(actor, action, concept_id, summary)
    return {"written": True, "version": version}


def previewed(before: DataFrame, after: DataFrame, validate) -> tuple[DataFrame, DataFrame]:
    """(id, change of what a change alters; severity, code, file, message of the errors it brings): all of them, with nothing written."""
    return diff(before, after).filter("change <> 'unchanged'"), new_errors(validate(before), validate(after))


def preview(store: Store, change, validate) -> dict:
    """What a change would do, with nothing written: ids by kind of change, and the errors it would bring, the first fifty of each."""
    before = store.read()
    changes, bad = previewed(before, change(before), validate)
    changes = changes.orderBy("change", "id").limit(50).collect()
    bad = bad.orderBy("code", "file").limit(50).collect()
    return {"changes": [(r.id, r.change) for r in changes], "errors": [r.asDict() for r in bad]}


def downgrade(concepts: DataFrame, concept_id: str, **fields) -> DataFrame:
    """Set fields of one concept; its verifications go, since what was verified has changed."""
    here = F.col("id") == concept_id
    out = concepts.withColumns({k: F.when(here, F.lit(v)).otherwise(F.col(k)) for k, v in fields.items()})
    return out.withColumn("verified", F.when(here, F.lit(None).cast("array<struct<by:string,at:string>>")).otherwise(F.col("verified")))


def concept_hash(names):
    """Of all that a concept has; columns it hasn't count as null."""
    return F.sha2(F.to_json(F.struct(*names)), 256)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change: added, removed, changed or unchanged by the hash of all that a concept has, but for its own source_digest."""
    names = sorted({*old.columns, *new.columns} - {"id", "source_digest"})
    own = lambda df: [F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names]
    a, b = old.select("id", concept_hash(own(old)).alias("_old")), new.select("id", concept_hash(own(new)).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged")
    return a.join(b, "id", "full_outer").select("id", change.alias("change"))


def diff_state(concepts: DataFrame, state: DataFrame, current: DataFrame, root: str) -> DataFrame:
    """id, change, origin against a sync state; paths outside the root aren't trusted and count as unhashed."""
    recorded = state.filter(F.col("path").startswith(f"{root.rstrip('/')}/") & ~F.col("path").contains("/../")).select("path", "sha256", F.explode("concepts").alias("id"))
    moved = recorded.join(current.select("path", F.col("sha256").alias("now")), "path", "left").filter("now is null or now <> sha256")
    first = moved.groupBy("id").agg(F.min("path").alias("origin"))
    rows = concepts.select("id", F.lit(True).alias("here")).join(recorded.select("id", F.lit(True).alias("known")).distinct(), "id", "full_outer").join(first, "id", "left")
    change = F.when(F.col("known").isNull(), "added").when(F.col("here").isNull(), "removed").when(F.col("origin").isNotNull(), "changed").otherwise("unchanged")
    return rows.select("id", change.alias("change"), "origin")


def provenance_of_all(concepts: DataFrame) -> DataFrame:
    """id, section, pos, ref, detail: sources, verifications and footnotes of each concept."""
    one = concepts
    src = one.select("id", F.lit("source").alias("section"), F.posexplode("sources").alias("pos", "s")).select("id", "section", "pos", F.col("s.id").alias("ref"), F.coalesce("s.resource", F.lit("")).alias("detail"))
    ver = one.select("id", F.lit("verified").alias("section"), F.posexplode("verified").alias("pos", "v")).select("id", "section", "pos", F.col("v.by"), F.coalesce("v.at", F.lit("")))
    notes = one.select("id", F.lit("footnote").alias("section"), F.posexplode(X.footnote_refs("body")).alias("pos", "ref"), F.transform(F.coalesce("sources", F.from_json(F.lit("[]"), "array<struct<id:string,resource:string,title:string,author:string,last_modified:string>>")), lambda s: s["id"]).alias("known"))
    return src.union(ver).union(notes.select("id", "section", "pos", "ref", F.when(F.array_contains("known", F.col("ref")), "resolved").otherwise("unresolved")))


def provenance(concepts: DataFrame, concept_id: str) -> DataFrame:
    """section, pos, ref, detail of one concept."""
    return provenance_of_all(concepts.filter(F.col("id") == concept_id)).drop("id")


def audit_log(raw: DataFrame, limit: int = 20) -> DataFrame:
    """raw: value, seq. The last entries, newest first; lines that aren't JSON objects are skipped."""
    got = raw.withColumn("j", F.from_json("value", "ts string, actor string, action string, concept_id string, summary string")).filter("j.action is not null")
    return got.orderBy(F.desc("seq")).limit(limit).select("seq", "j.ts", "j.actor", "j.action", "j.concept_id", "j.summary")


def activity(log_text: DataFrame, limit: int | None = 20) -> DataFrame:
    """log_text: bundle_id, text. Entries `* **Kind**: message` under their day, newest first; without a limit all, in no order."""
    rows = log_text.select("bundle_id", F.posexplode(X.split_lines("text")).alias("pos", "line"))
    day = F.when(F.col("line").rlike(r"^##\s+\d{4}-\d{2}-\d{2}\s*$"), F.regexp_extract("line", r"(\d{4}-\d{2}-\d{2})", 1))
    rows = rows.withColumn("day", F.last(day, ignorenulls=True).over(Window.partitionBy("bundle_id").orderBy("pos")))
    entry = r"^\*\s+\*\*([^*]+)\*\*:\s*(.*)$"
    rows = rows.filter(F.col("line").rlike(entry) & F.col("day").isNotNull())
    found = rows.select("bundle_id", "day", "pos", F.regexp_extract("line", entry, 1).alias("kind"), F.regexp_extract("line", entry, 2).alias("message"))
    return found if limit is None else found.orderBy(F.desc("day"), "bundle_id", "pos").limit(limit)


def render_log(entries: DataFrame) -> DataFrame:
    """bundle_id, text of a log, days and entries newest first. entries: bundle_id, day, seq, kind, message."""
    line = F.concat(F.lit("* **"), F.col("kind"), F.lit("**: "), F.col("message"))
    per = entries.filter(F.col("kind").isin("Creation", "Update", "Deprecation")).groupBy("bundle_id", "day").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("line"))), asc=False).alias("e"))
    block = F.concat(F.lit("## "), F.col("day").cast("string"), F.lit("\n\n"), F.array_join(F.transform("e", lambda x: x["line"]), "\n"))
    return per.groupBy("bundle_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", block.alias("b"))), asc=False), lambda x: x["b"]), "\n\n").alias("text"))


def index_page(concepts: DataFrame, prefix: str = "", by: tuple[str, ...] = ()) -> DataFrame:
    """pos, id, line of an index file, one of each bundle with `by`: titles in case-folded order, links relative to the prefix."""
    inside = concepts.filter(F.col("id").startswith(prefix)) if prefix else concepts
    rel = F.expr(f"substr(id, {len(prefix) + 1})") if prefix else F.col("id")
    title = F.when(X.blank("title"), X.leaf("id")).otherwise(F.col("title"))
    line = F.concat(F.lit("* ["), title, F.lit("]("), rel, F.lit(".md)"), F.when(X.blank("description"), "").otherwise(F.concat(F.lit(" - "), F.col("description"))))
    rows = inside.select(*by, F.lower(title).alias("_t"), "id", line.alias("line"))
    return ranked(rows, list(by), ["_t", "id"], "pos").select(*by, "pos", "id", "line")


def paged(units: DataFrame, offset: int = 0, max_chunks: int = S.PAGE_UNITS, max_tokens: int | None = None) -> DataFrame:
    """units (pos, text) of one page, with what remains. The first unit is shown whatever its cost if there is any budget; then up to the first overflow."""
    take = max(1, min(max_chunks, S.PAGE_UNITS))
    cost = F.greatest(F.lit(1), F.floor(F.length("text") / S.CHARS_PER_TOKEN))
    total = units.count()
    if offset > total:
        raise ValueError("continuation past the end")
    rows = units.filter((F.col("pos") >= offset) & (F.col("pos") < offset + take)).withColumn("cost", F.sum(cost).over(Window.orderBy("pos")))
    if max_tokens is not None:
        rows = rows.filter((F.col("cost") <= max_tokens) | ((F.col("pos") == offset) & F.lit(max_tokens > 0)))
    shown = rows.agg(F.count(F.lit(1)).alias("shown"))
    return rows.crossJoin(F.broadcast(shown)).select("pos", "text", F.col("cost").cast("long").alias("tokens_so_far"), (F.lit(total - offset) - F.col("shown")).cast("long").alias("remaining"))


def bundle_stats(concepts: DataFrame) -> DataFrame:
    """One row a bundle: concepts, tiers, distinct sources."""
    tier = T.trust_tier("verified")
    rows = concepts.withColumn("tier", tier)
    return rows.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("tier") == "human-reviewed").alias("human"), F.count_if(F.col("tier") == "machine-confirmed").alias("machine"),
        F.count_if(F.col("tier") == "unverified").alias("unverified"), F.count_distinct("resource").alias("resources"), F.sum(F.length("body")).alias("chars"),
    )


def strip_links_section(body):
    return X.strip(F.regexp_replace(body, r"(?s)(^|\n)## Links\n.*$", ""))


def with_links_section(body, links: list[tuple[str, str]]):
    lines = "\n".join(f"- [{text}]({target})" for text, target in links)
    base = strip_links_section(body)
    return F.concat(base, F.lit(f"\n\n## Links\n\n{lines}\n")) if links else base


def chat_context(hits: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, turn, ids: a turn's hits, or those of the last turn before it that had any. hits: conv_id, turn, ids."""
    rows = turns.select("conv_id", "turn").join(hits, ["conv_id", "turn"], "left")
    kept = F.last(F.when(F.size("ids") > 0, F.col("ids")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select("conv_id", "turn", F.coalesce(kept, F.array().cast("array<string>")).alias("ids"))


def audit_line(ts: str, actor: str, action: str, concept_id: str, summary: str) -> str:
    return json.dumps({"ts": ts, "actor": actor, "action": action, "concept_id": concept_id, "summary": summary}, ensure_ascii=False)
