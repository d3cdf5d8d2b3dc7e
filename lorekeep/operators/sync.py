"""Incremental sync: the plan of a snapshot against the state, scope, ownership, what applying it does."""

import base64
import time
import uuid
from collections.abc import Callable
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.operators.governance import index_page
from lorekeep.work import Workspace, ranked


def plan(current: DataFrame, state: DataFrame) -> DataFrame:
    """path, change, old_path, sha256, old_sha256, concepts, change_rank. current: path, sha256; state: path, sha256, concepts.

    A file that vanished and one that appeared with the same digest are a rename, nth with nth in path order.
    """
    new, old = current.select("path", "sha256"), state.select("path", F.col("sha256").alias("old_sha256"), "concepts")
    both = Workspace(current.sparkSession, "plan").keep(new.join(old, "path", "full_outer"), "both")
    nth = lambda df: ranked(df, ["sha"], ["path"], "k")  # noqa: E731  any number of files may have one digest, the empty one say
    appeared = nth(both.filter("old_sha256 is null and sha256 is not null").select("path", F.col("sha256").alias("sha")))
    vanished = nth(both.filter("sha256 is null and old_sha256 is not null").select("path", F.col("old_sha256").alias("sha"), "concepts"))
    renames = appeared.join(vanished.withColumnRenamed("path", "old_path"), ["sha", "k"]).select("path", "old_path", F.col("sha").alias("_sha"), F.col("concepts").alias("_concepts"))
    rows = both.join(renames, "path", "left").join(renames.select(F.col("old_path").alias("path"), F.lit(True).alias("_moved")), "path", "left").filter("_moved is null")
    change = (
        F.when(F.col("old_path").isNotNull(), "renamed").when(F.col("old_sha256").isNull() & F.col("sha256").isNotNull() & F.col("concepts").isNull(), "added")
        .when(F.col("sha256").isNull(), "removed").when(F.col("sha256") == F.col("old_sha256"), "unchanged").otherwise("updated")
    )
    rank = F.array_position(F.array(*[F.lit(c) for c in S.CHANGE_ORDER]), F.col("change"))
    rows = rows.withColumn("change", change).withColumn("change_rank", rank)
    return rows.select("path", "change", "old_path", "sha256", F.coalesce("old_sha256", "_sha").alias("old_sha256"), F.coalesce("concepts", "_concepts").alias("concepts"), "change_rank")


def summary(planned: DataFrame) -> DataFrame:
    """change, n: every kind of change, zeros too."""
    spark = planned.sparkSession
    kinds = spark.createDataFrame([(c,) for c in S.CHANGE_ORDER], "change string")
    counts = planned.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(kinds).join(counts, "change", "left").select("change", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def scoped(state: DataFrame, roots: DataFrame) -> DataFrame:
    """State entries at or under a scanned root: only their files may be deleted. Ancestors of a path are exploded, so the join is an equi-join."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keyed = state.withColumn("_root", F.explode(ups))
    inside = roots.select(F.regexp_replace("root", "(?<=.)/+$", "").alias("_root")).distinct()
    return keyed.join(inside, "_root", "left_semi").drop("_root").dropDuplicates(["path"])


def owners(state: DataFrame) -> DataFrame:
    """concept, owners: the paths that record each concept."""
    return state.select("path", F.explode("concepts").alias("concept")).groupBy("concept").agg(F.sort_array(F.collect_set("path")).alias("owners"))


def owned_by(path: str, state: DataFrame, concepts: DataFrame) -> DataFrame:
    """id of concepts recorded for the path, or whose resource it is, and that no other path records."""
    mine = state.filter(F.col("path") == path).select(F.explode("concepts").alias("id")).union(concepts.filter(F.col("resource") == path).select("id")).distinct()
    others = state.filter(F.col("path") != path).select(F.explode("concepts").alias("id"))
    return mine.join(others, "id", "left_anti")


def deletable(planned: DataFrame, state: DataFrame) -> DataFrame:
    """Concepts of removed files that nothing else owns; renamed and kept files still own theirs."""
    gone = planned.filter("change = 'removed'").select("path", F.explode("concepts").alias("id"))
    kept = state.join(planned.filter("change = 'removed'").select("path"), "path", "left_anti").select(F.explode("concepts").alias("id"))
    return gone.select("id").distinct().join(kept, "id", "left_anti")


def apply(planned: DataFrame, state: DataFrame, ingested: DataFrame) -> DataFrame:
    """The next state. ingested: path, concepts that added and updated files gave; an updated file that gave none keeps its record."""
    fresh = ingested.select("path", F.array_sort(F.array_distinct("concepts")).alias("_new"))
    rows = planned.filter("change <> 'removed'").join(fresh, "path", "left")
    kept = F.coalesce("_new", "concepts", F.array().cast("array<string>"))
    skipped = (F.col("change") == "updated") & F.col("_new").isNull()
    return rows.select("path", F.when(skipped, F.col("old_sha256")).otherwise(F.col("sha256")).alias("sha256"), kept.alias("concepts"))


def rewrite_resources(concepts: DataFrame, planned: DataFrame) -> DataFrame:
    """A rename changes the resource of its concepts and nothing else."""
    moved = planned.filter("change = 'renamed'").select(F.col("old_path").alias("resource"), F.col("path").alias("_to"))
    return concepts.join(moved, "resource", "left").withColumn("resource", F.coalesce("_to", "resource")).select(*concepts.columns)


def donors(files: DataFrame, manifest: DataFrame, state: DataFrame) -> DataFrame:
    """path, donor: for a file whose digest is known, the recorded path whose concepts it shares; the manifest's entry first."""
    live = state.filter(F.size("concepts") > 0).select(F.col("sha256").alias("digest"), F.col("path").alias("donor"))
    return _first_donors(files, live.join(manifest.select("digest", F.col("path").alias("donor"), F.lit(0).alias("rank")), ["digest", "donor"], "left"))


def _first_donors(files: DataFrame, live: DataFrame) -> DataFrame:
    """path, donor: the first donor of each file's digest that isn't the file itself. live: digest, donor, rank (0 where the manifest names it).

    Of a digest only the first donor and the next one can be it, so a digest that many files have gives each of them one row.
    """
    order = F.struct(F.coalesce("rank", F.lit(1)).alias("rank"), "donor")
    first = live.groupBy("digest").agg(F.min(order).alias("one"))
    others = live.join(first, "digest").filter(F.col("donor") != F.col("one.donor")).groupBy("digest").agg(F.min(order).alias("two"))
    both = files.select("path", F.col("sha256").alias("digest")).join(first.join(others, "digest", "left"), "digest")
    return both.select("path", F.when(F.col("one.donor") != F.col("path"), F.col("one.donor")).otherwise(F.col("two.donor")).alias("donor")).filter("donor is not null")


def resolve(planned: DataFrame, state: DataFrame, concepts: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, outcome, concepts, by: what becomes of the ownership of each added and removed file of a plan, all at once.

    Added: `adopted` if concepts say that they come from the path and no other entry records them (a sync that was interrupted);
    else `ingest` if the manifest doesn't know the digest; else `shared` with a recorded file (by) of the same digest, the one the manifest
    names first; else `stale` (the manifest's entry is to be dropped). Removed, in the order of paths: `kept` while another entry (by, the
    first) still records one of its concepts, be it that of a file removed later; else `removed` with the concepts that it records, or that
    say they come from it, and no entry that is left records. manifest: digest, path.
    """
    none = F.array().cast("array<string>")
    claims = state.select("path", F.explode("concepts").alias("id"))
    from_source = concepts.filter("resource is not null").select(F.col("resource").alias("path"), "id")
    added = planned.filter("change = 'added'").select("path", "sha256")
    found = added.join(from_source, "path").join(claims.select("id").distinct(), "id", "left_anti").groupBy("path").agg(F.array_sort(F.collect_set("id")).alias("adopted"))
    live = state.select(F.col("sha256").alias("digest"), F.col("path").alias("donor"))
    named = manifest.select("digest", F.col("path").alias("donor"), F.lit(0).alias("rank"))
    sharing = _first_donors(added, live.join(named, ["digest", "donor"], "left")).join(state.select(F.col("path").alias("donor"), F.col("concepts").alias("theirs")), "donor")
    known = manifest.select(F.col("digest").alias("sha256"), F.lit(True).alias("known")).distinct()
    rows = added.join(found, "path", "left").join(known, "sha256", "left").join(sharing, "path", "left")
    outcome = F.when(F.col("adopted").isNotNull(), "adopted").when(F.col("known").isNull(), "ingest").when(F.col("donor").isNotNull(), "shared").otherwise("stale")
    theirs = F.when(F.col("outcome") == "adopted", F.col("adopted")).when(F.col("outcome") == "shared", F.col("theirs")).otherwise(none)
    new = rows.withColumn("outcome", outcome).select("path", "outcome", theirs.alias("concepts"), F.when(F.col("outcome") == "shared", F.col("donor")).alias("by"))

    gone = planned.filter("change = 'removed'").select("path", F.lit(True).alias("gone"))
    marked = claims.join(gone, "path", "left")
    # of a concept's entries the first that stays, and the last that goes, decide for all of them
    per = marked.groupBy("id").agg(F.min(F.when(F.col("gone").isNull(), F.col("path"))).alias("stays"), F.max(F.when(F.col("gone"), F.col("path"))).alias("last"))
    later = ranked(marked.filter("gone").select("id", "path"), ["id"], ["path"], "k")
    after = later.select("id", (F.col("k") - 1).alias("k"), F.col("path").alias("next"))
    mine = later.join(after, ["id", "k"], "left").join(per, "id")
    firsts = mine.groupBy("path").agg(F.min(F.least("stays", "next")).alias("by"))  # nulls are skipped
    owned = mine.select("path", "id").union(gone.join(from_source, "path").select("path", "id")).distinct().join(per, "id", "left")
    free = owned.filter("stays is null and (last is null or last <= path)").groupBy("path").agg(F.array_sort(F.collect_set("id")).alias("freed"))
    old = gone.join(firsts, "path", "left").join(free, "path", "left")
    freed = F.when(F.col("by").isNull(), F.coalesce("freed", none)).otherwise(none)
    return new.unionByName(old.select("path", F.when(F.col("by").isNull(), "removed").otherwise("kept").alias("outcome"), freed.alias("concepts"), "by"))


def not_ingested(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return files.join(manifest.select(F.col("digest").alias("sha256")), "sha256", "left_anti")


def record(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by digest: the latest entry stays."""
    rows = manifest.unionByName(new)
    last = rows.groupBy("digest").agg(F.max_by(F.struct(*rows.columns), F.struct("ingested_at", "path")).alias("r"))
    return last.select("r.*")


def unrecord(manifest: DataFrame, gone: DataFrame) -> DataFrame:
    """Entries go only where the same path owns the digest."""
    return manifest.join(gone.select("digest", "path"), ["digest", "path"], "left_anti")


def staleness(state: DataFrame, current: DataFrame, failures: DataFrame) -> DataFrame:
    """path, health, detail: ok, stale or error for each recorded source."""
    rows = state.select("path", "sha256").join(current.select("path", F.col("sha256").alias("now")), "path", "left").join(failures.select("path", F.lit(True).alias("failed")), "path", "left")
    health = F.when(F.col("failed"), "error").when(F.col("now").isNull() | (F.col("now") != F.col("sha256")), "stale").otherwise("ok")
    return rows.select("path", health.alias("health"), F.when(F.col("failed"), "permanent failure").alias("detail"))


def changed_fast(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Paths whose size or time differ from the state: only these need hashing."""
    rows = listing.join(state.select("path", F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime")), "path", "left")
    return rows.filter(~(F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime_ns").eqNullSafe(F.col("_mtime")))).select(*listing.columns)


def fingerprint(listing: DataFrame) -> DataFrame:
    """One row that changes when any path, size or time does."""
    return listing.agg(F.count(F.lit(1)).alias("files"), F.sum(F.xxhash64("path", "size", "mtime_ns").cast("decimal(38,0)")).alias("fingerprint"))


#: Fixed value: how keys of paths that aren't UTF-8 begin.
KEY_PREFIX = "sync-key-b64:"


def encode_key(path: str) -> str:
    """A path as it stands, or the base64 of its bytes where it holds undecodable ones."""
    try:
        path.encode()
    except UnicodeEncodeError:
        return KEY_PREFIX + base64.b64encode(path.encode(errors="surrogateescape")).decode()
    return path


def decode_key(key: str) -> str:
    """The path of a key; what encode_key() doesn't give stands for itself."""
    if not key.startswith(KEY_PREFIX):
        return key
    try:
        path = base64.b64decode(key.removeprefix(KEY_PREFIX), validate=True).decode(errors="surrogateescape")
    except ValueError:
        return key
    return path if encode_key(path) == key else key


def preflight(planned: DataFrame, ingestable: DataFrame) -> DataFrame:
    """planned with `skipped`: updated files that wouldn't give anything keep their old concepts. ingestable: path, status of what ingesting would do."""
    state = ingestable.select("path", F.col("status").alias("_status"))
    skipped = (F.col("change") == "updated") & ~F.coalesce(F.col("_status") == "create", F.lit(False))
    return planned.join(state, "path", "left").withColumn("skipped", skipped).drop("_status")


#: Tables that a sync publishes beside the concepts.
STATE = "path string, sha256 string, concepts array<string>"
LOG = "day date, seq long, kind string, message string"
INDEX = "pos long, id string, line string"


def run_once(store, current: DataFrame, state: DataFrame | None, ingest: Callable[[DataFrame], tuple[DataFrame, DataFrame]], ingestable: DataFrame, owner: str, stale_s: float = 3600.0, roots: DataFrame | None = None, day: str | None = None) -> dict:
    """One sync under the writer's lock: plan, preflight, delete, move, ingest, publish; returns counts, the next state and whether the last sync was left incomplete.

    state: None for the one the store holds. roots (root): entries outside them are neither planned nor changed. ingest takes the paths to
    read and gives concepts and (path, concepts); what it fails on keeps its old state. A lock older than stale_s is taken over. Concepts, state,
    index page and log are published in one step at the end (the pages only where something changed), so a lost run leaves all of them as they
    were and is simply made again. day: the log's date, today (UTC) if none.
    """
    token = f"{owner}/{uuid.uuid4().hex}"
    held = store.locked_for()
    if held is not None and held > stale_s:
        store.unlock(store.holder())
    if not store.lock(token):
        return {"ran": False, "reason": "locked"}
    began = time.time()
    try:
        resumed = not store.mark("incomplete")
        known = store.beside("state", STATE) if state is None else state.select("path", "sha256", "concepts")
        inside = known if roots is None else scoped(known, roots)
        outside = None if roots is None else known.join(inside.select("path"), "path", "left_anti")
        ws = Workspace(current.sparkSession, "sync")
        planned = ws.keep(preflight(plan(current, inside), ingestable), "planned")
        concepts = store.read()
        fresh, given = ingest(planned.filter("change in ('added', 'updated') and not skipped").select("path"))
        gave = given.select("path", F.lit(True).alias("_gave")).dropDuplicates(["path"])
        leaves = (F.col("change") == "removed") | ((F.col("change") == "updated") & F.coalesce("_gave", F.lit(False)))  # an updated file that gave nothing keeps its concepts
        claims = planned.join(gave, "path", "left").select(F.explode("concepts").alias("id"), leaves.alias("leaves"))
        gone = claims.groupBy("id").agg(F.bool_and("leaves").alias("all_leave")).filter("all_leave").select("id")
        if outside is not None:
            gone = gone.join(outside.select(F.explode("concepts").alias("id")), "id", "left_anti")
        moved = rewrite_resources(concepts.join(gone, "id", "left_anti"), planned)
        new = moved.join(fresh.select("id"), "id", "left_anti").unionByName(fresh.select(*moved.columns))
        changes = {r.change: r.n for r in summary(planned).collect()}
        then = apply(planned, inside, given)
        tables = {"state": then if outside is None else then.unionByName(outside)}
        if any(n for change, n in changes.items() if change != "unchanged"):
            said = f"Sync: {', '.join(f'{changes[c]} {c}' for c in ('added', 'updated', 'renamed', 'removed'))}."
            log, today = store.beside("log", LOG), day or datetime.now(UTC).date().isoformat()
            seq = log.agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
            entry = log.sparkSession.createDataFrame([(date.fromisoformat(today), seq, "Update", said)], LOG)
            tables |= {"log": log.unionByName(entry), "index": lambda published: index_page(published).select(F.col("pos").cast("long"), "id", "line")}
        store.touch()
        version = store.publish(new, tables, token)
        store.unmark("incomplete")
        return {"ran": True, "version": version, "resumed": resumed, "state": store.beside("state", STATE), "changes": changes, "seconds": round(time.time() - began, 3)}
    finally:
        store.unlock(token)
