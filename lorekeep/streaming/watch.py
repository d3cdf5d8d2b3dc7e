"""Watching folders: polls against a recorded state, streams of changes, and windows of events."""

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.operators import sync
from lorekeep.sources import files
from lorekeep.streaming import folder


def _digests(batches: Iterator) -> Iterator:
    for pdf in batches:
        yield pdf.assign(sha256=[folder.sha256_of(p) for p in pdf["path"]])[["path", "sha256"]]


def poll(spark: SparkSession, roots: list[str], state: DataFrame, verify: bool) -> DataFrame:
    """path, sha256 of what is there now: digests are taken again where size or time differ, or everywhere with verify.

    Changed files are read where their rows are; a file that can't be read any more is left out.
    """
    if verify:
        return reduce(DataFrame.union, [files.scan(spark, r).select("path", "sha256") for r in roots]).dropDuplicates(["path"])
    now = reduce(DataFrame.union, [files.listing(spark, r) for r in roots]).dropDuplicates(["path"])
    now = now.filter(~F.lower(F.element_at(F.split("path", "/"), -1)).isin(*S.RESERVED))
    changed = sync.changed_fast(now, state).select("path")
    rehashed = changed.mapInPandas(_digests, "path string, sha256 string").filter("sha256 is not null")
    kept = now.select("path").join(changed, "path", "left_anti").join(state.select("path", "sha256"), "path")
    return kept.select("path", "sha256").unionByName(rehashed)


def watch(spark: SparkSession, roots: list[str], on_change: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds", verify_ms: int = 300_000, exclude: list[str] = []):  # noqa: B006
    """A running query that calls on_change(events, batch id) after each listing of the roots that shows a change.

    The first batch gives every file as added. A batch that fails is made again from the states before it, so on_change may see an event
    twice, never not at all; the checkpoint keeps the query the only writer of its place.
    """

    def batch(changes: DataFrame, i: int) -> None:
        changes.persist()
        try:
            if not changes.isEmpty():
                on_change(changes, i)
        finally:
            changes.unpersist()

    found = folder.events(folder.listings(spark, roots, exclude), verify_ms)
    return found.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(processingTime=every).start()


def event_states(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of a stream of events by window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")
