"""Patches of many concepts at once: what each does, what it takes from the trust in them, and the change of the body as hunks.

A patch may set a title and a body. Hunks are rows, found line by line in Arrow batches (longest matching blocks), and applied
to the old body with array functions, so a preview can be kept, joined and replayed like any table.
"""

import difflib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import temporal as T
from lorekeep.functions import text as X
from lorekeep.work import slices

HUNK = "id string, k int, old_at int, removed array<string>, new_at int, added array<string>"
LINKS_SECTION = r"(?s)(?:^|\n)## Links\n.*$"


def patched(concepts: DataFrame, patches: DataFrame) -> DataFrame:
    """id, outcome, changed (names of fields), lost_trust, and the new title, body and verified of each patch (id, title, body, downgrade; ids are unique).

    `missing`: there is no such concept. `empty`: a blank title or body, or neither. `refused`: a human has reviewed the concept and
    the patch doesn't say that this may be lost. `no change`: all is as it was. Else `updated`: a human's review is lost by any change, a
    machine's by a new body only. A new body keeps the links section that the old one ends with.
    """
    rows = patches.select("id", F.col("title").alias("p_title"), F.col("body").alias("p_body"), F.coalesce("downgrade", F.lit(False)).alias("downgrade"))
    old = concepts.select("id", "title", "body", "verified", F.lit(True).alias("there"))
    rows = rows.join(old, "id", "left").withColumn("tier", T.trust_tier("verified"))
    blank = (F.col("p_title").isNotNull() & X.blank("p_title")) | (F.col("p_body").isNotNull() & X.blank("p_body")) | (F.col("p_title").isNull() & F.col("p_body").isNull())
    section = F.regexp_extract(F.coalesce("body", F.lit("")), LINKS_SECTION, 0)
    body = F.when(F.col("p_body").isNull(), F.col("body")).when((section != "") & ~F.col("p_body").rlike(LINKS_SECTION), F.concat(F.regexp_replace("p_body", r"\s+$", ""), F.lit("\n"), F.regexp_replace(section, r"^\n?", "\n"))).otherwise(F.col("p_body"))
    title = F.coalesce(X.strip("p_title"), "title")
    rows = rows.withColumns({"n_title": title, "n_body": body})
    names = F.array_compact(F.array(F.when(~F.col("n_title").eqNullSafe(F.col("title")), "title"), F.when(~F.col("n_body").eqNullSafe(F.col("body")), "body")))
    rows = rows.withColumn("changed", names)
    outcome = (
        F.when(F.col("there").isNull(), "missing").when(blank, "empty").when((F.col("tier") == "human-reviewed") & ~F.col("downgrade"), "refused")
        .when(F.size("changed") == 0, "no change").otherwise("updated")
    )
    rows = rows.withColumn("outcome", outcome)
    done = F.col("outcome") == "updated"
    lost = done & ((F.col("tier") == "human-reviewed") | ((F.col("tier") == "machine-confirmed") & F.array_contains("changed", "body")))
    none = F.array().cast("array<string>")
    pick = lambda new, was: F.when(done, F.col(new)).otherwise(F.col(was))
    return rows.withColumn("lost_trust", lost).select(
        "id", "outcome", F.when(done, F.col("changed")).otherwise(none).alias("changed"), "lost_trust", pick("n_title", "title").alias("title"), pick("n_body", "body").alias("body"), F.when(~F.col("lost_trust"), F.col("verified")).alias("verified")
    )


def apply(concepts: DataFrame, patches: DataFrame) -> DataFrame:
    """The concepts after their patches; one that isn't patched, or whose patch does nothing, stays as it is."""
    new = patched(concepts, patches).filter("outcome = 'updated'").select("id", *[F.col(c).alias(f"_{c}") for c in ("title", "body", "verified")], F.lit(True).alias("_done"))
    rows = concepts.join(new, "id", "left")
    return rows.select(*[F.when(F.col("_done"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("title", "body", "verified") else F.col(c) for c in concepts.columns])


def hunks(pairs: DataFrame) -> DataFrame:
    """id, k, old_at, removed, new_at, added: the lines of each pair (id, old, new) that differ, in order; places from 0. Null counts as empty."""
    names = [c.split()[0] for c in HUNK.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.string())]

    def run(batches):
        for batch in slices(batches):
            out = []
            for i, old, new in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                a, b = (old or "").split("\n"), (new or "").split("\n")
                if a == b:
                    continue
                found = [g for g in difflib.SequenceMatcher(None, a, b, False).get_opcodes() if g[0] != "equal"]
                out += [(i, k, x, a[x:y], u, b[u:v]) for k, (_, x, y, u, v) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return pairs.select(F.col("id").cast("string").alias("id"), "old", "new").mapInArrow(run, HUNK)


def rebuilt(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """id, new: the old texts (id, old) with their hunks applied."""
    each = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("old_at", "k", "removed", "added"))).alias("h"))  # a text's own hunks
    lines = F.split(F.coalesce("old", F.lit("")), "\n", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("lines"))

    def step(done, h):
        kept = F.slice("l", done["at"] + 1, h["old_at"] - done["at"])
        return F.struct((h["old_at"] + F.size(h["removed"])).alias("at"), F.concat(done["lines"], kept, h["added"]).alias("lines"))

    rest = lambda done: F.concat(done["lines"], F.slice("l", done["at"] + 1, F.size("l") - done["at"]))
    rows = pairs.select(F.col("id").cast("string").alias("id"), lines.alias("l")).join(each, "id", "left")
    return rows.select("id", F.array_join(F.when(F.col("h").isNull(), F.col("l")).otherwise(F.aggregate("h", start, step, rest)), "\n").alias("new"))
