"""Nested values from callers, as JSON texts: their size, and a copy without markers of trust.

A value is taken apart level by level: the containers of a level are exploded as variants and their children are the next one,
until nothing is nested or the levels allowed are over. Nodes, depth and characters are counts over the levels. What passes is
put together again at once: each node that stays gives the JSON before its children and, as a container, its end after them, and these pieces
are joined in the order of their places. A value over a bound is refused before anything of it is grouped, so no group holds more than twice the nodes allowed.

Defined cases. A null or what isn't JSON is refused as such. Keys come back in code-point order and numbers in their shortest form, as variants have them.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.work import Workspace

# What is refused depends on them.
MAX_DEPTH, MAX_NODES, MAX_CHARS = 32, 10_000, 1_000_000
MARKER = "verified"
_NODE = "id, path, key, kind, value, first, gone"
#: A place behind all children.
_END = (1 << 31) - 1


def _kind(value):
    first = F.substring(value, 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "text").otherwise("other")


def _levels(values: DataFrame, ws: Workspace, depth: int, marker: str) -> list[DataFrame]:
    """The nodes of each level: id, path (places from the top), key, kind, value as JSON, first (of its siblings that stay), gone (with a key that is the marker)."""
    top = values.select("id", F.to_json(F.try_parse_json("value")).alias("value")).filter("value is not null")
    level = top.select("id", F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("key"), _kind(F.col("value")).alias("kind"), "value", F.lit(True).alias("first"), F.lit(False).alias("gone"))
    out = [ws.keep(level, "level0")]
    while len(out) <= depth + 1:
        # keys stand in one order, so where the marker is the first one its next sibling is the first that stays
        led = F.coalesce((F.col("kind") == "object") & (F.get(F.json_object_keys("value"), F.lit(0)) == marker), F.lit(False))
        nested = out[-1].filter("kind in ('object', 'array')").select("id", "path", "gone", led.alias("led"), F.parse_json("value").alias("v"))
        each = nested.lateralJoin(nested.sparkSession.tvf.variant_explode(F.col("v").outer()))
        value = F.coalesce(F.to_json(F.col("value")), F.lit("null"))
        first = (F.col("pos") == 0) | ((F.col("pos") == 1) & F.col("led"))
        gone = F.col("gone") | F.coalesce(F.col("key") == marker, F.lit(False))
        level = each.select("id", F.concat("path", F.array("pos")).alias("path"), "key", value.alias("value"), first.alias("first"), gone.alias("gone"))
        level = ws.keep(level.withColumn("kind", _kind(F.col("value"))).selectExpr(*_NODE.split(", ")), f"level{len(out)}")
        if not level.limit(1).count():
            break
        out.append(level)
    return out


def _pieces():
    """The places and texts that a node gives to its value's JSON."""
    named = F.to_json(F.array("key"))
    lead = F.concat(F.when(F.col("first"), "").otherwise(","), F.when(F.col("key").isNull(), "").otherwise(F.concat(F.expr("substring(n, 2, length(n) - 2)"), F.lit(":"))))
    ends = {"object": ("{", "}"), "array": ("[", "]")}
    opened, closed = (F.when(F.col("kind") == "object", ends["object"][k]).when(F.col("kind") == "array", ends["array"][k]) for k in (0, 1))
    start = F.struct("path", F.concat("lead", F.coalesce(opened, F.col("value"))).alias("piece"))
    stop = F.struct(F.concat("path", F.array(F.lit(_END))).alias("path"), closed.alias("piece"))
    return named, lead, F.when(closed.isNull(), F.array(start)).otherwise(F.array(start, stop))


def clean(values: DataFrame, marker: str = MARKER, depth: int = MAX_DEPTH, nodes: int = MAX_NODES, chars: int = MAX_CHARS) -> DataFrame:
    """id, nodes, depth, chars, refused (why, or null), cleaned (JSON without the marker's keys) of values (id, value: JSON text; ids are unique)."""
    ws = Workspace(values.sparkSession, "hygiene")
    values = ws.keep(values.select("id", "value"), "values")
    levels = _levels(values, ws, depth, marker)
    text = F.when(F.col("kind") == "text", F.length(F.get_json_object(F.concat(F.lit('{"t":'), "value", F.lit("}")), "$.t"))).otherwise(0)
    counts = reduce(DataFrame.union, [level.select("id", text.alias("chars"), F.lit(k).alias("depth")) for k, level in enumerate(levels)])
    sized = counts.groupBy("id").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"), F.sum("chars").alias("chars"))
    why = F.when(F.col("nodes").isNull(), "no JSON").when(F.col("depth") > depth, "too deep").when(F.col("nodes") > nodes, "too many items").when(F.col("chars") > chars, "too large")
    judged = ws.keep(values.select("id").join(sized, "id", "left").withColumn("refused", why), "judged")
    passed = judged.filter("refused is null").select("id")
    named, lead, pieces = _pieces()
    kept = reduce(DataFrame.union, levels).filter("not gone").join(passed, "id", "left_semi")
    each = kept.withColumn("n", named).withColumn("lead", lead).select("id", F.explode(pieces).alias("p"))
    built = each.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("cleaned"))
    return judged.join(built, "id", "left").select("id", "nodes", "depth", "chars", "refused", "cleaned")
