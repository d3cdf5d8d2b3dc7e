"""A prefix trie over conversations by preorder intervals.

Method. A turn is the digest of its role and text, and a prefix of a conversation is known by the sum of hashes of its
turns with their places, so that prefixes of one very long conversation are running sums in blocks. Distinct
prefixes are the nodes. A node whose parent has members that don't go through it is a choice; a
sequence's path is the digests of its choices, which order sequences as the digests of all their turns would (of two that
differ, the choice where they part decides; one that ends goes first). Distinct sequences are sorted by path in
ranges; the least and the largest place of a node's members span its subtree. Sorted by least place and depth, nodes are
in preorder: their place is `position`, the last one of the subtree `end`. Leaves and savings of a subtree
are differences of prefix sums over positions at end and before position.

Bounds. A path with b choices needs b other sequences that share 1, 2, ... b of its turns, so paths hold at most the square
root of twice the turns, and all of them together no more digests than there are turns. Members that end at a node are
joined to chunks of CHUNK ids, whose text one hash reads in order: SHA-256 can't be computed in parts.

Defined cases. Turns of one conversation with the same turn number, or none, are ordered by their digest. Null roles and texts are
empty. Rows without a conv_id belong to no conversation and are left out. Repeated rows are turns of their own. Remainders have the
sign of the id. Without conversations there are no nodes. Other columns are ignored, whatever their names.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import Workspace, numbered, running, small

#: Ids in one piece of the text that a node's hash reads. Conversations that share a base, and what h is a remainder of.
CHUNK, SIBLINGS, HEADS = 512, 5, 9
NODE = ["depth", "id1", "id2"]
LOW = (1 << 32) - 1


def turn_key(role, text):
    """128 bits of digest of a turn."""
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(framed.cast("binary"), 256)), 1, 16)


def _role_text():
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]


def texts(conversations: DataFrame) -> DataFrame:
    """key, role, text of each distinct turn, to be joined to the key of nodes."""
    role, text = _role_text()
    return conversations.select(turn_key(role, text).alias("key"), role.alias("role"), text.alias("text")).dropDuplicates(["key"])


def sequences(conversations: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos from 0, key, bytes) and conversations (conv_id, length)."""
    role, text = _role_text()
    slim = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key(role, text).alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    placed = numbered(slim, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")], ws, "placed")
    each = ws.keep(placed.groupBy("conv_id").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("length")), "conversations")
    turns = placed.join(small(each.select("conv_id", "first")), "conv_id").select("conv_id", (F.col("n") - F.col("first")).alias("pos"), "key", "bytes")
    return turns, each.select("conv_id", "length")


def rebuilt(turns: DataFrame, each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same with the first h turns of each conversation taken from the first of its SIBLINGS."""
    base = F.col("conv_id") - F.col("conv_id") % SIBLINGS
    named = each.select("conv_id", "length", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"))
    bases = each.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    named = named.join(bases, "base", "left").withColumn("have", F.least("h", F.coalesce("base_length", F.lit(0))))
    lengths = named.select("conv_id", (F.col("have") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"))
    heads = turns.filter(F.col("pos") < HEADS - 1).withColumnRenamed("conv_id", "base").join(named.select("conv_id", "base", "h"), "base").filter("pos < h")
    own = turns.join(small(named.select("conv_id", "h", "have")), "conv_id").filter("pos >= h").withColumn("pos", F.col("have") + F.col("pos") - F.col("h"))
    slim = ["conv_id", "pos", "key", "bytes"]
    return heads.select(slim).unionByName(own.select(slim)), lengths


def prefixes(turns: DataFrame, each: DataFrame, ws: Workspace) -> DataFrame:
    """conv_id, depth, id1, id2 of the prefix and up1, up2 of the one before, key, bytes, last; a row a turn."""
    halves = lambda x: [F.shiftrightunsigned(x, 32), x.bitwiseAND(LOW)]
    parts = [*halves(F.xxhash64("pos", "key")), *halves(F.xxhash64("key", "pos", F.lit(1)))]
    hashed = turns.select("*", *[p.alias(f"p{i}") for i, p in enumerate(parts)], *[p.alias(f"s{i}") for i, p in enumerate(parts)])
    summed = running(ws.keep(hashed, "hashed"), ["conv_id"], "pos", [f"s{i}" for i in range(4)], ws, "prefixes")
    low = lambda i, own: (F.col(f"s{i}") - (F.col(f"p{i}") if own else 0)).bitwiseAND(LOW)
    pair = lambda i, own: F.shiftleft(low(i, own), 32).bitwiseOR(low(i + 1, own))
    ends = small(each.select("conv_id", "length"))
    return summed.join(ends, "conv_id").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), pair(0, False).alias("id1"), pair(2, False).alias("id2"), pair(0, True).alias("up1"), pair(2, True).alias("up2"),
        "key", "bytes", (F.col("pos") + 1 == F.col("length")).alias("last"),
    )


def _nodes(rows: DataFrame, each: DataFrame) -> DataFrame:
    same = F.when(F.min("key") == F.max("key"), F.min("key")).otherwise(F.raise_error(F.lit("two prefixes have one hash")))
    below = rows.groupBy(*NODE).agg(
        F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if("last").alias("ends"), same.alias("key"), F.max("bytes").alias("bytes")
    )
    none = lambda kind: F.lit(None).cast(kind)
    root = each.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("length") == 0).alias("ends")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    return below.unionByName(root.select(zero.alias("depth"), zero.alias("id1"), zero.alias("id2"), none("long").alias("up1"), none("long").alias("up2"), "conv_id", "n_convs", "ends", none("binary").alias("key"), zero.alias("bytes")))


def _hashed(batches):
    """SHA-256 of each node's chunks, which come in order."""
    at, state = None, None
    for batch in batches:
        done = []
        for *node, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if node != at:
                if at:
                    done.append((*at, state.hexdigest()))
                at, state = node, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*NODE, "ends_sha256"])
    if at:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*at, state.hexdigest())], [*NODE, "ends_sha256"])


def end_hashes(rows: DataFrame, each: DataFrame, ws: Workspace) -> DataFrame:
    """depth, id1, id2, ends_sha256 of the nodes at which members end."""
    zero = F.lit(0).cast("long")
    ended = rows.filter("last").select(*NODE, "conv_id").unionByName(each.filter("length = 0").select(zero.alias("depth"), zero.alias("id1"), zero.alias("id2"), "conv_id"))
    placed = numbered(ended, [*map(F.col, NODE), F.col("conv_id")], ws, "ended")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = placed.groupBy(*NODE, F.floor(F.col("n") / CHUNK).alias("chunk")).agg(ids.alias("ids"))
    sorted_ = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return sorted_.select(*NODE, "ids").mapInArrow(_hashed, "depth long, id1 long, id2 long, ends_sha256 string")


def trie(turns: DataFrame, each: DataFrame, ws: Workspace) -> DataFrame:
    """The nodes of the conversations with these turns (conv_id, pos, key, bytes) and lengths (conv_id, length).

    position, end, depth, key, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    each = ws.keep(each, "lengths")
    rows = ws.keep(prefixes(turns, each, ws), "rows")
    nodes = ws.keep(_nodes(rows, each), "nodes")
    shared = nodes.filter("n_convs > 1").select((F.col("depth") + 1).alias("depth"), F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("n_convs").alias("above"), F.col("conv_id").alias("parent"))
    nodes = nodes.join(small(shared), ["depth", "up1", "up2"], "left")
    # an unshared parent has the one member that its child has
    nodes = nodes.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))).withColumn("chosen", F.coalesce(F.col("n_convs") < F.col("above"), F.lit(False)))
    nodes = ws.keep(nodes.drop("above", "parent"), "chosen")
    choices = nodes.filter("chosen")
    children = choices.groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("id1"), F.col("up2").alias("id2")).agg(F.count(F.lit(1)).alias("n_children"))

    reps = ws.keep(rows.filter("last").groupBy(*NODE).agg(F.min("conv_id").alias("conv_id")).select("conv_id"), "distinct")
    theirs = ws.keep(rows.join(small(reps), "conv_id", "left_semi").select("conv_id", *NODE, "key"), "theirs")
    made = theirs.join(small(choices.select(*NODE)), NODE).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "key"))).alias("made"))
    path = F.coalesce(F.array_join(F.transform("made", lambda c: F.hex(c["key"])), ""), F.lit(""))
    ranked = numbered(reps.join(made, "conv_id", "left").select("conv_id", path.alias("path")), [F.col("path")], ws, "paths", "r").select("conv_id", "r")
    span = theirs.join(small(ws.keep(ranked, "ranked")), "conv_id").groupBy(*NODE).agg(F.min("r").alias("low"), F.max("r").alias("high"))
    most = F.lit(max(0, reps.count() - 1)).cast("long")  # the root spans all
    spanned = nodes.join(span, NODE, "left").withColumns({"low": F.coalesce("low", F.lit(0).cast("long")), "high": F.coalesce("high", most)})

    leaf, save = (F.col("n_convs") == F.col("ends")).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    ordered = numbered(spanned.withColumns({"leaf": leaf, "save": save, "leaves": leaf, "saves": save}), [F.col("low"), F.col("depth")], ws, "preorder", "position")
    ordered = ws.keep(running(ordered, [], "position", ["leaves", "saves"], ws, "sums"), "summed")
    tails = ordered.groupBy(F.col("low").alias("high")).agg(F.max("position").alias("end"), F.max("leaves").alias("_leaves"), F.max("saves").alias("_saves"))
    out = ordered.join(small(ws.keep(tails, "tails")), "high").join(children, NODE, "left").join(end_hashes(rows, each, ws), NODE, "left")
    return out.select(
        "position", "end", "depth", "key", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", 1 - F.col("leaf")).alias("n_children"),
        (F.col("_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("_saves") - F.col("saves") + F.col("save")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(spark: SparkSession, conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """trie() of a table of conv_id, turn, role, text; rebuilt first from their siblings' heads unless told otherwise."""
    ws = Workspace(spark, "trie")
    turns, each = sequences(conversations, ws)
    return trie(*(rebuilt(turns, each) if rebuild else (turns, each)), ws)


ORACLE_SQL = """
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) AS v FROM range(256) r(i))),
o AS (SELECT conv_id, key, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM (
  SELECT conv_id, turn, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS key, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM o), tab),
have AS (SELECT c.conv_id, c.base, c.h, least(c.h, (SELECT count(*) FROM o WHERE o.conv_id = c.base)) AS k FROM c),
r AS (SELECT have.conv_id, o.pos + 1 AS depth, key, bytes FROM have JOIN o ON o.conv_id = have.base AND o.pos < h UNION ALL SELECT have.conv_id, k + o.pos - h + 1, key, bytes FROM have JOIN o ON o.conv_id = have.conv_id AND o.pos >= h),
m AS (SELECT conv_id, depth, bytes, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM m),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS save, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256 FROM l GROUP BY path, depth),
kids AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
sub AS (SELECT left(path, 32 * d) AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(save)::BIGINT AS saved_tokens FROM (SELECT path, n_children, save, unnest(range(depth + 1)) AS d FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, sub.n_leaves, sub.saved_tokens, f.ends_sha256
FROM f JOIN sub ON sub.path = f.path LEFT JOIN n AS up ON f.depth > 0 AND up.path = left(f.path, length(f.path) - 32)
"""
