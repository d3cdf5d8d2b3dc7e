"""Sharding by a k-d tree over document metadata, with shards of nearly equal bytes.

Method. Equal texts are one point with their total size as weight; its coordinates are the logarithm of
the text's size, the least doc_id of its rows, and hashes of source and language. From the root down, each
node is split on its widest coordinate at a weighted quantile, so that the halves get the bytes
their leaves are to hold, until a leaf is one shard. A quantile is found by radix: four passes of
partially aggregated sums over 12 bits of the key, of which a node's 4096 sums reach the driver.
Points of over 1/COARSE of a shard (at most COARSE a shard) are known to the driver: each goes to the side of the quantile
that its coordinate says, or to the other where its own is full, and the lighter points are split at the quantile that
fills what these leave. Groups of over 1/HEAVY of a shard, which no cut can make even, are dealt before the tree,
largest to the emptiest shard, and the leaves' targets are lowered by them. Copies stay together.

Defined cases. A null text has size 1 and crc 0, like an empty one, and is in its group. Null ids, sources and
languages are points at 0; ids may be any longs. Repeated rows are documents of their own in their group's shard. One group over
a whole shard's share is a shard by itself; the others then share the rest evenly. Slots are gapless in each shard, in hashed order.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import Workspace, prefix_sum

SHARDS, HEAVY, COARSE, DIGITS, BITS = 16, 4, 64, 4, 12
AXES = ("ax_size", "ax_id", "ax_source", "ax_lang")


def measured(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    unit = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) / float(1 << 32)
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("digest"),
        unit("source").alias("source_at"), unit("lang").alias("lang_at"),
    )


def points(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy("digest").agg(
        F.sum("size").alias("weight"), F.min("size").alias("one"), F.min("doc_id").alias("id"), F.min("source_at").alias("ax_source"), F.min("lang_at").alias("ax_lang")
    )
    top = grouped.agg(F.max("id").alias("most"), F.min("id").alias("least"))
    real = lambda c: F.col(c).cast("double")  # noqa: E731  ids may be as far apart as no long says
    at = (real("id") - real("least")) / F.greatest(F.lit(1.0), real("most") - real("least") + 1)
    return grouped.join(F.broadcast(top)).select("digest", "weight", (F.log2("one") / 64).alias("ax_size"), F.coalesce(at, F.lit(0.0)).alias("ax_id"), "ax_source", "ax_lang")


def key(axis: str):
    """48 bits: the coordinate first, a hash of the text after it, so that equal coordinates can be told apart."""
    return F.shiftleft(F.floor(F.col(axis) * ((1 << 20) - 1)).cast("long"), 28).bitwiseOR(F.xxhash64("digest").bitwiseAND((1 << 28) - 1))


def even_targets(weights: list[int], total: float, shards: int) -> tuple[list[int], list[float]]:
    """The shard of each heavy weight, largest first; and what each shard still takes."""
    load, where = [0] * shards, []
    for w in weights:
        s = min(range(shards), key=lambda i: (load[i], i))
        load[s] += w
        where.append(s)
    rest = total - sum(load)
    level, open_ = 0.0, sorted(load)
    for n in range(1, shards + 1):
        level = (rest + sum(open_[:n])) / n
        if n == shards or level <= open_[n]:
            break
    return where, [max(0.0, level - x) for x in load]


def assign(spark: SparkSession, groups: DataFrame, shards: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """digest and shard of the light points, and of the others (a bounded table)."""
    total = groups.agg(F.sum("weight")).first()[0] or 0
    over = lambda n: F.col("weight") * (n * shards) > total
    heavy = groups.filter(over(HEAVY)).select("digest", "weight").orderBy(F.desc("weight"), "digest").limit(HEAVY * shards).collect()
    where, target = even_targets([r.weight for r in heavy], total, shards)
    fixed = {bytes(r.digest): s for r, s in zip(heavy, where, strict=True)}
    chosen = groups.filter(over(COARSE) & ~over(HEAVY)).select("digest", "weight", *AXES, *[key(x).alias(f"key_{x}") for x in AXES])
    coarse = [r.asDict() | {"node": 0} for r in chosen.orderBy(F.desc("weight"), "digest").limit(COARSE * shards).collect()]
    light = groups.filter(~over(COARSE)).withColumn("node", F.lit(0))
    nodes, leaf = {0: (0, shards)}, {}
    for depth in range(shards.bit_length()):
        leaf |= {n: a for n, (a, b) in nodes.items() if b - a == 1}
        nodes = {n: (a, b) for n, (a, b) in nodes.items() if b - a > 1}
        if not nodes:
            break
        light = ws.keep(light, f"level{depth}")
        spans = [F.max(x).alias(f"hi_{x}") for x in AXES] + [F.min(x).alias(f"lo_{x}") for x in AXES]
        seen = {r.node: r.asDict() for r in light.filter(F.col("node").isin(list(nodes))).groupBy("node").agg(*spans, F.sum("weight").alias("w")).collect()}
        axis, want, room = {}, {}, {}
        for n, (a, b) in nodes.items():
            own = [c for c in coarse if c["node"] == n]
            lights = [seen[n]] if n in seen else []
            if not own and not lights:
                continue
            extent = lambda x, own=own, lights=lights: max([c[x] for c in own] + [r[f"hi_{x}"] for r in lights]) - min([c[x] for c in own] + [r[f"lo_{x}"] for r in lights])
            axis[n] = max(AXES, key=lambda x, extent=extent: (extent(x), x))
            weight = sum(c["weight"] for c in own) + sum(r["w"] for r in lights)
            all_, left = sum(target[a:b]), sum(target[a : (a + b) // 2])
            want[n] = weight * (left / all_ if all_ else 0.5)
            room[n] = [want[n], weight - want[n]]
        chosen = dict.fromkeys(axis, 0)
        pick = lambda values: reduce(lambda e, kv: e.when(F.col("node") == kv[0], kv[1]), values.items(), F.when(F.lit(False), F.lit(0).cast("long")))
        keyed = light.select("node", "weight", pick({n: key(x) for n, x in axis.items()}).alias("key"))
        for digit in range(DIGITS):
            shift = BITS * (DIGITS - 1 - digit)
            prefix = F.shiftright("key", shift + BITS)
            bins = keyed.filter(prefix == pick({n: F.lit(c).cast("long") for n, c in chosen.items()})).groupBy("node", F.shiftright("key", shift).bitwiseAND((1 << BITS) - 1).alias("digit")).agg(F.sum("weight").alias("w"))
            held: dict[int, list] = {n: [] for n in axis}
            for r in bins.collect():
                held[r.node].append((r.digit, r.w))
            if digit == 0:
                for n in axis:
                    want[n] = max(0.0, want[n] - _sides([c for c in coarse if c["node"] == n], axis[n], held[n], want[n], room[n]))
            for n, found in held.items():
                found.sort()
                at = 0
                for k, (d, w) in enumerate(found):
                    if w >= want[n] or k == len(found) - 1:
                        at = d + (digit == DIGITS - 1 and want[n] > w / 2)
                        break
                    want[n] -= w
                chosen[n] = chosen[n] << BITS | at if digit < DIGITS - 1 else (chosen[n] << BITS) + at
        side = {n: F.when(key(axis[n]) < chosen[n], 2 * n + 1).otherwise(2 * n + 2) for n in axis}
        light = light.withColumn("node", reduce(lambda e, kv: e.when(F.col("node") == kv[0], kv[1]), side.items(), F.when(F.lit(False), F.lit(0))).otherwise(F.col("node")))
        for c in coarse:
            c["node"] = c.pop("to", c["node"])
        nodes = {c: r for n, (a, b) in nodes.items() for c, r in ((2 * n + 1, (a, (a + b) // 2)), (2 * n + 2, ((a + b) // 2, b)))}
    leaf |= {n: a for n, (a, b) in nodes.items() if b - a == 1}
    shard = reduce(lambda e, kv: e.when(F.col("node") == kv[0], F.lit(kv[1])), leaf.items(), F.when(F.lit(False), F.lit(0)))
    fixed |= {bytes(c["digest"]): leaf[c["node"]] for c in coarse}
    return light.select("digest", shard.alias("shard")), spark.createDataFrame(list(fixed.items()), "digest binary, shard int")


def _sides(own: list[dict], axis: str, cells: list[tuple[int, int]], want: float, room: list[float]) -> int:
    """Give each coarse point of a node the side (`to`) that its coordinate says, while there is room; returns the weight of the left ones.

    cells: the light points' weights by the first digit of their key. room: what either side takes.
    """
    shift = BITS * (DIGITS - 1)
    every = sorted([*cells, *((c[f"key_{axis}"] >> shift, c["weight"]) for c in own)])
    cut, upto = 0, 0
    for cell, weight in every:
        cut, upto = cell, upto + weight
        if upto >= want:
            break
    room, left = list(room), 0
    for c in sorted(own, key=lambda c: (-c["weight"], c["digest"])):
        cell = c[f"key_{axis}"] >> shift
        side = int(cell > cut) if cell != cut else int(room[1] > room[0])
        if c["weight"] > room[side] and room[1 - side] > room[side]:
            side = 1 - side
        room[side] -= c["weight"]
        left += c["weight"] * (1 - side)
        c["to"] = 2 * c["node"] + 1 + side
    return left


def shard(spark: SparkSession, documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document."""
    ws = Workspace(spark, "shard")
    rows = ws.keep(measured(documents), "rows")
    groups = ws.keep(points(rows), "points")
    light, fixed = assign(spark, groups, shards, ws)
    slim = rows.select("doc_id", "size", "text_crc32", "digest").join(F.broadcast(fixed), "digest", "left")
    first = slim.filter("shard is not null")
    rest = slim.filter("shard is null").drop("shard").join(light, "digest")
    placed = first.unionByName(rest).drop("digest").withColumn("one", F.lit(1).cast("long"))
    out = prefix_sum(placed, ["shard"], ["doc_id", "text_crc32", "size"], "one", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
