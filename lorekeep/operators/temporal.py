"""Supersession and validity at an instant.

resolve_heads() finds for each concept the deepest valid concept that supersedes it, by relaxing one row a
node (depth, head) until nothing changes: O(longest chain) joins on edges, never paths. What hasn't settled
after max_rounds lies behind a cycle or on a longer chain; only weak components that hold such a node
go to a depth-first walk, a component in a task. All others keep what they settled on.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import temporal as T
from lorekeep.work import Workspace, components, small


def edges(concepts: DataFrame) -> DataFrame:
    """(src, dst): src supersedes dst; only to concepts that exist, each once."""
    raw = concepts.select(F.col("id").alias("src"), F.explode(T.normalize_supersedes("supersedes")).alias("dst")).distinct()
    return raw.join(concepts.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def dangling(concepts: DataFrame) -> DataFrame:
    """(id, missing): what a concept says to supersede and isn't there."""
    raw = concepts.select("id", F.explode(T.normalize_supersedes("supersedes")).alias("missing")).distinct()
    return raw.join(concepts.select(F.col("id").alias("missing")), "missing", "left_anti").select("id", "missing")


def window(concepts: DataFrame, at) -> DataFrame:
    return concepts.select("id", T.window_status("valid_from", "valid_until", at).alias("window"), T.has_temporal().alias("has_temporal"))


def _walk(pdf):
    """Heads of one weak component with a cycle: post-order, open nodes are dead ends, smaller ids first."""
    import pandas as pd

    valid = dict(zip(pdf["node"], pdf["valid"], strict=True))
    above = {n: sorted(s) for n, s in zip(pdf["node"], pdf["above"], strict=True)}
    best: dict = {}
    for start in sorted(valid):
        stack, open_ = [(start, False)], {start}
        while stack:
            node, done = stack.pop()
            if done:
                reach = [(best[x][0] + 1, best[x][1]) for x in above[node] if best.get(x)]
                if valid[node]:
                    reach.append((0, node))
                best[node] = min(reach, key=lambda r: (-r[0], r[1])) if reach else None
                open_.discard(node)
            elif node not in best:
                stack.append((node, True))
                for x in above[node]:
                    if x not in best and x not in open_:
                        open_.add(x)
                        stack.append((x, False))
    return pd.DataFrame({"id": list(valid), "head": [best[n][1] if best.get(n) else n for n in valid]})


def resolve_heads(concepts: DataFrame, at, max_rounds: int = 64) -> DataFrame:
    """id, head: the concept itself where nothing further is valid. Longest path wins, then the smaller id."""
    ws = Workspace(concepts.sparkSession, "heads")
    valid = window(concepts, at).select("id", (F.col("window") == "current").alias("valid"))
    links = ws.keep(edges(concepts).select(F.col("dst").alias("old"), F.col("src").alias("new")), "links")
    on_graph = links.select(F.col("old").alias("id")).union(links.select(F.col("new").alias("id"))).distinct().join(valid, "id")
    state = ws.keep(on_graph.select("id", "valid", F.when(F.col("valid"), F.struct(F.lit(0).alias("depth"), F.col("id").alias("head"))).alias("best"), F.lit(False).alias("better")), "state0")
    for k in range(1, max_rounds + 1):
        step = links.join(state.select(F.col("id").alias("new"), "best").filter("best is not null"), "new").select(F.col("old").alias("id"), F.struct((F.col("best.depth") + 1).alias("depth"), F.col("best.head").alias("head")).alias("cand"))
        best = step.groupBy("id").agg(F.min(F.struct((-F.col("cand.depth")).alias("d"), F.col("cand.head").alias("h"))).alias("c"))
        better = (F.col("best").isNull() & F.col("c").isNotNull()) | (-F.col("c.d") > F.col("best.depth")) | ((-F.col("c.d") == F.col("best.depth")) & (F.col("c.h") < F.col("best.head")))
        moved = state.drop("better").join(best, "id", "left").withColumn("better", F.coalesce(better, F.lit(False)))
        state = ws.keep(moved.select("id", "valid", F.when(F.col("better"), F.struct((-F.col("c.d")).alias("depth"), F.col("c.h").alias("head"))).otherwise(F.col("best")).alias("best"), "better"), f"state{k}")
        ws.drop(f"state{k - 1}")
        if not state.filter("better").limit(1).count():
            break
    heads = state.select("id", "best.head")
    unsettled = state.filter("better").select("id")
    if unsettled.limit(1).count():
        walked = _walked(ws, unsettled, state.select("id", "valid"), links)
        heads = heads.join(walked.select("id"), "id", "left_anti").unionByName(walked)
    return concepts.select("id").join(heads, "id", "left").select("id", F.coalesce("head", "id").alias("head"))


def _walked(ws: Workspace, unsettled: DataFrame, valid: DataFrame, links: DataFrame) -> DataFrame:
    """id, head of the weak components that hold an unsettled node."""
    comp = components(links.select(F.col("old").alias("a"), F.col("new").alias("b")), ws, "weak").withColumnRenamed("node", "id")
    own = valid.select("id").join(comp, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))  # a self-loop is no edge of a component
    own = own.join(own.join(unsettled, "id").select("comp").distinct(), "comp", "left_semi")
    above = links.groupBy(F.col("old").alias("id")).agg(F.sort_array(F.collect_set("new")).alias("above"))
    nodes = own.join(valid, "id").join(above, "id", "left").select("comp", F.col("id").alias("node"), "valid", F.coalesce("above", F.array().cast("array<string>")).alias("above"))
    return ws.keep(nodes.groupBy("comp").applyInPandas(_walk, "id string, head string"), "walked")


def statuses(concepts: DataFrame, at) -> DataFrame:
    """id, status, superseded_by, has_temporal. The window comes before supersession."""
    heads = resolve_heads(concepts, at)
    rows = window(concepts, at).join(heads, "id")
    gone = (F.col("window") == "current") & (F.col("head") != F.col("id"))
    return rows.select("id", F.when(gone, "superseded").otherwise(F.col("window")).alias("status"), F.when(gone, F.col("head")).alias("superseded_by"), "has_temporal")


def snapshot(concepts: DataFrame, at) -> DataFrame:
    """What holds at the instant."""
    return concepts.join(statuses(concepts, at).filter("status = 'current'").select("id"), "id", "left_semi")


def cycles(concepts: DataFrame, max_rounds: int = 64) -> DataFrame:
    """cycle array<string>: found by one depth-first walk, rotated to the least id.

    Nodes without a way in or out are peeled off by joins first, so that only what lies on or between
    cycles reaches the walk.
    """
    ws = Workspace(concepts.sparkSession, "cycles")
    live = ws.keep(edges(concepts), "live0")
    for k in range(1, max_rounds + 1):
        kept = live.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = ws.keep(kept.select("src", "dst"), f"live{k}")
        done = kept.count() == live.count()
        ws.drop(f"live{k - 1}")
        live = kept
        if done:
            break

    def walk(batches):
        import pandas as pd

        for pdf in batches:
            out: dict[str, list[str]] = {}
            for s, d in zip(pdf["src"], pdf["dst"], strict=True):
                out.setdefault(s, []).append(d)
            found, seen = set(), set()
            for start in sorted(out):
                if start in seen:
                    continue
                seen.add(start)
                path, todo = [start], [iter(sorted(out[start]))]
                while path:
                    nxt = next(todo[-1], None)
                    if nxt is None:
                        path.pop()
                        todo.pop()
                    elif nxt in path:
                        ring = path[path.index(nxt) :]
                        k = ring.index(min(ring))
                        found.add(tuple(ring[k:] + ring[:k]))
                    elif nxt not in seen:
                        seen.add(nxt)
                        path.append(nxt)
                        todo.append(iter(sorted(out.get(nxt, []))))
            yield pd.DataFrame({"cycle": [list(c) for c in sorted(found)]})

    def grouped(pdf):
        return next(walk([pdf]))

    comp = components(live.select(F.col("src").alias("a"), F.col("dst").alias("b")), ws, "weak").withColumnRenamed("node", "src")
    rows = live.join(small(comp), "src", "left").withColumn("comp", F.coalesce("comp", "src"))
    return rows.groupBy("comp").applyInPandas(grouped, "cycle array<string>")


def carry_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """Temporal fields of the same id are kept across a re-ingest; a field that the new row sets stays."""
    names = ("valid_from", "valid_until", "supersedes", "last_verified")
    before = old.select("id", *[F.col(n).alias(f"old_{n}") for n in names])
    joined = new.join(before, "id", "left")
    return joined.select(*[F.coalesce(c, f"old_{c}").alias(c) if c in names else F.col(c) for c in new.columns])


def stamp_supersedes(supersedes, displaced):
    return F.array_union(F.coalesce(supersedes, F.array().cast("array<string>")), F.array(displaced))
