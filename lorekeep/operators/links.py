"""Links between concepts: extraction, resolution, edges, dead links, orphans, neighbours, bounded traversal.

Four surfaces read links differently, and each has its own view: graph_links (inline links), the
validator's (code stripped first, see validate.py), viz_links (inline and reference definitions, clamping at the
root) and raw_links (written targets compared with ids as they stand). Resolution is equi-joins on candidate paths
with a priority, prefixes of ids are exploded once, and a traversal is at most three unrolled joins.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.functions import temporal as T
from lorekeep.functions import text as X


def directories(files: DataFrame) -> DataFrame:
    """path of every directory that holds a file, at any depth; the root is ''."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select(F.explode(up).alias("path")).distinct()


def files_of(concepts: DataFrame) -> DataFrame:
    return concepts.select(F.concat("id", F.lit(".md")).alias("path"))


def primary_sections(concepts: DataFrame) -> DataFrame:
    """doc, primary: the section named like the document, else the first generated, else the least id."""
    parts = F.split("id", "/")
    ups = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    rows = concepts.select("id", F.coalesce("generated.at", F.lit("")).alias("at"), F.explode(ups).alias("doc"))
    other = X.leaf("id") != X.leaf("doc")
    best = F.min(F.struct(other.alias("other"), F.when(other, F.col("at")).otherwise("").alias("at"), F.col("id").alias("id")))
    return rows.groupBy("doc").agg(best["id"].alias("primary"))


def resolve(links: DataFrame, concepts: DataFrame, files: DataFrame | None = None, fallback: bool = True) -> DataFrame:
    """links (source id, pos, target) with kind and concept_id: external, ok, dir, asset, reserved or dead.

    A path is tried as a file, as a directory, then with .md; what is left inside the bundle is tried again
    from each ancestor of the linking concept, where a whole document stands for its primary section.
    """
    files = files if files is not None else files_of(concepts)
    ids = concepts.select(F.col("id").alias("cid"))
    rows = links.withColumn("clean", X.without_fragment("target"))
    outside = (F.col("clean") == "") | F.col("clean").startswith("//") | F.col("clean").rlike(S.EXTERNAL)
    rows = rows.withColumn("path", F.when(~outside, X.resolve_path(X.parent_dir("source"), F.col("clean"), clamp=False)))
    reserved = F.lower(X.leaf("path")).isin(*S.RESERVED)
    known = files.select(F.col("path").alias("cand"), F.lit("file").alias("what")).union(directories(files).select("path", F.lit("dir"))).distinct()
    tries = F.array(F.struct(F.lit(0).alias("rank"), F.col("path").alias("cand")), F.struct(F.lit(2).alias("rank"), F.concat("path", F.lit(".md")).alias("cand")))
    keyed = rows.filter(~outside & F.col("path").isNotNull() & ~reserved).select("source", "pos", F.explode(tries).alias("t")).select("source", "pos", "t.rank", "t.cand")
    hit = keyed.join(known, "cand").withColumn("rank", F.col("rank") + (F.col("what") == "dir").cast("int"))
    best = hit.groupBy("source", "pos").agg(F.min(F.struct("rank", "cand", "what")).alias("b")).select("source", "pos", F.col("b.cand").alias("cand"), F.col("b.what").alias("what"))
    out = rows.join(best, ["source", "pos"], "left")
    is_md = F.lower("cand").endswith(".md")
    kind = F.when(outside, "external").when(F.col("path").isNull(), "dead").when(reserved, "reserved").when(F.col("what") == "dir", "dir").when(is_md, "ok").when(F.col("what") == "file", "asset").otherwise("dead")
    out = out.withColumn("kind", kind).withColumn("concept_id", F.when((F.col("what") == "file") & is_md, F.expr("left(cand, length(cand) - 3)")))
    if fallback:
        lost = out.filter((F.col("kind") == "dead") & F.col("path").isNotNull()).select("source", "pos", "clean")
        parts = F.split("source", "/")
        bases = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("level"), F.array_join(F.slice(parts, 1, F.size(parts) - k), "/").alias("base")))
        tried = lost.select("source", "pos", "clean", F.explode(bases).alias("b")).withColumn("cand", X.id_target("b.base", "clean"))
        start = tried.filter("b.level = 0 and cand is not null and cand <> source").select("source", "pos")
        tried = tried.join(start, ["source", "pos"], "left_semi").filter("cand is not null and cand <> source")
        direct = tried.join(ids, F.col("cand") == F.col("cid")).select("source", "pos", (2 * F.col("b.level")).alias("rank"), "cid")
        whole = tried.filter("b.level > 0").join(primary_sections(concepts), F.col("cand") == F.col("doc")).filter("primary <> source").select("source", "pos", (2 * F.col("b.level") + 1).alias("rank"), F.col("primary").alias("cid"))
        found = direct.union(whole).groupBy("source", "pos").agg(F.min_by("cid", "rank").alias("found"))
        out = out.join(found, ["source", "pos"], "left").withColumn("concept_id", F.coalesce("concept_id", "found")).withColumn("kind", F.when(F.col("found").isNotNull(), "ok").otherwise(F.col("kind")))
    return out.select("source", "pos", "target", "kind", "concept_id")


def graph_links(concepts: DataFrame, body="body") -> DataFrame:
    return concepts.select(F.col("id").alias("source"), F.posexplode(X.link_targets(body)).alias("pos", "target"))


def edges(resolved: DataFrame, concepts: DataFrame) -> DataFrame:
    """from, to: each once, only to concepts."""
    ids = concepts.select(F.col("id").alias("to"))
    return resolved.filter("kind = 'ok'").select(F.col("source").alias("from"), F.col("concept_id").alias("to")).join(ids, "to", "left_semi").select("from", "to").distinct()


def dead_links(resolved: DataFrame, concepts: DataFrame) -> DataFrame:
    """source, target that resolve to nothing, or to a file that is no concept."""
    ids = concepts.select(F.col("id").alias("concept_id"))
    gone = resolved.filter("kind = 'dead'").unionByName(resolved.filter("kind = 'ok'").join(ids, "concept_id", "left_anti"), allowMissingColumns=True)
    return gone.select("source", "target")


def nodes(concepts: DataFrame, statuses: DataFrame) -> DataFrame:
    return concepts.join(statuses, "id").select("id", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("title", "id").alias("title"), F.col("status").alias("temporal_status"), "superseded_by")


def orphans(concepts: DataFrame, index_files: DataFrame) -> DataFrame:
    """Concepts that no link of any index file reaches. index_files: path, text. A directory reaches all beneath it."""
    source = F.regexp_replace("path", r"(?i)\.md$", "")
    links = index_files.select(source.alias("source"), F.posexplode(X.link_targets("text")).alias("pos", "target"))
    every = files_of(concepts).union(index_files.select("path"))
    found = resolve(links, concepts, every)
    reached = found.filter("kind = 'ok'").select(F.col("concept_id").alias("id"))
    dirs = found.filter("kind = 'dir'").select(X.resolve_path(X.parent_dir("source"), X.without_fragment("target")).alias("dir")).distinct()
    parts = F.split("id", "/")
    ups = concepts.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    reached = reached.union(ups.join(dirs, "dir", "left_semi").select("id"))
    return concepts.select("id").join(reached, "id", "left_anti")


def viz_links(concepts: DataFrame) -> DataFrame:
    """from, to, dead: inline links and reference definitions, clamped at the root; links to oneself are left out."""
    inline = X.link_targets("body")
    defs = F.regexp_extract_all("body", F.lit(r"(?m)^\s{0,3}\[[^\]\n]+\]:\s*(\S+)"), F.lit(1))
    raw = concepts.select("id", F.explode(F.array_distinct(F.concat(inline, defs))).alias("raw"))
    to = raw.select(F.col("id").alias("from"), X.id_target("id", "raw").alias("to")).filter("to is not null and to <> from").distinct()
    return to.join(concepts.select(F.col("id").alias("to"), F.lit(False).alias("dead")), "to", "left").select("from", "to", F.coalesce("dead", F.lit(True)).alias("dead"))


def raw_links(concepts: DataFrame) -> DataFrame:
    """source, pos, text, target as written: duplicates kept, relative paths not resolved, a leading slash dropped."""
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(r"\[([^\]]*)\]\(([^)\s]+)\)"), F.lit(1)).alias("text"), F.regexp_extract_all("body", F.lit(r"\[([^\]]*)\]\(([^)\s]+)\)"), F.lit(2)).alias("target"))
    rows = concepts.select(F.col("id").alias("source"), F.posexplode(pairs).alias("pos", "p")).select("source", "pos", "p.text", "p.target")
    return rows.filter(~X.is_external("target")).withColumn("target", F.regexp_replace(X.without_fragment("target"), "^/", "")).filter("target <> ''")


def neighbors_of_all(links: DataFrame, wanted: str | None = None) -> DataFrame:
    """node, direction, pos, id, text: outgoing in order with duplicates; of each source that links a node, its first link to it."""
    rows = links if wanted is None else links.filter(X.relation_matches("text", "target", wanted))
    out = rows.select(F.col("source").alias("node"), F.lit("out").alias("direction"), "pos", F.col("target").alias("id"), "text")
    first = rows.groupBy("target", "source").agg(F.min(F.struct("pos", "text")).alias("m"))
    return out.union(first.select(F.col("target"), F.lit("in"), "m.pos", "source", "m.text"))


def neighbors(links: DataFrame, node: str, wanted: str | None = None) -> DataFrame:
    """direction, pos, id, text of one node."""
    return neighbors_of_all(links.filter((F.col("source") == node) | (F.col("target") == node)), wanted).filter(F.col("node") == node).drop("node")


def walk(links: DataFrame, statuses: DataFrame, start: str, depth: int = 2, wanted: str | None = None) -> DataFrame:
    """level, id, via, status of all that a traversal visits; status is null for targets that aren't there.

    Breadth first over raw links, at most three levels. A target is visited once, by the parent discovered first, and a
    parent's targets in the order of their ids. Superseded and missing targets count as visited but aren't expanded.
    A concept's place in the order of discovery is the ids on the way to it, so nothing has to be numbered.
    """
    depth = max(1, min(depth, S.TRAVERSE_DEPTH))
    rows = links if wanted is None else links.filter(X.relation_matches("text", "target", wanted))
    first = rows.select("source", "target").distinct()
    front = links.sparkSession.createDataFrame([(start, [])], "id string, way array<string>")
    seen = front.select("id")
    out = None
    for level in range(1, depth + 1):
        step = front.join(first, F.col("id") == F.col("source")).select(F.col("target").alias("id"), "way", F.col("source").alias("via"))
        step = step.join(seen, "id", "left_anti").groupBy("id").agg(F.min(F.struct("way", "via")).alias("b")).select("id", F.concat("b.way", F.array("id")).alias("way"), "b.via")
        known = step.join(statuses.select("id", "status"), "id", "left")
        part = known.select(F.lit(level).alias("level"), "id", "via", "status")
        out = part if out is None else out.union(part)
        seen = seen.union(step.select("id"))
        front = known.filter("status is not null and status <> 'superseded'").select("id", "way")
    return out


def traverse(links: DataFrame, statuses: DataFrame, start: str, depth: int = 2, wanted: str | None = None) -> DataFrame:
    """level, id, via, status of what a traversal shows."""
    return walk(links, statuses, start, depth, wanted).filter("status is not null and status <> 'superseded'")


def traverse_counts(links: DataFrame, statuses: DataFrame, start: str, depth: int = 2, wanted: str | None = None) -> DataFrame:
    """reached, hidden (superseded) and dangling (missing) targets of a traversal, in one row."""
    return walk(links, statuses, start, depth, wanted).agg(
        F.count_if(F.col("status").isNotNull() & (F.col("status") != "superseded")).alias("reached"), F.count_if(F.col("status") == "superseded").alias("hidden"), F.count_if(F.col("status").isNull()).alias("dangling")
    )


def graph_stats(nodes_: DataFrame, edges_: DataFrame, dead: DataFrame) -> DataFrame:
    """nodes, edges, dead_links, non_current, in one row."""
    counts = nodes_.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.coalesce("temporal_status", F.lit("current")) != "current").alias("non_current"))
    some = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return counts.crossJoin(some(edges_, "edges")).crossJoin(some(dead, "dead_links")).select("nodes", "edges", "dead_links", "non_current")


def graph_report(nodes_: DataFrame, edges_: DataFrame, dead: DataFrame, lost: DataFrame) -> DataFrame:
    """section, line of a graph's text report: counts, concepts that aren't current with their mark, orphans, dead links."""
    counts = graph_stats(nodes_, edges_, dead).select(F.lit("counts").alias("section"), F.format_string("%d concepts, %d links, %d dead links", "nodes", "edges", "dead_links").alias("line"))
    other = nodes_.filter(F.coalesce("temporal_status", F.lit("current")) != "current")
    marked = other.select(F.lit("non-current"), F.concat("id", F.lit(" ("), T.temporal_mark("temporal_status", "superseded_by"), F.lit(")")))
    return counts.union(marked).union(lost.select(F.lit("orphan"), "id")).union(dead.select(F.lit("dead link"), F.concat_ws(": ", "source", "target")))


def mermaid(nodes_: DataFrame, edges_: DataFrame) -> list[str]:
    """Lines of a flowchart; node names are escaped so that no two ids meet. A driver-side formatter over a bounded graph."""

    def name(i: str) -> str:
        return "n_" + "".join(c if c.isascii() and c.isalnum() else "__" if c == "_" else f"_u{ord(c):04x}_" for c in i) if i else "n_empty"

    rows = nodes_.orderBy("id").limit(S.GRAPH_NODES).collect()
    kept = {r.id for r in rows}
    out = ["flowchart LR"]
    for r in rows:
        mark = {"superseded": f"superseded by {r.superseded_by}" if r.superseded_by else "superseded", "expired": "expired", "not_yet_valid": "not yet valid"}.get(r.temporal_status)
        label = f"{r.id} — {r.title}".replace('"', "'").replace("]", ")")
        out.append(f'    {name(r.id)}["{label}{f" ({mark})" if mark else ""}"]')
    for e in edges_.filter(F.col("from").isin(*kept) & F.col("to").isin(*kept)).orderBy("from", "to").collect() if kept else []:
        out.append(f"    {name(e['from'])} --> {name(e['to'])}")
    return out


def bounded_graph(nodes_: DataFrame, edges_: DataFrame, limit: int = S.GRAPH_NODES) -> tuple[DataFrame, DataFrame]:
    """The first nodes by id, and the edges among them."""
    kept = nodes_.orderBy("id").limit(limit)
    ids = kept.select("id")
    inner = edges_.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    return kept, inner


def adjacency(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    lists = edges_.groupBy(F.col("from").alias("id")).agg(F.sort_array(F.collect_list("to")).alias("to"))
    return nodes_.select("id").join(lists, "id", "left").select("id", F.coalesce("to", F.array().cast("array<string>")).alias("to"))
