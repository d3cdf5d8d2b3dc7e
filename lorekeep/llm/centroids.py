"""Clustering by centroids with the sort-means scan, exact in whole numbers.

Method. A round orders, for each centroid, all others by their distance from it. A vector is held against
its previous centroid and then the others in that order, until one is strictly beyond twice the vector's
distance from the previous centroid: by the triangle inequality none from there on can be nearer. (Squared: beyond four times
the squared distance.) Vectors stay in the cluster table a round reads and the next replaces; a task adds up its vectors by cluster, so a
round moves one row a cluster and task however large a cluster is. Centroids, a fixed number of them, go to the tasks.

Defined cases. Components are floor(256 * x) with x as double, held to within 2^27 of zero (x within 524,288), as squared
distances wouldn't fit a long otherwise. Vectors that are null, of another length, or with a null or non-finite component are left out. A null
vec_id counts as empty in the hash that picks the first centroids; equal hashes (repeated ids) are ordered by components. With
fewer vectors than clusters each vector starts one; an empty table gives no rows. Repeated rows are vectors of their own. Inertias
over a long's range are given as its largest value. Other columns are ignored, whatever their names.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import Workspace

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
LIMIT, LONG = 1 << 27, (1 << 63) - 1
#: Vectors that are held against centroids at once.
SLICE = 4096


def whole_vectors(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<int>) of the vectors that are kept."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = embeddings.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).filter(finite)
    held = lambda c: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), c * scale))).cast("int")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, held).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = vectors.select(named.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r.v for r in found], np.int64)


class Scan:
    """Nearest centroids of vectors, by the order of centroids around each vector's previous one."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        # a centroid is in reach of d if apart <= 4 d; rounded up, so that nothing leaves int64
        self.reach = -(-np.take_along_axis(apart, self.order, 1) // 4)

    def nearest(self, x: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of each row of x; of equal distances the smaller number."""
        best, near = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for c in np.unique(previous):
            mine = np.flatnonzero(previous == c)
            d = ((x[mine] - self.centroids[c]) ** 2).sum(1)
            steps = np.searchsorted(self.reach[c], d, side="right")
            by = np.argsort(-steps, kind="stable")  # those with the longest scan first
            mine, d, steps = mine[by], d[by], steps[by]
            rows, won, got = x[mine], np.full(len(mine), c), d.copy()
            for k in range(int(steps[0])):
                n = np.searchsorted(-steps, -k, side="left")
                other = self.order[c, k]
                if other == c:
                    continue
                far = ((rows[:n] - self.centroids[other]) ** 2).sum(1)
                closer = (far < got[:n]) | ((far == got[:n]) & (other < won[:n]))
                got[:n][closer], won[:n][closer] = far[closer], other
            best[mine], near[mine] = won, got
        return best, near


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors (vec_id, v, cluster: the previous one) with their nearest cluster and distance."""
    dims, scan = centroids.shape[1], Scan(centroids)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                won, got = scan.nearest(_matrix(part.column(1), dims), part.column(2).to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(won, pa.int32()), pa.array(got)], ["vec_id", "v", "cluster", "distance"])

    return vectors.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id long, v array<int>, cluster int, distance long")


def means(assigned: DataFrame, before: np.ndarray) -> np.ndarray:
    """The centroids of the clusters as they are; those of empty clusters as before."""
    clusters, dims = before.shape

    def run(batches):
        sums, counts = [[0] * dims for _ in range(clusters)], [0] * clusters
        for batch in batches:
            x, at = _matrix(batch.column(0), dims), batch.column(1).to_numpy()
            for c in np.unique(at):
                mine = x[at == c]
                counts[c] += len(mine)
                sums[c] = [a + int(b) for a, b in zip(sums[c], mine.sum(0), strict=True)]
        rows = [(c, n, sums[c]) for c, n in enumerate(counts) if n]
        if rows:
            yield pa.RecordBatch.from_pylist([{"cluster": c, "n": n, "dim": d, "s": str(s)} for c, n, part in rows for d, s in enumerate(part)])

    parts = assigned.select("v", "cluster").mapInArrow(run, "cluster long, n long, dim long, s string")
    exact = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # clusters x dims
    after = before.copy()
    for r in exact:
        after[r.cluster, r.dim] = int(r.s) // r.n
    return after


def cluster(spark: SparkSession, embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    ws = Workspace(spark, "centroids")
    table = ws.keep(whole_vectors(embeddings, dims, scale).withColumn("cluster", F.lit(0)), "vectors")
    centroids = first_centroids(table, clusters, seed)
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], shape)
    last = "vectors"
    for k in range(rounds + 1):
        table = ws.keep(assign(table, centroids), f"round{k}")
        ws.drop(last)
        last = f"round{k}"
        if k < rounds:
            centroids = means(table, centroids)
    inside = {r.cluster: int(r.d) for r in table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row a cluster
    total = sum(inside.values())
    facts = [(c, min(d, LONG), min(total, LONG), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inside.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Rounds as steps of one statement: vectors and centroids by component."""
    square = "sum((v.x - c.x) * (v.x - c.x))::BIGINT"
    out = ["""WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64),
k AS (SELECT vec_id, e, row_number() OVER (ORDER BY vec_id) AS i FROM w WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT i, d, floor(256 * e[d])::BIGINT AS x FROM (SELECT i, e, unnest(range(1, 65)) AS d FROM k)),
f AS (SELECT i, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, ''))) - 1 AS c FROM k QUALIFY c < 40),
c0 AS (SELECT f.c, v.d, v.x FROM f JOIN v USING (i))"""]
    for k in range(ROUNDS + 1):
        out.append(f"d{k} AS (SELECT v.i, c.c, {square} AS dist FROM v JOIN c{k} c USING (d) GROUP BY v.i, c.c)")
        out.append(f"a{k} AS (SELECT i, c, dist FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, c) AS r FROM d{k}) WHERE r = 1)")
        if k < ROUNDS:
            out.append(f"m{k} AS (SELECT a.c, v.d, sum(v.x)::BIGINT AS s, count(*) AS n FROM a{k} a JOIN v USING (i) GROUP BY a.c, v.d)")
            out.append(f"c{k + 1} AS (SELECT c.c, c.d, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{k} c LEFT JOIN m{k} m ON m.c = c.c AND m.d = c.d)")
    out.append(f"h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)")
    return ",\n".join(out) + f"""
SELECT k.vec_id, a.c::INT AS cluster, a.dist AS distance, (sum(a.dist) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.dist) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM a{ROUNDS} a JOIN k USING (i) JOIN h ON h.c = a.c"""


ORACLE_SQL = _sql()
