"""Centroid clustering by ball k-means, on whole numbers.

A cluster is a ball: its centroid and the largest distance of a member. In a round, a task
has vectors with the cluster that they were in. For the members of a cluster in an Arrow
batch it takes their distances to the moved centroid, and from the ball's radius the
neighbour centroids, those at most two radii away. Half the distance to a neighbour bounds
the annulus where this neighbour can be as near: members within half the distance to the
nearest neighbour are the stable core and are not compared, the others are compared
exactly with the neighbours whose annulus they reach, and with no others.

All distances are sums of squared whole numbers and exact. Each round is one pass that
writes the vectors with their clusters and each task's sums; the driver sees k centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import ship, work_folder

DIM, K, ROUNDS = 64, 40, 5
#: Components are floor(SCALE * x). Beyond LARGEST a distance might not fit 64 bits.
SCALE, LARGEST = 256, 1 << 27
#: Below this, sums of products are exact in double precision, and BLAS is used.
EXACT_IN_DOUBLE = 1 << 21


def kept(vectors: DataFrame, dim: int = DIM, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, q): vectors of ``dim`` finite components, as whole numbers."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * SCALE < LARGEST))
    return vectors.where(x.isNotNull() & (F.size(x) == dim) & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("int")).alias("q")
    )


def first_centroids(rows: DataFrame, k: int = K, seed: int = 2) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``; ties by components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    top = rows.orderBy(mark, "q").limit(k).select("q").collect()  # k rows
    return np.array([r.q for r in top], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each of x, a column for each of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT_IN_DOUBLE:
        x, c = x.astype(np.float64), c.astype(np.float64)
        out = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        return out.astype(np.int64)
    return np.stack([((x - v) ** 2).sum(1) for v in c], axis=1)


def nearest_of_all(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = squared(x, centroids)
    own = d.argmin(1)  # the first of the smallest
    return own, d[np.arange(len(x)), own]


def between(centroids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each centroid the others, nearest first, and their squared distances."""
    d = squared(centroids, centroids)
    out = []
    for i in range(len(centroids)):
        order = np.argsort(d[i], kind="stable")
        order = order[order != i]
        out.append((order, d[i][order]))
    return out


def reassign(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Clusters and squared distances after the centroids moved, and how many distances
    were taken. 4 d(x, c)^2 < d(c, c')^2 proves that c' is farther from x than c."""
    new, best, taken = own.copy(), np.zeros(len(x), np.int64), len(x)
    for c in np.unique(own):
        at = np.flatnonzero(own == c)
        mine = squared(x[at], centroids[c : c + 1])[:, 0]
        others, apart = near[c]
        # neighbours of the ball: at most two radii away
        n = np.searchsorted(apart, 4 * mine.max(), "right")
        others, apart = others[:n], apart[:n]
        ring = np.searchsorted(apart, 4 * mine, "right")
        best[at] = mine
        for r in np.unique(ring):
            if r == 0:  # the stable core
                continue
            members = np.flatnonzero(ring == r)
            d = squared(x[at[members]], centroids[others[:r]])
            taken += d.size
            low = d.min(1)
            # of equally near centroids the smallest number, c itself among them
            number = np.where(d == low[:, None], others[:r], len(centroids)).min(1)
            move = (low < mine[members]) | ((low == mine[members]) & (number < c))
            new[at[members[move]]] = number[move]
            best[at[members[move]]] = low[move]
    return new, best, taken


def _pass(rows: DataFrame, centroids: np.ndarray, folder: str, last: bool) -> DataFrame:
    """One assignment: rows (vec_id, q, cluster, distance), and for each task and cluster a
    row (cluster, n, sums, distance) with n not null. The last pass needs no q."""
    near, k = between(centroids), len(centroids)
    schema = pa.schema([("vec_id", pa.int64()), ("q", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, far = np.zeros(k, np.int64), np.zeros((k, centroids.shape[1]), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1).astype(np.int64)
            if len(b.columns) == 2:
                own, d = nearest_of_all(x, centroids)
            else:
                own, d, _ = reassign(x, b.column(2).to_numpy().astype(np.int64), centroids, near)
            n += np.bincount(own, minlength=k)
            np.add.at(far, own, d)
            if not last:
                order = np.argsort(own, kind="stable")
                found, first = np.unique(own[order], return_index=True)
                total[found] += np.add.reduceat(x[order], first, axis=0)
            none = pa.nulls(b.num_rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), none if last else b.column(1), pa.array(own, pa.int32()), pa.array(d), pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.list_(pa.int64()))], schema=schema)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.list_(pa.int32())), pa.array(some, pa.int32()), pa.array(far[some]), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], schema=schema)

    rows.mapInArrow(run, "vec_id long, q array<int>, cluster int, distance long, n long, sums array<long>").write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def _moved(done: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of each cluster that has members; the others stay. The tasks' sums
    are added in Spark, k rows come to the driver."""
    dim = centroids.shape[1]
    rows = done.where("n IS NOT NULL").groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums")).collect()
    out = centroids.copy()
    for r in rows:
        out[r.cluster] = np.array(r.sums, np.int64) // r.n
    return out


def ball_kmeans(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 2) -> DataFrame:
    """One row a vector: vec_id, cluster, distance (squared, to its centroid),
    cluster_inertia, inertia (distances summed over the cluster and over all),
    centroid_sha256 (of the centroid's components, joined by commas) and centroid.

    Vectors that are null, of another length, or with a component that is null or not
    finite take no part and give no row; nor do vectors with a component of 2^19 or more,
    whose distances might not fit 64 bits. Repeated rows, and rows without an id, are
    vectors of their own; other columns are ignored, whatever their names. Of equally near
    centroids the smaller number is taken. With fewer than k vectors there are as many
    clusters; an empty table gives no rows."""
    spark = vectors.sparkSession
    ship(spark)
    folder = work_folder(spark, "clusters")
    rows = kept(vectors, dim, id_col, vec_col)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    for i in range(rounds + 1):
        done = _pass(rows, centroids, f"{folder}/{i}", last=i == rounds)
        if i < rounds:
            centroids = _moved(done, centroids)
            rows = done.where("n IS NULL").select("vec_id", "q", "cluster")
    sums = {r.cluster: r.d for r in done.where("n IS NOT NULL").groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    about = [(c, int(d), sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), centroids[c].tolist()) for c, d in sums.items()]
    names = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return done.where("n IS NULL").select("vec_id", "cluster", "distance").join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def oracle(k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = 2) -> str:
    """SQL of the whole clustering: plain rounds, every vector against every centroid."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rn, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = {dim} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x) AND abs(x::DOUBLE) * {SCALE} < {LARGEST}]) = {dim})""",
        "x AS MATERIALIZED (SELECT rn, unnest(q) AS x, unnest(range(len(q))) AS i FROM v)",
        f"start AS (SELECT rn, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, 'null')), q) - 1 AS k FROM v ORDER BY 2 LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT k, i, x AS c FROM x JOIN start USING (rn))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT rn, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT rn, k, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{r} USING (i) GROUP BY rn, k) GROUP BY rn)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT k, i, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT k, i, CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS m
  FROM (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (rn) GROUP BY k, i)) USING (k, i))"""
            )
    parts.append(f"h AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (rn) JOIN h USING (k)"""


ORACLE = oracle()
