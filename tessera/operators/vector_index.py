"""A vector index: a coarse quantiser whose lists are Parquet partitions.

Vectors go to the list of their nearest centroid; a list is known by its centroid, its
number of vectors and the cosine of its farthest one. A search reads lists in the order of
their best possible score, as partitions that the scan prunes, keeps what passes the filter,
and goes on with twice as many until k are found and no unread list can hold a better one.
So the result is that of a scan of all vectors, whatever the filter leaves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.retrieval import cosine
from tessera.session import ship

#: Lists at most (their centroids are on the driver), vectors that centroids are fitted on as
#: expected number, and rounds of the fit.
MAX_LISTS, SAMPLE, ROUNDS = 1024, 20_000, 8
#: The list of vectors without a direction (null, zero or with other lengths); no search finds them.
NOWHERE = -1
#: A cosine may be off by so much in double precision.
SLACK = 1e-9


def _centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means; the start is every so manyth vector of the sample."""
    lists = min(lists, len(sample))
    c = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        own = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def _units(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors, and these as unit vectors."""
    at = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim and None not in v]
    x = np.array([vectors[i] for i in at], float).reshape(len(at), dim)
    norm = np.linalg.norm(x, axis=1)
    fine = np.isfinite(norm) & (norm > 0)
    return np.array(at, int)[fine], x[fine] / norm[fine, None]


def write(rows: DataFrame, folder: str, vec_col: str, lists: int | None = None, by: tuple[str, ...] = (), sample: int = SAMPLE) -> None:
    """Write ``rows`` below ``folder``, partitioned by the columns ``by`` and by list, and
    the lists' table in ``folder/_lists``. The length of most vectors is the index's."""
    spark = rows.sparkSession
    ship(spark)
    dims = rows.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim, n = (dims[0], dims[1]) if dims else (1, 0)
    lists = min(MAX_LISTS, lists or max(1, math.isqrt(n)))
    few = rows.where(F.size(vec_col) == dim)
    if n > sample:
        few = few.where(F.pmod(F.xxhash64(vec_col), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    # the sample as expected; ordered, so that the same rows give the same lists
    x = _units([r[0] for r in few.select(vec_col).orderBy(vec_col).collect()], dim)[1]
    c = _centroids(x, lists) if len(x) else np.zeros((0, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, near = np.full(b.num_rows, NOWHERE), np.zeros(b.num_rows)
            at, unit = _units(b.column(vec_col).to_pylist(), dim)
            if len(at) and len(c):
                score = unit @ c.T
                own[at] = score.argmax(1)
                near[at] = score.max(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(near)], [*b.schema.names, "list", "__near"])

    done = rows.mapInArrow(assign, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, list int, __near double")
    done.write.partitionBy(*by, "list").parquet(folder)
    held = spark.read.parquet(folder).groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("__near").alias("reach"))
    centres = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(c)], "list int, centroid array<double>")
    held.join(F.broadcast(centres), "list").coalesce(1).write.parquet(f"{folder}/_lists")


class VectorIndex:
    """Searches over what write() left in a folder."""

    def __init__(self, spark: SparkSession, folder: str, id_col: str, vec_col: str):
        self.rows, self.id_col, self.vec_col = spark.read.parquet(folder).drop("__near"), id_col, vec_col
        self.lists = spark.read.parquet(f"{folder}/_lists").orderBy("list").collect()  # MAX_LISTS rows at most

    def bounds(self, query: list[float]) -> list[tuple[float, int, int]]:
        """(best possible score, list, vectors in it), the best first: with the angle to the
        centroid less the angle of the farthest vector."""
        q = np.array(query, float)
        out = []
        for r in self.lists:
            c = np.array(r.centroid)
            far = math.acos(max(-1.0, min(1.0, r.reach)))
            angle = math.acos(max(-1.0, min(1.0, float(q @ c) / max(float(np.linalg.norm(q) * np.linalg.norm(c)), 1e-300))))
            out.append((math.cos(max(0.0, angle - far)), r.list, r.n))
        return sorted(out, key=lambda b: (-b[0], b[1]))

    def search(self, query: list[float], k: int, where: Column | None = None, fetch: int = 4) -> DataFrame:
        """The rows of the k nearest by cosine that pass the filter, with ``score``; ties to
        the larger id. First the lists that hold ``fetch`` times k vectors are read."""
        order, at, best = self.bounds(query), 0, None
        score = cosine(F.col(self.vec_col), F.array(*[F.lit(float(x)) for x in query]))
        ranks = [F.desc("score"), F.desc(self.id_col)]
        want, held = fetch * k, 0
        found, take = [], []
        while at < len(order):
            take = []
            while at < len(order) and (held < want or not take):
                take.append(order[at][1])
                held += order[at][2]
                at += 1
            rows = self.probe(take)
            rows = (rows if where is None else rows.where(where)).select(self.id_col, score.alias("score")).where("score is not null")
            # k ids and scores of each probe, the lists that they are from are known
            found += [(r[1], r[0], take) for r in rows.orderBy(*ranks).limit(k).collect()]
            found = sorted(found, key=lambda f: (f[0], f[1]), reverse=True)[:k]
            if len(found) == k and (at == len(order) or order[at][0] < found[-1][0] - SLACK):
                break
            want *= 2
        lists = sorted({x for f in found for x in f[2]})
        out = self.probe(lists) if found else self.rows.where(F.lit(False))
        out = (out if where is None else out.where(where)).withColumn("score", score)
        return out.where(F.col("score") >= (found[-1][0] if found else 0.0)).orderBy(*ranks).limit(k)

    def probe(self, lists: list[int]) -> DataFrame:
        """The rows of some lists: a filter of partitions."""
        return self.rows.where(F.col("list").isin(lists))

    def rest(self) -> DataFrame:
        """The rows that no search finds."""
        return self.rows.where(F.col("list") == NOWHERE)
