"""Nearest neighbours by collision counting.

Vectors are projected on random lines. In a block of vectors each line has a sorted array
of its projections. A query opens a window around its own place on each line and widens it
ring by ring (virtual rehashing: the same arrays serve every radius); only what a ring
adds on either side is counted, from the arrays where it is narrow, by comparing places
where it holds much of them. A vector that lies inside the windows of enough lines is
verified, once, with its exact inner product. The windows stop when a vector as near as
the k-th best verified one would have reached the threshold almost surely.

Largest inner products are nearest points after one coordinate is added that gives all
vectors the same norm. Equal vectors are indexed once. Blocks are ranges on the first
lines: each query first meets the block of its own row, and what it finds there bounds the
radius; then it goes only to the blocks whose ranges its windows touch. Each meeting
returns at most k rows a query.

Data without structure in many dimensions leave no range untouched: there the blocks save
nothing, and pairs of a query and a vector grow with both numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import cut, ship

LINES = 160
#: Share of the lines on which a vector has to collide.
THRESHOLD = 0.7
#: Standard deviations by which a k-th best vector has to exceed the threshold.
SURE = 1.0
#: Factor of a ring; rows of a block that give the first radius.
GROWTH, PROBE = 1.15, 64
BLOCK, CHUNK = 16_384, 4_096
SEED = 20
#: Share of all places from which a ring is counted by comparing places.
DENSE = 0.08
#: Lines whose ranges make the blocks, and the radii that a window on these reaches: a
#: vector within the radius is outside on one of them with a probability below 0.01.
AXES, REACH = 3, 3.0
#: Blocks (some 40 bytes each) that are sent to all tasks at most; beyond, they are joined.
BROADCAST_BLOCKS = 100_000
#: Queries whose windows are looked up together.
BATCH = 64
#: A window that holds all places: points at a distance of at most 2 fall inside.
WHOLE = 12.0


def lines(dim: int) -> np.ndarray:
    """The random lines for vectors of a length, with the added coordinate."""
    return np.random.default_rng(SEED).standard_normal((LINES, dim + 1))


def lifted(x: np.ndarray, m: float) -> np.ndarray:
    """Rows of x, of norms up to m, as points of norm 1."""
    return np.column_stack([x, np.sqrt(np.maximum(m * m - (x * x).sum(1), 0))]) / m


def asked(q: np.ndarray) -> np.ndarray:
    """Rows of q as query points of norm 1."""
    return np.column_stack([q / np.sqrt((q * q).sum(1))[:, None], np.zeros(len(q))])


class Block:
    """Sorted arrays of a block of vectors (rows of x), which have a norm of at most m.
    ``pairs``, ``touched`` and ``verified`` tell the work of its searches."""

    def __init__(self, x: np.ndarray, m: float):
        self.x, self.m = x, m
        self.lines = lines(x.shape[1])
        h = lifted(x, m) @ self.lines.T
        order = np.argsort(h, axis=0, kind="stable")
        self.sorted = np.take_along_axis(h, order, 0).T.copy()  # a row a line
        self.order = order.T.ravel()
        self.rank = np.empty((LINES, len(x)), np.uint16 if len(x) < 1 << 16 else np.uint32)  # places by vector
        np.put_along_axis(self.rank, order.T, np.arange(len(x), dtype=self.rank.dtype)[None], 1)
        self.pairs = self.touched = self.verified = 0
        p = THRESHOLD + SURE * math.sqrt(THRESHOLD * (1 - THRESHOLD) / LINES)
        self.sure = NormalDist().inv_cdf((1 + min(p, 0.999)) / 2)

    def windows(self, h: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, line): where the window begins and ends among all places of all lines."""
        lo, hi = np.empty(h.shape, np.int64), np.empty(h.shape, np.int64)
        for i, places in enumerate(self.sorted):
            lo[:, i] = np.searchsorted(places, h[:, i] - half, "left") + i * len(places)
            hi[:, i] = np.searchsorted(places, h[:, i] + half, "right") + i * len(places)
        return lo, hi

    def collisions(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each vector, on how many lines its place is in the window, by comparing
        places: cheaper than to walk the arrays where the windows hold much of them."""
        n = len(self.x)
        out, place, inside = np.zeros(n, np.uint8 if LINES < 256 else np.uint16), np.empty(n, self.rank.dtype), np.empty(n, bool)
        first = (lo - np.arange(LINES) * n).astype(self.rank.dtype)
        sizes = (hi - lo).astype(self.rank.dtype)
        for i in np.flatnonzero(hi > lo):
            if hi[i] - lo[i] == n:
                out += 1
                continue
            np.subtract(self.rank[i], first[i], out=place)  # places below wrap around, beyond the size as well
            np.less(place, sizes[i], out=inside)
            np.add(out, inside, out=out)
        return out

    def search(self, q: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query (row of q; only products of its floor or more are of interest):
        its row, and the rows and inner products of its k best verified vectors."""
        n, need = len(self.x), math.ceil(THRESHOLD * LINES)
        norm = np.sqrt((q * q).sum(1))
        places = asked(q) @ self.lines.T
        self.pairs += n * len(q)
        far = lambda s, i: math.sqrt(max(2 - 2 * s / (self.m * norm[i]), 1e-12))
        for a in range(0, len(q), BATCH):
            batch = np.arange(a, min(a + BATCH, len(q)))
            first = (self.x[:PROBE] @ q[batch].T).max(0)
            half = np.array([0.7 * self.sure * far(max(s, floor[i]), i) for s, i in zip(first, batch)])
            held: dict[int, tuple] = {}
            while len(batch):
                lo, hi = self.windows(places[batch], half)
                left = []
                for r, i in enumerate(batch):
                    if i in held:
                        counts, seen, rows, scores, was_lo, was_hi = held.pop(i)
                        ring = [(b, e) for b, e in zip((*lo[r], *was_hi), (*was_lo, *hi[r])) if b < e]
                    else:
                        counts, seen, rows, scores = np.zeros(n, np.int64), np.zeros(n, bool), np.empty(0, np.int64), np.empty(0)
                        ring = [(b, e) for b, e in zip(lo[r], hi[r]) if b < e]
                    size = sum(e - b for b, e in ring)
                    self.touched += int(size)
                    if size > DENSE * n * LINES:
                        counts = self.collisions(lo[r], hi[r]).astype(np.int64)
                    elif ring:
                        counts += np.bincount(np.concatenate([self.order[b:e] for b, e in ring]), minlength=n)
                    new = np.flatnonzero((counts >= need) & ~seen)
                    self.verified += len(new)
                    seen[new] = True
                    rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.x[new] @ q[i]])
                    if len(rows) > k:
                        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                        rows, scores = rows[scores >= edge], scores[scores >= edge]
                    least = max(scores.min() if len(rows) >= k else -math.inf, floor[i])
                    enough = self.sure * far(least, i) if least > -math.inf else WHOLE
                    if half[r] >= min(enough, WHOLE):
                        yield int(i), rows, scores
                    else:
                        held[i] = counts, seen, rows, scores, lo[r], hi[r]
                        left.append((i, min(half[r] * GROWTH, enough)))
                batch, half = np.array([i for i, _ in left], int), np.array([w for _, w in left])


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, some not 0."""
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda v: F.coalesce(ok(v.cast("double")), F.lit(False))) & F.exists(vec, lambda v: v != 0)


def _place(rows: DataFrame, largest: dict[int, float]) -> DataFrame:
    """``rows`` (node, asks, v) with dim, norm, and the places on the first lines of the
    vector as a point (at) and as a query (qat)."""
    kind = "node long, asks boolean, v array<double>, dim int, norm double, at array<double>, qat array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(2)
            dims = np.diff(vectors.offsets.to_numpy())
            for d in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                x = np.asarray(part.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
                axes = lines(int(d))[:AXES].T
                flat = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), AXES).cast(pa.list_(pa.float64()))
                cols = [*part.columns, pa.array(np.full(len(x), d, np.int32)), pa.array(np.sqrt((x * x).sum(1))), flat(lifted(x, largest[int(d)]) @ axes), flat(asked(x) @ axes)]
                yield pa.RecordBatch.from_arrays(cols, ["node", "asks", "v", "dim", "norm", "at", "qat"])

    return rows.select("node", "asks", "v").mapInArrow(run, kind)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row for which ``queries`` (a
    condition on the column vec_id) holds, the k vectors found with the largest inner
    product in double precision, ties to the smaller vec_id.

    A row is no candidate for its own id. Vectors that are null, empty or zero or hold a
    null or non-finite component take no part, nor do rows with a null id. Vectors of
    different lengths are never compared. Rows that repeat an id with the same vector
    count once; with different vectors, each of them asks and answers, and the best
    product of an id counts. With fewer than k candidates all are returned; an empty
    table gives no rows. Other columns are ignored, whatever their names."""
    spark = vectors.sparkSession
    ship(spark)
    src = cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).dropDuplicates(["vec_id", "v"]).withColumn("asks", F.coalesce(queries, F.lit(False))))

    # equal vectors are one node, named by its least id; of its ids the k + 1 least can be answers
    alike = Window.partitionBy("v").orderBy("vec_id")
    members = src.select("v", "vec_id", F.row_number().over(alike).alias("i")).where(F.col("i") <= k + 1)
    nodes = members.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    wanted = src.where("asks").groupBy("v").agg(F.lit(True).alias("asks"))
    nodes = cut(nodes.join(wanted, "v", "left").select(F.col("ids")[0].alias("first"), F.monotonically_increasing_id().alias("node"), F.coalesce("asks", F.lit(False)).alias("asks"), "v", "ids"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sizes = {r.dim: r for r in nodes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m"), F.count_if("asks").alias("q")).collect()}  # a row a length
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest = {d: float(r.m) * (1 + 1e-9) for d, r in sizes.items()}
    placed = cut(_place(nodes, largest))

    grid = {d: math.ceil((r.n / block) ** (1 / AXES)) for d, r in sizes.items()}
    bounds = {}  # of each line's ranges; their number is that of the blocks to the power 1/3
    for d, g in grid.items():
        if g > 1:
            shares = [i / g for i in range(1, g)]
            got = placed.where(F.col("dim") == d).agg(*[F.percentile_approx(F.col("at")[j], shares, 10_000).alias(f"b{j}") for j in range(AXES)]).first()
            bounds[d] = [got[j] for j in range(AXES)]
        else:
            bounds[d] = [[] for _ in range(AXES)]
    pick = lambda of: F.coalesce(*[F.when(F.col("dim") == d, of(d)) for d in sizes])
    edges = [pick(lambda d, j=j: F.lit(bounds[d][j]).cast("array<double>") if bounds[d][j] else F.array().cast("array<double>")) for j in range(AXES)]
    span = lambda j, place: F.size(F.filter(edges[j], lambda b: b < place))
    cell = ["dim", *[f"c{j}" for j in range(AXES)]]
    placed = placed.select("*", *[span(j, F.col("at")[j]).alias(f"c{j}") for j in range(AXES)])
    blocks = cut(placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).select(*cell, F.ceil(F.col("n") / block).cast("int").alias("parts")))
    n_blocks = blocks.agg(F.sum("parts")).first()[0]
    small = (lambda df: F.broadcast(df)) if blocks.count() <= BROADCAST_BLOCKS else (lambda df: df)
    placed = cut(placed.join(small(blocks), cell).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")))

    width = spark.sparkContext.defaultParallelism
    result = "qnode long, node long, score double"

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            found = Block(np.array(left["v"].tolist(), np.float64), largest[int(key[0])])
            ids, own = left["node"].to_numpy(), right["qnode"].to_numpy()
            for r, rows, s in found.search(np.array(right["qv"].tolist(), np.float64), right["floor"].to_numpy(np.float64), k + 1):
                out.append(pd.DataFrame({"qnode": own[r], "node": ids[rows], "score": s}))
        return pd.concat(out) if out else pd.DataFrame({"qnode": np.empty(0, np.int64), "node": np.empty(0, np.int64), "score": np.empty(0)})

    def meetings(asking: DataFrame, n_chunks: int) -> DataFrame:
        """Blocks and queries (cell, part, node, v, floor) in cells of bounded size."""
        keys = [*cell, "part", "chunk"]
        data = placed.select(*cell, "part", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"), "node", "v")
        turn = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(n_chunks)).cast("int")
        asking = asking.select(*[F.col(c).alias(f"q_{c}") for c in (*cell, "part")], turn.alias("q_chunk"), F.col("node").alias("qnode"), F.col("v").alias("qv"), "floor")
        n = min(2 * n_blocks * n_chunks, 20_000)  # by number, as Spark would merge cells for their few bytes
        theirs = [f"q_{c}" for c in keys]
        return data.repartition(n, *keys).groupBy(*keys).cogroup(asking.repartition(n, *theirs).groupBy(*theirs)).applyInPandas(meet, result)

    chunks = lambda q: max(1, math.ceil(q / chunk), math.ceil(2 * width / n_blocks))
    home = placed.where("asks").select(*cell, "part", "node", "v", F.lit(-math.inf).alias("floor"))
    found = cut(meetings(home, chunks(max(r.q for r in sizes.values()) / n_blocks)))
    if n_blocks > len(sizes):
        # what the own block gave bounds the radius; without k + 1 there, all blocks are of interest
        rank = F.row_number().over(Window.partitionBy("qnode").orderBy(F.desc("score")))
        floor = found.select("qnode", "score", rank.alias("i")).where(F.col("i") == k + 1).select(F.col("qnode").alias("node"), F.col("score").alias("floor"))
        radius = F.sqrt(F.greatest(2 - 2 * F.col("floor") / (F.col("norm") * pick(lambda d: F.lit(largest[d]))), F.lit(0.0)))
        away = placed.where("asks").select(*[F.col(c).alias(f"own_{c}") for c in (*cell[1:], "part")], "dim", "node", "v", "norm", "qat").join(floor, "node", "left")
        away = away.withColumn("reach", F.coalesce(REACH * radius + 1e-9, F.lit(WHOLE)))
        for j in range(AXES):
            away = away.withColumn(f"c{j}", F.explode(F.sequence(span(j, F.col("qat")[j] - F.col("reach")), span(j, F.col("qat")[j] + F.col("reach")))))
        away = away.join(small(blocks), cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        same = F.lit(True)
        for c in (*cell[1:], "part"):
            same = same & (F.col(c) == F.col(f"own_{c}"))
        away = away.where(~same).select(*cell, "part", "node", "v", F.coalesce("floor", F.lit(-math.inf)).alias("floor"))
        found = found.unionByName(meetings(away, chunks(max(r.q for r in sizes.values()))))

    # k + 1 nodes at most, then k + 1 ids at most: a query may be among its own
    best = Window.partitionBy("qnode").orderBy(F.desc("score"), "first")
    first = nodes.select("node", "first")
    found = found.join(first, "node").select("qnode", "node", "score", F.row_number().over(best).alias("i")).where(F.col("i") <= k + 1)
    spread = found.join(nodes.select("node", "ids"), "node").select("qnode", F.explode("ids").alias("vec_id"), "score")
    order = Window.partitionBy("qnode").orderBy(F.desc("score"), "vec_id")
    spread = spread.select("qnode", "vec_id", "score", F.row_number().over(order).alias("i")).where(F.col("i") <= 2 * k + 1)
    asking = src.where("asks").select("vec_id", "v").join(nodes.where("asks").select("node", "v"), "v").select(F.col("vec_id").alias("query_id"), F.col("node").alias("qnode"))
    out = asking.join(spread, "qnode").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.select("query_id", F.row_number().over(last).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
