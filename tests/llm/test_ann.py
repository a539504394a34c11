import numpy as np
from pyspark.sql import functions as F

from tessera.llm import ann
from test_other_ops import slow_nearest


def clustered(n, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 40, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.02 * rng.standard_normal((n, dim))
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def test_rings_count_what_the_whole_windows_hold():
    x = clustered(900).astype(float)
    b = ann.Block(x, float(np.sqrt((x * x).sum(1)).max()) + 1e-9)
    h = ann.asked(x[:3]) @ b.lines.T
    places = ann.lifted(x, b.m) @ b.lines.T
    inner = b.windows(h, np.full(3, 0.3))
    outer = b.windows(h, np.full(3, 0.7))
    for q in range(3):
        ring = [b.order[s:e] for (lo, hi), (a, z) in zip(zip(inner[0][q], inner[1][q]), zip(outer[0][q], outer[1][q])) for s, e in ((a, lo), (lo, hi), (hi, z))]
        counts = np.bincount(np.concatenate(ring), minlength=len(x))
        assert (counts == (np.abs(places - h[q]) <= 0.7).sum(1)).all()


def test_few_vectors_are_verified_where_neighbours_are_near():
    x = clustered(8000).astype(float)
    b = ann.Block(x, float(np.sqrt((x * x).sum(1)).max()) + 1e-9)
    q, hit = x[::100], 0
    for r, rows, s in b.search(q, np.full(len(q), -np.inf), 10):
        hit += len(set(np.sort(s)[::-1][:10].round(9)) & set(np.sort(x @ q[r])[::-1][:10].round(9)))
    assert hit >= 0.9 * 10 * len(q) and b.verified < 0.1 * b.pairs


def test_recall_over_many_blocks(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(3000))]
    rows += [(5000 + i, rows[20][1]) for i in range(900)]  # nearly a quarter of the rows are one vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {(q, i) for q, _, i, _ in slow_nearest(rows, 10)}
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 10, block=150).collect()
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want) and len(got) == len(want)
    tied = {r.query_id: [x.vec_id for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == r.query_id] for r in got if r.query_id in (20, 5000, 5880)}
    assert tied[20] == [5000 + i for i in range(10)]
    assert tied[5000] == [20, *range(5001, 5010)] and tied[5880] == [20, *range(5000, 5009)]


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.2]), (20, None)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
