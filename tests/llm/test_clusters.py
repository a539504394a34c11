import hashlib

import duckdb
import numpy as np

from tessera.llm import clusters


def plain(rows, k, rounds, dim):
    """Python integers, every vector against every centroid."""
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    cent = [q for _, q in sorted(ok, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        own = [min((dist(q, c), n) for n, c in enumerate(cent)) for _, q in ok]
        if r < rounds:
            for n in range(len(cent)):
                mine = [q for (_, q), (_, o) in zip(ok, own) if o == n]
                if mine:
                    cent[n] = [sum(col) // len(mine) for col in zip(*mine)]
    by = {}
    for d, n in own:
        by[n] = by.get(n, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted(((i, n, d, by[n], sum(by.values()), sha[n]) for (i, _), (d, n) in zip(ok, own)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, n int, q string")


def got(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_against_plain_rounds_with_odd_rows_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = 2 * rng.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + (0.05 if i % 4 else 0.8) * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, [float(x) for x in (i % 3, -(i % 2), 0, 0, 0, 0, 0, 0)]) for i in range(40)]  # ties
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 7), (2003, [float("nan")] * 8), (2004, [float("inf")] + [0.0] * 7), (2005, [None] + [0.0] * 7), (2006, [0.0] * 8)]
    for k in (1, 5, 40):
        assert got(clusters.ball_kmeans(frame(spark, rows), k=k, rounds=3, dim=8)) == plain(rows, k, 3, 8)
    few = rows[:3]
    assert got(clusters.ball_kmeans(frame(spark, few), k=40, rounds=5, dim=8)) == plain(few, 40, 5, 8)
    assert clusters.ball_kmeans(frame(spark, rows).where("false"), dim=8).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2.0 ** (i % 19)), float(-i), 3e5 if i % 2 else -3e5]) for i in range(60)] + [(99, [1e30, 0.0, 0.0])]
    assert got(clusters.ball_kmeans(frame(spark, rows), k=7, rounds=4, dim=3)) == plain(rows[:-1], 7, 4, 3)


def test_core_and_annuli_spare_distances():
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (40, 16))
    x = centres[np.arange(4000) % 40] + rng.integers(-40, 40, (4000, 16))
    own, d = clusters.nearest_of_all(x, centres)
    moved = centres + rng.integers(-3, 3, centres.shape)
    new, best, taken = clusters.reassign(x, own, moved, clusters.between(moved))
    want, least = clusters.nearest_of_all(x, moved)
    assert (new == want).all() and (best == least).all()
    assert taken < 2 * len(x)  # of 40 * len(x)
    far = rng.integers(0, 40, len(x))  # any earlier cluster gives the same
    new, best, _ = clusters.reassign(x, far, moved, clusters.between(moved))
    assert (new == want).all() and (best == least).all()


def test_whole_table_against_sql(spark, data):
    rows = clusters.ball_kmeans(spark.read.parquet(f"{data}/embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    cur = con.execute(clusters.ORACLE)
    assert [c[0] for c in cur.description] == rows.columns[:6]
    assert got(rows) == sorted(cur.fetchall(), key=str)
