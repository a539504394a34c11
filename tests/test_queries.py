import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from tessera.plans import generic, modules  # noqa: F401  (modules registers its queries)


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.fixture(scope="module")
def results(spark, data, request):
    """The chosen queries, some at a time: most of each is waiting for small jobs."""
    names = [i.callspec.params["name"] for i in request.session.items if i.fspath == request.fspath and hasattr(i, "callspec")]

    def run(name):
        df = generic.QUERIES[name](spark, data)
        return df.columns, df.collect()

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in names}


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(generic.ORACLES))
def test_query_gives_what_its_sql_gives(db, results, name):
    columns, rows = results[name].result()
    found = db.execute(generic.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in rows) == want


def test_greedy_assignment_is_greedy(spark, data):
    from pyspark.sql import functions as F

    from tessera.operators import matching

    pairs = [(i, j, float((i * 7 + j * 11) % 13)) for i in range(12) for j in range(15) if (i + j) % 3]
    taken, left, right = [], set(), set()
    for i, j, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if i not in left and j not in right:
            taken.append((i, j, s))
            left.add(i)
            right.add(j)
    df = spark.createDataFrame(pairs, "a long, b long, score double")
    assert sorted(map(tuple, matching.greedy_assign(df, "a", "b", "score").collect())) == sorted(taken)
    assert matching.greedy_assign(df.where(F.lit(False)), "a", "b", "score").count() == 0
