import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval, vector_index
from tessera.session import shared_folder


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    out = [(i, (centres[i % 12] + 0.15 * rng.standard_normal(16)).astype(np.float32).tolist(), i % 7) for i in range(1500)]
    out += [(5000 + i, out[3][1], 1) for i in range(8)] + [(6000, [0.0] * 16, 1), (6001, None, 1), (6002, [1.0], 1)]
    return spark.createDataFrame(out, "id long, v array<float>, kind int")


@pytest.fixture(scope="module")
def index(spark, rows):
    folder = f"{shared_folder(spark)}/test-index-{uuid.uuid4().hex}"
    vector_index.write(rows, folder, "v", lists=24)
    return vector_index.VectorIndex(spark, folder, "id", "v")


def ids(df):
    return [(r.id, round(r.score, 9)) for r in df.orderBy(F.desc("score"), F.desc("id")).collect()]


@pytest.mark.parametrize("where", [None, "kind = 1", "id >= 5000", "id < 0"])
def test_equal_to_a_scan(rows, index, where):
    for seed in range(3):
        q = np.random.default_rng(seed).standard_normal(16).tolist() if seed else rows.where("id = 3").first().v
        cond = None if where is None else F.expr(where)
        want = [(r.id, round(r.score, 9)) for r in retrieval.vector_topk(rows, q, 20, "id", "v", cond).orderBy("rank").collect()]
        assert ids(index.search(q, 20, cond)) == want


def test_lists_are_pruned(rows, index):
    q = rows.where("id = 3").first().v
    read = []
    probe = index.probe
    index.probe = lambda lists: read.append(lists) or probe(lists)
    try:
        out = index.search(q, 5)
    finally:
        del index.probe
    assert sum(map(len, read[:-1])) <= 6 and len(index.lists) == 24
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1][:200]
    assert {r.id for r in index.rest().collect()} == {6000, 6001, 6002}


def test_empty_index(spark, rows):
    folder = f"{shared_folder(spark)}/test-index-{uuid.uuid4().hex}"
    vector_index.write(rows.where("id = 6000"), folder, "v")
    assert vector_index.VectorIndex(spark, folder, "id", "v").search([1.0] * 16, 3).count() == 0
