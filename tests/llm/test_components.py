import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import simhash


def test_long_chain_in_random_order_is_one_component(spark):
    ids = list(range(1000))
    random.Random(4).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(2001, 2000)], "a long, b long")
    got = dict(map(tuple, simhash.components(edges).collect()))
    assert got == {**{i: 0 for i in range(1000)}, 2000: 2000, 2001: 2000}


def test_rows_without_id_are_nodes(spark, monkeypatch):
    # the text is its fingerprint: 0 and 63 meet by way of 7 alone, far ones stand apart
    far, near = str(0xFFFF << 20), str(0xFFFF << 20 | 1)
    docs = spark.createDataFrame([(1, "0"), (2, "63"), (None, "7"), (None, far), (None, near), (None, near), (5, str(0xFFFF << 40)), (None, str(0xFFFF << 40 | 3))], "doc_id long, text string")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a: docs.select("doc_id", docs.text.cast("long").alias("fp")))
    monkeypatch.setattr(simhash, "_fingerprint_of", lambda text: F.lower(F.lpad(F.hex(text.cast("long")), 16, "0")))
    got = {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in simhash.simhash_components(docs).collect()}
    assert got[1, 0] == got[2, 63] == got[None, 7] == 1 and got[None, int(far)] is None and got[None, 0xFFFF << 40 | 3] == 5
    assert sorted(map(repr, simhash.keep_first(docs).collect())) == sorted(map(repr, docs.where(f"doc_id in (1, 5) or text in ('{far}', '{near}')").distinct().collect()))


def test_texts_without_id_stay_apart(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f"), (None, "something else that nobody shares"), (None, None)], "doc_id long, text string")
    assert sorted(repr(r.text) for r in simhash.keep_first(docs).collect()) == sorted(map(repr, ["a b c d e f", "something else that nobody shares", None]))


def test_one_id_with_several_texts(spark):
    one, other = "alpha beta gamma delta epsilon zeta", "quite another text that shares no words with it"
    docs = spark.createDataFrame([(1, one, "x"), (5, one, "y"), (5, other, "z"), (7, "third", "b"), (7, "third", "a"), (8, None, "n"), (8, "", "m")], "doc_id long, text string, tag string")
    got = sorted(map(tuple, simhash.keep_first(docs).collect()))
    assert [r[:2] for r in got] == [(1, one), (5, other), (7, "third"), (8, None)] and [r[2] for r in got] == ["x", "z", "a", "n"]


@pytest.mark.parametrize("size", [2000, 5])
def test_many_fingerprints_that_share_a_segment(spark, monkeypatch, size):
    monkeypatch.setattr(simhash, "HOT_SEGMENT", size)
    rng = random.Random(size)
    low = [0xDEADBEEF, 0xDEADBEEE, 0xDEADBEEF ^ 0x8000, 1]
    fps = {rng.choice(low) | (rng.getrandbits(6) * 0x01010111 & 0x7FFFFFFF) << 32 for _ in range(150)} | {rng.getrandbits(5) * 0x1010101 | 0x7ABCDEF0 << 32 for _ in range(40)}
    fps = sorted(fps)
    got = simhash.links(spark.createDataFrame(list(enumerate(fps)), "node long, fp long")).collect()
    want = {(i, j, (fps[i] ^ fps[j]).bit_count()) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert {tuple(r) for r in got} == want and len(got) == len(want) and want
