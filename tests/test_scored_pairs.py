"""Pairs are scored by classes before their rows meet, and none that reaches the threshold is lost."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import matching

ROW = "id long, kind int, name string, path string, items array<string>, limits array<string>"


def by_rows(o, n, threshold):
    pairs = matching.candidates(o, n, "kind", "name", "items", matching.least_attributes(threshold), key="id")
    pair = lambda c: (F.col(f"o_{c}"), F.col(f"n_{c}"))
    score = matching.pair_score(F.col("same_name"), text.jaccard(*pair("items")), text.jaccard(*pair("limits")), 100 * text.path_shape(*pair("path")), matching.name_similarity(*pair("name")))
    return pairs.select("o_id", "n_id", F.round(score, 6).alias("score")).where(F.col("score") >= threshold)


@pytest.mark.parametrize("names", [["a-b", "a_b", "AB", "alpha", "alphabet", "x" * 40, "x" * 39 + "y", ""], ["a", "b", None]])
def test_classes_lose_no_pair(spark, names):
    rnd = random.Random(3)
    some = lambda of, most: [rnd.choice(of) for _ in range(rnd.randint(0, most))]
    rows = lambda n: spark.createDataFrame([(i, rnd.randint(0, 1), rnd.choice(names), f"n/{rnd.randint(0, 2)}/{rnd.randint(0, 1)}", some("abcdefg", 5) if i % 9 else None, some("xyz", 2)) for i in range(n)], ROW)
    o, n = rows(60), rows(80)
    want = sorted(map(tuple, by_rows(o, n, 48.0).collect()))
    assert want and sorted(map(tuple, matching.scored_pairs(o, n, 48.0).collect())) == want


def test_classes_that_cannot_reach_the_threshold_meet_no_rows(spark, monkeypatch):
    """One shared item of four cannot do it, whatever the paths and names are."""
    kept = []
    stored = matching.stored
    monkeypatch.setattr(matching, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    o = spark.createDataFrame([(i, 1, f"{i}", "n/1", ["p", f"q{i}", f"r{i}", f"s{i}"], ["m"]) for i in range(50)], ROW)
    n = spark.createDataFrame([(i, 1, f"{i + 100}", "n/1", ["p", f"q-{i}", f"r-{i}", f"s-{i}"], ["m"]) for i in range(50)], ROW)
    assert matching.candidates(o, n, "kind", "name", "items", matching.least_attributes(48.0), key="id").count() == 2500
    assert matching.scored_pairs(o, n, 48.0).count() == 0
    assert [df.count() for df in kept if "n_class" in df.columns and "o_class" in df.columns] == [0]
