"""The greedy choice among rows that say the same: as among all their pairs, without these."""

import random

import pytest
from test_matching import chosen
from test_scored_pairs import ROW

from tessera.operators import matching

PAIR = "a long, b long, score double"


def copies(rnd, n, most):
    """class: ids of its rows, mixed, each class by its least id."""
    ids = rnd.sample(range(1000), n * most)
    parts = [ids[i * most : i * most + rnd.randint(1, most)] for i in range(n)]
    return {min(p): p for p in parts}


@pytest.mark.parametrize("seed", range(2))
def test_choice_of_copies_is_that_of_their_rows(spark, seed):
    rnd = random.Random(seed)
    lefts, rights = copies(rnd, 7, 5), copies(rnd, 8, 4)
    pairs = [(a, b, float(rnd.randint(0, 3))) for a in lefts for b in rights if rnd.random() < (0.4, 0.9)[seed]]
    members = lambda side: spark.createDataFrame([(c, i) for c, ids in side.items() for i in ids], "rep long, id long")
    got = matching.greedy_assign_copies(spark.createDataFrame(pairs, PAIR), "a", "b", "score", members(lefts), members(rights))
    assert sorted(map(tuple, got.collect())) == chosen([(i, j, s) for a, b, s in pairs for i in lefts[a] for j in rights[b]])


def test_an_id_of_two_classes_is_taken_once(spark):
    lefts = spark.createDataFrame([(1, 1), (1, 5), (2, 2), (2, 5), (3, None)], "rep long, id long")
    rights = spark.createDataFrame([(7, 7), (8, 8), (8, 9)], "rep long, id long")
    pairs = [(1, 7, 90.0), (2, 8, 80.0), (2, 7, 70.0), (3, 8, 99.0)]
    got = matching.greedy_assign_copies(spark.createDataFrame(pairs, PAIR), "a", "b", "score", lefts, rights)
    members = {1: [1, 5], 2: [2, 5], 3: [], 7: [7], 8: [8, 9]}
    assert sorted(map(tuple, got.collect())) == chosen([(i, j, s) for a, b, s in pairs for i in members[a] for j in members[b]])
    assert matching.greedy_assign_copies(spark.createDataFrame([], PAIR), "a", "b", "score", lefts, rights).count() == 0


def test_copies_make_no_pairs(spark, monkeypatch):
    """Of 200 and 300 rows of one kind that say the same, one pair is scored."""
    from tessera.plans import generic

    row = lambda at, n: spark.createDataFrame([(at + i, 1, "x", "n/1", ["p"], ["m"]) for i in range(n)], ROW)
    monkeypatch.setattr(generic, "_rename_sides", lambda spark, d: (row(0, 200), row(500, 300)))
    scored, scored_pairs = [], matching.scored_pairs
    monkeypatch.setattr(matching, "scored_pairs", lambda *a: scored.append(scored_pairs(*a)) or scored[-1])
    got = sorted(map(tuple, generic.greedy_assignment(spark, "").collect()))
    assert scored[0].count() == 1 and got == [(i, 500 + i, 100.0) for i in range(200)]
