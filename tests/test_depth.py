"""No operator stops at a depth or a number of rounds."""

from tessera.operators import graph, matching
from tessera.sources import yang


def test_closure_of_a_long_chain_and_a_cycle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5, 7), (None, 1)], "c long, p long")
    got = {(r.child, r.ancestor): r.depth for r in graph.closure(edges, "c", "p").collect()}
    want = {(i, j): j - i - (i <= 5 and j >= 7) for i in range(200) for j in range(i + 1, 201)}
    want |= {(1000 + i, 1000 + j): (j - i) % 3 or 3 for i in range(3) for j in range(3)}
    assert got == want
    few = graph.closure(edges, "c", "p", 5).collect()
    assert {(r.child, r.ancestor): r.depth for r in few} == {k: d for k, d in want.items() if d <= 5}


def test_deep_groupings(spark):
    body = "".join(f"grouping g{i} {{ container c{i} {{ leaf l{i} {{ type string; }} uses g{i + 1}; }} }} " for i in range(50))
    text = f"module m {{ prefix m; {body} grouping g50 {{ leaf end {{ type int8; }} }} uses g0; grouping loop {{ container again {{ uses m:loop; }} }} container r {{ uses loop; }} }}"
    paths = {r.path for r in yang.expand_uses(yang.nodes(spark.createDataFrame([("m.yang", text)], "file string, text string"))).select("path").collect()}
    assert "m/" + "/".join(f"c{i}" for i in range(50)) + "/end" in paths
    assert "m/r/again" in paths and "m/r/again/again" not in paths


def test_groupings_of_one_name_stay_apart(spark):
    texts = [
        ("a.yang", "module a { prefix p; grouping g { leaf x { type string; } } container c { uses g; } }"),
        ("b.yang", "module b { prefix p; import a { prefix q; } grouping g { leaf y { type string; } } container d { uses p:g; } container e { uses q:g; } container f { uses zz:g; } }"),
        ("s.yang", "submodule s { belongs-to b { prefix o; } container h { uses o:g; } }"),
    ]
    rows = yang.expand_uses(yang.nodes(spark.createDataFrame(texts, "file string, text string"))).where("keyword = 'leaf' and grouping is null")
    assert {r.path for r in rows.collect()} == {"a/c/x", "b/d/y", "b/e/x", "b/h/y"}


def test_many_rounds_of_the_greedy_choice(spark):
    # each round frees one pair: i prefers what i + 1 takes first
    pairs = [(i, i, float(2 * i)) for i in range(40)] + [(i, i + 1, float(2 * i + 1)) for i in range(40)]
    got = sorted(map(tuple, matching.greedy_assign(spark.createDataFrame(pairs, "a long, b long, score double"), "a", "b", "score").collect()))
    assert got == [(i, i + 1, float(2 * i + 1)) for i in range(40)]
