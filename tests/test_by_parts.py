"""The greedy choice without looking at all pairs is the same choice."""

import random

from tessera.operators import matching
from tessera.plans import schema_diff

TYPES = "norm_path string, keyword string, name string, type_name string, props array<struct<kind:string,field:string,pos:int,value:string>>"


def side(spark, seed, far):
    rnd = random.Random(seed)
    rows = {}
    for k in range(12):
        for _ in range(3):
            name = rnd.choice(["b", "one-two", "one_two", "alpha", f"c{k}", "bgp-rib"])
            path = "/".join([f"top{k}", *([f"far{k}", "loc-rib"] if far and k % 3 else [f"old{rnd.randint(0, 30)}"] if rnd.random() < 0.6 else ["ipv4-routes"]), name])
            props = [("attribute", "name", 0, name)] + [("attribute", "description", 0, rnd.choice(["box", "cup"]))] * rnd.randint(0, 1) + [("constraint", "when", 0, "x")] * rnd.randint(0, 1)
            rows[path] = (path, "leaf", name, rnd.choice(["string", "int8"]), props)
    return spark.createDataFrame(list(rows.values()), TYPES)


def test_by_parts_takes_what_all_pairs_give(spark, monkeypatch):
    old, new = side(spark, 1, False), side(spark, 2, True)
    run = lambda: sorted(map(tuple, schema_diff.match_moves(old, new).select("old_path", "new_path", "keyword", "score").collect()))
    want = run()
    monkeypatch.setattr(matching, "ALL_PAIRS", -1)
    assert want and run() == want


def test_few_pairs_are_rated(spark, monkeypatch):
    """Same-named leaves of many modules that moved: far fewer pairs than all are rated."""
    leaf = lambda p: (p, "leaf", "b", "int8", [("attribute", "name", 0, "b")])
    old = spark.createDataFrame([leaf(f"top{k}/old{k}/b") for k in range(100, 400)], TYPES)
    new = spark.createDataFrame([leaf(f"top{k}/far{k}/fresh{k}/b") for k in range(100, 400)], TYPES)
    seen = []
    greedy = matching.greedy_assign
    monkeypatch.setattr(matching, "ALL_PAIRS", 1000)
    monkeypatch.setattr(matching, "greedy_assign", lambda pairs, *a: seen.append(pairs.count()) or greedy(pairs, *a))
    got = {r.old_path: r.new_path for r in schema_diff.match_moves(old, new).collect()}
    assert len(got) == 300 and all(v.split("/")[0] == p.split("/")[0] for p, v in got.items())
    assert max(seen) < 300 * 300 / 10
