import random


def chosen(pairs):
    """Greedy choice, one pair after the other."""
    taken, left, right = [], set(), set()
    for i, j, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if i not in left and j not in right:
            taken.append((i, j, s))
            left.add(i)
            right.add(j)
    return sorted(taken)


def test_scores_see_all_of_a_kind(spark):
    """No pair of a kind that reaches the threshold is missing: against a loop over all."""
    from tessera.plans import generic

    data = "/root/testdata/sf0.01"
    old, new = (x.collect() for x in generic._rename_sides(spark, data))
    named = {(r.kind, r.name) for r in new}
    share = lambda a, b: 100 * len(set(a) & set(b)) / len(set(a) | set(b))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = []
    for o in old:
        for n in (n for n in new if n.kind == o.kind and (n.name == o.name or (o.kind, o.name) not in named)):
            a, c, p = share(o.items, n.items), share(o.limits, n.limits), 100 if o.path == n.path else 200 / 3
            near = 100 * (1 - edits(o.name, n.name) / max(len(o.name), len(n.name), 1))
            s = 0.75 * a + 0.15 * c + 0.1 * p if o.name == n.name else 0.6 * a + 0.2 * c + 0.15 * near + 0.05 * p
            if round(s, 6) >= 48:
                want.append((o.id, n.id, round(s, 4)))
    assert sorted((r.o_id, r.n_id, round(r.score, 4)) for r in generic.rename_scores(spark, data).collect()) == sorted(want) and want
    pairs = [tuple(r) for r in generic.rename_scores(spark, data).collect()]
    assert sorted(map(tuple, generic.greedy_assignment(spark, data).collect())) == chosen(pairs)


def test_similar_items_find_every_pair(spark):
    from tessera.operators import matching

    rng = random.Random(7)
    side = lambda at: [(at + i, rng.choice("xy"), f"{at}-{i}", [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]) for i in range(60)]
    old, new = side(0), side(100)
    frame = lambda rows: spark.createDataFrame(rows, "id long, kind string, name string, items array<string>")
    for least in (0.35, 0.5, 1.0, 0.0):
        alike = lambda a, b: len(set(a) & set(b)) >= least * len(set(a) | set(b)) - 1e-9  # noqa: E731, B023
        got = matching.candidates(frame(old), frame(new), "kind", "name", "items", least).select("o_id", "n_id").collect()
        assert sorted(map(tuple, got)) == sorted((o[0], n[0]) for o in old for n in new if o[1] == n[1] and alike(o[3], n[3]))


def test_nodes_renamed_and_moved_are_found(spark, tmp_path):
    from tessera.plans import schema_diff

    def nodes(name, body):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.yang").write_text(f'module m {{ namespace "urn:m"; prefix m; {body} }}')
        return schema_diff.load_nodes(spark, str(tmp_path / name))

    foo = 'type string {{ length "1..9"; }} default "k"; units "m"; description "{}";'
    old = nodes("old", f"container a {{ container x {{ leaf foo {{ {foo.format('the foo')} }} }} }} container c {{ leaf size {{ {foo.format('the size')} mandatory true; }} }}")
    new = nodes("new", f"container a {{ container y {{ leaf bar {{ {foo.format('the foo')} }} }} }} container d {{ leaf extent {{ {foo.format('the size')} mandatory true; }} }}")
    moves = {(r.old_path, r.keyword): r.new_path for r in schema_diff.match_moves(old, new).collect()}
    assert moves["a/x/foo", "leaf"] == "a/y/bar" and moves["c/size", "leaf"] == "d/extent"


def test_greedy_choice_among_ties(spark):
    from tessera.operators import matching

    def same(pairs):
        got = matching.greedy_assign(spark.createDataFrame(pairs, "a long, b long, score double"), "a", "b", "score")
        assert sorted(map(tuple, got.collect())) == chosen(pairs)

    same([(i, j, 80.0) for i in range(150) for j in range(130)])
    # two classes of one score, a class below them that they rob, and a bridge
    same([(i, j, 50.0) for i in range(9) for j in range(7)] + [(i, j, 50.0) for i in range(20, 25) for j in range(30, 39)] + [(i, j, 40.0) for i in range(20, 30) for j in range(5, 39)] + [(8, 30, 50.0)])
    rng = random.Random(2)
    same([(i, j, float(rng.randint(0, 2))) for i in range(14) for j in range(16) if rng.random() < 0.7])
