"""Modules in several revisions, and files that are broken."""

from tessera.plans import schema_diff
from tessera.sources import yang

SHARED = {
    "a.yang": 'module a { prefix a; revision 2020-01-01; include part; typedef t { type int8; } identity root; grouping g { leaf early { type t; } leaf r { type identityref { base a:root; } } uses s; } container own { leaf gone { type t; } } }',
    "a@2022.yang": 'module a { prefix a; revision 2022-05-05; revision 2020-01-01; include part; typedef t { type int16; } identity root; grouping g { leaf late { type t; } uses s; } container own { uses g; } }',
    "part1.yang": "submodule part { belongs-to a { prefix a; } revision 2019-09-09; grouping s { leaf s1 { type a:t; } } }",
    "part2.yang": "submodule part { belongs-to a { prefix a; } revision 2021-01-01; grouping s { leaf s2 { type a:t; } } container sub { } }",
}


def loaded(spark, texts):
    nodes, *_ = schema_diff._nodes_and_uses(spark.createDataFrame(sorted(texts.items()), "file string, text string"))
    return {r.path: r for r in nodes.collect()}


def test_imports_speak_of_the_revision_as_of_their_date(spark):
    dates = {"exact": "2020-01-01", "between": "2021-06-01", "newer": "2030-01-01", "before": "2000-01-01", "none": None}
    users = {f"{k}.yang": f'module {k} {{ prefix a; import a {{ prefix x; {f"revision-date {d};" if d else ""} }} container {k} {{ uses x:g; leaf l {{ type x:t; }} }} }}' for k, d in dates.items()}
    rows = loaded(spark, {**SHARED, **users})
    assert {p for p, r in rows.items() if r.keyword in ("leaf", "container")} == {
        "a/g/late", "a/s/s2", "a/own", "a/own/late", "a/own/s2", "a/sub",
        *(f"{k}/{k}{n}" for k in ("exact", "between", "before") for n in ("", "/early", "/r", "/s1", "/l")), *(f"{k}/{k}{n}" for k in ("newer", "none") for n in ("", "/late", "/s2", "/l")),
    }
    assert '"a@2020-01-01:t"' in rows["exact/exact/early/type"].type_json and '"a:t"' in rows["none/none/late/type"].type_json
    assert '"base": "a@2020-01-01:root"' in rows["exact/exact/r/type"].type_json
    assert '"a@2020-01-01:t"' in rows["exact/exact/l/type"].type_json and '\\"name\\": \\"int8\\"' in rows["exact/exact/l/type"].defs
    assert '"a@2020-01-01:t"' in rows["exact/exact/s1/type"].type_json


def test_one_revision_each_changes_nothing(spark):
    rows = yang.nodes(spark.createDataFrame([("a.yang", SHARED["a.yang"]), ("x.yang", None), ("y.yang", "")], "file string, text string"))
    assert yang.by_revision(rows) is rows


def kinds(text):
    out = []

    def walk(s, path):
        out.append("/".join([*path, s.arg or s.keyword]))
        for c in s.children:
            walk(c, [*path, s.arg or s.keyword])

    for s in yang.parse(text):
        walk(s, [])
    return out


def test_an_open_block_ends_by_layout():
    text = "submodule m {\n  container a {\n    leaf x { type int8; }\n    list l {\n      key x;\n  container b {\n    leaf y { type int8; }\n  }\n}\n"
    assert kinds(text) == ["m", "m/a", "m/a/x", "m/a/x/int8", "m/a/l", "m/a/l/x", "m/b", "m/b/y", "m/b/y/int8"]
    assert kinds(text.replace("key x;\n", "key x;\n    }\n  }\n")) == kinds(text)


def test_an_open_block_ends_by_what_stands_in_modules_alone():
    assert kinds("module m { container a { leaf x { type int8; } identity i; container b { } }") == ["m", "m/a", "m/a/x", "m/a/x/int8", "m/i", "m/b"]
    # no layout and no such statement: the block ends with the text
    assert kinds("module m { container a { leaf x { type int8; } container b { } }") == ["m", "m/a", "m/a/x", "m/a/x/int8", "m/a/b"]


def test_a_brace_too_many_loses_nothing():
    assert kinds("module m { container a { } } container b { } leaf c { type int8; } } module n { leaf d { type int8; } }") == ["m", "m/a", "m/b", "m/c", "m/c/int8", "n", "n/d", "n/d/int8"]


def test_a_broken_submodule_keeps_its_module(spark):
    rows = loaded(spark, {"m.yang": "module m {\n  prefix p;\n  include s;\n  container top { uses g; }\n}\n", "s.yang": "submodule s {\n  belongs-to m { prefix p; }\n  grouping h {\n    leaf x { type int8; }\n  grouping g {\n    leaf y { type int8; }\n  }\n  container c { }\n}\n"})
    assert {"m/top", "m/top/y", "m/c"} <= set(rows) and "m/h/g/y" not in rows
