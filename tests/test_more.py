import os

from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import text, xpath
from tessera.operators import matching, report, retrieval
from tessera.sources import reports, yang

HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "schema")


def one(spark, value, *cols):
    return spark.createDataFrame([value], ", ".join(f"c{i} string" for i in range(len(value)))).select(*cols).first()


def test_text_functions(spark):
    c = F.col
    r = one(
        spark, ('leaf a "x y" 1..5;', "a,b, c", "../a = 'x' and not(b)", "[0-9]+|a", "module/leaf", "value <tag>"),
        text.snippet_tokens(c("c0")), text.split_values(c("c1"), F.lit("comma")), text.expression_profile(c("c2")), text.pattern_profile(c("c3")), text.repair_skeleton(c("c4"), F.lit("type"), F.lit("range")), text.strip_tag(c("c5")),
        text.keyword_window(F.split(F.lit("x y leaf z"), " "), F.array(F.lit("leaf"))),
    )
    assert r[0] == ["leaf", "a", '"x y"', "1..5", ";"] and r[1] == ["a", "b", "c"]
    assert r[2] == ["and", "not", "equal", "function", "parent"] and r[3] == ["class", "repeat", "either"]
    assert r[4] == "module/leaf/type/range" and r[5] == "value" and r[6] == ["y", "leaf", "z"]


def test_masks(spark):
    values = {"": "<NO_VALUE>", "true": "<BOOLEAN>", "00:1a:2B:3c:4d:5e": "<MAC_ADDRESS>", "2024-01-01": "<VERSION>", "1.2.3": "<VERSION>", "10.0.0.1": "<VERSION>", "10.0.0.1/8": "<IP_ADDRESS>", "fe80::1": "<IP_ADDRESS>", "-4.5": "<NUMBER>", "1..max": "<RANGE>", "../a/b": "<PATH>", "name-1": "<IDENTIFIER>", "[a-z]+": "<REGEX>", "a, b": "<LIST>", "é": "<STRING>"}
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.mask(F.col("v")).alias("m"))
    assert {r.v: r.m for r in df.collect()} == values


def test_intervals(spark):
    from tessera.functions import intervals

    cases = [("1..5", "1..10", "relaxed"), ("1..2 | 3..4", "1..4", "equivalent"), ("0..9", "1..5 | 7", "narrowed"), ("1..5", "4..9", "redefined"), ("min..5", "0..5", "narrowed"), ("x", "1", None), ("5", "5", "equivalent")]
    df = spark.createDataFrame(cases, "a string, b string, want string").select("want", intervals.interval_change(F.col("a"), F.col("b")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_paths(spark):
    rows = spark.createDataFrame([("m/a/b", "../c", "/a/c", "equivalent"), ("m/a/b", "../c", "../d", "incomparable"), ("m/a/b", "../zz", "../d", "relaxed"), ("m/a/b", "../c", "../../../../c", "narrowed"), ("m/a/b", "p:x/../y", "../zz", "incomparable")], "ctx string, o string, n string, want string")
    nodes = spark.createDataFrame([("m/a/c",), ("m/a/d",)], "path string")
    assert all(r.want == r.path_change for r in xpath.compare_paths(rows, nodes, nodes, "o", "n", "ctx").collect())


def test_predicates_are_parsed(spark):
    cases = {"/a/b[c[d='1']/e='2']/f": "/a/b/f", "/a[x=']']/b": "/a/b", '/p:a[p:k="[1]"][p:j=current()/../q:z]/p:b': "/a/b", "a/b": "a/b", "count(/a[b[c[d]]])": "/a", "/a[b": "/a[b"}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", xpath.clean(F.col("p")).alias("c"))
    assert {r.p: r.c for r in df.collect()} == cases


def test_module_tables(spark, tmp_path):
    files = yang.read_files(spark, f"{HERE}/old")
    stmts = yang.statements(files)
    assert [tuple(r) for r in yang.outline(files).collect()] == [("box.yang", "module", "box", None)]
    assert yang.scan(files).where("keyword = 'leaf'").count() == 9
    assert yang.diagnostics(stmts).count() == 0
    bad = spark.createDataFrame([("f.yang", "module f { prefix f; leaf a { type nope; } uses none; q:x 1; }")], "file string, text string")
    assert {r.code for r in yang.diagnostics(yang.statements(bad)).collect()} == {"type-not-found", "uses-not-found", "prefix-not-found"}
    vertices, edges = yang.statement_graph(stmts)
    assert vertices.count() == edges.count() + 1
    named = yang.resolve_prefixes(stmts.withColumn("name", F.concat_ws(":", "prefix", "keyword")), yang.prefixes(stmts), "name")
    assert {r.name_module for r in named.where("prefix = 'x'").collect()} == {"extra"}
    assert yang.fingerprints(stmts).count() == 3
    assert yang.uses_signature(yang.nodes(files)).collect()[0].n == 2


def test_augments_and_deviations(spark):
    f = spark.createDataFrame([("m.yang", "module m { prefix m; container a { leaf b { type string; } leaf c { type string; } } augment /m:a { leaf d { type int8; } } deviation /m:a/m:b { deviate not-supported; } }")], "file string, text string")
    paths = {text_: k for text_, k in yang.apply_deviations(yang.nodes(f)).select("path", "keyword").collect()}
    assert "m/a/c" in paths and "m/a/b" not in paths and "m/a/b/type" not in paths and any(p.endswith("m:a/d") for p in paths)


def test_report_passes(spark):
    rows = spark.createDataFrame([(1, "changed", ["a/b", "c/d"]), (2, "changed", ["a/b", "a/c"]), (3, "added", ["a/b", "c/d"])], "id int, action string, paths array<string>")
    assert sorted((r.id, len(r.paths)) for r in report.split_paths(rows).collect()) == [(1, 1), (1, 1), (2, 2), (3, 2)]
    lines = spark.createDataFrame([("added", 1, 2), ("deleted", 1, 2)], "action string, old_line int, new_line int")
    assert [tuple(r) for r in report.fix_lines(lines).orderBy("action").collect()] == [("added", None, 2), ("deleted", 1, None)]
    noop = spark.createDataFrame([("changed", "x", "x"), ("changed", "x", None), ("added", None, None)], "action string, old_value string, new_value string")
    assert report.drop_noops(noop).count() == 2
    tree = spark.createDataFrame([("a", "added"), ("a/b", "added"), ("a/b", "deleted"), ("ab", "added")], "path string, action string")
    assert {tuple(r) for r in report.drop_covered_children(tree, "path", ["action"]).collect()} == {("a", "added"), ("a/b", "deleted"), ("ab", "added")}


def test_children_follow_their_parents(spark):
    parents = spark.createDataFrame([("a", "x"), ("a/b", "y")], "old_path string, new_path string")
    gone = spark.createDataFrame([("a/c",), ("a/b/d",), ("a/b/e",)], "path string")
    came = spark.createDataFrame([("x/c",), ("y/d",), ("x/b/e",)], "path string")
    assert {tuple(r) for r in matching.child_pairs(parents, gone, came).collect()} == {("a/c", "x/c"), ("a/b/d", "y/d")}


def test_backfill_and_synthetic(spark):
    pool = spark.createDataFrame([(i, "k" if i % 2 else "z", f"t{i}") for i in range(10)], "id long, kw string, t string")
    assert retrieval.backfill(pool.where("id < 2"), pool, "kw", "k", "id", 3).count() == 5
    top = spark.createDataFrame([(1, "k", "t", 0.5)], "rank int, yang_keyword string, display_text string, score double")
    more = retrieval.with_synthetic(top, [("k", "x"), ("new", "new <STRING>")]).orderBy("rank").collect()
    assert [(r["rank"], r.yang_keyword, r.score) for r in more] == [(1, "k", 0.5), (2, "new", None)]


def test_command_line(spark, tmp_path):
    assert cli.main(["compare", f"{HERE}/old", f"{HERE}/new", "--rules", f"{HERE}/rules.xml", "--out", f"{tmp_path}/out", "--rfc7950"]) == 0
    back = reports.read_text(spark, f"{tmp_path}/out/report")
    assert back.where("kind = 'change' and keyword = 'leaf' and action = 'deleted'").count() == 1
    assert spark.read.json(f"{tmp_path}/out/sections").where("section = 'non_compatible'").count() > 3
    assert cli.main(["check-rules", f"{HERE}/rules.xml"]) == 0


def test_rules_of_a_similar_keyword(tmp_path):
    from tessera import cli
    from tessera.sources import rules_xml

    rule = "<rule><rule-id>r1</rule-id><structurals><structural>leaf</structural></structurals><actions><action>added</action></actions><compatible>backward-compatible</compatible></rule>"
    path = tmp_path / "rules.xml"
    path.write_text(f"<rules>{rule}</rules>")
    assert cli.main(["add-rules", str(path), "blob", "--like", "leaf"]) == 0
    rows = rules_xml.rule_rows(path.read_text())
    assert [(r[1], r[3], r[18], r[20]) for r in rows] == [("r1", "leaf", "added", "backward-compatible"), ("r1-blob", "blob", "added", "backward-compatible")]
    assert (tmp_path / "rules.xml.1").read_text() == f"<rules>{rule}</rules>"
    assert cli.main(["add-rules", str(path), "blob", "--like", "leaf"]) == 1
    assert cli.main(["add-rules", str(path), "other", "--like", "none"]) == 1
    assert cli.main(["add-rules", str(path), "blob2", "--like", "leaf"]) == 0 and (tmp_path / "rules.xml.2").exists()


def test_a_moved_statement_hides_its_aliases(spark):
    from tessera.operators import matching

    rows = spark.createDataFrame([(1, "leaf", "a", None, 3, "added"), (2, "leaf", "a", None, 3, "changed"), (3, "leaf", "a", "f", 3, "added"), (4, "leaf", "a", None, 3, "deleted")], "id int, keyword string, name string, file string, line int, action string")
    left = matching.drop_aliases(rows, rows.where("id = 2"), ["keyword", "name", "file", "line"])
    assert sorted(r.id for r in left.collect()) == [2, 3, 4]
