from pyspark.sql import functions as F

from tessera.operators import diff, steps
from tessera.plans import schema_diff
from tessera.sources import rules_xml, yang

RULES = "<rules><rule><rule-id>r</rule-id><structurals><structural>leaf</structural></structurals><actions><action>added</action></actions><compatible>backward-compatible</compatible></rule></rules>"


def _files(spark, *texts):
    return spark.createDataFrame([(f"m{i}.yang", t) for i, t in enumerate(texts)], "file string, text string")


def test_paths_are_not_placed_where_nothing_asks(spark, monkeypatch):
    monkeypatch.setattr(steps, "places", lambda rows: 1 / 0)
    monkeypatch.setattr(yang, "diagnostics", lambda rows: 1 / 0)
    old, new = (_files(spark, "module m { prefix p; container top { %s leaf b { type int8; } } }" % t) for t in ("", "leaf a { type int8; }"))
    c = schema_diff.compare_files(old, new, spark.createDataFrame(rules_xml.rule_rows(RULES), rules_xml.RULES))
    assert sorted((r.norm_path, r.action) for r in c.changes.collect()) == [("top/a", "added"), ("top/a/type", "added")]


def test_only_nodes_that_differ_go_on(spark):
    old = schema_diff.nodes_of(_files(spark, "module m { prefix p; container top { b:w x; leaf a { type int8; } leaf b { type int8; must 1; must 2; } leaf c { type int8; } } }"))
    new = schema_diff.nodes_of(_files(spark, "module m { prefix p; container top { b:w x; leaf a { type int16; } leaf b { type int8; must 2; must 1; } leaf d { type int8; } } }"))
    a, b = schema_diff.differing(old, new)
    paths = lambda df: {r.norm_path for r in df.collect()}
    assert paths(a) == {"top", "top/a/type", "top/b", "top/c", "top/c/type"} and paths(b) == {"top", "top/a/type", "top/b", "top/d", "top/d/type"}
    assert sorted(r.change_id for r in schema_diff.node_changes(a, b).collect()) == sorted(r.change_id for r in schema_diff.node_changes(old, new).collect())


def test_last_of_few_is_last_per_key(spark):
    rows = spark.range(60).select((F.col("id") % 50).cast("string").alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("j"), "id", F.array("id").alias("v"))
    twice = rows.unionByName(rows.where("id < 9").withColumn("id", F.col("id") + 100))
    for df in (rows.where("id < 50"), twice, rows.where("false")):
        assert sorted(map(str, diff.last_of_few(df, ["k", "j"], "id").collect())) == sorted(map(str, diff.last_per_key(df, ["k", "j"], "id").collect()))


def test_prefixes_of_nodes_are_those_of_statements(spark):
    one = ("module a { prefix x; import b { prefix y; } }", "module b { }", "module c { prefix z; import b { prefix 'y'; } import a { prefix x; } leaf import { type string; } }")
    for texts in (one, (*one, "submodule s { belongs-to a { prefix q; } import b { prefix r; } }")):
        files = _files(spark, *texts)
        assert sorted(yang.prefixes_of(yang.nodes(files), files).collect()) == sorted(yang.prefixes(yang.statements(files)).collect())


def test_places_pass_over_several_levels(spark):
    rows = schema_diff.nodes_of(_files(spark, "module m { prefix p; container t { choice c { case d { choice e { case f { leaf g { type enumeration { enum h; } } } } } } } }"))
    got = {r.path: (r.up, r.at) for r in steps.places(rows).collect()}
    assert got["m/t/c/d/e/f/g"] == ("m/t", "m/t/c/d/e/f/g") and got["m/t/c/d/e"] == ("m/t", "m/t") and got["m/t/c/d/e/f/g/type/h"] == ("m/t/c/d/e/f/g",) * 2 and got["m"] == (None, "m")
