import os

import pytest

from tessera.functions import conditions, regex_inclusion, types
from tessera.plans import schema_diff
from tessera.sources import rules_xml, yang

HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "schema")


def test_parser_takes_any_text():
    top = yang.parse("module m { // note\n leaf a { type string; } /* x { */ p:q 'it''s'; description \"a\n   b\" + ' c'; }")
    assert [s.keyword for s in top] == ["module"] and [c.keyword for c in top[0].children] == ["leaf", "q", "description"]
    assert top[0].children[2].arg == "a\nb c" and top[0].children[1].prefix == "p" and top[0].children[0].line == 2
    for text in ("", "}}}", "module m {", "leaf", '"open', "a b c; {;}", "/* never closed"):
        yang.parse(text)


def test_statements_and_tables(spark):
    s = yang.statements(yang.read_files(spark, f"{HERE}/old"))
    assert {r.prefix: r.module for r in yang.prefixes(s).collect()} == {"b": "box", "x": "extra"}
    assert s.where("keyword = 'leaf' and depth = 2").count() == 8


def test_groupings_are_expanded(spark):
    rows = yang.expand_uses(yang.nodes(yang.read_files(spark, f"{HERE}/old")))
    assert {"box/top/tag", "box/top/tag/type"} <= {r.path for r in rows.collect()}


@pytest.fixture(scope="module")
def verdicts(spark):
    out = {}
    for mode in ("default", "rfc7950"):
        c = schema_diff.compare(spark, f"{HERE}/old", f"{HERE}/new", f"{HERE}/rules.xml", mode)
        heads = {(r.norm_path, r.keyword, r.action): r for r in c.changes.collect()}
        details = {}
        for r in c.details.collect():
            path = next(k[0] for k, h in heads.items() if h.change_id == r.change_id)
            details[path, r.subject] = (r.change, r.verdict)
        out[mode] = heads, details, c
    return out


BC, NBC = "backward-compatible", "non-backward-compatible"


@pytest.mark.parametrize(
    "path, field, change, verdict, strict",
    [
        ("top/size/type", "name", "relaxed", BC, NBC),
        ("top/code/type", "pattern", "narrowed", NBC, NBC),
        ("top/near/type", "path", "equivalent", BC, BC),
        ("top/tag/type", "length", "relaxed", BC, BC),
        ("top/seen", "when", "relaxed", BC, BC),
        ("top/row", "max-elements", "narrowed", NBC, NBC),
        ("top", "rights", "expanded", BC, BC),
        ("low", "rights", "narrowed", NBC, NBC),
    ],
)
def test_details(verdicts, path, field, change, verdict, strict):
    assert verdicts["default"][1][path, field] == (change, verdict)
    assert verdicts["rfc7950"][1][path, field] == (change, strict)


def test_heads_moves_and_sections(verdicts):
    heads, details, c = verdicts["default"]
    assert heads["top/gone", "leaf", "deleted"].verdict == NBC
    assert heads["top/kind/type/c", "enum", "added"].verdict == BC
    assert heads["top/row", "list", "changed"].verdict == NBC and heads["top/seen", "leaf", "changed"].verdict == BC
    moved = heads["low/new-name", "leaf", "changed"]
    assert moved.old.norm_path == "low/old-name" and details["low/new-name", "node-path"][1] == NBC
    sections = {r.norm_path: r.section for r in c.sections().collect()}
    assert sections["top/gone"] == "non_compatible" and sections["top/kind/type/c"] == "compatible"
    kinds = {r.norm_path: r.kind for r in c.condensed().collect()}
    assert kinds["low/new-name"] == "renamed" and kinds["top/gone"] == "deleted" and "top/gone/type" not in kinds
    assert any("leaf deleted" in r.line for r in schema_diff.render(c).collect())


def test_no_change_between_equal_folders(spark):
    c = schema_diff.compare(spark, f"{HERE}/old", f"{HERE}/old", f"{HERE}/rules.xml")
    assert c.changes.count() == 0 and c.details.count() == 0


def test_rule_files():
    text = open(f"{HERE}/rules.xml").read()
    assert rules_xml.problems(text) == [] and len(rules_xml.rule_rows(text)) > 20
    assert rules_xml.problems("<rules><rule><compatible>maybe</compatible></rule></rules>") and rules_xml.problems("<rules>")


def test_rules_round_trip(spark):
    table = rules_xml.read_rules(spark, f"{HERE}/rules.xml")
    rows = table.orderBy("ord").collect()
    again = rules_xml.rule_rows(rules_xml.to_xml(rows))
    assert [(r[1], r[3], r[18], r[20], r[21]) for r in again] == [(r.rule_id, r.subject, r.action, r.verdict, r.verdict_strict) for r in rows]


@pytest.mark.parametrize(
    "old, new, want",
    [
        ("[0-9]+", "[0-9a-z]+", "relaxed"), ("[0-9a-z]+", "[0-9]+", "narrowed"), ("a|b", "[ab]", "equivalent"), ("a*", "b*", "incomparable"), ("(ab){2,3}", "(ab)*", "relaxed"),
        (r"\d{3}", "[0-9][0-9][0-9]", "equivalent"), ("[^a]", "[^ab]", "narrowed"), (".*", "[a-z]*", "narrowed"), (r"(a)\1", "a", "error"), ("a{1,9999}", "a", "error"), ("x?y?", "y", "narrowed"), ("[", "a", "error"),
    ],
)
def test_regex_inclusion(old, new, want):
    assert regex_inclusion.compare(old, new) == want


def test_regex_inclusion_against_strings():
    import itertools
    import re

    patterns = ["a*b", "a+b?", "(a|b)*", "ab|ba", "a{0,2}", "[ab]{1,2}", "b(ab)*", ""]
    words = ["".join(w) for n in range(7) for w in itertools.product("ab", repeat=n)]
    for x, y in itertools.product(patterns, patterns):
        a, b = ({w for w in words if re.fullmatch(p, w)} for p in (x, y))
        want = "equivalent" if a == b else "relaxed" if a < b else "narrowed" if b < a else "incomparable"
        assert regex_inclusion.compare(x, y) == want, (x, y)


@pytest.mark.parametrize(
    "old, new, want",
    [
        ("../a = 'x'", "../a = 'x' or ../a = 'y'", "relaxed"), ("../a = 'x' and ../b", "../a = 'x'", "relaxed"), ("../n > 5", "../n >= 5", "relaxed"), ("../n > 5", "../n > 9", "narrowed"),
        ("not(../a = 'x')", "not(../a = 'x' or ../a = 'y')", "narrowed"), ("p:a = 'p:x'", "q:a = 'q:x'", "equivalent"), (None, "../a", "narrowed"), ("../a", None, "relaxed"), ("../a", "../a[b]", "narrowed"),
        ("5 < ../n", "../n > 5", "equivalent"), ("../a = '3'", "../a > 1", "relaxed"), ("(../a or ../b) and ../c", "../c and (../b or ../a)", "equivalent"), ("../a and ../b", "../a or ../b", "relaxed"), ("../a or ../b", "../b and ../a", "narrowed"), ("../n > 5", "../n != 3", "relaxed"), ("../n != 3", "../n < 3", "narrowed"), ("../n > 5", "../n != 7", "incomparable"),
        ("../a = 'x' and ../n > 5", "../a = 'x' or ../a = 'y'", "relaxed"), ("../a and ../n > 9", "../n > 5 and ../a", "relaxed"), ("(../a and ../b) or (../a and ../c)", "../a", "relaxed"), ("../a[x[y]]", "../a[x]", "incomparable"), ("../a[x = ']']", "../a", "relaxed"), ("../a = 'x'", "../b = 'x'", "incomparable"),
    ],
)
def test_conditions(old, new, want):
    assert conditions.change(old, new) == want


def test_value_spaces():
    d = types.describe
    of = lambda a, b, strict=False: types.superset(d(a), d(b), strict)
    assert of({"name": "int8"}, {"name": "int16"}) and not of({"name": "int32"}, {"name": "int8"})
    assert of({"name": "uint8", "range": "1..4 | 6"}, {"name": "int16", "range": "min..6"}) and not of({"name": "int8"}, {"name": "string"})
    assert of({"name": "leafref", "path": "a"}, {"name": "string"}) and of({"name": "enumeration", "enum": ["a"]}, {"name": "enumeration", "enum": ["a", "b"]})
    assert not of({"name": "bits", "bit": {"a": 0}}, {"name": "bits", "bit": {"a": 1}})
    union = lambda *m: {"name": "union", "members": [{"name": x} for x in m]}
    assert of(union("int8"), union("int16", "string")) and not of(union("int8"), union("int16", "string"), True) and of({"name": "int8"}, union("string", "int16"))
    assert of({"name": "my"}, {"name": "your"}) is None and of({"name": "string", "pattern": ["a"]}, {"name": "string", "pattern": ["a|b"]})
    small = types.describe({"name": "small", "range": "1..5"}, {"small": {"name": "int32", "range": "0..10"}}.get)
    assert small["kind"] == "integer" and types.superset(small, d({"name": "uint8"})) and not types.superset(d({"name": "uint8"}), small)


def change_of_types(spark, old, new, body='leaf a {{ type {}; }}'):
    """change of the leaf's type name between two versions, each with its own definitions."""
    from pyspark.sql import functions as F

    def nodes(defs, name):
        text = "module m { prefix m; import other { prefix o; } " + defs + " container c { " + body.format(name) + " } }"
        other = "module other { prefix x; typedef far { type m2; } typedef m2 { type int32 { range \"0..9\"; } } identity base; identity sub { base base; } identity subsub { base x:sub; } }"
        return schema_diff.nodes_of(spark.createDataFrame([("m.yang", text), ("other.yang", other)], "file string, text string"))

    changes = schema_diff.node_changes(nodes(*old), nodes(*new))
    rows = changes.where("norm_path = 'c/a/type' and action = 'changed'")
    return [r.change for r in rows.select(types.type_change(F.col("old.type_json"), F.col("new.type_json"), old_defs=F.col("old.defs"), new_defs=F.col("new.defs")).alias("change")).collect()]


def test_types_are_compared_with_their_definitions(spark):
    t = "typedef t { type int16 { range \"1..5\"; } } typedef u { type t { range \"2..3\"; } } typedef e { type enumeration { enum a; enum b; } } typedef w { type union { type u; type string; } } typedef loop { type loop; }"
    wide = t.replace("1..5", "1..500")
    assert change_of_types(spark, (t, "u"), (t, "t")) == ["relaxed"]
    assert change_of_types(spark, (t, "m:t"), (t, "u")) == ["narrowed"]
    assert change_of_types(spark, (t, "t"), (wide, "int16")) == ["relaxed"]
    assert change_of_types(spark, (t, "u"), (t, "w")) == ["relaxed"]
    assert change_of_types(spark, (t, "o:far"), (t, "uint8")) == ["relaxed"]
    assert change_of_types(spark, (t, "uint8"), (t, "o:far")) == ["narrowed"]
    assert change_of_types(spark, (t, "e"), (t, "string")) == ["relaxed"]
    assert change_of_types(spark, (t, "loop"), (t, "string")) == ["unknown"]
    assert change_of_types(spark, (t, "identityref { base o:base; }"), (t, "string")) == ["relaxed"]
