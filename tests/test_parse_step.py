"""The parse step reads whole statements at once; only what is asked for leaves it."""

import pytest

from tessera.plans import modules
from tessera.sources import yang


def test_whole_statements_are_not_read_token_by_token(monkeypatch):
    text = 'module m { // note\n prefix p; description\n  "a\n   b" + \'c\'; leaf x { type p:t { range "1..2"; } } /* x { */ identity i; }'
    by_token = yang._events_of_tokens(text)
    monkeypatch.setattr(yang, "tokens", lambda t: pytest.fail("read token by token"))
    assert yang._events(text) == by_token
    for pattern in (modules._MAIN, modules._USER, modules._AIMED, *modules._BROKEN):
        assert yang.parse(pattern)


@pytest.mark.parametrize("text", ["leaf x", "a b c;", "{ leaf x; } ;", 'a + "b" "c";', "leaf x { type 'open", "a /* open", '"k" v;', "a; } } b {", 'a "b" + c;', "a+\"b\" + 'c';"])
def test_other_texts_have_the_same_events(text):
    assert yang._events(text) == yang._events_of_tokens(text)


def test_only_what_is_named_leaves_the_parser(spark):
    files = spark.createDataFrame([("a.yang", "module m { leaf x { type int8; default 3; } }"), ("b.yang", " " * (9 << 20)), ("c.yang", "")], "file string, text string").coalesce(1)
    found = yang.nodes(files, ("leaf",), ("path", "type_name"))
    assert found.columns == ["path", "type_name"] and [tuple(r) for r in found.collect()] == [("m/x", "int8")]
    stmts = yang.statements(files, yang.EXPRESSIONS, ("file", "keyword", "arg"))
    assert [tuple(r) for r in stmts.collect()] == [("a.yang", "default", "3")]
    assert yang.nodes(files).count() == 3 and yang.statements(files).count() == 4
