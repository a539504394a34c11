"""The schema operators over modules made from the driver's tables, with their SQL.

Each part is a module, with a second one that uses its grouping, a third one that
augments and deviates it, and a chain of submodules; key, size and brand of the part are
in its text. The texts are parsed like any file; the SQL gives the rows straight from the
table, so the two meet only in the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import model
from tessera.functions import conditions, text, types, xpath
from tessera.operators import aligned, diff, graph, matching, report, retrieval, rules
from tessera.plans import retriever, schema_diff, verify
from tessera.plans.generic import query
from tessera.session import spread, stored
from tessera.sources import loaders, reports, rules_xml, yang
from tessera.sources.tables import table

_MAIN = """module m@ {
  namespace "urn:m@"; prefix p@;
  import base { prefix b; }
  typedef t@ { type uint8 { range "0..~"; } }
  identity root@;
  identity leafy@ { base root@; }
  grouping g@ {
    leaf x { type p@:t@; description "^"; }
    container in { leaf y { type string { length "1..~"; pattern "[a-z]+"; } mandatory true; } }
  }
  container top@ {
    uses g@;
    list row { key "id"; leaf id { type int32; } max-elements ~; }
    leaf state { type enumeration { enum up { value 1; } enum down { value 2; } } when "../x > ~"; }
    leaf either { type union { type int8; type string; } }
    b:wrap w@ { leaf inner { type binary; } }
  }
}
"""
_USER = 'module n@ { prefix q; import m@ { prefix o; } grouping g@ { leaf other { type int8; } } container c@ { uses o:g@; uses q:g@; } }'
_AIMED = """module d@ { prefix d; import m@ { prefix o; }
  augment "/o:top@" { leaf more { type int8; } }
  deviation "/o:top@/o:in/o:y" { deviate not-supported; }
  deviation "/o:top@/o:row" { deviate replace { max-elements 77; } }
  deviation "/o:top@/o:state" { deviate add { default "up"; } deviate delete { when "../x > ~"; } }
}"""
_BASE = "module base { prefix b; extension wrap { argument name; } }"


def _fill(pattern: str | Column) -> Column:
    """The pattern with the part's key, size and brand."""
    out: Column = F.lit(pattern)
    for mark, c in (("@", "p_partkey"), ("~", "p_size"), ("^", "p_brand")):
        out = F.replace(out, F.lit(mark), F.col(c).cast("string"))
    return out


def _parts(spark, d) -> DataFrame:
    """What the texts are made of, dealt out: a row here is a text to parse."""
    return spread(table(spark, d, "part").select("p_partkey", "p_size", "p_brand"))


def _files(spark, d, /, **patterns: str) -> DataFrame:
    """(file, text) of a module a part and pattern, and the base module."""
    part = _parts(spark, d)
    each = F.explode(F.array(*[F.struct(F.concat(F.lit(name), F.col("p_partkey").cast("string"), F.lit(".yang")).alias("file"), _fill(p).alias("text")) for name, p in patterns.items()])).alias("f")
    return part.select(each).select("f.*").unionByName(spark.createDataFrame([("base.yang", _BASE)], "file string, text string"))


def _one_of(spark, d, patterns: list[str]) -> DataFrame:
    """(file, text) of a module a part: of the patterns, that which its key picks."""
    case = (F.abs("p_partkey") % len(patterns)).cast("int")
    file = F.concat(F.lit("m"), case.cast("string"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".yang"))
    return _parts(spark, d).select(file.alias("file"), _fill(F.get(F.array(*map(F.lit, patterns)), case)).alias("text"))


def _at(column: str) -> str:
    """SQL for a column of patterns, filled."""
    return f"replace(replace(replace({column}, '@', p_partkey::VARCHAR), '~', p_size::VARCHAR), '^', p_brand)"


# --- scans ---------------------------------------------------------------------

_NODES = """('m@', 'module', 'm@', NULL, 1), ('m@/urn:m@', 'namespace', 'urn:m@', NULL, 2), ('m@/base', 'import', 'base', NULL, 3), ('m@/t@', 'typedef', 't@', 'uint8', 4), ('m@/t@/type', 'type', 'uint8', 'uint8', 4),
('m@/root@', 'identity', 'root@', NULL, 5), ('m@/leafy@', 'identity', 'leafy@', NULL, 6), ('m@/g@', 'grouping', 'g@', NULL, 7), ('m@/g@/x', 'leaf', 'x', 'p@:t@', 8), ('m@/g@/x/type', 'type', 'p@:t@', 'p@:t@', 8),
('m@/g@/in', 'container', 'in', NULL, 9), ('m@/g@/in/y', 'leaf', 'y', 'string', 9), ('m@/g@/in/y/type', 'type', 'string', 'string', 9), ('m@/top@', 'container', 'top@', NULL, 11), ('m@/top@/g@', 'uses', 'g@', NULL, 12),
('m@/top@/row', 'list', 'row', NULL, 13), ('m@/top@/row/id', 'leaf', 'id', 'int32', 13), ('m@/top@/row/id/type', 'type', 'int32', 'int32', 13), ('m@/top@/state', 'leaf', 'state', 'enumeration', 14), ('m@/top@/state/type', 'type', 'enumeration', 'enumeration', 14),
('m@/top@/state/type/up', 'enum', 'up', NULL, 14), ('m@/top@/state/type/down', 'enum', 'down', NULL, 14), ('m@/top@/either', 'leaf', 'either', 'union', 15), ('m@/top@/either/type', 'type', 'union', 'union', 15),
('m@/top@/either/type/int8', 'type', 'int8', 'int8', 15), ('m@/top@/either/type/string', 'type', 'string', 'string', 15), ('m@/top@/w@', 'b:wrap', 'w@', NULL, 16), ('m@/top@/w@/inner', 'leaf', 'inner', 'binary', 16), ('m@/top@/w@/inner/type', 'type', 'binary', 'binary', 16)"""


@query(f"SELECT {_at('path')} AS path, keyword, {_at('name')} AS name, {_at('kind')} AS type_name, line FROM part, (VALUES {_NODES}) v(path, keyword, name, kind, line)")
def module_nodes(spark, d):
    return yang.nodes(_files(spark, d, m=_MAIN)).where("module <> 'base'").select("path", "keyword", "name", "type_name", "line")


_WORDS = """('module', 1, 1), ('namespace', 1, 2), ('prefix', 2, 5), ('import', 1, 3), ('typedef', 1, 4), ('type', 9, 109), ('range', 1, 4), ('identity', 2, 11), ('base', 1, 6), ('grouping', 1, 7), ('leaf', 6, 75), ('description', 1, 8), ('container', 2, 20),
('length', 1, 9), ('pattern', 1, 9), ('mandatory', 1, 9), ('uses', 1, 12), ('list', 1, 13), ('key', 1, 13), ('max-elements', 1, 13), ('enum', 2, 28), ('value', 2, 28), ('when', 1, 14), ('wrap', 1, 16)"""


@query(f"SELECT 'm' || p_partkey || '.yang' AS file, keyword, n::BIGINT AS n, lines::BIGINT AS lines FROM part, (VALUES {_WORDS}) v(keyword, n, lines)")
def module_statements(spark, d):
    s = yang.statements(_files(spark, d, m=_MAIN)).where("file <> 'base.yang'")
    return s.groupBy("file", "keyword").agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("lines"))


@query(f"SELECT 'm' || p_partkey || '.yang' AS file, CASE keyword WHEN 'wrap' THEN 'b:wrap' ELSE keyword END AS keyword, n::BIGINT AS n FROM part, (VALUES {_WORDS}) v(keyword, n, lines)")
def module_pattern_scan(spark, d):
    return yang.scan(_files(spark, d, m=_MAIN)).where("file <> 'base.yang'").groupBy("file", "keyword").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 's' || p_partkey || '.yang' AS file, 'submodule' AS kind, 's' || p_partkey AS name, 'm' || p_partkey AS belongs_to FROM part
UNION ALL SELECT 'm' || p_partkey || '.yang', 'module', 'm' || p_partkey, NULL FROM part UNION ALL SELECT 'base.yang', 'module', 'base', NULL"""
)
def module_outline(spark, d):
    return yang.outline(_files(spark, d, m=_MAIN, s="// submodule no { }\nsubmodule s@ { belongs-to m@ { prefix p; } /* module x { */ leaf l { type string; } }"))


@query(
    """SELECT 's' || p_partkey || '-' || c AS child, 's' || p_partkey || '-' || a AS ancestor, (a - c)::INTEGER AS depth FROM part, range(0, 4) x(c), range(0, 5) y(a) WHERE a > c"""
)
def module_includes(spark, d):
    chain = {f"s{i}-": f"module s@-{i} {{ prefix s; {f'include s@-{i + 1};' if i < 4 else ''} }}" for i in range(5)}
    return yang.module_closure(yang.statements(_files(spark, d, **chain))).select("child", "ancestor", "depth")


@query(
    """SELECT 'm' || p_partkey || '.yang' AS file, 'p' || p_partkey || ':t' || p_partkey AS name, 'm' || p_partkey AS name_module FROM part
UNION ALL SELECT 'n' || p_partkey || '.yang', 'o:g' || p_partkey, 'm' || p_partkey FROM part UNION ALL SELECT 'n' || p_partkey || '.yang', 'q:g' || p_partkey, 'n' || p_partkey FROM part"""
)
def module_prefixes(spark, d):
    s = stored(yang.statements(_files(spark, d, m=_MAIN, n=_USER)))
    names = s.where("keyword in ('type', 'uses') and arg like '%:%'").select("file", F.col("arg").alias("name"))
    return yang.resolve_prefixes(names, yang.prefixes(s), "name")


@query(
    """SELECT 'm' || p_partkey AS module, 'typedef' AS kind, 't' || p_partkey AS name, 'uint8' AS base FROM part UNION ALL SELECT 'm' || p_partkey, 'identity', 'root' || p_partkey, NULL FROM part
UNION ALL SELECT 'm' || p_partkey, 'identity', 'leafy' || p_partkey, 'root' || p_partkey FROM part"""
)
def module_definitions(spark, d):
    s = stored(yang.statements(_files(spark, d, m=_MAIN)))
    kind = lambda df, k: df.select("module", F.lit(k).alias("kind"), "name", "base")
    return kind(yang.typedefs(s), "typedef").unionByName(kind(yang.identities(s), "identity"))


@query(
    """SELECT 'm' || p_partkey || ':t' || p_partkey AS name, '{"name": "uint8", "range": "0..' || p_size || '", "pattern": []}' AS json, 0::INTEGER AS refs FROM part
UNION ALL SELECT 'identity m' || p_partkey || ':root' || p_partkey, '["m' || p_partkey || ':leafy' || p_partkey || '"]', 0 FROM part"""
)
def definition_registry(spark, d):
    return yang.definitions(stored(yang.nodes(_files(spark, d, m=_MAIN)))).select("name", "json", F.size("refs").alias("refs"))


_TOKEN_SQL = r"""\"[^\"]*\"|'[^']*'|[^\s{};\"']+\.\.[^\s{};\"']+|[^\s{};\"']+|[{};]""".replace("'", "''")
_WORD_LIST = ", ".join(f"'{w}'" for w in (*model.STRUCTURAL, *model.CONSTRAINT, *model.ATTRIBUTE))
_in = lambda words: ", ".join(f"'{w}'" for w in words)
_MASKED_SQL = f"""WITH t AS (SELECT p_partkey, unnest(range(len(x))) AS i, unnest(x) AS tok FROM (SELECT p_partkey, regexp_extract_all({_at("'" + _MAIN.replace("'", "''") + "'")}, '{_TOKEN_SQL}') AS x FROM part)),
p AS (SELECT *, coalesce(lag(tok) OVER (PARTITION BY p_partkey ORDER BY i), '{{') AS before FROM t),
v AS (SELECT *, regexp_replace(before, '^[^:]*:', '') AS k, CASE WHEN regexp_matches(tok, '^"(.|\n)*"$') THEN tok[2:len(tok) - 1] ELSE tok END AS v FROM p),
m AS (SELECT p_partkey, CASE WHEN tok IN ('{{', '}}', ';') THEN tok WHEN before IN ('{{', '}}', ';') THEN CASE WHEN i = 0 OR regexp_replace(tok, '^[^:]*:', '') IN ({_WORD_LIST}) THEN tok ELSE regexp_replace(tok, '^[^:]*:', '') END
  WHEN k = 'type' AND v IN ({_in(model.BUILTIN)}) THEN v WHEN k = 'type' AND (contains(v, ':') OR v = 't' || p_partkey) THEN '<TYPEDEF>' WHEN k IN ({_in(text.NAMED)}) THEN '<IDENTIFIER>' WHEN k IN ({_in(text.CONDITIONS)}) THEN '<CONDITION>'
  WHEN k = 'pattern' THEN '<REGEX>' WHEN k IN ({_in(text.BOOLEAN)}) AND v IN ('true', 'false') THEN '<BOOLEAN>' WHEN k IN ('range', 'length') THEN CASE WHEN contains(v, '..') OR contains(v, '|') THEN '<RANGE>' ELSE '<NUMBER>' END
  WHEN k IN ({_in(text.NUMERIC)}) THEN '<NUMBER>' WHEN k IN ('key', 'unique') THEN CASE WHEN contains(trim(v), ' ') THEN '<LIST>' ELSE '<IDENTIFIER>' END
  WHEN k = 'namespace' OR contains(trim(v), ' ') OR contains(v, '#') THEN '<STRING>' ELSE '<IDENTIFIER>' END AS mask FROM v)
SELECT p_partkey, mask, count(*) AS n FROM m GROUP BY 1, 2"""


@query(_MASKED_SQL)
def snippet_masks(spark, d):
    """Tokens of modules masked by the token before them: typedefs after type, conditions
    after when, numbers after their keywords, and names after what takes one."""
    part = _parts(spark, d)
    tokens = part.select("p_partkey", text.snippet_tokens(_fill(_MAIN)).alias("t"))
    words_ = (*model.STRUCTURAL, *model.CONSTRAINT, *model.ATTRIBUTE)
    own = F.array(F.concat(F.lit("t"), F.col("p_partkey").cast("string")))
    masks = tokens.select("p_partkey", F.explode(text.mask_snippet(F.col("t"), words_, own)).alias("mask"))
    return masks.groupBy("p_partkey", "mask").agg(F.count(F.lit(1)).alias("n"))


# --- joins of modules ------------------------------------------------------------

_LEAVES = """('m@/top@/x', 'p@:t@'), ('m@/top@/in/y', 'string'), ('m@/top@/row/id', 'int32'), ('m@/top@/state', 'enumeration'), ('m@/top@/either', 'union'), ('m@/top@/w@/inner', 'binary')"""


@query(f"SELECT {_at('path')} AS path, {_at('kind')} AS type_name FROM part, (VALUES {_LEAVES}, ('n@/c@/x', 'p@:t@'), ('n@/c@/in/y', 'string'), ('n@/c@/other', 'int8')) v(path, kind)")
def uses_expansion(spark, d):
    """Groupings of one name in two modules stay apart, and prefixes tell which is meant."""
    rows = yang.expand_uses(stored(yang.nodes(_files(spark, d, m=_MAIN, n=_USER))))
    return rows.where("keyword = 'leaf' and grouping is null").select("path", "type_name")


@query(
    """WITH r AS (SELECT p_partkey, 2000 + p_size % 20 + a AS year, (2000 + p_partkey % 40) || '-06-01' AS wanted FROM part, (VALUES (0), (5), (30)) v(a)),
c AS (SELECT p_partkey, coalesce(max(year) FILTER (WHERE year || '-01-01' <= wanted), min(year)) AS dated, max(year) AS newest FROM r GROUP BY p_partkey)
SELECT 'n' || p_partkey || '/c' || p_partkey || '/' || w || '/y' || CASE w WHEN 'dated' THEN dated ELSE newest END AS path, CASE WHEN w = 'dated' AND dated < newest THEN 'd:t' ELSE 't' END AS type_name FROM c, (VALUES ('dated'), ('newest')) v(w)"""
)
def import_revisions(spark, d):
    """What an import by date takes of a module in three revisions, as of that date, and what
    one without a date does, by way of a grouping of another module."""
    k, first = F.col("p_partkey"), F.lit(2000) + F.col("p_size") % 20
    part = _parts(spark, d)

    def texts(mark: str, pattern: str, **values: Column) -> DataFrame:
        text_ = _fill(pattern)
        for name, value in values.items():
            text_ = F.replace(text_, F.lit(f"<{name}>"), value.cast("string"))
        return part.select(F.concat(F.lit(mark), k.cast("string"), F.lit(".yang")).alias("file"), text_.alias("text"))

    files = texts("n", "module n@ { prefix d; import a@ { prefix x; revision-date <want>-06-01; } import b@ { prefix y; } container c@ { container dated { uses x:g; } container newest { uses y:h; } } }", want=F.lit(2000) + k % 40)
    files = files.unionByName(texts("b", "module b@ { prefix b; import a@ { prefix d; } grouping h { uses d:g; } }"))
    for after in (0, 5, 30):
        name = "d:t" if after < 30 else "t"
        files = files.unionByName(texts(f"a{after}-", f"module a@ {{ prefix d; revision <year>-01-01; typedef t {{ type int8; }} grouping g {{ leaf y<year> {{ type {name}; }} }} }}", year=first + after))
    return schema_diff.nodes_of(files).where("keyword = 'leaf' and path like 'n%'").select("path", "type_name")


#: A module and three broken forms of it: a brace too few, where layout or a statement of modules ends the block, and one too many.
_BROKEN = [
    "module m@ {\n  container a@ {\n    leaf x { type int8; }\n  }\n  identity i;\n  container b@ { leaf y { type t~; } }\n}\n",
    "module m@ {\n  container a@ {\n    leaf x { type int8; }\n  identity i;\n  container b@ { leaf y { type t~; } }\n}\n",
    "module m@ { container a@ { leaf x { type int8; } identity i; container b@ { leaf y { type t~; } } }",
    "module m@ { container a@ { leaf x { type int8; } } } identity i; container b@ { leaf y { type t~; } } }",
]


@query(f"SELECT {_at('path')} AS path, keyword, {_at('t')} AS type_name FROM part, (VALUES ('m@/a@', 'container', NULL), ('m@/a@/x', 'leaf', 'int8'), ('m@/i', 'identity', NULL), ('m@/b@', 'container', NULL), ('m@/b@/y', 'leaf', 't~')) v(path, keyword, t)")
def module_recovery(spark, d):
    """A broken module has the nodes that it had whole."""
    return yang.nodes(_one_of(spark, d, _BROKEN), ("container", "leaf", "identity"), ("path", "keyword", "type_name"))


@query(f"SELECT {_at('g')} AS grouping, {_at('a')} AS at FROM part, (VALUES ('m@:g@', 'm@/top@'), ('m@:g@', 'n@/c@'), ('n@:g@', 'n@/c@')) v(g, a)")
def grouping_contexts(spark, d):
    return yang.grouping_contexts(stored(yang.nodes(_files(spark, d, m=_MAIN, n=_USER))))


@query(
    f"""SELECT {_at('path')} AS path, {_at('v')} AS props FROM part, (VALUES ('m@/top@/row', 'key=id;max-elements=77;name=row'), ('m@/top@/state', 'default=up;name=state'), ('m@/top@/x', 'description=^;name=x'), ('d@/o:top@/more', 'name=more')) v(path, v)
UNION ALL SELECT {_at('path')}, 'name=' || n FROM part, (VALUES ('m@/top@/row/id', 'id'), ('m@/top@/either', 'either'), ('m@/top@/w@/inner', 'inner')) v(path, n)"""
)
def deviations_applied(spark, d):
    rows = yang.apply_deviations(yang.expand_uses(stored(yang.nodes(_files(spark, d, m=_MAIN, d=_AIMED))))).where("keyword in ('leaf', 'list') and grouping is null")
    return rows.select("path", F.array_join(F.array_sort(F.transform("props", lambda p: F.concat_ws("=", p["field"], p["value"]))), ";").alias("props"))


@query(
    """SELECT 'f' || p_partkey || '.yang' AS file, (2 + p_partkey % 4)::INTEGER AS line, CASE p_partkey % 4 WHEN 0 THEN 'type-not-found' WHEN 1 THEN 'uses-not-found' WHEN 2 THEN 'base-not-found' ELSE 'prefix-not-found' END AS code FROM part
UNION ALL SELECT 'f' || p_partkey || '.yang', (2 + p_partkey % 4)::INTEGER, CASE p_partkey % 4 WHEN 0 THEN 'type-not-found' WHEN 1 THEN 'uses-not-found' WHEN 2 THEN 'base-not-found' END FROM part WHERE p_partkey % 4 < 3"""
)
def module_diagnostics(spark, d):
    """Each module has a statement that names what nothing defines and one that names what
    only another module defines, on a line of their own; those that ask the other module,
    or name its own, are fine."""
    lines = ["leaf a { type lost@; } leaf b { type far@; } leaf c { type o:far@; } leaf d { type f:own@; }", "uses lost@; uses far@; uses o:far@; uses f:own@;", "identity i { base lost@; base far@; base o:far@; base f:own@; }", "zz:note 1;"]
    head = "module f@ { prefix f; import x@ { prefix o; } typedef own@ { type int8; } grouping own@ { } identity own@;\n"
    texts = {f"f{i}-": head + "\n" * i + lines[i] + "\n}" for i in range(4)} | {"x": "module x@ { prefix x; typedef far@ { type int8; } grouping far@ { } identity far@; }"}
    mine = F.regexp_extract("file", "-([0-9]+)", 1).try_cast("long") % 4
    every = _files(spark, d, **texts).where(~F.col("file").startswith("f") | (F.regexp_extract("file", "f([0-9])-", 1) == mine.cast("string")))
    out = yang.diagnostics(stored(yang.statements(every)))
    return out.select(F.regexp_replace("file", "^f[0-9]-", "f").alias("file"), "line", "code")


_REFINING = """module r@ { prefix p;
  grouping low@ { leaf x { type int8; default 1; description "low"; must "../y"; } container box { leaf y { type string; } } }
  grouping mid@ { container k { uses low@ { refine x { default 2; mandatory true; must "../z"; } augment box { leaf z { type int8; } } } } }
  container a@ { uses mid@ { refine "p:k/p:x" { default ~; } refine k/box { presence "^"; } } }
  container b@ { uses p:mid@; }
  container c@ { uses low@; uses other:none { refine x { default 9; } } }
}"""
_REFINED = """('r@/a@/k/x', 'default=~;description=low;mandatory=true;must=../y;must=../z;name=x'), ('r@/a@/k/box', 'name=box;presence=^'), ('r@/a@/k/box/y', 'name=y'), ('r@/a@/k/box/z', 'name=z'), ('r@/a@/k', 'name=k'), ('r@/a@', 'name=a@'),
('r@/b@/k/x', 'default=2;description=low;mandatory=true;must=../y;must=../z;name=x'), ('r@/b@/k/box', 'name=box'), ('r@/b@/k/box/y', 'name=y'), ('r@/b@/k/box/z', 'name=z'), ('r@/b@/k', 'name=k'), ('r@/b@', 'name=b@'),
('r@/c@/x', 'default=9;description=low;must=../y;name=x'), ('r@/c@/box', 'name=box'), ('r@/c@/box/y', 'name=y'), ('r@/c@', 'name=c@')"""


@query(f"SELECT {_at('path')} AS path, {_at('v')} AS props FROM part, (VALUES {_REFINED}) v(path, v)")
def uses_refined(spark, d):
    """A leaf that two nested uses refine takes the inner one's values, then the outer's;
    what an augment below a use adds is at its target."""
    rows = yang.expand_uses(stored(yang.nodes(_files(spark, d, r=_REFINING)))).where("keyword in ('leaf', 'container') and grouping is null")
    return rows.select("path", F.array_join(F.array_sort(F.transform("props", lambda p: F.concat_ws("=", p["field"], p["value"]))), ";").alias("props"))


@query(
    """SELECT 'n' || p_partkey AS module, 'g' || p_partkey AS grouping, 2::BIGINT AS n, sha1(array_to_string(['leaf other int8', 'type other/type int8'], chr(10))) AS signature FROM part
UNION ALL SELECT 'm' || p_partkey, 'g' || p_partkey, 5, sha1(array_to_string(['container in ', 'leaf in/y string', 'leaf x p' || p_partkey || ':t' || p_partkey, 'type in/y/type string', 'type x/type p' || p_partkey || ':t' || p_partkey], chr(10))) FROM part"""
)
def grouping_signature(spark, d):
    """Groupings of one name in two modules have signatures of their own."""
    return yang.uses_signature(yang.nodes(_files(spark, d, m=_MAIN, n=_USER)))


@query("SELECT 'm' || p_partkey || '.yang' AS file, 42::BIGINT AS vertices, 41::BIGINT AS edges, 21::BIGINT AS leaves FROM part")
def statement_graph(spark, d):
    vertices, edges = yang.statement_graph(stored(yang.statements(_files(spark, d, m=_MAIN)).where("file <> 'base.yang'")))
    file = lambda c: F.regexp_extract(c, "^([^#]*)#", 1).alias("file")
    v, e = vertices.groupBy(file("node_id")).agg(F.count(F.lit(1)).alias("vertices")), edges.groupBy(file("source")).agg(F.count(F.lit(1)).alias("edges"))
    low = vertices.join(edges.select(F.col("source").alias("node_id")).distinct(), "node_id", "left_anti").groupBy(file("node_id")).agg(F.count(F.lit(1)).alias("leaves"))
    return v.join(e, "file").join(low, "file")


@query("SELECT 'm' || p_partkey || '.yang' AS file, keyword, left(sha1(e), 12) AS fingerprint FROM part, (VALUES ('pattern', '[a-z]+'), ('when', '../x > ')) v(keyword, t), LATERAL (SELECT CASE keyword WHEN 'when' THEN t || p_size ELSE t END) w(e)")
def expression_fingerprints(spark, d):
    stmts = yang.statements(_files(spark, d, m=_MAIN), yang.EXPRESSIONS, ("file", "stmt_id", "keyword", "arg"))
    return yang.fingerprints(stmts).select("file", "keyword", "fingerprint")


# --- comparison ------------------------------------------------------------------

#: A small rule file of the same form as any other.
RULES = """<rules>
<rule><rule-id>node-added</rule-id><structurals><structural>leaf</structural><structural>enum</structural><structural>type</structural></structurals><actions><action>added</action></actions><compatible>backward-compatible</compatible></rule>
<rule><rule-id>node-deleted</rule-id><structurals><structural>leaf</structural><structural>enum</structural><structural>type</structural></structurals><actions><action>deleted</action></actions><compatible>non-backward-compatible</compatible></rule>
<rule><rule-id>node-changed</rule-id><structurals><structural>leaf</structural><structural>list</structural><structural>type</structural></structurals><actions><action>changed</action></actions><compatible>conditional-backward-compatible</compatible></rule>
<rule><rule-id>same-type</rule-id><attributes><attribute parent="type" identical="true">name</attribute></attributes><actions><action>changed</action></actions><compatible>backward-compatible</compatible></rule>
<rule><rule-id>wider-type</rule-id><attributes><attribute parent="type" relaxed="true">name</attribute></attributes><actions><action>changed</action></actions><compatible>backward-compatible</compatible><compatible flag="rfc7950">non-backward-compatible</compatible></rule>
<rule><rule-id>other-type</rule-id><attributes><attribute parent="type" relaxed="false">name</attribute></attributes><actions><action>changed</action></actions><compatible>non-backward-compatible</compatible></rule>
<rule><rule-id>relaxed</rule-id><constraints><constraint type="numbers" relaxed="true">range</constraint><constraint type="number" relaxed="true">max-elements</constraint><constraint type="regex" relaxed="true">pattern</constraint><constraint type="condition" relaxed="true" assistance="true">when</constraint></constraints><actions><action>changed</action></actions><compatible>backward-compatible</compatible></rule>
<rule><rule-id>narrowed</rule-id><constraints><constraint type="numbers" relaxed="false">range</constraint><constraint type="number" relaxed="false">max-elements</constraint><constraint type="regex" relaxed="false">pattern</constraint><constraint type="condition" relaxed="false" assistance="true">when</constraint></constraints><actions><action>changed</action></actions><compatible>non-backward-compatible</compatible></rule>
</rules>"""


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    """All modules in an old version, with a leaf more in some, and in a new one."""
    k = F.col("p_partkey")
    part = _parts(spark, d)
    gone = F.when(k % 7 == 0, " leaf gone { type string; }").otherwise("")
    old = F.replace(_fill(_MAIN), F.lit("b:wrap"), F.concat(gone, F.lit(" b:wrap")))
    new = _fill(_MAIN)
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    swap = lambda c, a, b, when: F.replace(c, as_column(a), F.when(when, as_column(b)).otherwise(as_column(a)))
    size = lambda pattern, n: F.replace(F.lit(pattern), F.lit("~"), n.cast("string"))
    z = F.col("p_size")
    new = swap(new, size('"0..~"', z), size('"0..~"', z + k % 3 - 1), F.lit(True))
    new = swap(new, size("max-elements ~", z), size("max-elements ~", z + k % 2), F.lit(True))
    new = swap(new, "value 2; }", "value 2; } enum mid { value 3; }", k % 2 == 0)
    new = swap(new, "type int8; type string;", "type int8; type string; type binary;", k % 5 == 0)
    new = swap(new, "type int32", "type int64", k % 4 == 0)
    new = swap(new, "type int32", F.concat(F.lit("type p"), k.cast("string"), F.lit(":t"), k.cast("string")), k % 4 == 1)
    new = swap(new, "[a-z]+", "[a-z0-9]+", k % 3 == 0)
    new = swap(new, "../x >", "../x >=", k % 6 == 0)
    new = swap(new, size("../x > ~", z), size("../x > ~", z + 1), k % 6 == 1)
    new = swap(new, "inner { type binary", "inner { type string", k % 8 == 0)
    base = spark.createDataFrame([("base.yang", _BASE)], "file string, text string")
    named = lambda c: part.select(F.concat(F.lit("m"), k.cast("string"), F.lit(".yang")).alias("file"), c.alias("text")).unionByName(base)
    return named(old), named(new)


def _comparison(spark, d, mode: str = "default") -> schema_diff.Comparison:
    rules = spark.createDataFrame(rules_xml.rule_rows(RULES), rules_xml.RULES)
    return schema_diff.compare_files(*_versions(spark, d), rules, mode)


_FINE, _BREAK = "backward-compatible", "non-backward-compatible"
_DETAILS = f"""SELECT path, field, change, CASE WHEN change = 'narrowed' THEN '{_BREAK}' WHEN field = 'name' THEN '{{0}}' ELSE '{_FINE}' END AS verdict FROM (
SELECT 't' || p_partkey || '/type' AS path, 'range' AS field, CASE p_partkey % 3 WHEN 0 THEN 'narrowed' ELSE 'relaxed' END AS change FROM part WHERE p_partkey % 3 <> 1
UNION ALL SELECT 'top' || p_partkey || '/row', 'max-elements', 'relaxed' FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT 'top' || p_partkey || '/row/id/type', 'name', CASE p_partkey % 4 WHEN 0 THEN 'relaxed' ELSE 'narrowed' END FROM part WHERE p_partkey % 4 < 2
UNION ALL SELECT w || p_partkey || '/in/y/type', 'pattern', 'relaxed' FROM part, (VALUES ('g'), ('top')) v(w) WHERE p_partkey % 3 = 0
UNION ALL SELECT 'top' || p_partkey || '/state', 'when', CASE p_partkey % 6 WHEN 0 THEN 'relaxed' ELSE 'narrowed' END FROM part WHERE p_partkey % 6 < 2
UNION ALL SELECT 'top' || p_partkey || '/w' || p_partkey || '/inner/type', 'name', 'narrowed' FROM part WHERE p_partkey % 8 = 0)"""


def _details_of(c: schema_diff.Comparison) -> DataFrame:
    changed = c.changes.where("action = 'changed'").select("change_id", F.col("norm_path").alias("path"))
    return c.details.join(changed, "change_id").select("path", F.col("subject").alias("field"), "change", "verdict")


@query(_DETAILS.format(_FINE))
def schema_details(spark, d):
    return _details_of(_comparison(spark, d))


@query(_DETAILS.format(_BREAK))
def schema_details_strict(spark, d):
    return _details_of(_comparison(spark, d, "rfc7950"))


_SECTIONS = f"""SELECT path, 'changed' AS action, CASE WHEN bool_or(verdict = '{_BREAK}') THEN 'non_compatible' ELSE 'compatible' END AS section FROM ({_DETAILS.format(_FINE)}) GROUP BY path
UNION ALL SELECT 'top' || p_partkey || '/state/type/mid', 'added', 'compatible' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'top' || p_partkey || '/either/type/binary', 'added', 'compatible' FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT 'top' || p_partkey || s, 'deleted', 'non_compatible' FROM part, (VALUES ('/gone'), ('/gone/type')) v(s) WHERE p_partkey % 7 = 0"""


@query(_SECTIONS)
def schema_sections(spark, d):
    return _comparison(spark, d).sections().select(F.col("norm_path").alias("path"), "action", "section")


#: Old and new statement, and its change, verdict and whether it needs a look.
_UNTOLD = [
    ("pattern '[a-z]{1,400}';", "pattern '[a-z]{1,401}';", "pattern", "error", "[UNMARKED]", True), ("pattern '[a-z]{1,~}';", "pattern '[a-z]{0,~}';", "pattern", "relaxed", _FINE, False), ("pattern '(a)\\1';", "pattern 'a';", "pattern", "error", "[UNMARKED]", True),
    ('when "../n > 5";', 'when "../n != ~0";', "when", "incomparable", _BREAK, True), ('when "../n > ~";', 'when "../n >= ~";', "when", "relaxed", _FINE, False), ('when "../n >= ~";', 'when "../n > ~";', "when", "narrowed", _BREAK, False),
]
_UNTOLD_SQL = ", ".join(f"({i}, '{'c/l/type' if f == 'pattern' else 'c'}', '{c}', '{v}', {str(n).lower()})" for i, (_, _, f, c, v, n) in enumerate(_UNTOLD))


@query(f"SELECT 'top' || p_partkey || '/' || path AS path, change, verdict, needs_analysis FROM part JOIN (VALUES {_UNTOLD_SQL}) v(i, path, change, verdict, needs_analysis) ON p_partkey % {len(_UNTOLD)} = i")
def schema_assistance(spark, d):
    """A direction that could not be told fits no rule for a direction, stays unmarked and
    needs a look; so does one that a rule asks help for where neither form implies the
    other; what is told does not."""
    case = (F.col("p_partkey") % len(_UNTOLD)).cast("int")
    part = _parts(spark, d)

    def version(side: int) -> DataFrame:
        own = F.get(F.array(*[F.lit(r[side]) for r in _UNTOLD]), case)
        pattern = F.get(F.array(*[F.lit(r[2] == "pattern") for r in _UNTOLD]), case)
        text_ = F.concat(F.lit("module m@ { prefix p; container top@ { leaf n { type int8; } container c { "), F.when(pattern, "").otherwise(own), F.lit(" leaf l { type string { "), F.when(pattern, own).otherwise(""), F.lit(" } } } } }"))
        for mark, c in (("@", "p_partkey"), ("~", "p_size")):
            text_ = F.replace(text_, F.lit(mark), F.col(c).cast("string"))
        return part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".yang")).alias("file"), text_.alias("text"))

    c = schema_diff.compare_files(version(0), version(1), spark.createDataFrame(rules_xml.rule_rows(RULES), rules_xml.RULES))
    changed = c.changes.where("action = 'changed'").select("change_id", F.col("norm_path").alias("path"))
    return c.details.join(changed, "change_id").select("path", "change", "verdict", "needs_analysis")


@query(
    f"""WITH s AS ({_SECTIONS}) SELECT section, action AS kind, path AS first, 1::INTEGER AS n FROM s WHERE path NOT LIKE '%/gone/type' AND path NOT LIKE '%/in/y/type'
UNION ALL SELECT section, action, replace(path, 'top', 'g'), 2 FROM s WHERE path LIKE 'top%/in/y/type'"""
)
def schema_report(spark, d):
    """The report after its passes: the grouping's change and its expansion are one row,
    what is below a deleted leaf goes."""
    return _comparison(spark, d).report().select("section", "kind", F.col("paths")[0].alias("first"), F.size("paths").alias("n"))


@query(
    """SELECT 'top' || p_partkey || '/a' AS path, CASE WHEN p_partkey % 2 = 0 THEN 'other-errors' ELSE 'unmarked' END AS section FROM part"""
)
def schema_missing_references(spark, d):
    """Changes whose statement names what no module defines are other errors."""
    body = "module m@ {{ prefix p; typedef known {{ type string; }}\n container top@ {{\n leaf a {{\n default \"{0}\"; type {1}; }} }} }}"
    old, new = _files(spark, d, m=body.format("1", "known")), _files(spark, d, m=body.format("2", "known"))
    broken = F.when(F.regexp_extract("file", "([0-9]+)", 1).try_cast("long") % 2 == 0, F.replace("text", F.lit(" leaf a {\n default"), F.lit(" leaf a { if-feature z; type lost; default"))).otherwise(F.col("text"))
    rules = spark.createDataFrame(rules_xml.rule_rows(RULES.replace(">leaf<", ">other<")), rules_xml.RULES)
    c = schema_diff.compare_files(old, new.withColumn("text", broken), rules)
    return c.sections().where("keyword = 'leaf'").select(F.col("norm_path").alias("path"), "section")


_BODY = 'leaf y { type string; description "^"; } container deep { leaf z { type int8; } }'
#: Old and new text of a container, by the part's key: a block put around, taken away, changed
#: for another, around a part of it with a change inside, and a statement that becomes a block.
_BLOCKS = [
    (_BODY, "b:wrap w@ { %s }" % _BODY), ("b:wrap w@ { %s }" % _BODY, _BODY), ("b:wrap w@ { %s }" % _BODY, "b:note v~ { %s }" % _BODY),
    (_BODY, "b:wrap w@ { b:note v~ { %s } }" % _BODY.replace("int8", "int16").replace('"^"', '"new"')), ("b:wrap w@; leaf y { type string; }", "b:wrap w@ { leaf y { type string; } }"), ("b:wrap w@ { leaf y { type string; } } leaf y { type int8; }", "b:note v~ { leaf y { type int8; } } leaf y { type string; }"),
]
_BLOCK_ROWS = """(0, 'w@', 'b:wrap', 'added'), (1, 'w@', 'b:wrap', 'deleted'), (2, 'v~', 'b:note', 'added'), (2, 'w@', 'b:wrap', 'deleted'), (3, 'w@', 'b:wrap', 'added'), (3, 'w@/v~', 'b:note', 'added'), (3, 'w@/v~/y', 'leaf', 'changed'),
(3, 'w@/v~/deep/z/type', 'type', 'changed'), (4, 'w@', 'b:wrap', 'added'), (5, 'w@', 'b:wrap', 'deleted'), (5, 'v~', 'b:note', 'added'), (5, 'v~/y/type', 'type', 'changed'), (5, 'y/type', 'type', 'changed')"""


@query(f"SELECT 'top' || p_partkey || '/' || {_at('path')} AS path, keyword, action FROM part JOIN (VALUES {_BLOCK_ROWS}) v(i, path, keyword, action) ON p_partkey % {len(_BLOCKS)} = i")
def schema_blocks(spark, d):
    """A block that is put around a subtree, taken away or changed for another is the only
    change; what changed inside is told where it is now, and a statement that became a
    block is not shown a second time."""
    case = (F.col("p_partkey") % len(_BLOCKS)).cast("int")
    part = _parts(spark, d)
    base = spark.createDataFrame([("base.yang", _BASE)], "file string, text string")

    def version(side: int) -> DataFrame:
        body = F.get(F.array(*[F.lit(b[side]) for b in _BLOCKS]), case)
        text_ = F.concat(F.lit("module m@ { prefix p; import base { prefix b; } container top@ { "), body, F.lit(" } }"))
        for mark, c in (("@", "p_partkey"), ("~", "p_size"), ("^", "p_brand")):
            text_ = F.replace(text_, F.lit(mark), F.col(c).cast("string"))
        return part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".yang")).alias("file"), text_.alias("text")).unionByName(base)

    rules = spark.createDataFrame(rules_xml.rule_rows(RULES), rules_xml.RULES)
    c = schema_diff.compare_files(version(0), version(1), rules)
    return c.changes.select(F.col("norm_path").alias("path"), "keyword", "action")


_RENAMED = [
    ("leaf alpha { type string; } leaf keep { type int8; }", "leaf alphabet { type string; } leaf keep { type int8; }"),
    ('container old@ { description "^ box"; leaf alpha { type string; } leaf b { type int8; } }', 'container far@ { container fresh@ { description "^ box"; leaf alphabet { type string; } leaf b { type int8; } } }'),
    ("leaf one-two { type string; }", "leaf one_two { type int8; }"),
    ("leaf a1 { type string; } leaf a2 { type string; }", "leaf b1 { type string; } leaf b2 { type string; }"),
]
_RENAMED_ROWS = """(0, 'alpha', 'alphabet', 'leaf'), (0, 'alpha/type', 'alphabet/type', 'type'), (1, 'old@', 'far@/fresh@', 'container'), (1, 'old@/alpha', 'far@/fresh@/alphabet', 'leaf'), (1, 'old@/alpha/type', 'far@/fresh@/alphabet/type', 'type'),
(1, 'old@/b', 'far@/fresh@/b', 'leaf'), (1, 'old@/b/type', 'far@/fresh@/b/type', 'type'), (2, 'one-two', 'one_two', 'leaf'), (2, 'one-two/type', 'one_two/type', 'type'),
(3, 'a1', 'b1', 'leaf'), (3, 'a1/type', 'b1/type', 'type'), (3, 'a2', 'b2', 'leaf'), (3, 'a2/type', 'b2/type', 'type')"""


@query(f"SELECT 'top' || p_partkey || '/' || {_at('o')} AS old_path, 'top' || p_partkey || '/' || {_at('n')} AS new_path, keyword FROM part JOIN (VALUES {_RENAMED_ROWS}) v(i, o, n, keyword) ON p_partkey % {len(_RENAMED)} = i")
def schema_renames(spark, d):
    """Renamed leaves that say nothing but their type, a renamed leaf below a container that
    moved and was renamed, names that differ in a hyphen, and ties."""
    case = (F.col("p_partkey") % len(_RENAMED)).cast("int")
    part = _parts(spark, d)

    def version(side: int) -> DataFrame:
        text_ = F.concat(F.lit("module m@ { prefix p; container top@ { "), F.get(F.array(*[F.lit(r[side]) for r in _RENAMED]), case), F.lit(" } }"))
        for mark, c in (("@", "p_partkey"), ("~", "p_size"), ("^", "p_brand")):
            text_ = F.replace(text_, F.lit(mark), F.col(c).cast("string"))
        return schema_diff.nodes_of(part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".yang")).alias("file"), text_.alias("text")))

    return schema_diff.match_moves(version(0), version(1)).select("old_path", "new_path", "keyword")


_PATHS = """leaf a { type int8; } leaf b { type int16; } leaf e { type enumeration { enum up; enum e~; } }
  choice c { case one { leaf d { type leafref { path "../a"; } } } } leaf o { type leafref { path "../d"; } }
  list row { key id; leaf id { type uint8; } leaf r { type leafref { path "../../d"; } } }
  leaf q { type %s; } container w { %s }"""
#: Old and new type of the leaf q, old and new condition of the container w, and what becomes
#: of the type's name, of its path and of the condition.
_PATH_CASES = [
    ('leafref { path "../a"; }', 'leafref { path "/p@:top@/p@:a"; }', 'when "../a > ~";', 'when "../a > ~";', None, "equivalent", None),
    ('leafref { path "../a"; }', 'leafref { path "../row/../a"; }', 'when "../zz > ~";', 'when "../a > ~";', None, "equivalent", "relaxed"),
    ('leafref { path "../a"; }', 'leafref { path "../b"; }', 'when "../a > ~";', 'when "../zz > ~";', None, "incomparable", "narrowed"),
    ('leafref { path "deref(../o)/../a"; }', 'leafref { path "../a"; }', "when \"../e = 'e~'\";", "when \"../e = 'gone'\";", None, "equivalent", "narrowed"),
    ('leafref { path "../row[id = current()/../a]/r"; }', 'leafref { path "../row[p@:id=current()/../a]/r"; }', "when \"../e = 'none'\";", "when \"../e = 'lost'\";", None, "equivalent", "equivalent"),
    ('leafref { path "../row[id = current()/../a]/r"; }', 'leafref { path "../row[id = current()/../b]/r"; }', 'when "count(../zz) > 1";', 'when "count(../zz) > 2";', None, "incomparable", "narrowed"),
    ('leafref { path "../o"; }', "int8", 'when "../zz > ~";', 'when "../zz >= ~";', "equivalent", None, "equivalent"),
    ('leafref { path "../o"; }', "int16", 'when "../d > ~";', 'when "../c/d > ~";', "relaxed", None, "narrowed"),
    ('leafref { path "../b"; }', "int8", "", "", "narrowed", None, None),
    ("int8", 'leafref { path "../a"; }', "", "", "narrowed", None, None),
    ('leafref { path "../../../../a"; }', 'leafref { path "../a"; }', "", "", None, "relaxed", None),
    ('leafref { path "../a"; }', 'leafref { path "../nowhere"; }', "", "", None, "narrowed", None),
]
_PATH_SQL = ", ".join(f"({i}, '{path}', '{field}', '{change}')" for i, c in enumerate(_PATH_CASES) for path, field, change in (("q/type", "name", c[4]), ("q/type", "path", c[5]), ("w", "when", c[6])) if change)
_PATH_RULES = RULES.replace("</rules>", '<rule><rule-id>other-path</rule-id><attributes><attribute type="XPath" identical="false">path</attribute></attributes><actions><action>changed</action></actions><compatible>non-backward-compatible</compatible></rule></rules>')


@query(f"SELECT 'top' || p_partkey || '/' || path AS path, field, change FROM part JOIN (VALUES {_PATH_SQL}) v(i, path, field, change) ON p_partkey % {len(_PATH_CASES)} = i")
def schema_paths(spark, d):
    """Paths of leafrefs are compared by the nodes that they lead to, over choices, names
    before dots and other leafrefs, and by their predicates; a leafref that became another
    type by the type at its end; a condition by whether its operands and values are in the
    schema of its own version."""
    case = (F.col("p_partkey") % len(_PATH_CASES)).cast("int")
    part = _parts(spark, d)

    def version(side: int) -> DataFrame:
        body = F.get(F.array(*[F.lit(_PATHS % (c[side], c[2 + side])) for c in _PATH_CASES]), case)
        text_ = F.concat(F.lit("module m@ { prefix p@; container top@ { "), body, F.lit(" } }"))
        for mark, c in (("@", "p_partkey"), ("~", "p_size"), ("^", "p_brand")):
            text_ = F.replace(text_, F.lit(mark), F.col(c).cast("string"))
        return part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".yang")).alias("file"), text_.alias("text"))

    rules = spark.createDataFrame(rules_xml.rule_rows(_PATH_RULES), rules_xml.RULES)
    c = schema_diff.compare_files(version(0), version(1), rules)
    changed = c.changes.where("action = 'changed'").select("change_id", F.col("norm_path").alias("path"))
    return c.details.join(changed, "change_id").where("action = 'changed'").select("path", F.col("subject").alias("field"), "change")


@query(
    """SELECT 'g' || p_partkey || v.rel AS path, replace(v.place, '@', p_partkey::VARCHAR) AS place FROM part, (VALUES ('/in/y/type', 'm@/top@/in/y/type'), ('/in/y/type', 'n@/c@/in/y/type'), ('/in/y/type', 'n@/deep@/in/y/type'), ('/in/new', 'm@/top@/in/new'), ('/in/new', 'n@/c@/in/new'), ('/in/new', 'n@/deep@/in/new'),
('/in/new/type', 'm@/top@/in/new/type'), ('/in/new/type', 'n@/c@/in/new/type'), ('/in/new/type', 'n@/deep@/in/new/type')) v(rel, place) WHERE CASE WHEN v.rel = '/in/y/type' THEN p_partkey % 3 = 0 ELSE p_partkey % 2 = 0 END"""
)
def schema_places(spark, d):
    """Each change of a grouping with every place of use, in its own module and another, and
    by way of a grouping that uses it."""
    k = F.regexp_extract("file", "([0-9]+)", 1).try_cast("long")
    user = 'module n@ { prefix q; import m@ { prefix o; } grouping g@ { leaf other { type int8; } } grouping by@ { uses o:g@; } container c@ { uses o:g@; uses q:g@; } container deep@ { uses by@; } }'
    old = _files(spark, d, m=_MAIN, n=user)
    text_ = F.when(k % 3 == 0, F.replace("text", F.lit("[a-z]+"), F.lit("[a-z0-9]+"))).otherwise(F.col("text"))
    text_ = F.when(k % 2 == 0, F.replace(text_, F.lit("mandatory true; }"), F.lit("mandatory true; } leaf new { type int8; }"))).otherwise(text_)
    c = schema_diff.compare_files(old, old.withColumn("text", text_), spark.createDataFrame(rules_xml.rule_rows(RULES), rules_xml.RULES))
    return c.places().join(c.changes.select("change_id", F.col("norm_path").alias("path")), "change_id").select("path", "place")


# --- types ------------------------------------------------------------------------

#: name, old and new descriptor, and the change; ~ stands for the part's size (1 to 50).
_LATTICE = [
    ("integer-same", '{"name": "int8", "range": "0..~"}', '{"name": "int8", "range": "0..~"}', "equivalent"),
    ("integer-wider", '{"name": "int8", "range": "0..~"}', '{"name": "int16"}', "relaxed"),
    ("integer-narrower", '{"name": "uint16"}', '{"name": "uint16", "range": "1..~"}', "narrowed"),
    ("integer-parts", '{"name": "uint8", "range": "1..~ | 60..61"}', '{"name": "uint8", "range": "0..55 | 60..max"}', "relaxed"),
    ("decimal-range", '{"name": "decimal64", "fraction-digits": "2", "range": "0..~"}', '{"name": "decimal64", "fraction-digits": "2", "range": "-1..60"}', "relaxed"),
    ("decimal-digits", '{"name": "decimal64", "fraction-digits": "2"}', '{"name": "decimal64", "fraction-digits": "3"}', "narrowed"),
    ("string-length", '{"name": "string", "length": "1..~"}', '{"name": "string", "length": "1..99"}', "relaxed"),
    ("string-pattern", '{"name": "string", "pattern": ["[a-z]{1,~}"]}', '{"name": "string", "pattern": ["[a-z]*"]}', "relaxed"),
    ("string-pattern-added", '{"name": "string"}', '{"name": "string", "pattern": ["[a-z]{1,~}"]}', "narrowed"),
    ("binary-length", '{"name": "binary", "length": "~"}', '{"name": "binary", "length": "1..50"}', "binary"),
    ("enumeration-more", '{"name": "enumeration", "enum": ["a", "e~"]}', '{"name": "enumeration", "enum": ["a", "b", "e~"]}', "relaxed"),
    ("enumeration-less", '{"name": "enumeration", "enum": ["a", "e~"]}', '{"name": "enumeration", "enum": ["a"]}', "narrowed"),
    ("bits-more", '{"name": "bits", "bit": {"a": 0, "b": ~}}', '{"name": "bits", "bit": {"a": 0, "b": ~, "c": 99}}', "relaxed"),
    ("bits-moved", '{"name": "bits", "bit": {"a": 0, "b": ~}}', '{"name": "bits", "bit": {"a": 0, "b": 99}}', "narrowed"),
    ("union-member-wider", '{"name": "union", "members": [{"name": "int8"}, {"name": "string", "length": "1..~"}]}', '{"name": "union", "members": [{"name": "int16"}, {"name": "string"}]}', "relaxed"),
    ("union-member-gone", '{"name": "union", "members": [{"name": "int8"}, {"name": "boolean"}]}', '{"name": "union", "members": [{"name": "int8"}]}', "narrowed"),
    ("into-union", '{"name": "uint8", "range": "0..~"}', '{"name": "union", "members": [{"name": "string"}, {"name": "uint8"}]}', "relaxed"),
    ("boolean", '{"name": "boolean"}', '{"name": "boolean"}', "equivalent"),
    ("empty", '{"name": "empty"}', '{"name": "empty"}', "equivalent"),
    ("from-empty", '{"name": "empty"}', '{"name": "string", "length": "0..~"}', "narrowed"),
    ("leafref-string", '{"name": "leafref", "path": "../a~"}', '{"name": "string"}', "relaxed"),
    ("leafref-path", '{"name": "leafref", "path": "../a~"}', '{"name": "leafref", "path": "../b~"}', "narrowed"),
    ("identityref-string", '{"name": "identityref", "base": "m:b~"}', '{"name": "string"}', "relaxed"),
    ("identityref-base", '{"name": "identityref", "base": "m:low"}', '{"name": "identityref", "base": "m:high"}', "relaxed"),
    ("identityref-lower", '{"name": "identityref", "base": "m:high"}', '{"name": "identityref", "base": "m:low"}', "narrowed"),
    ("enumeration-string", '{"name": "enumeration", "enum": ["e~"]}', '{"name": "string"}', "relaxed"),
    ("instance-required", '{"name": "instance-identifier", "require-instance": "true"}', '{"name": "instance-identifier", "require-instance": "false"}', "relaxed"),
    ("instance-free", '{"name": "instance-identifier", "require-instance": "false"}', '{"name": "instance-identifier", "require-instance": "true"}', "narrowed"),
    ("typedef-known", '{"name": "m:small"}', '{"name": "int32", "range": "0..~"}', "small"),
    ("typedef-of-typedef", '{"name": "m:smaller"}', '{"name": "m:small"}', "relaxed"),
    ("typedef-unknown", '{"name": "m:nowhere~"}', '{"name": "m:lost~"}', "unknown"),
    ("typedef-same-name", '{"name": "m:nowhere~"}', '{"name": "x:nowhere~"}', "relaxed"),
    ("integer-string", '{"name": "int8", "range": "0..~"}', '{"name": "string"}', "narrowed"),
]
_KNOWN = '{"m:small": "{\\"name\\": \\"uint8\\", \\"range\\": \\"0..9\\"}", "m:smaller": "{\\"name\\": \\"m:small\\", \\"range\\": \\"2..4\\"}", "identity m:high": "[\\"m:low\\", \\"m:lowest\\"]", "identity m:low": "[\\"m:lowest\\"]"}'
_LATTICE_SQL = ", ".join(f"({i}, '{n}', '{c}')" for i, (n, _, _, c) in enumerate(_LATTICE))


@query(
    f"""SELECT p_partkey, name, CASE c WHEN 'binary' THEN 'relaxed' WHEN 'small' THEN CASE WHEN p_size >= 9 THEN 'relaxed' ELSE 'narrowed' END ELSE c END AS change
FROM part JOIN (VALUES {_LATTICE_SQL}) v(i, name, c) ON p_partkey % {len(_LATTICE)} = i"""
)
def type_lattice(spark, d):
    """Each row of the table of value spaces, with the part's size in its limits."""
    case = (F.col("p_partkey") % len(_LATTICE)).cast("int")
    pick = lambda i: F.replace(F.get(F.array(*[F.lit(r[i]) for r in _LATTICE]), case), F.lit("~"), F.col("p_size").cast("string"))
    known = F.lit(_KNOWN)
    return table(spark, d, "part").select("p_partkey", pick(0).alias("name"), types.type_change(pick(1), pick(2), old_defs=known, new_defs=known).alias("change"))


@query(
    """SELECT p_partkey, n, CASE WHEN p_partkey % 3 = 1 AND n > 1 THEN 'narrowed' WHEN n >= 2 THEN 'relaxed' ELSE 'equivalent' END AS change FROM (SELECT p_partkey, (p_partkey % 2 + 1 + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END)::INTEGER AS n FROM part)"""
)
def union_strict(spark, d):
    """Unions with more members: wider by default, breaking in strict mode."""
    k = F.col("p_partkey")
    n = (k % 2 + 1 + F.when(k % 5 == 0, 1).otherwise(0)).cast("int")
    new = F.concat(F.lit('{"name": "union", "members": [{"name": "int8"}'), F.when(n > 1, ', {"name": "string"}').otherwise(""), F.when(n > 2, ', {"name": "binary"}').otherwise(""), F.lit("]}"))
    old = F.lit('{"name": "union", "members": [{"name": "int8"}]}')
    return table(spark, d, "part").select("p_partkey", n.alias("n"), F.when(k % 3 == 1, types.type_change(old, new, strict=True)).otherwise(types.type_change(old, new)).alias("change"))


# --- conditions and paths ------------------------------------------------------------

_CONDITIONS = [
    ("../a = 's~'", "../a = 's~' or ../a = 'y'", "relaxed"), ("../a = 's~' or ../b", "../b", "narrowed"), ("../a and ../n > ~", "../a", "relaxed"), ("../a", "../a and ../n > ~", "narrowed"), ("../n >= ~", "../n > ~", "narrowed"), ("../n < ~", "../n <= ~", "relaxed"),
    ("../n != ~", "../n > ~", "narrowed"), ("../n = ~", "../n != 99", "relaxed"), ("../n = ~", "../n = 99", "incomparable"), ("not(../n > ~)", "not(../n > 99)", "relaxed"), ("../a", "../a[k = '~']", "narrowed"), ("../a[k = '~'][j]", "../a[j]", "relaxed"),
    ("p:a = 'p:s~'", "q:a = 'q:s~'", "equivalent"), ("../a and ../b", "../a or ../b", "relaxed"), ("(../a or ../b) and ../n > ~", "../n > ~", "relaxed"), ("../a = 's~'", "../b = 's~'", "incomparable"), ("", "../n > ~", "narrowed"), ("../n > ~", "", "relaxed"),
    ("count(../a) > ~", "count(../b) > ~", "incomparable"), ("../a", "../a = 's~'", "narrowed"), ("~ < ../n", "../n > ~", "equivalent"),
]


@query(f"SELECT p_partkey, c AS change FROM part JOIN (VALUES {', '.join(f'({i}, {chr(39)}{c}{chr(39)})' for i, (_, _, c) in enumerate(_CONDITIONS))}) v(i, c) ON p_partkey % {len(_CONDITIONS)} = i")
def condition_matrix(spark, d):
    """Each kind of clause against each change of it."""
    case = (F.col("p_partkey") % len(_CONDITIONS)).cast("int")
    pick = lambda i: F.replace(F.get(F.array(*[F.lit(r[i]) for r in _CONDITIONS]), case), F.lit("~"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", conditions.condition_change(pick(0), pick(1)).alias("change"))


@query(
    """SELECT p_partkey, CASE WHEN o IS NULL OR n IS NULL THEN 'needs-analysis' WHEN NOT o AND NOT n THEN 'equivalent' WHEN NOT o THEN 'relaxed' WHEN NOT n THEN 'narrowed' WHEN p_size % 2 = 0 THEN 'equivalent' ELSE 'narrowed' END AS change
FROM (SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS o, CASE p_partkey // 3 % 3 WHEN 0 THEN true WHEN 1 THEN false END AS n FROM part)"""
)
def condition_operands(spark, d):
    """Every cell of the matrix of operands that are valid, invalid or unknown."""
    ok = lambda c: F.when(c == 0, True).when(c == 1, False)
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", conditions.validity(ok(k % 3), ok(F.floor(k / 3) % 3), F.col("p_size") % 2 == 0).alias("change"))


_TREE = ("m/top/a", "m/top/b", "m/top/box/c", "m/other/a")


@query(
    """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'equivalent' WHEN 1 THEN 'incomparable' WHEN 2 THEN 'relaxed' WHEN 3 THEN 'narrowed' WHEN 4 THEN 'incomparable' WHEN 5 THEN 'equivalent' WHEN 6 THEN 'equivalent' ELSE 'incomparable' END AS change FROM part"""
)
def xpath_comparison(spark, d):
    """The five cases of two forms of a path: same node, another one, new, gone, neither."""
    forms = [("../a", "/p:top/p:a"), ("../a", "../b"), ("../lost~", "../b"), ("../a", "../lost~"), ("../lost~", "/none"), ("../box[k = ']']/c", "/q:top/q:box/q:c"), ("current()/../a", "../p:a[x[y]]"), ("../a", "/other/a")]
    case = (F.col("p_partkey") % 8).cast("int")
    pick = lambda i: F.replace(F.get(F.array(*[F.lit(f[i]) for f in forms]), case), F.lit("~"), F.col("p_size").cast("string"))
    rows = table(spark, d, "part").select("p_partkey", F.lit("m/top/leaf").alias("context"), pick(0).alias("old"), pick(1).alias("new"))
    nodes = spark.createDataFrame([(p,) for p in _TREE], "path string")
    return xpath.compare_paths(rows, nodes, nodes, "old", "new", "context").select("p_partkey", F.col("path_change").alias("change"))


@query(
    """SELECT p_partkey, p_partkey % 6 IN (0, 3, 4) AS same FROM part"""
)
def xpath_equivalence(spark, d):
    """Local names, then nodes, then the places where a grouping is used decide."""
    forms = [("../p:a", "../q:a"), ("../a", "../b"), ("../a", "/top/a"), ("../p:inner~", "../q:inner~"), ("/x:none~", "/y:none~"), ("../inner~", "../a")]
    case = (F.col("p_partkey") % 6).cast("int")
    pick = lambda i: F.replace(F.get(F.array(*[F.lit(f[i]) for f in forms]), case), F.lit("~"), F.col("p_size").cast("string"))
    rows = table(spark, d, "part").select("p_partkey", F.when(case.isin(3, 5), "m/g/leaf").otherwise("m/top/leaf").alias("context"), F.when(case.isin(3, 5), "m:g").alias("grouping"), pick(0).alias("old"), pick(1).alias("new"))
    inner = table(spark, d, "part").select(F.concat(F.lit("m/use/inner"), F.col("p_size").cast("string")).alias("path")).distinct()
    nodes = spark.createDataFrame([(p,) for p in _TREE], "path string").unionByName(inner)
    uses = spark.createDataFrame([("m:g", "m/use")], "grouping string, at string")
    return xpath.equivalent_paths(rows, nodes, nodes, uses, "old", "new", "context", "grouping").select("p_partkey", "same")


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'non-backward-compatible' WHEN 1 THEN 'backward-compatible' WHEN 2 THEN 'non-backward-compatible' WHEN 3 THEN 'backward-compatible' WHEN 4 THEN 'backward-compatible' ELSE 'non-backward-compatible' END AS verdict FROM part"""
)
def leafref_compatibility(spark, d):
    k = F.col("p_partkey") % 6
    old = F.when(k == 0, "string").otherwise("leafref")
    new = F.when(k.isin(0, 1, 2), "leafref").when(k == 3, "string").when(k == 4, "int8").otherwise("boolean")
    change = F.when(k == 1, "equivalent").otherwise("incomparable")
    return table(spark, d, "part").select("p_partkey", xpath.leafref_change(old, new, change, F.lit("int8")).alias("verdict"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'equivalent' ELSE CASE WHEN p_partkey % 3 = 1 THEN 'relaxed' ELSE 'narrowed' END END AS change FROM part")
def boolean_constraint(spark, d):
    from tessera.functions import intervals

    k = F.col("p_partkey") % 3
    return table(spark, d, "part").select("p_partkey", intervals.boolean_change(F.when(k == 0, "true").when(k == 2, "true"), F.when(k == 2, "false").otherwise("true")).alias("change"))


# --- items of lists, unions and wrappers ------------------------------------------------

_ITEMS_OLD = "SELECT p_partkey AS id, p_size % 5 AS owner, 'n' || p_partkey AS name, ['b' || p_brand, 's' || p_size, 'x' || p_partkey // 10] AS attrs FROM part"
_ITEMS_NEW = "SELECT p_partkey AS id, p_size % 5 AS owner, CASE WHEN p_partkey % 9 = 0 THEN 'r' ELSE 'n' END || p_partkey AS name, ['b' || p_brand, 's' || CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END, 'x' || p_partkey // 10] AS attrs FROM part WHERE p_partkey % 11 <> 0"


@query(
    f"""WITH RECURSIVE o AS ({_ITEMS_OLD}), n AS ({_ITEMS_NEW}), a AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.owner = o.owner AND n.name = o.name)), b AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.owner = o.owner AND n.name = o.name)),
c AS (SELECT a.owner, a.name AS x, b.name AS y, round(100.0 * len(list_intersect(a.attrs, b.attrs)) / len(list_distinct(list_concat(a.attrs, b.attrs))), 6) AS s FROM a JOIN b ON a.owner = b.owner),
r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY s DESC, x, y) AS i FROM c WHERE s >= 55),
w(owner, i, xs, ys, took) AS (SELECT DISTINCT owner, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], false FROM r UNION ALL
  SELECT q.owner, q.i, CASE WHEN q.free THEN list_append(q.xs, q.x) ELSE q.xs END, CASE WHEN q.free THEN list_append(q.ys, q.y) ELSE q.ys END, q.free
  FROM (SELECT w.xs, w.ys, r.*, NOT list_contains(w.xs, r.x) AND NOT list_contains(w.ys, r.y) AS free FROM w JOIN r ON r.owner = w.owner AND r.i = w.i + 1) q),
t AS (SELECT r.owner, x, y FROM r JOIN w ON r.owner = w.owner AND r.i = w.i WHERE took)
SELECT o.owner, o.name AS old_name, n.name AS new_name, CASE WHEN o.attrs = n.attrs THEN 'unchanged' ELSE 'changed' END AS action FROM o JOIN n ON o.owner = n.owner AND o.name = n.name
UNION ALL SELECT t.owner, t.x, t.y, 'changed' FROM t UNION ALL SELECT owner, name, NULL, 'deleted' FROM a WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.owner = a.owner AND t.x = a.name)
UNION ALL SELECT owner, NULL, name, 'added' FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.owner = b.owner AND t.y = b.name)"""
)
def list_items_by_name(spark, d):
    """Items of a list meet by name, what is left by the best similarity of 55 or more."""
    part = table(spark, d, "part")
    k, z = F.col("p_partkey"), F.col("p_size")
    attrs = lambda size: F.array(F.concat(F.lit("b"), "p_brand"), F.concat(F.lit("s"), size.cast("string")), F.concat(F.lit("x"), F.floor(k / 10).cast("string"))).alias("attrs")
    old = part.select((z % 5).alias("owner"), F.concat(F.lit("n"), k.cast("string")).alias("name"), attrs(z))
    new = part.where(k % 11 != 0).select((z % 5).alias("owner"), F.concat(F.when(k % 9 == 0, "r").otherwise("n"), k.cast("string")).alias("name"), attrs(F.when(k % 4 == 0, z + 1).otherwise(z)))
    return matching.items_by_name(old, new, "owner", "name", "attrs").select("owner", "old_name", "new_name", "action")


@query(
    """SELECT p_partkey, i AS pos, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'deleted' WHEN a = b THEN 'unchanged' ELSE 'changed' END AS action, a AS old_value, b AS new_value
FROM (SELECT p_partkey, i, CASE WHEN i < 3 THEN ['int8', 'string', 's' || p_size][i + 1] END AS a, CASE WHEN i < 2 + p_partkey % 3 THEN ['int8', CASE WHEN p_partkey % 2 = 0 THEN 'string' ELSE 'binary' END, 's' || p_size, 'new'][i + 1] END AS b FROM part, range(0, 4) r(i)) WHERE a IS NOT NULL OR b IS NOT NULL"""
)
def union_members(spark, d):
    """Members of unions, place by place; of the longer side the rest is added or deleted."""
    k, size = F.col("p_partkey"), F.concat(F.lit("s"), F.col("p_size").cast("string"))
    part = table(spark, d, "part")
    long = lambda c: part.select("p_partkey", F.posexplode(c).alias("pos", "value"))
    old = long(F.array(F.lit("int8"), F.lit("string"), size))
    new = long(F.slice(F.array(F.lit("int8"), F.when(k % 2 == 0, "string").otherwise("binary"), size, F.lit("new")), F.lit(1), (2 + k % 3).cast("int")))
    return diff.positional_diff(old, new, ["p_partkey"], "pos", "value")


_LISTED = "SELECT p_partkey, p_partkey // 8 AS id, p_size % 5 AS v, p_size % 4 = 0 AS gone, p_size % 7 = 0 AS late, p_size % 5 + 5 * (p_size % 7 = 1)::INTEGER AS w FROM part"


@query(
    f"""WITH RECURSIVE p AS ({_LISTED}), o AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY p_partkey) - 1 AS i, 'v' || v AS x FROM p), n AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY late, p_partkey) - 1 AS j, 'v' || w AS y FROM p WHERE NOT gone),
m AS (SELECT o.id, i, j FROM o JOIN n ON o.id = n.id AND x = y), c(id, i, j, way) AS (SELECT id, i, j, [i * 100 + j] FROM m UNION ALL SELECT c.id, m.i, m.j, list_append(way, m.i * 100 + m.j) FROM c JOIN m ON m.id = c.id AND m.i > c.i AND m.j > c.j),
best AS (SELECT id, way FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len(way) DESC, way) AS r FROM c) WHERE r = 1), same AS (SELECT id, k // 100 AS i, k % 100 AS j FROM (SELECT id, unnest(way) AS k FROM best)),
ro AS (SELECT *, (SELECT count(*) FROM same s WHERE s.id = o.id AND s.i < o.i) AS gap, row_number() OVER (PARTITION BY id, x ORDER BY i) AS k FROM o WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.id = o.id AND s.i = o.i)), rn AS (SELECT *, (SELECT count(*) FROM same s WHERE s.id = n.id AND s.j < n.j) AS gap, row_number() OVER (PARTITION BY id, y ORDER BY j) AS k FROM n WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.id = n.id AND s.j = n.j)),
moved AS (SELECT ro.id, ro.i, rn.j FROM ro JOIN rn ON ro.id = rn.id AND x = y AND ro.k = rn.k), go AS (SELECT *, row_number() OVER (PARTITION BY id, gap ORDER BY i) AS q FROM ro WHERE NOT EXISTS (SELECT 1 FROM moved s WHERE s.id = ro.id AND s.i = ro.i)), gn AS (SELECT *, row_number() OVER (PARTITION BY id, gap ORDER BY j) AS q FROM rn WHERE NOT EXISTS (SELECT 1 FROM moved s WHERE s.id = rn.id AND s.j = rn.j)),
every AS (SELECT id, i, j, 'unchanged' AS action FROM same UNION ALL SELECT *, 'moved' FROM moved UNION ALL SELECT coalesce(go.id, gn.id), i, j, CASE WHEN i IS NULL THEN 'added' WHEN j IS NULL THEN 'deleted' ELSE 'changed' END FROM go FULL JOIN gn ON go.id = gn.id AND go.gap = gn.gap AND go.q = gn.q)
SELECT e.id, e.i AS old_pos, e.j AS new_pos, action, x AS old_value, y AS new_value FROM every e LEFT JOIN o ON o.id = e.id AND o.i = e.i LEFT JOIN n ON n.id = e.id AND n.j = e.j"""
)
def list_alignment(spark, d):
    """Lists of repeated values whose items went, came late and changed, by their longest
    common subsequence; the SQL tries all subsequences."""
    k, z = F.col("p_partkey"), F.col("p_size")
    v = lambda c: F.concat(F.lit("v"), c.cast("string"))
    w = v(z % 5 + F.when(z % 7 == 1, 5).otherwise(0))
    put = lambda order, value, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(*order, value.alias("v"))))), lambda s: s["v"])
    lists = table(spark, d, "part").groupBy(F.floor(k / 8).alias("id")).agg(put([k], v(z % 5), F.lit(True)).alias("a"), put([(z % 7 == 0).alias("late"), k], w, z % 4 != 0).alias("b"))
    return aligned.items(lists, ["id"], "a", "b")


#: Old and new members of a union: one put first, one gone between, a new order, another length.
_MEMBERS = [
    ("type string { length ~; } type string { length 90; }", "type string { length 95; } type string { length ~; } type string { length 90; }"),
    ("type int8; type string { length ~; } type boolean;", "type int8; type boolean;"),
    ("type int8; type t@;", "type t@; type int8;"),
    ("type int8; type string { length ~; }", "type int8; type string { length 91; }"),
]
_MEMBER_ROWS = """(0, '', 'type', NULL, 0, 'added', NULL, '{"name":"string","length":"95","pattern":[]}'), (1, '', 'type', 1, NULL, 'deleted', '{"name":"string","length":"~","pattern":[]}', NULL),
(2, '', 'type', 1, 0, 'moved', '{"name":"m@:t@","pattern":[]}', '{"name":"m@:t@","pattern":[]}'), (3, '', 'type', 1, 1, 'changed', '{"name":"string","length":"~","pattern":[]}', '{"name":"string","length":"91","pattern":[]}'),
(0, '/must', 'must', NULL, 1, 'added', NULL, '../n < ~'), (1, '/must', 'must', NULL, 1, 'added', NULL, '../n < ~'), (2, '/must', 'must', NULL, 1, 'added', NULL, '../n < ~'), (3, '/must', 'must', NULL, 1, 'added', NULL, '../n < ~')"""


@query(
    f"""SELECT 'top' || p_partkey || '/u' || CASE field WHEN 'type' THEN '/type' ELSE '' END AS path, field, old_pos, new_pos, action, {_at('o')} AS old_value, {_at('n')} AS new_value
FROM part JOIN (VALUES {_MEMBER_ROWS}) v(i, s, field, old_pos, new_pos, action, o, n) ON p_partkey % {len(_MEMBERS)} = i"""
)
def schema_items(spark, d):
    """Members of unions and repeated conditions that differ between two versions: what
    comes in between shifts nothing else."""
    case = F.col("p_partkey") % len(_MEMBERS)
    part = _parts(spark, d)

    def version(side: int) -> DataFrame:
        must = ['must "../n > 1"; must "../n != 50";', 'must "../n > 1"; must "../n < ~"; must "../n != 50";'][side]
        body = F.get(F.array(*[F.lit(c[side]) for c in _MEMBERS]), case)
        text_ = F.concat(F.lit("module m@ { prefix p; typedef t@ { type int8; } container top@ { leaf n { type uint8; } leaf u { " + must + " type union { "), body, F.lit(" } } } }"))
        for mark, c in (("@", "p_partkey"), ("~", "p_size"), ("^", "p_brand")):
            text_ = F.replace(text_, F.lit(mark), F.col(c).cast("string"))
        return part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".yang")).alias("file"), text_.alias("text"))

    rules = spark.createDataFrame(rules_xml.rule_rows(RULES), rules_xml.RULES)
    return schema_diff.compare_files(version(0), version(1), rules).items()


@query(
    """SELECT 'top' || p_partkey || '/w' || p_partkey || p AS path, k AS keyword, a AS action FROM part, (VALUES ('/inner/type', 'type', 'changed', 0), ('/extra', 'leaf', 'added', 1), ('/extra/type', 'type', 'added', 1), ('/inner', 'leaf', 'deleted', 2), ('/inner/type', 'type', 'deleted', 2), ('/kept', 'leaf', 'added', 2), ('/kept/type', 'type', 'added', 2)) v(p, k, a, m) WHERE p_partkey % 4 = m"""
)
def wrapper_blocks(spark, d):
    """What changes inside an extension's block is a change of a node below the block."""
    body = "module m@ {{ prefix p; import base {{ prefix b; }} container top@ {{ b:wrap w@ {{ {0} }} }} }}"
    new = ["leaf inner { type string; }", "leaf inner { type binary; } leaf extra { type int8; }", "leaf kept { type int8; }", "leaf inner { type binary; }"]
    old = schema_diff.nodes_of(_files(spark, d, m=body.format("leaf inner { type binary; }")))
    base = spark.createDataFrame([("base.yang", _BASE)], "file string, text string")
    pick = _one_of(spark, d, [body.format(t) for t in new]).unionByName(base)
    changes = schema_diff.node_changes(old, schema_diff.nodes_of(pick))
    return changes.select(F.col("norm_path").alias("path"), "keyword", "action")


# --- verification --------------------------------------------------------------------


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'backward-compatible' WHEN o_custkey % 2 = 0 THEN 'non-backward-compatible' END AS decision, CASE WHEN o_orderkey % 3 = 0 THEN CASE o_orderstatus WHEN 'O' THEN 'confirmed' ELSE 'conflict' END
WHEN o_custkey % 2 = 0 THEN CASE o_orderstatus WHEN 'O' THEN 'conflict' ELSE 'confirmed' END ELSE 'unverified' END AS outcome FROM orders"""
)
def verdict_lookup(spark, d):
    """Verdicts that were given before, by value; a certain direction counts first."""
    o = table(spark, d, "orders")
    change = F.when(F.col("o_orderkey") % 3 == 0, "relaxed").otherwise("unknown")
    verdict = F.when(F.col("o_orderstatus") == "O", "backward-compatible").otherwise("non-backward-compatible")
    rows = o.select("o_orderkey", F.lit("when").alias("subject"), F.col("o_custkey").cast("string").alias("old_value"), F.lit("x").alias("new_value"), change.alias("change"), verdict.alias("verdict"))
    said = o.where("o_custkey % 2 = 0").select(F.lit("when").alias("subject"), F.col("o_custkey").cast("string").alias("old_value"), F.lit("x").alias("new_value"), F.lit("non-backward-compatible").alias("decision"), F.lit("seen before").alias("explanation"))
    out = verify.lookup(rows, said)
    final = F.coalesce(verify.static_decision(F.col("change")), F.col("decision"))
    return out.select("o_orderkey", final.alias("decision"), "outcome")


# --- list items, types, reports ------------------------------------------------------------


@query(
    """WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS o FROM part),
b AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN list_reverse(o) WHEN 1 THEN o[2:] WHEN 2 THEN list_append(o, 'x' || p_partkey) ELSE list_append(o[2:], 'new') END AS n FROM a),
c AS (SELECT p_partkey, NOT list_has_all(n, o) AS gone, NOT list_has_all(o, n) AS came FROM b)
SELECT p_partkey, CASE WHEN gone THEN 'breaks' WHEN came THEN 'fits' ELSE 'backward-compatible' END AS verdict, CASE WHEN gone THEN 'non-backward-compatible' ELSE 'backward-compatible' END AS unruled FROM c"""
)
def list_constraint(spark, d):
    """Lists as constraints: an item that went decides before one that came."""
    old = F.split(F.col("p_name"), " ")
    came, gone = F.array_append(old, F.concat(F.lit("x"), F.col("p_partkey").cast("string"))), F.slice(old, 2, 100)
    new = F.when(F.col("p_partkey") % 4 == 0, F.reverse(old)).when(F.col("p_partkey") % 4 == 1, gone).when(F.col("p_partkey") % 4 == 2, came).otherwise(F.array_append(gone, "new"))
    none = F.lit(None).cast("string")
    return table(spark, d, "part").select("p_partkey", diff.list_verdict(old, new, F.lit("breaks"), F.lit("fits")).alias("verdict"), diff.list_verdict(old, new, none, none).alias("unruled"))


@query("SELECT c_custkey, c_custkey % 3 = 2 AS changed FROM customer")
def item_comparison(spark, d):
    """A new prefix alone is no change of an item."""
    k = F.col("c_custkey").cast("string")
    name = lambda p, end: F.concat(F.lit(f"../{p}:box/"), F.lit(f"{p}:n"), k, F.lit(end))
    new = F.when(F.col("c_custkey") % 3 == 0, name("a", "")).when(F.col("c_custkey") % 3 == 1, name("b", "")).otherwise(name("b", "x"))
    return table(spark, d, "customer").select("c_custkey", diff.item_changed(name("a", ""), new).alias("changed"))


@query(
    """SELECT 'm/leaf' || p_partkey AS path, e AS name, CASE e WHEN 'late' THEN 'added' WHEN 'early' THEN 'deleted' ELSE 'changed' END AS action,
CASE e WHEN 'both' THEN 'error' WHEN 'old' THEN 'warning' ELSE 'info' END AS severity FROM part, (VALUES ('late', 0), ('early', 1), ('both', 2), ('old', 3)) v(e, i) WHERE regexp_extract(p_brand, '[0-9]+')::INTEGER % 5 = i AND p_partkey % 7 > 0"""
)
def typedef_references(spark, d):
    """Leaves whose type's name stays while the entries that it stands for change."""
    part = table(spark, d, "part")
    refs = part.select(F.concat(F.lit("m/leaf"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_brand").alias("type_name"))
    i = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") % 5
    entry = lambda n, v, s="current": F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"), F.lit(s).alias("status"))
    drop = lambda a: F.filter(a, lambda x: x.isNotNull())
    common = [entry("both", "1"), entry("old", "2")]
    old = part.select(F.col("p_brand").alias("type_name"), drop(F.array(*common, F.when(i == 1, entry("early", "3")))).alias("entries")).distinct()
    fresh = [F.when(i == 2, entry("both", "7")).otherwise(common[0]), F.when(i == 3, entry("old", "2", "deprecated")).otherwise(common[1]), F.when(i == 0, entry("late", "4"))]
    new = part.select(F.col("p_brand").alias("type_name"), drop(F.array(*fresh)).alias("entries")).distinct()
    later = refs.join(part.where("p_partkey % 7 = 0").select(F.concat(F.lit("m/leaf"), F.col("p_partkey").cast("string")).alias("path")), "path", "left_anti")
    return diff.definition_diff(refs, later, old, new, ["path"], "type_name", "entries").select("path", "name", "action", "severity")


@query("SELECT p_partkey, map_keys(m) AS keys FROM (SELECT p_partkey, map {'key': p_brand, 'name': p_name} AS m FROM part)")
def attributes_without_type(spark, d):
    m = F.create_map(F.lit("name"), "p_name", F.lit("type"), "p_type", F.lit("key"), "p_brand")
    return table(spark, d, "part").select("p_partkey", F.array_sort(F.map_keys(diff.without_type(m))).alias("keys"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'groups.yang' ELSE 'main.yang' END AS file, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 50 ELSE o_custkey END AS line FROM orders"""
)
def condition_source(spark, d):
    """A node whose condition comes from another file is shown where that stands."""
    k = F.col("o_orderkey")
    source = F.when(k % 3 == 1, "groups.yang").when(k % 3 == 2, "main.yang")
    file, line = diff.rebind(F.lit("main.yang"), F.col("o_custkey"), source, k % 50)
    return table(spark, d, "orders").select("o_orderkey", file.alias("file"), line.alias("line"))


@query(
    """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 16 = 15 THEN p_partkey WHEN p_partkey % 8 > 0 THEN p_partkey - 1 WHEN p_partkey % 64 = 0 THEN -9 END AS ref, p_brand FROM part),
w AS (SELECT id, id AS at, 0 AS hops FROM n UNION ALL SELECT w.id, n.ref, hops + 1 FROM w JOIN n ON w.at = n.id WHERE n.ref IS NOT NULL AND hops < 10)
SELECT n.id, e.at AS terminal, e.p_brand AS type_name FROM n LEFT JOIN (SELECT w.id, w.at, x.p_brand FROM w JOIN n x ON w.at = x.id WHERE x.ref IS NULL) e ON n.id = e.id WHERE n.ref IS NOT NULL"""
)
def leafref_targets(spark, d):
    """References to references, some in a circle and some to nothing: the last node's type."""
    k = F.col("p_partkey")
    ref = F.when(k % 16 == 15, k).when(k % 8 > 0, k - 1).when(k % 64 == 0, F.lit(-9))
    return graph.terminals(table(spark, d, "part").select(k.alias("id"), ref.alias("ref"), F.col("p_brand").alias("type_name")), "id", "ref", "type_name")


@query(
    """SELECT p_partkey AS id, 'container' AS keyword, CASE WHEN p_partkey % 3 = 0 THEN 'changed' ELSE 'added' END AS action FROM part
WHERE NOT (p_partkey % 3 > 0 AND EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 3 = 0 AND q.p_brand = part.p_brand AND q.p_size = part.p_size))"""
)
def alias_suppression(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("container").alias("keyword"), F.when(F.col("p_partkey") % 3 == 0, "changed").otherwise("added").alias("action"), F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("file"), F.col("p_size").alias("line"))
    return matching.drop_aliases(rows, rows.where("action = 'changed'"), ["keyword", "name", "file", "line"]).select("id", "keyword", "action")


_LINES = "SELECT p_partkey // 20 AS report, p_partkey % 20 AS line, p_size % 5 AS level, p_brand AS name FROM part"


def _report_lines(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.floor(k / 20).cast("long").alias("report"), (k % 20).alias("line"), (F.col("p_size") % 5).alias("level"), F.col("p_brand").alias("name"))


@query(f"WITH l AS ({_LINES}) SELECT report, line, (SELECT max(p.line) FROM l p WHERE p.report = l.report AND p.line < l.line AND p.level < l.level) AS parent FROM l")
def report_parents(spark, d):
    return report.enclosing(_report_lines(spark, d)).select("report", "line", "parent")


@query(
    f"""WITH RECURSIVE l AS ({_LINES}), e AS (SELECT *, (SELECT max(p.line) FROM l p WHERE p.report = l.report AND p.line < l.line AND p.level < l.level) AS parent FROM l),
c AS (SELECT report, line, name, '' AS context FROM e WHERE parent IS NULL UNION ALL SELECT e.report, e.line, e.name, CASE c.context WHEN '' THEN c.name ELSE c.context || '/' || c.name END FROM e JOIN c ON e.report = c.report AND e.parent = c.line)
SELECT report, line, context FROM c"""
)
def report_contexts(spark, d):
    return report.contexts(_report_lines(spark, d))


@query("SELECT s_suppkey, 'at [''' || s_name || '''][''x'']' AS value FROM supplier")
def report_filter(spark, d):
    lines = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("at root['"), "s_name", F.lit("']['x']")).alias("value"))
    return reports.without_root(lines)


@query(
    """SELECT 'r' || o_custkey AS rule_id, 'Rule ID: r' || o_custkey || chr(10) || 'Category: structural' || chr(10) || 'Actions: ' || string_agg(DISTINCT a, ', ' ORDER BY a) || chr(10) || 'Compatible: backward-compatible' AS text
FROM (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'added (parent=deleted)' WHEN o_orderkey % 3 = 1 THEN 'added' ELSE 'changed' END AS a FROM orders WHERE o_orderstatus = 'F') GROUP BY o_custkey"""
)
def rule_texts(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("rule_id"), F.lit("structural").alias("kind"), F.when(F.col("o_orderstatus") == "F", "leaf").otherwise("list").alias("subject"),
        F.when(k % 3 == 2, "changed").otherwise("added").alias("action"), F.when(k % 3 == 0, "deleted").alias("parent_action"), F.lit("backward-compatible").alias("verdict"),
    )
    return rules.rules_for(rows, "leaf")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'backward-compatible' WHEN 1 THEN 'non-backward-compatible' END AS verdict FROM part")
def type_presence(spark, d):
    k = F.col("p_partkey") % 4
    return table(spark, d, "part").select("p_partkey", types.type_presence(F.when(k.isin(1, 2), F.col("p_type")), F.when(k.isin(0, 2), F.col("p_type"))).alias("verdict"))


@query(f"SELECT 'm' || p_partkey || '.yang' AS file, keyword, n::BIGINT AS n FROM part, (VALUES {_WORDS}) v(keyword, n, lines) WHERE keyword IN ('wrap', {', '.join(repr(k) for k in (*model.STRUCTURAL, 'range', 'when'))})")
def allowed_statements(spark, d):
    """The statements that a corpus takes, extensions among them."""
    s = yang.allowed(yang.statements(_files(spark, d, m=_MAIN)), [*model.STRUCTURAL, "range", "when"]).where("file <> 'base.yang'")
    return s.groupBy("file", "keyword").agg(F.count(F.lit(1)).alias("n"))
