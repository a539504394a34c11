"""The operators over the driver's tables, each with its DuckDB SQL.

Two versions of a table are two deterministic views of it, so that every comparison runs
on all its rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import conditions, intervals, text, types, xpath
from tessera.functions.regex_inclusion import regex_change
from tessera.operators import diff, graph, matching, report, retrieval, rules, vector_index
from tessera.plans import verify
from tessera.session import shared_folder
from tessera.sources.tables import table
from tessera.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_PART = ["p_name", "p_brand", "p_size"]
_OLD = "SELECT p_partkey, p_name, p_brand, p_size FROM part"
_NEW = "SELECT CASE WHEN p_partkey % 10 = 0 THEN -1 - p_partkey ELSE p_partkey END AS p_partkey, p_name, p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All rows in both: the new version has other keys for some and other sizes for some."""
    part = table(spark, d, "part").select("p_partkey", *_PART)
    new = part.withColumn("p_size", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return part, new.withColumn("p_partkey", F.when(F.col("p_partkey") % 10 == 0, -1 - F.col("p_partkey")).otherwise(F.col("p_partkey")))


_FULL = f"""
WITH o AS ({_OLD}), n AS ({_NEW})
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey,
  CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'deleted'
       WHEN o.p_name IS NOT DISTINCT FROM n.p_name AND o.p_brand IS NOT DISTINCT FROM n.p_brand AND o.p_size IS NOT DISTINCT FROM n.p_size THEN 'unchanged'
       ELSE 'changed' END AS action,
  o.p_name AS old_p_name, n.p_name AS new_p_name, o.p_brand AS old_p_brand, n.p_brand AS new_p_brand, o.p_size AS old_p_size, n.p_size AS new_p_size
FROM o FULL JOIN n ON o.p_partkey = n.p_partkey"""


@query(_FULL)
def diff_full_outer(spark, d):
    return diff.full_outer_diff(*_versions(spark, d), ["p_partkey"], _PART)


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM n WHERE p_partkey NOT IN (SELECT p_partkey FROM o)")
def diff_added(spark, d):
    old, new = _versions(spark, d)
    return diff.only_in(new, old, ["p_partkey"])


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o WHERE p_partkey NOT IN (SELECT p_partkey FROM n)")
def diff_deleted(spark, d):
    return diff.only_in(*_versions(spark, d), ["p_partkey"])


_LONG = "SELECT p_partkey, 'p_name' AS field, p_name AS value FROM {0} WHERE p_name IS NOT NULL UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM {0} WHERE p_brand IS NOT NULL UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR FROM {0} WHERE p_size IS NOT NULL"


@query(
    f"""WITH o0 AS ({_OLD}), n0 AS ({_NEW}), o AS ({_LONG.format("o0")}), n AS ({_LONG.format("n0")})
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, coalesce(o.field, n.field) AS field,
  CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'deleted' ELSE 'changed' END AS action, o.value AS old_value, n.value AS new_value
FROM o FULL JOIN n ON o.p_partkey = n.p_partkey AND o.field = n.field WHERE o.value IS DISTINCT FROM n.value"""
)
def diff_property_long(spark, d):
    return diff.property_diff(*_versions(spark, d), ["p_partkey"], _PART)


@query(f"SELECT action, count(*) AS n FROM ({_FULL}) WHERE action <> 'unchanged' GROUP BY action")
def diff_action_counts(spark, d):
    return diff_full_outer(spark, d).where("action <> 'unchanged'").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def last_row_per_key(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return diff.last_per_key(rows, ["o_custkey"], "o_orderkey")


@query(
    """WITH o AS (SELECT role, turn, min(text) AS text FROM conversations GROUP BY 1, 2),
n AS (SELECT role, CASE WHEN turn > 3 THEN turn + 2 ELSE turn END AS turn, CASE WHEN turn % 4 = 0 THEN min(text) ELSE max(text) END AS text FROM conversations GROUP BY role, conversations.turn)
SELECT coalesce(o.role, n.role) AS role, coalesce(o.turn, n.turn) AS pos,
  CASE WHEN o.role IS NULL THEN 'added' WHEN n.role IS NULL THEN 'deleted' WHEN o.text IS NOT DISTINCT FROM n.text THEN 'unchanged' ELSE 'changed' END AS action,
  o.text AS old_value, n.text AS new_value FROM o FULL JOIN n ON o.role = n.role AND o.turn = n.turn"""
)
def positional_list_diff(spark, d):
    c = table(spark, d, "conversations")
    old = c.groupBy("role", "turn").agg(F.min("text").alias("text"), F.max("text").alias("last"))
    new = old.select("role", F.when(F.col("turn") > 3, F.col("turn") + 2).otherwise(F.col("turn")).alias("turn"), F.when(F.col("turn") % 4 == 0, F.col("text")).otherwise(F.col("last")).alias("text"))
    return diff.positional_diff(old, new, ["role"], "turn", "text")


@query(
    """SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN count(*) OVER w > 1 THEN row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 END AS idx
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_returnflag)"""
)
def duplicate_sibling_index(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey")
    return diff.sibling_index(rows, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey"]).drop("l_partkey", "l_suppkey")


@query(
    """WITH o AS (SELECT p_brand, p_type AS name, max(p_size) AS value, min(p_name) AS status FROM part GROUP BY 1, 2),
n AS (SELECT p_brand, CASE WHEN max(p_size) > 45 THEN p_type || '+' ELSE p_type END AS name, max(p_size) AS value, max(p_name) AS status FROM part GROUP BY p_brand, p_type)
SELECT coalesce(o.p_brand, n.p_brand) AS p_brand, coalesce(o.name, n.name) AS name,
 CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'deleted' ELSE 'changed' END AS action,
 CASE WHEN o.name IS NOT NULL AND n.name IS NOT NULL AND o.value IS DISTINCT FROM n.value THEN 'error' WHEN o.name IS NOT NULL AND n.name IS NOT NULL AND o.status IS DISTINCT FROM n.status THEN 'warning' ELSE 'info' END AS severity,
 o.value AS old_value, n.value AS new_value
FROM o FULL JOIN n ON o.p_brand = n.p_brand AND o.name = n.name
WHERE o.name IS NULL OR n.name IS NULL OR o.value IS DISTINCT FROM n.value OR o.status IS DISTINCT FROM n.status"""
)
def symbolic_entry_diff(spark, d):
    p = table(spark, d, "part")

    e = p.groupBy("p_brand", "p_type").agg(F.max("p_size").alias("value"), F.min("p_name").alias("low"), F.max("p_name").alias("high"))
    side = lambda name, status: e.groupBy("p_brand").agg(F.collect_list(F.struct(name.alias("name"), "value", F.col(status).alias("status"))).alias("entries"))
    renamed = F.when(F.col("value") > 45, F.concat("p_type", F.lit("+"))).otherwise(F.col("p_type"))
    return diff.symbolic_diff(side(F.col("p_type"), "low"), side(renamed, "high"), ["p_brand"], "entries")


# --- paths and text ----------------------------------------------------------

_NORM = "array_to_string(list_transform(list_slice(string_split(url, '/'), 2, len(string_split(url, '/'))), lambda s: regexp_replace(s, '^[^:]*:', '')), '/')"


@query(f"SELECT page_id, {_NORM} AS path FROM pages")
def path_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", text.normalise_path(F.col("url")).alias("path"))


@query(
    """WITH s AS (SELECT page_id, list_filter(list_transform(string_split(url, '/'), lambda s: regexp_replace(s, '^[^:]*:', '')), lambda s: s <> '') AS p FROM pages)
SELECT page_id, array_to_string(CASE WHEN len(p) > 1 AND p[1] = p[2] THEN list_slice(p, 2, len(p)) ELSE p END, '/') AS path FROM s"""
)
def path_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", text.canonical_path(F.col("url")).alias("path"))


@query(
    """WITH s AS (SELECT page_id, list_filter(string_split(url, '/'), lambda s: s <> '') AS a, list_filter(string_split('https://thther.example.org/en/685', '/'), lambda s: s <> '') AS b FROM pages)
SELECT page_id, round(CASE WHEN greatest(len(a), len(b)) = 0 THEN 0 ELSE (
  CASE WHEN a[1] = b[1] THEN CASE WHEN a[2] = b[2] THEN CASE WHEN a[3] = b[3] THEN CASE WHEN a[4] = b[4] THEN 4 ELSE 3 END ELSE 2 END ELSE 1 END ELSE 0 END)
  / greatest(len(a), len(b))::DOUBLE END, 6) AS score FROM s"""
)
def path_shape_score(spark, d):
    return table(spark, d, "pages").select("page_id", F.round(text.path_shape(F.col("url"), F.lit("https://thther.example.org/en/685")), 6).alias("score"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^0-9a-z_]+'), lambda t: len(t) >= {})"


@query(f"SELECT doc_id, len({_WORDS.format(1)}) AS n_words, len(list_distinct({_WORDS.format(1)})) AS n_distinct FROM documents")
def tokenise_words(spark, d):
    w = text.words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


_KEYS = ["the", "with", "that", "les", "der", "para"]


@query(f"SELECT doc_id, array_to_string(list_filter(['the','with','that','les','der','para'], lambda k: list_contains({_WORDS.format(1)}, k)), ',') AS keywords FROM documents")
def keyword_detect(spark, d):
    keys = F.array(*[F.lit(k) for k in _KEYS])
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_intersect(keys, text.words(F.col("text"))), ",").alias("keywords"))


@query(f"""SELECT doc_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END, 6) AS score
FROM (SELECT doc_id, list_distinct({_WORDS.format(2)}) AS a, list_distinct(list_filter(regexp_split_to_array(lower('The attic and the theatre with that'), '[^0-9a-z_]+'), lambda t: len(t) >= 2)) AS b FROM documents)""")
def jaccard_similarity(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(retrieval.lexical_overlap(F.col("text"), F.lit("The attic and the theatre with that")), 6).alias("score"))


@query("SELECT doc_id, substr(sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 12) AS fingerprint FROM documents")
def fingerprint_sha1(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def dedup_first_occurrence(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


_MASK = r"""CASE WHEN v IS NULL OR trim(v) = '' THEN '<NO_VALUE>' WHEN v IN ('true', 'false') THEN '<BOOLEAN>'
 WHEN regexp_matches(v, '^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$') THEN '<MAC_ADDRESS>'
 WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}$|^\d+(\.\d+)+$') AND NOT regexp_matches(v, '^[+-]?\d+(\.\d+)?$') THEN '<VERSION>'
 WHEN regexp_matches(v, '^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)(/\d+)?$') OR regexp_matches(v, '^[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}(/[0-9]+)?$') THEN '<IP_ADDRESS>'
 WHEN regexp_matches(v, '^[+-]?\d+(\.\d+)?$') THEN '<NUMBER>'
 WHEN regexp_matches(v, '^\s*(min|-?\d+(\.\d+)?)\s*\.\.\s*(max|-?\d+(\.\d+)?)(\s*\|.*)?$') THEN '<RANGE>'
 WHEN regexp_matches(v, '^(\.\.?)?/[^\s]+$') THEN '<PATH>'
 WHEN regexp_matches(v, '^[A-Za-z_][A-Za-z0-9_.-]*$') THEN '<IDENTIFIER>'
 WHEN regexp_matches(v, '[\[\]{}*+?^$|\\]') THEN '<REGEX>' WHEN contains(trim(v), ' ') THEN '<LIST>' ELSE '<STRING>' END"""


@query(f"SELECT {_MASK} AS mask, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS v FROM documents) GROUP BY 1")
def mask_token_histogram(spark, d):
    v = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    return v.groupBy(text.mask(F.col("v")).alias("mask")).agg(F.sum("k").alias("n"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def xml_text_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))


@query("SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events")
def props_variant_extract(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.expr("try_variant_get(parse_json(props), '$.k', 'bigint')").alias("k"))


# --- matching ----------------------------------------------------------------

_SIDE = """SELECT *, 'n/' || kind || '/' || cents // 1000 % 10 AS path, ['p' || cents % 10, 'q' || cents // 10 % 10, 'r' || cents // 100 % 10, 'b' || thousands] AS items,
  CASE WHEN balance < 0 THEN ['debt'] WHEN balance > 5000 THEN ['credit', 'much'] ELSE ['credit'] END AS limits
FROM (SELECT {0}_{1}key AS id, {0}_nationkey AS kind, regexp_replace({0}_name, '^.*#0*', '') AS name, {0}_acctbal AS balance, abs(round({0}_acctbal * 100))::BIGINT AS cents, floor({0}_acctbal / 1000)::BIGINT AS thousands FROM {2})"""
_CAND = f"""WITH RECURSIVE o AS ({_SIDE.format("s", "supp", "supplier")}), n AS ({_SIDE.format("c", "cust", "customer")}), lone AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.kind = o.kind AND n.name = o.name)),
met AS (SELECT o, n, true AS same_name FROM o JOIN n ON o.kind = n.kind AND o.name = n.name UNION ALL SELECT l, n, false FROM lone l JOIN n ON l.kind = n.kind),
share AS (SELECT o, n, same_name, 100.0 * len(list_intersect(o.items, n.items)) / len(list_distinct(list_concat(o.items, n.items))) AS attrs, 100.0 * len(list_intersect(o.limits, n.limits)) / len(list_distinct(list_concat(o.limits, n.limits))) AS lims,
  100.0 * CASE WHEN o.path = n.path THEN 3 ELSE 2 END / 3 AS shape, 100.0 * (1 - levenshtein(o.name, n.name) / greatest(length(o.name), length(n.name), 1)) AS near FROM met),
cand AS (SELECT o.id AS o_id, n.id AS n_id, same_name, round(greatest(0, least(100, CASE WHEN same_name THEN 0.75 * attrs + 0.15 * lims + 0.10 * shape ELSE 0.60 * attrs + 0.20 * lims + 0.15 * near + 0.05 * shape END))::DOUBLE, 6) AS score
  FROM share WHERE same_name OR attrs >= {100 * matching.least_attributes(48.0)} - 1e-7)"""


def _rename_sides(spark, d):
    def side(name: str, s: str, key: str) -> DataFrame:
        balance = F.col(f"{s}_acctbal")
        cents = F.abs(F.round(balance * 100)).cast("long")
        digit = lambda i: (F.floor(cents / 10**i) % 10).cast("string")
        items = F.array(F.concat(F.lit("p"), digit(0)), F.concat(F.lit("q"), digit(1)), F.concat(F.lit("r"), digit(2)), F.concat(F.lit("b"), F.floor(balance / 1000).cast("string")))
        limits = F.when(balance < 0, F.array(F.lit("debt"))).when(balance > 5000, F.array(F.lit("credit"), F.lit("much"))).otherwise(F.array(F.lit("credit")))
        path = F.concat_ws("/", F.lit("n"), F.col(f"{s}_nationkey").cast("string"), digit(3))
        return table(spark, d, name).select(F.col(f"{s}_{key}").alias("id"), F.col(f"{s}_nationkey").alias("kind"), F.regexp_replace(f"{s}_name", "^.*#0*", "").alias("name"), path.alias("path"), items.alias("items"), limits.alias("limits"))

    return side("supplier", "s", "suppkey"), side("customer", "c", "custkey")


@query(f"{_CAND} SELECT o_id, n_id, same_name FROM cand")
def rename_candidates(spark, d):
    """All pairs of a kind that can reach the threshold."""
    pairs = matching.candidates(*_rename_sides(spark, d), "kind", "name", "items", matching.least_attributes(48.0))
    return pairs.select("o_id", "n_id", "same_name")


@query(f"{_CAND} SELECT o_id, n_id, score FROM cand WHERE score >= 48")
def rename_scores(spark, d):
    return matching.scored_pairs(*_rename_sides(spark, d), 48.0)


@query(
    f"""{_CAND}, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, o_id, n_id) AS i FROM cand WHERE score >= 48),
walk(i, lefts, rights, took) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], false UNION ALL
  SELECT r.i, CASE WHEN free THEN list_append(lefts, r.o_id) ELSE lefts END, CASE WHEN free THEN list_append(rights, r.n_id) ELSE rights END, free
  FROM (SELECT walk.lefts, walk.rights, ranked.*, NOT list_contains(walk.lefts, ranked.o_id) AND NOT list_contains(walk.rights, ranked.n_id) AS free FROM walk JOIN ranked ON ranked.i = walk.i + 1) r)
SELECT o_id, n_id, score FROM ranked JOIN walk USING (i) WHERE took"""
)
def greedy_assignment(spark, d):
    """Rows that differ in their ids alone are scored once and dealt out in the choice."""
    sides = [matching.with_rep(df) for df in _rename_sides(spark, d)]
    pairs = matching.scored_pairs(*[df.where("id = rep").drop("rep").distinct() for df in sides], 48.0)
    return matching.greedy_assign_copies(pairs, "o_id", "n_id", "score", *sides)


# --- rules -------------------------------------------------------------------

_RULES = [
    (1, "r-open", "O", None, "changed", None, None, None, None, None, rules.BC, None),
    (2, "r-done-high", "F", ["1-URGENT", "2-HIGH"], "changed", None, None, None, None, None, rules.NBC, None),
    (3, "r-done", "F", None, "changed", None, None, None, None, None, rules.CONDITIONAL, rules.NBC),
    (4, "r-never", "F", None, "added", None, None, None, None, None, rules.BC, None),
]
_RULE_SCHEMA = "ord int, rule_id string, subject string, parents array<string>, action string, parent_action string, value string, from_value string, to_value string, relaxed boolean, verdict string, verdict_strict string"
_RULE_SQL = """WITH r(ord, rule_id, subject, pa, pb, action, verdict, strict) AS (VALUES
 (1, 'r-open', 'O', NULL, NULL, 'changed', 'backward-compatible', NULL), (2, 'r-done-high', 'F', '1-URGENT', '2-HIGH', 'changed', 'non-backward-compatible', NULL),
 (3, 'r-done', 'F', NULL, NULL, 'changed', 'conditional-backward-compatible', 'non-backward-compatible'), (4, 'r-never', 'F', NULL, NULL, 'added', 'backward-compatible', NULL)),
m AS (SELECT o_orderkey, r.ord, r.rule_id, {0} AS verdict FROM orders JOIN r ON o_orderstatus = subject AND r.action = 'changed' AND (pa IS NULL OR o_orderpriority IN (pa, pb)) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY r.ord) = 1)
SELECT o.o_orderkey AS detail_id, m.rule_id, coalesce(m.verdict, '[UNMARKED]') AS verdict FROM orders o LEFT JOIN m USING (o_orderkey)"""


def _classified(spark, d, mode="default"):
    details = table(spark, d, "orders").select(F.col("o_orderkey").alias("detail_id"), F.col("o_orderstatus").alias("subject"), F.lit("changed").alias("action"), F.col("o_orderpriority").alias("parent"), F.lit("changed").alias("parent_action"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"), F.lit(None).cast("string").alias("change"))
    return rules.first_match(details, spark.createDataFrame(_RULES, _RULE_SCHEMA), mode)


@query(_RULE_SQL.format("r.verdict"))
def rule_first_match(spark, d):
    return _classified(spark, d).select("detail_id", "rule_id", "verdict")


@query(_RULE_SQL.format("coalesce(r.strict, r.verdict)"))
def rule_mode_select(spark, d):
    return _classified(spark, d, "rfc7950").select("detail_id", "rule_id", "verdict")


@query("WITH r AS (SELECT p_partkey::DOUBLE AS ord, 'r' || p_partkey AS rule_id, p_brand AS subject FROM part) SELECT * FROM r UNION ALL SELECT ord + 0.5, rule_id, 'X' FROM r WHERE subject = (SELECT min(subject) FROM r)")
def rule_clone(spark, d):
    """The rules of one brand again for a keyword that has none."""
    known = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("rule_id"), F.col("p_brand").alias("subject"))
    return rules.clone_rules(known, known.agg(F.min("subject")).first()[0], "X").select("ord", "rule_id", "subject")


_LISTS = """SELECT p_partkey, CASE WHEN {0} THEN 'unchanged' WHEN len(list_filter(a, lambda x: NOT list_contains(b, x))) > 0 THEN 'narrowed' WHEN len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0 THEN 'expanded' ELSE 'reordered' END AS change
FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, CASE p_partkey % 4 WHEN 0 THEN string_split(p_name, ' ') WHEN 1 THEN list_reverse(string_split(p_name, ' ')) WHEN 2 THEN list_append(string_split(p_name, ' '), 'new') ELSE list_slice(string_split(p_name, ' '), 2, len(string_split(p_name, ' '))) END AS b FROM part)"""


def _list_changes(spark, d, ordered):
    a = F.split("p_name", " ")
    b = F.when(F.col("p_partkey") % 4 == 0, a).when(F.col("p_partkey") % 4 == 1, F.reverse(a)).when(F.col("p_partkey") % 4 == 2, F.array_append(a, F.lit("new"))).otherwise(F.slice(a, F.lit(2), F.size(a)))
    return table(spark, d, "part").select("p_partkey", diff.list_change(a, b, ordered).alias("change"))


@query(_LISTS.format("a = b"))
def list_change_olist(spark, d):
    return _list_changes(spark, d, True)


@query(_LISTS.format("len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AND len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0"))
def list_change_ulist(spark, d):
    return _list_changes(spark, d, False)


_ROWS = """SELECT l_orderkey AS change_id, l_linenumber AS n, l_linenumber = 1 AS is_parent, CASE WHEN l_orderkey % 5 = 0 THEN 'deleted' ELSE 'changed' END AS action,
 CASE WHEN l_linenumber = 1 THEN {0} WHEN l_quantity > 45 THEN 'non-backward-compatible' WHEN l_quantity < 3 THEN '[UNMARKED]' ELSE 'backward-compatible' END AS verdict FROM lineitem"""


def _verdict_rows(spark, d, parent):
    v = F.when(F.col("l_linenumber") == 1, parent).when(F.col("l_quantity") > 45, rules.NBC).when(F.col("l_quantity") < 3, rules.UNMARKED).otherwise(rules.BC)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("change_id"), F.col("l_linenumber").alias("n"), (F.col("l_linenumber") == 1).alias("is_parent"), F.when(F.col("l_orderkey") % 5 == 0, "deleted").otherwise("changed").alias("action"), v.alias("verdict"))


@query(
    f"""SELECT change_id, n, is_parent, action, CASE WHEN is_parent AND verdict = 'conditional-backward-compatible' THEN CASE WHEN coalesce(min(CASE WHEN NOT is_parent THEN (verdict = 'backward-compatible')::INT END) OVER (PARTITION BY change_id), 1) = 1 THEN 'backward-compatible' ELSE 'non-backward-compatible' END ELSE verdict END AS verdict
FROM ({_ROWS.format("'conditional-backward-compatible'")})"""
)
def conditional_bool_and(spark, d):
    return rules.settle_conditional(_verdict_rows(spark, d, F.lit(rules.CONDITIONAL)))


@query(
    f"""WITH r AS ({_ROWS.format("CASE WHEN l_quantity > 20 THEN 'non-backward-compatible' ELSE 'backward-compatible' END")}),
w AS (SELECT *, max((is_parent AND verdict = 'non-backward-compatible')::INT) OVER p AS pn, max((is_parent AND action = 'deleted')::INT) OVER p AS pd, max((NOT is_parent AND verdict = 'non-backward-compatible')::INT) OVER p AS cn FROM r WINDOW p AS (PARTITION BY change_id))
SELECT change_id, n, is_parent, action, CASE WHEN NOT is_parent AND verdict <> '[UNMARKED]' AND pn = 1 AND (pd = 1 OR (cn = 0 AND verdict = 'backward-compatible')) THEN 'non-backward-compatible' ELSE verdict END AS verdict FROM w"""
)
def nbc_propagation(spark, d):
    return rules.propagate(_verdict_rows(spark, d, F.when(F.col("l_quantity") > 20, rules.NBC).otherwise(rules.BC)))


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def missing_references(spark, d):
    return rules.unresolved(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "part").where("p_size > 10"), "l_partkey", "p_partkey")


# --- report ------------------------------------------------------------------

_CHANGES = "SELECT o_orderkey AS change_id, CASE o_orderstatus WHEN 'O' THEN 'backward-compatible' WHEN 'F' THEN 'non-backward-compatible' ELSE '[UNMARKED]' END AS verdict FROM orders"
_DETAILS = "SELECT l_orderkey AS change_id, CASE WHEN l_quantity > 47 THEN 'non-backward-compatible' ELSE 'backward-compatible' END AS verdict, l_discount > 0.09 AS missing, l_returnflag || l_linestatus || (l_partkey % 50)::VARCHAR AS fingerprint FROM lineitem"


def _changes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("change_id"), F.when(F.col("o_orderstatus") == "O", rules.BC).when(F.col("o_orderstatus") == "F", rules.NBC).otherwise(rules.UNMARKED).alias("verdict"))
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("change_id"), F.when(F.col("l_quantity") > 47, rules.NBC).otherwise(rules.BC).alias("verdict"), (F.col("l_discount") > 0.09).alias("missing"), F.concat("l_returnflag", "l_linestatus", (F.col("l_partkey") % 50).cast("string")).alias("fingerprint"))
    return o, line


@query(
    f"""WITH c AS ({_CHANGES}), k AS (SELECT change_id, max((verdict = 'non-backward-compatible')::INT) AS nbc, max(missing::INT) AS gone FROM ({_DETAILS}) GROUP BY 1)
SELECT c.change_id, c.verdict, CASE WHEN coalesce(gone, 0) = 1 THEN 'other-errors' WHEN c.verdict = '[UNMARKED]' THEN 'unmarked' WHEN c.verdict = 'non-backward-compatible' OR coalesce(nbc, 0) = 1 THEN 'non_compatible' ELSE 'compatible' END AS section FROM c LEFT JOIN k USING (change_id)"""
)
def section_categorize(spark, d):
    return report.categorise(*_changes(spark, d))


@query(
    f"""WITH c AS ({_CHANGES}), dt AS ({_DETAILS}), good AS (SELECT DISTINCT fingerprint FROM dt WHERE verdict = 'backward-compatible' AND change_id % 3 = 0),
k AS (SELECT dt.change_id, bool_and(g.fingerprint IS NOT NULL) AS a FROM dt LEFT JOIN good g USING (fingerprint) GROUP BY 1)
SELECT c.change_id, CASE WHEN c.verdict = 'non-backward-compatible' AND coalesce(a, false) THEN 'backward-compatible' ELSE c.verdict END AS verdict FROM c LEFT JOIN k USING (change_id)"""
)
def bc_promotion(spark, d):
    c, details = _changes(spark, d)
    known = details.withColumn("verdict", F.when(F.col("change_id") % 3 == 0, F.col("verdict")).otherwise(rules.NBC))
    return report.promote(c, known)


@query(
    """SELECT l_returnflag, l_linestatus, l_shipdate::DATE AS day, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS paths, count(*) AS n, max(l_partkey) AS best_path,
 CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS l_suppkey, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1, 2, 3"""
)
def group_duplicates(spark, d):
    rows = table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    out = report.group_duplicates(rows, ["l_returnflag", "l_linestatus", "day"], F.col("l_partkey"), F.col("l_partkey"), ["l_suppkey"])
    return out.select("l_returnflag", "l_linestatus", "day", F.array_join(F.transform("paths", lambda x: x.cast("string")), ",").alias("paths"), "n", "best_path", "l_suppkey", F.size("l_suppkey_all").cast("long").alias("n_suppliers"))


@query(
    """SELECT l_returnflag, l_suppkey, l_partkey, array_to_string(list_sort(list_distinct(list(l_orderkey))), ',') AS paths, count(*) AS n FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1, 2, 3
UNION ALL SELECT l_returnflag, NULL, l_partkey, l_orderkey::VARCHAR, 1 FROM lineitem WHERE l_linenumber = 2"""
)
def merge_provenance(spark, d):
    rows = table(spark, d, "lineitem").withColumn("l_suppkey", F.when(F.col("l_linenumber") != 2, F.col("l_suppkey")))
    out = report.merge_by_source(rows, "l_suppkey", "l_partkey", ["l_returnflag"], "l_orderkey")
    return out.withColumn("paths", F.array_join(F.transform("paths", lambda x: x.cast("string")), ","))


_PATHS = "WITH u AS (SELECT DISTINCT array_to_string(list_slice(string_split(regexp_replace(url, '[?#].*$', ''), '/'), 3, 3 + (page_id % 3)::INT), '/') AS path FROM pages)"


@query(f"{_PATHS} SELECT path FROM u c WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.path <> c.path AND starts_with(c.path, p.path || '/'))")
def child_path_dedup(spark, d):
    path = F.array_join(F.slice(F.split(F.regexp_replace("url", "[?#].*$", ""), "/"), F.lit(3), F.col("page_id") % 3 + 1), "/")
    u = table(spark, d, "pages").select(path.alias("path")).distinct()
    return report.drop_covered_children(u, "path", [])


@query(
    """SELECT p_partkey, CASE WHEN o <> n AND regexp_replace(o, '/?[^/]*$', '') = regexp_replace(n, '/?[^/]*$', '') THEN 'renamed' WHEN o <> n THEN 'reallocated' ELSE 'changed' END AS kind
FROM (SELECT p_partkey, p_brand || '/' || p_type || '/' || p_name AS o, CASE p_partkey % 3 WHEN 0 THEN p_brand || '/' || p_type || '/' || p_name WHEN 1 THEN p_brand || '/' || p_type || '/x' ELSE p_brand || '/' || p_name END AS n FROM part)"""
)
def condense_moves(spark, d):
    p = table(spark, d, "part")
    j = lambda *c: F.concat_ws("/", *c)
    new = F.when(F.col("p_partkey") % 3 == 0, j("p_brand", "p_type", "p_name")).when(F.col("p_partkey") % 3 == 1, j("p_brand", "p_type", F.lit("x"))).otherwise(j("p_brand", "p_name"))
    rows = p.select("p_partkey", F.lit("changed").alias("action"), j("p_brand", "p_type", "p_name").alias("old_path"), new.alias("new_path"))
    return report.condense(rows).select("p_partkey", "kind")


@query("SELECT event_type AS keyword, min(event_id) AS change_id, arg_min(user_id, event_id) AS user_id FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1")
def uncovered_statements(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("change_id"), F.col("event_type").alias("keyword"), "user_id", F.lit(rules.UNMARKED).alias("verdict"))
    return report.uncovered(e, spark.createDataFrame([("view",), ("click",)], "keyword string")).select("keyword", "change_id", "user_id")


# --- intervals and closures --------------------------------------------------

_SPEC = "SELECT l_partkey, min(l_quantity) FILTER (WHERE l_linenumber <= 3) AS olow, max(l_quantity) FILTER (WHERE l_linenumber <= 3) AS ohigh, min(l_quantity) FILTER (WHERE l_linenumber > 1) AS nlow, max(l_quantity) FILTER (WHERE l_linenumber > 1) AS nhigh FROM lineitem GROUP BY 1"


@query(
    f"""SELECT l_partkey, CASE WHEN nlow <= olow AND nhigh >= ohigh AND olow <= nlow AND ohigh >= nhigh THEN 'equivalent' WHEN nlow <= olow AND nhigh >= ohigh THEN 'relaxed' WHEN olow <= nlow AND ohigh >= nhigh THEN 'narrowed' ELSE 'redefined' END AS change
FROM ({_SPEC}) WHERE olow IS NOT NULL AND nlow IS NOT NULL"""
)
def interval_containment(spark, d):
    q = lambda f, c: f(F.when(c, F.col("l_quantity").cast("int")))
    low, high = F.col("l_linenumber") <= 3, F.col("l_linenumber") > 1
    s = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.concat_ws("..", q(F.min, low), q(F.max, low)).alias("old"), F.concat_ws("..", q(F.min, high), q(F.max, high)).alias("new"))
    return s.where("old <> '' and new <> ''").select("l_partkey", intervals.interval_change(F.col("old"), F.col("new")).alias("change"))


@query(
    """SELECT p_partkey, name, CASE WHEN a = b THEN 'equivalent' WHEN name = 'min-elements' THEN CASE WHEN b < a THEN 'relaxed' ELSE 'narrowed' END WHEN name = 'max-elements' THEN CASE WHEN b > a THEN 'relaxed' ELSE 'narrowed' END ELSE CASE WHEN b > a THEN 'narrowed' ELSE 'relaxed' END END AS change
FROM (SELECT p_partkey, p_size AS a, (p_partkey * 7) % 50 + 1 AS b, CASE p_partkey % 3 WHEN 0 THEN 'min-elements' WHEN 1 THEN 'max-elements' ELSE 'fraction-digits' END AS name FROM part)"""
)
def constraint_number_change(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, "min-elements").when(F.col("p_partkey") % 3 == 1, "max-elements").otherwise("fraction-digits")
    p = table(spark, d, "part").select("p_partkey", name.alias("name"), F.col("p_size").cast("string").alias("a"), (F.col("p_partkey") * 7 % 50 + 1).cast("string").alias("b"))
    return p.select("p_partkey", "name", intervals.number_change(F.col("name"), F.col("a"), F.col("b")).alias("change"))


@query(
    """WITH RECURSIVE e(child, parent) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
c(child, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT c.child, e.parent, c.depth + 1 FROM c JOIN e ON c.ancestor = e.child) SELECT * FROM c"""
)
def typedef_closure(spark, d):
    j = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table(spark, d, "nation").select(j("n", "n_nationkey").alias("child"), j("r", "n_regionkey").alias("parent"))
    e = e.unionByName(table(spark, d, "customer").select(j("c", "c_custkey").alias("child"), j("n", "c_nationkey").alias("parent")))
    e = e.unionByName(table(spark, d, "region").select(j("r", "r_regionkey").alias("child"), F.lit("world").alias("parent")))
    return graph.closure(e, "child", "parent")


@query(
    """WITH n AS (SELECT conv_id, turn, turn - 1 AS up FROM conversations), w AS (SELECT * FROM n)
SELECT w.conv_id, w.turn, 'parent' AS kind, n.turn AS other_turn FROM w JOIN n ON n.conv_id = w.conv_id AND n.turn = w.up
UNION ALL SELECT w.conv_id, w.turn, 'child', n.turn FROM w JOIN n ON n.conv_id = w.conv_id AND n.up = w.turn"""
)
def graph_neighbors(spark, d):
    n = table(spark, d, "conversations").select("conv_id", "turn", F.col("conv_id").alias("up_conv"), (F.col("turn") - 1).alias("up"))
    return graph.neighbours(n, n, ["conv_id", "turn"], ["up_conv", "up"]).select("conv_id", "turn", "kind", "other_turn")


# --- retrieval ---------------------------------------------------------------

_QUERY_TERMS = ["the", "with", "theatre", "les"]


@query(
    f"""WITH t AS (SELECT doc_id, {_WORDS.format(1)} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
q AS (SELECT unnest(['the','with','theatre','les']) AS term), tf AS (SELECT t.doc_id, q.term, len(t.w) AS dl, len(list_filter(t.w, lambda x: x = q.term)) AS f FROM t, q),
df AS (SELECT term, count(*) FILTER (WHERE f > 0) AS df FROM tf GROUP BY 1),
s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM tf JOIN df USING (term), n GROUP BY 1 HAVING sum(f) > 0)
SELECT doc_id, round(score, 5) AS score FROM s ORDER BY round(score, 5) DESC, doc_id LIMIT 20"""
)
def bm25_topk(spark, d):
    s = retrieval.bm25(table(spark, d, "documents"), _QUERY_TERMS, "doc_id", "text").withColumn("score", F.round("score", 5))
    return s.orderBy(F.desc("score"), "doc_id").limit(20)


_VEC = [math_value / 10 - 3.0 for math_value in range(64)]
_COS = "list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: i / 10.0 - 3.0)::DOUBLE[])"


@query(f"SELECT row_number() OVER (ORDER BY score DESC, vec_id DESC) AS rank, vec_id, round(score, 5) AS score FROM (SELECT vec_id, {_COS} AS score FROM embeddings) ORDER BY rank LIMIT 10")
def vector_topk_cosine(spark, d):
    return retrieval.vector_topk(table(spark, d, "embeddings"), _VEC, 10, "vec_id", "embedding").withColumn("score", F.round("score", 5))


@query(f"SELECT row_number() OVER (ORDER BY score DESC, vec_id DESC) AS rank, vec_id, round(score, 5) AS score FROM (SELECT vec_id, {_COS} AS score FROM embeddings WHERE label <= 2) ORDER BY rank LIMIT 10")
def vector_prefilter_topk(spark, d):
    return retrieval.vector_topk(table(spark, d, "embeddings"), _VEC, 10, "vec_id", "embedding", F.col("label") <= 2).withColumn("score", F.round("score", 5))


@query(f"SELECT row_number() OVER (ORDER BY score DESC, vec_id DESC) AS rank, vec_id, round(score, 5) AS score FROM (SELECT vec_id, {_COS} AS score FROM embeddings WHERE vec_id % 3 = 1) ORDER BY rank LIMIT 50")
def vector_index_topk(spark, d):
    """The index over all vectors, searched with a filter that leaves a third of them."""
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex[:12]}"
    vector_index.write(table(spark, d, "embeddings").select("vec_id", "embedding"), folder, "embedding")
    found = vector_index.VectorIndex(spark, folder, "vec_id", "embedding").search(_VEC, 50, F.col("vec_id") % 3 == 1)
    return retrieval.ranked(found.select("vec_id", "score"), [F.desc("score"), F.desc("vec_id")]).withColumn("score", F.round("score", 5))


@query(
    f"""WITH a AS (SELECT vec_id, {_COS} AS score FROM embeddings), b AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: 3.0 - i / 10.0)::DOUBLE[]) AS score FROM embeddings)
SELECT vec_id, round(max(score), 5) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1"""
)
def multi_query_merge(spark, d):
    e = table(spark, d, "embeddings")
    one = lambda v: e.select("vec_id", retrieval.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in v])).alias("score"))
    return retrieval.merge_queries([one(_VEC), one([-x for x in _VEC])], "vec_id").withColumn("score", F.round("score", 5))


_HYB = f"""WITH f AS (SELECT doc_id, source, lang, list_distinct({_WORDS.format(2)}) AS a, list_distinct(list_filter(regexp_split_to_array(lower('the theatre with that thing'), '[^0-9a-z_]+'), lambda t: len(t) >= 2)) AS b FROM documents),
s AS (SELECT doc_id, source, 0.30 * (CASE WHEN lang = 'en' THEN 1 ELSE 0 END) + 0.05 * (CASE WHEN source = 'src1' THEN 1 ELSE 0 END) + 0.05 * (CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END) AS score FROM f)"""


def _hybrid(spark, d):
    features = {"structure": (F.col("lang") == "en").cast("double"), "category": (F.col("source") == "src1").cast("double"), "lexical": retrieval.lexical_overlap(F.col("text"), F.lit("the theatre with that thing"))}
    return table(spark, d, "documents").select("doc_id", "source", retrieval.fuse(features).alias("score"))


@query(f"{_HYB} SELECT row_number() OVER (ORDER BY round(score, 5) DESC, doc_id) AS rank, doc_id, round(score, 7) AS score FROM s ORDER BY rank LIMIT 25")
def hybrid_rerank(spark, d):
    return retrieval.rerank(_hybrid(spark, d), 25, "doc_id").select("rank", "doc_id", F.round("score", 7).alias("score"))


@query(f"{_HYB} SELECT source, arg_max(doc_id, struct_pack(s := round(score, 7), d := -doc_id)) AS doc_id, round(max(score), 7) AS score, count(*) AS n FROM s WHERE score >= 0.1 GROUP BY source")
def best_per_keyword(spark, d):
    return retrieval.best_per_keyword(_hybrid(spark, d).withColumn("score", F.round("score", 7)), "source", "doc_id")


@query("SELECT lang, source, count(*) AS n, sum(n_chars) AS n_chars FROM documents GROUP BY 1, 2")
def category_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 5")
def per_keyword_cap(spark, d):
    return retrieval.cap_per_key(table(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"], 5)


@query("SELECT source, doc_id FROM documents WHERE source IN ('src1', 'src2') UNION ALL SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE source NOT IN ('src1', 'src2')) WHERE r <= 5")
def keyword_coverage(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    return retrieval.cover_keywords(docs.where("source in ('src1', 'src2')"), docs, "source", ["doc_id"])


@query(
    """SELECT event_id, CASE WHEN q = d THEN 1.0 WHEN q = 'ATTRIBUTE, CONSTRAINT' AND d IN ('ATTRIBUTE', 'CONSTRAINT') THEN 1.0 WHEN d = 'ATTRIBUTE, CONSTRAINT' AND q IN ('ATTRIBUTE', 'CONSTRAINT') THEN 1.0 ELSE 0.0 END::DOUBLE AS score
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ATTRIBUTE, CONSTRAINT' WHEN 1 THEN 'STRUCTURAL' ELSE 'ATTRIBUTE' END AS q, CASE event_type WHEN 'view' THEN 'ATTRIBUTE' WHEN 'click' THEN 'CONSTRAINT' WHEN 'error' THEN 'ATTRIBUTE, CONSTRAINT' ELSE 'STRUCTURAL' END AS d FROM events)"""
)
def category_match(spark, d):
    q = F.when(F.col("event_id") % 3 == 0, "ATTRIBUTE, CONSTRAINT").when(F.col("event_id") % 3 == 1, "STRUCTURAL").otherwise("ATTRIBUTE")
    c = F.when(F.col("event_type") == "view", "ATTRIBUTE").when(F.col("event_type") == "click", "CONSTRAINT").when(F.col("event_type") == "error", "ATTRIBUTE, CONSTRAINT").otherwise("STRUCTURAL")
    return table(spark, d, "events").select("event_id", retrieval.category_score(q, c).alias("score"))


@query("SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS first FROM conversations")
def previous_token_context(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("previous"), F.first("role").over(w).alias("first"))


# --- lattices and streams ----------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 <= p_size % 10 THEN 'relaxed' ELSE 'narrowed' END AS change FROM part")
def condition_change(spark, d):
    old = F.concat(F.lit("../size > "), (F.col("p_size") % 10).cast("string"))
    new = F.concat(F.lit("../size >= "), (F.col("p_partkey") % 7).cast("string"))
    return table(spark, d, "part").select("p_partkey", conditions.condition_change(old, new).alias("change"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 > p_size % 9 THEN 'relaxed' WHEN p_partkey % 9 < p_size % 9 THEN 'narrowed' ELSE 'equivalent' END AS change FROM part")
def regex_inclusion(spark, d):
    up_to = lambda c: F.concat(F.lit("[a-z]{1,"), (F.col(c) % 9 + 1).cast("string"), F.lit("}x?"))
    return table(spark, d, "part").select("p_partkey", regex_change(up_to("p_size"), up_to("p_partkey")).alias("change"))


@query(
    """WITH t(i, low, high) AS (VALUES (0, -128::HUGEINT, 127::HUGEINT), (1, -32768, 32767), (2, -2147483648, 2147483647), (3, -9223372036854775808, 9223372036854775807), (4, 0, 255), (5, 0, 65535), (6, 0, 4294967295), (7, 0, 18446744073709551615))
SELECT p_partkey, CASE WHEN o.i = n.i THEN 'equivalent' WHEN n.low <= o.low AND n.high >= o.high THEN 'relaxed' ELSE 'narrowed' END AS change FROM part JOIN t o ON p_size % 8 = o.i JOIN t n ON p_partkey % 8 = n.i"""
)
def type_value_space(spark, d):
    names = F.array(*[F.lit('{"name": "%s"}' % n) for n in ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64")])
    pick = lambda c: F.get(names, (F.col(c) % 8).cast("int"))
    return table(spark, d, "part").select("p_partkey", types.type_change(pick("p_size"), pick("p_partkey")).alias("change"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'box/' || p_brand || '/x' WHEN 1 THEN 'box/y/z' WHEN 2 THEN NULL ELSE 'box/' || p_brand || '/node/low' END AS path FROM part"""
)
def xpath_resolve(spark, d):
    context = F.concat(F.lit("box/"), F.col("p_brand"), F.lit("/node"))
    path = F.when(F.col("p_partkey") % 4 == 0, "../p:x").when(F.col("p_partkey") % 4 == 1, "/p:y[id = '1']/p:z").when(F.col("p_partkey") % 4 == 2, "../../../q").otherwise("current()/low")
    return table(spark, d, "part").select("p_partkey", xpath.resolve(context, path).alias("path"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    w = live.windowed_counts(table(spark, d, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("value", 3).alias("value"))


@query("SELECT o_orderkey, CASE WHEN c IN ('relaxed') THEN CASE o_orderstatus WHEN 'O' THEN 'confirmed' ELSE 'conflict' END WHEN c = 'narrowed' THEN CASE o_orderstatus WHEN 'F' THEN 'confirmed' ELSE 'conflict' END ELSE 'unverified' END AS outcome FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'relaxed' WHEN 1 THEN 'narrowed' END AS c FROM orders)")
def verification_outcome(spark, d):
    change = F.when(F.col("o_orderkey") % 3 == 0, "relaxed").when(F.col("o_orderkey") % 3 == 1, "narrowed")
    verdict = F.when(F.col("o_orderstatus") == "O", rules.BC).when(F.col("o_orderstatus") == "F", rules.NBC).otherwise(rules.UNMARKED)
    rows = table(spark, d, "orders").select("o_orderkey", change.alias("change"), verdict.alias("verdict"))
    return verify.verify(rows).select("o_orderkey", "outcome")


@query(
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(e, '\\sand\\s') THEN 'and' END, CASE WHEN regexp_matches(e, '\\sor\\s') THEN 'or' END, CASE WHEN regexp_matches(e, '[^!<>]=') THEN 'equal' END, CASE WHEN regexp_matches(e, '[<>]') THEN 'order' END], lambda x: x IS NOT NULL), ',') AS profile
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a = ' || p_size || ' and b' WHEN 1 THEN 'a > ' || p_size || ' or c' WHEN 2 THEN 'a' ELSE 'a = 1 or b < 2' END AS e FROM part)"""
)
def expression_profile(spark, d):
    size = F.col("p_size").cast("string")
    e = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("a = "), size, F.lit(" and b"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("a > "), size, F.lit(" or c"))).when(F.col("p_partkey") % 4 == 2, "a").otherwise("a = 1 or b < 2")
    return table(spark, d, "part").select("p_partkey", F.array_join(text.expression_profile(e), ",").alias("profile"))


@query("SELECT c_mktsegment AS home, count(*) AS n, sum(CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END)::BIGINT AS without FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def enrich_left_join(spark, d):
    """The shape of joining report rows to expansions: all rows stay."""
    c, o = table(spark, d, "customer").select("c_custkey", "c_mktsegment"), table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_mktsegment").alias("home")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey").isNull()).alias("without"))
