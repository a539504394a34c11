"""Scalar expressions on paths, tokens and values; all but block_ratio are built-in functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import model
from tessera.session import ship

# The mask tokens that stand for values in snippets.
MASKS = ("<STRING>", "<IDENTIFIER>", "<TYPEDEF>", "<VERSION>", "<REGEX>", "<MAC_ADDRESS>", "<IP_ADDRESS>", "<NUMBER>", "<RANGE>", "<BOOLEAN>", "<LIST>", "<PATH>", "<NO_VALUE>", "<CONDITION>")


def strip_prefixes(path: Column) -> Column:
    """Every ``prefix:`` before a name goes; the names and separators stay."""
    return F.regexp_replace(path, r"[A-Za-z_][A-Za-z0-9_.-]*:(?=[A-Za-z_])", "")


def segments(path: Column) -> Column:
    """Non-empty segments of a path."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def normalise_path(path: Column) -> Column:
    """Without the first segment (the module) and without prefixes in the others; empty
    segments stay."""
    parts = F.split(path, "/")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.array_join(F.transform(rest, lambda s: F.regexp_replace(s, "^[^:]*:", "")), "/")


def canonical_path(path: Column) -> Column:
    """Non-empty segments without prefixes; a repeated head segment counts once."""
    parts = F.filter(F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, "^[^:]*:", "")), lambda s: s != "")
    return F.array_join(F.when((F.size(parts) > 1) & (F.get(parts, F.lit(0)) == F.get(parts, F.lit(1))), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts), "/")


def path_quality(path: Column) -> Column:
    """For max_by: prefixed paths first, then without empty segments, shallow and short."""
    return F.struct(path.contains(":").cast("int"), (~path.contains("//")).cast("int"), -F.size(F.split(path, "/")), -F.length(path))


def parent_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def ancestors(path: Column) -> Column:
    """All proper prefixes of a path, shortest first."""
    parts = segments(path)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    return F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.struct((s["on"] & x).alias("on"), (s["n"] + (s["on"] & x).cast("int")).alias("n")), lambda s: s["n"])


def path_shape(a: Column, b: Column) -> Column:
    """Shared leading segments over the longer path's segments; 0 for two empty paths."""
    x, y = segments(a), segments(b)
    n = F.greatest(F.size(x), F.size(y))
    return F.when(n > 0, common_prefix(x, y) / n).otherwise(F.lit(0.0))


def words(text: Column, least: int = 1) -> Column:
    """Lower-case runs of letters of a-z, digits and underscores, of at least that length."""
    parts = F.array_remove(F.split(F.lower(text), "[^0-9a-z_]+"), "")
    return parts if least <= 1 else F.filter(parts, lambda t: F.length(t) >= least)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it: projections that
    are merged would compute it for each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def jaccard(a: Column, b: Column, empty: float = 100.0, scale: float = 100.0) -> Column:
    """Jaccard index of two arrays as sets; ``empty`` where both are."""
    sizes = let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.struct(F.size(F.array_union(s["a"], s["b"])).alias("u"), F.size(F.array_intersect(s["a"], s["b"])).alias("i")))
    return let(sizes, lambda s: F.when(s["u"] == 0, F.lit(empty)).otherwise(F.lit(scale) * s["i"] / s["u"]))


def identifier_form(name: Column) -> Column:
    """Names that differ only in case, hyphens and underscores become equal."""
    return F.lower(F.regexp_replace(name, "[-_]+", ""))


def block_ratio(a: Column, b: Column) -> Column:
    """0 to 100: twice the characters in common blocks over all characters, where the
    longest common block is taken first and then those left and right of it. Nulls are
    empty; each distinct pair of a batch is computed once."""
    ship()

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        pairs = list(zip(x.fillna(""), y.fillna("")))
        done = {p: 100.0 * SequenceMatcher(None, *p).ratio() for p in set(pairs)}
        return pd.Series([done[p] for p in pairs], dtype=float)

    return run(a, b)


def fingerprint(text: Column) -> Column:
    """Twelve hex digits of SHA-1 over the text with single spaces."""
    return F.substring(F.sha1(F.trim(F.regexp_replace(text, r"\s+", " ")).cast("binary")), 1, 12)


def is_mac(value: Column) -> Column:
    return value.rlike("^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$")


def is_ip(value: Column) -> Column:
    return value.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)(/\d+)?$") | value.rlike("^[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}(/[0-9]+)?$")


def is_number(value: Column) -> Column:
    return value.rlike(r"^[+-]?\d+(\.\d+)?$")


def is_range(value: Column) -> Column:
    return value.rlike(r"^\s*(min|-?\d+(\.\d+)?)\s*\.\.\s*(max|-?\d+(\.\d+)?)(\s*\|.*)?$")


def is_version(value: Column) -> Column:
    return value.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d+(\.\d+)+$")


def is_identifier(value: Column) -> Column:
    return value.rlike("^[A-Za-z_][A-Za-z0-9_.-]*$")


def is_regex(value: Column) -> Column:
    return value.rlike(r"[\[\]{}*+?^$|\\]")


def is_path(value: Column) -> Column:
    return value.rlike(r"^(\.\.?)?/[^\s]+$")


def mask(value: Column, plain: str = "<STRING>") -> Column:
    """The mask token of one value, by the first class that fits it."""
    return (
        F.when(value.isNull() | (F.trim(value) == ""), "<NO_VALUE>")
        .when(value.isin("true", "false"), "<BOOLEAN>")
        .when(is_mac(value), "<MAC_ADDRESS>")
        .when(is_version(value) & ~is_number(value), "<VERSION>")
        .when(is_ip(value), "<IP_ADDRESS>")
        .when(is_number(value), "<NUMBER>")
        .when(is_range(value), "<RANGE>")
        .when(is_path(value), "<PATH>")
        .when(is_identifier(value), "<IDENTIFIER>")
        .when(is_regex(value), "<REGEX>")
        .when(F.trim(value).contains(" "), "<LIST>")
        .otherwise(plain)
    )


# Keywords whose argument is a name, true or false, a number, or a condition.
NAMED = ("leaf", "container", "list", "leaf-list", "grouping", "typedef", "identity", "extension", "feature", "rpc", "notification", "action", "choice", "case", "bit", "enum")
BOOLEAN = ("config", "mandatory", "ordered-by", "yin-element", "require-instance")
NUMERIC = ("min-elements", "max-elements", "fraction-digits", "position", "value")
SPANS, CONDITIONS, KEYS = ("range", "length"), ("when", "must", "if-feature"), ("key", "unique")
MARKS = ("{", "}", ";", ",", "(", ")", "[", "]")


def unquoted(token: Column) -> Column:
    return F.when(token.rlike("(?s)^\".*\"$|^'.*'$"), F.substr(token, F.lit(2), F.length(token) - 2)).otherwise(token)


def mask_argument(keyword: Column, token: Column, typedefs: Column | None = None) -> Column:
    """The mask of the argument of a keyword. Built-in types and marks stay; a type that has
    a prefix or is among ``typedefs`` (an array; null for any) is a typedef."""

    def by_keyword(s: Column) -> Column:
        keyword, value, quoted = s["keyword"], s["value"], token.rlike("^[\"']")
        known = F.lit(True) if typedefs is None else F.coalesce(F.array_contains(typedefs, value), F.lit(False))
        return (
            F.when(token.isin(*MARKS), token)
            .when((keyword == "type") & value.isin(*model.BUILTIN), value)
            .when((keyword == "type") & (value.contains(":") | known), "<TYPEDEF>")
            .when(keyword.isin(*NAMED), "<IDENTIFIER>")
            .when(keyword.isin(*CONDITIONS), "<CONDITION>")
            .when(keyword == "pattern", "<REGEX>")
            .when(keyword.isin(*BOOLEAN) & value.isin("true", "false"), "<BOOLEAN>")
            .when(keyword.isin(*SPANS), F.when(value.rlike(r"\.\.|\|"), "<RANGE>").otherwise("<NUMBER>"))
            .when(keyword.isin(*NUMERIC), "<NUMBER>")
            .when(keyword.isin(*KEYS), F.when(F.trim(value).contains(" "), "<LIST>").otherwise("<IDENTIFIER>"))
            .when(quoted & (keyword == "path"), "<PATH>")
            .when(quoted & F.trim(value).contains(" "), "<STRING>")
            .otherwise(mask(value))
        )

    return let(F.struct(keyword.alias("keyword"), unquoted(token).alias("value")), by_keyword)


def mask_snippet(tokens: Column, keywords: tuple[str, ...], typedefs: Column | None = None) -> Column:
    """The tokens of a statement's text masked one after the other, each by the one before
    it. Marks stay; where a statement begins (after a mark or nothing) its keyword stays,
    one of an extension inside a block without its prefix; an argument is masked by its
    keyword."""

    def one(t: Column, i: Column) -> Column:
        before = F.coalesce(F.get(tokens, i - 1), F.lit("{"))
        begins = before.isin("{", "}", ";")
        head = F.when((i == 0) | ~t.contains(":"), t).otherwise(let(F.regexp_replace(t, "^[^:]*:", ""), lambda n: F.when(n.isin(*keywords), t).otherwise(n)))
        return F.when(t.isin(*MARKS), t).when(begins, head).otherwise(mask_argument(F.regexp_replace(before, "^[^:]*:", ""), t, typedefs))

    return F.transform(tokens, one)


def snippet_tokens(text: Column) -> Column:
    """Tokens of a statement's text: quoted strings and a..b ranges stay whole."""
    # possessive: a run without marks is a token, so nothing is tried again
    return F.regexp_extract_all(text, F.lit(r"[^\s{};\"']++|\"[^\"]*+\"|'[^']*+'|[{};]"), F.lit(0))


def strip_tag(text: Column) -> Column:
    """Without a <tag> at the end."""
    return F.regexp_replace(text, r"\s*<[^<>]*>\s*$", "")


def split_values(text: Column, separator: Column) -> Column:
    """Non-empty values by a declared separator (a name or the mark itself), else blanks."""
    mark = F.coalesce(F.when(separator == "comma", ",").when(separator == "semicolon", ";").when(separator == "pipe", "|").when(separator == "space", " ").otherwise(separator), F.lit(" "))
    parts = F.when(F.trim(mark) == "", F.split(text, r"\s+")).otherwise(F.split(text, F.concat(F.lit("\\Q"), mark, F.lit("\\E"))))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def expression_profile(expr: Column) -> Column:
    """Which kinds of operators an expression uses, in a fixed order."""
    kinds = {"and": r"\sand\s", "or": r"\sor\s", "not": r"not\s*\(", "equal": r"[^!<>]=", "unequal": "!=", "order": "[<>]", "function": r"[a-z-]+\(", "predicate": r"\[", "parent": r"\.\."}
    return F.filter(F.array(*[F.when(expr.rlike(r), F.lit(k)) for k, r in kinds.items()]), lambda x: x.isNotNull())


def pattern_profile(pattern: Column) -> Column:
    """Which constructs a regular expression uses, in a fixed order."""
    kinds = {"class": r"\[", "repeat": r"[*+?]|\{\d", "either": r"\|", "group": r"\(", "escape": r"\\[dwspDWSP]", "anchor": r"[\^$]", "any": r"(^|[^\\])\."}
    return F.filter(F.array(*[F.when(pattern.rlike(r), F.lit(k)) for k, r in kinds.items()]), lambda x: x.isNotNull())


def repair_skeleton(path: Column, parent: Column, keyword: Column) -> Column:
    """A skeleton path that starts at module, ends in the keyword and has the parent
    right before it; consecutive repeats count once."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "module") & (s != keyword))
    tail = F.when(parent.isNotNull() & (F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")) != parent) & (parent != "module"), F.array(parent)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.lit("module")), parts, tail, F.array(keyword)), "/")


def keyword_window(tokens: Column, keywords: Column, size: int = 8) -> Column:
    """At most ``size`` tokens from the one before the first known keyword on."""
    at = F.aggregate(F.transform(tokens, lambda t: F.array_contains(keywords, t)), F.struct(F.lit(0).alias("i"), F.lit(0).alias("hit")), lambda s, x: F.struct((s["i"] + 1).alias("i"), F.when((s["hit"] == 0) & x, s["i"] + 1).otherwise(s["hit"]).alias("hit")), lambda s: s["hit"])
    return F.slice(tokens, F.greatest(at - 1, F.lit(1)), F.lit(size))
