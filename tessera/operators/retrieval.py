"""Retrieval: term and vector scores, features, fusion and top-k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import jaccard, let, words
from tessera.session import cut, stored

# The weights of the features of a candidate.
WEIGHTS = {
    "structure": 0.30,
    "description": 0.05,
    "path_shape": 0.10,
    "keywords": 0.05,
    "category": 0.05,
    "neighbours": 0.05,
    "lexical": 0.05,
    "bm25": 0.05,
    "tokens": 0.30,
}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a vector is zero or lengths differ."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def vector_topk(docs: DataFrame, query: list[float], k: int, id_col: str, vec_col: str, where: Column | None = None) -> DataFrame:
    """rank, id, score of the k nearest by cosine after an optional filter; ties to the
    larger id. A top-k plan: each task keeps k rows."""
    rows = docs if where is None else docs.where(where)
    scored = rows.select(id_col, cosine(F.col(vec_col), F.array(*[F.lit(float(x)) for x in query])).alias("score")).where("score is not null")
    return ranked(scored.orderBy(F.desc("score"), F.desc(id_col)).limit(k), [F.desc("score"), F.desc(id_col)])


def ranked(few: DataFrame, order: list[Column], partition: list[str] | None = None) -> DataFrame:
    """rank from 1: over all rows, for a result already limited to its k, or by partition."""
    w = (Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))).orderBy(*order)
    return few.select(F.row_number().over(w).alias("rank"), "*")


def bm25(docs: DataFrame, query: list[str], id_col: str, text_col: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents that hold a query term, by BM25 with the idf
    ln(1 + (N - df + 0.5) / (df + 0.5)).

    Texts are read once, for the term counts, which are written; the corpus numbers (a
    row) and each document's score come from these, with no shuffle of postings."""
    terms = sorted(set(query))
    toks = words(F.col(text_col))
    counted = let(toks, lambda t: F.struct(F.size(t).alias("len"), *[(F.size(t) - F.size(F.array_remove(t, q))).alias(f"tf{i}") for i, q in enumerate(terms)]))
    tf = cut(docs.select(id_col, counted.alias("c")).select(id_col, "c.*"))
    total = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    mean = total.avg or 1.0
    score = F.lit(0.0)
    for i in range(len(terms)):
        df = total[f"df{i}"]
        idf = math.log(1 + (total.n - df + 0.5) / (df + 0.5))
        score = score + F.lit(idf) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / mean))
    hit = " or ".join(f"tf{i} > 0" for i in range(len(terms))) or "false"
    return tf.where(hit).select(id_col, score.alias("score"))


def max_normalised(rows: DataFrame, column: str) -> DataFrame:
    """``column`` over its largest value (0 where that is not positive)."""
    top = rows.agg(F.max(column)).first()[0] or 0.0
    return rows.withColumn(column, F.col(column) / top if top > 0 else F.lit(0.0))


def category_score(query: Column, doc: Column) -> Column:
    """1 for one category, or where one side is the mixed one and the other fits it."""
    mixed = "ATTRIBUTE, CONSTRAINT"
    return F.when(query == doc, 1.0).when((query == mixed) & doc.isin("ATTRIBUTE", "CONSTRAINT"), 1.0).when((doc == mixed) & query.isin("ATTRIBUTE", "CONSTRAINT"), 1.0).otherwise(0.0)


def category(keywords: Column, structural: list[str], constraint: list[str], attribute: list[str], extension: Column, block: Column, order: str = "corpus") -> Column:
    """Category of a statement: constraints first in the corpus, structure first for a
    query; an extension is structural with a block and mixed without."""
    has = lambda names: F.arrays_overlap(keywords, F.array(*[F.lit(x) for x in names]))
    first = [(has(constraint), "CONSTRAINT"), (has(structural), "STRUCTURAL")]
    out = F.when(extension, F.when(block, "STRUCTURAL").otherwise("ATTRIBUTE, CONSTRAINT"))
    for cond, name in [*(first if order == "corpus" else first[::-1]), (has(attribute), "ATTRIBUTE")]:
        out = out.when(cond, name)
    return out.otherwise("ATTRIBUTE, CONSTRAINT")


def token_match(query: Column, doc: Column) -> Column:
    """Share of the query's mask tokens that the document has; identifiers count as
    strings. 0 where only the query has any, 1 where the query has none."""
    same = lambda a: F.array_distinct(F.transform(a, lambda t: F.when(t == "<IDENTIFIER>", "<STRING>").otherwise(t)))
    q, d = same(query), same(doc)
    return F.when(F.size(q) == 0, 1.0).when(F.size(d) == 0, 0.0).otherwise(F.size(F.array_intersect(q, d)) / F.size(q))


def neighbour_score(query: Column, near: Column, structural: list[str]) -> Column:
    """Share of the query's keywords that a parent or child has, else 0.1 beside a
    structural one."""
    shared = F.size(F.array_intersect(query, near))
    near_structure = F.arrays_overlap(near, F.array(*[F.lit(x) for x in structural]))
    return F.when(F.size(query) == 0, 0.0).when(shared > 0, shared / F.size(query)).when(near_structure, 0.1).otherwise(0.0)


def keyword_overlap(a: Column, b: Column) -> Column:
    return jaccard(a, b, empty=0.0, scale=1.0)


def lexical_overlap(a: Column, b: Column) -> Column:
    """Jaccard of the distinct words of at least two characters."""
    x, y = F.array_distinct(words(a, 2)), F.array_distinct(words(b, 2))
    # of two sets, what both have tells the size of what either has
    sizes = let(F.struct(x.alias("x"), y.alias("y")), lambda s: F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("i"), (F.size(s["x"]) + F.size(s["y"])).alias("n")))
    return F.when(a.isNotNull() & b.isNotNull(), let(sizes, lambda s: F.when(s["n"] == s["i"], F.lit(0.0)).otherwise(s["i"] / (s["n"] - s["i"]))))


def fuse(features: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of features; missing ones count 0."""
    out = F.lit(0.0)
    for name, w in (weights or WEIGHTS).items():
        if name in features:
            out = out + F.lit(w) * F.coalesce(features[name].cast("double"), F.lit(0.0))
    return out


def rerank(scored: DataFrame, k: int, id_col: str) -> DataFrame:
    """rank, ... of the k best by the score rounded (half even) to five places, ties to the smaller id."""
    order = [F.desc(F.bround("score", 5)), F.col(id_col)]
    return ranked(scored.orderBy(*order).limit(k), order)


def merge_queries(results: list[DataFrame], id_col: str) -> DataFrame:
    """Best score of each document over several queries."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.groupBy(id_col).agg(F.max("score").alias("score"))


def best_per_keyword(scored: DataFrame, keyword: str, id_col: str, least: float = 0.4, relaxed: float = 0.1, enough: int = 5) -> DataFrame:
    """Best result and number of results of each keyword, from scores of at least
    ``least``, or of ``relaxed`` where that leaves fewer than ``enough`` keywords."""
    one = F.struct("score", -F.col(id_col))
    parts = lambda t, s: [F.max_by(id_col, F.when(F.col("score") >= t, one)).alias(f"id_{s}"), F.max(F.when(F.col("score") >= t, F.col("score"))).alias(f"score_{s}"), F.count(F.when(F.col("score") >= t, 1)).alias(f"n_{s}")]
    # both sets of scores in one pass over the rows; what is left has a row a keyword
    rows = stored(scored.groupBy(keyword).agg(*parts(least, "strict"), *parts(relaxed, "relaxed")))
    which = "strict" if rows.where("n_strict > 0").limit(enough).count() >= enough else "relaxed"
    return rows.where(f"n_{which} > 0").select(keyword, F.col(f"id_{which}").alias(id_col), F.col(f"score_{which}").alias("score"), F.col(f"n_{which}").alias("n"))


def cap_per_key(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key: a feature of the corpus build, kept per task first
    (WindowGroupLimit)."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cover_keywords(chosen: DataFrame, pool: DataFrame, key: str, order: list[str], n: int = 5) -> DataFrame:
    """``chosen`` and the first n rows of the pool for each keyword that it lacks."""
    lacking = pool.join(chosen.select(key).distinct(), key, "left_anti")
    return chosen.unionByName(cap_per_key(lacking, key, order, n).drop("rank"))


def backfill(chosen: DataFrame, pool: DataFrame, key: str, wanted: str, id_col: str, n: int = 20) -> DataFrame:
    """``chosen`` and, where fewer than n of its rows have the wanted keyword, up to n
    more of the pool's that have it and are not yet chosen, by id."""
    if chosen.where(F.col(key) == wanted).limit(n).count() >= n:
        return chosen
    more = pool.where(F.col(key) == wanted).join(chosen.select(id_col), id_col, "left_anti").orderBy(id_col).limit(n)
    return chosen.unionByName(more.select(*chosen.columns))


def with_synthetic(top: DataFrame, entries: list[tuple[str, str]]) -> DataFrame:
    """A top-k (rank, yang_keyword, display_text, ...) and, after it, an entry for each
    (keyword, text) that it lacks, with ranks that go on and no score."""
    have = {r.yang_keyword for r in top.select("yang_keyword").distinct().collect()}  # at most k
    last = top.agg(F.max("rank")).first()[0] or 0
    rows = [(last + i + 1, k, t) for i, (k, t) in enumerate(e for e in entries if e[0] not in have)]
    if not rows:
        return top
    return top.unionByName(top.sparkSession.createDataFrame(rows, "rank int, yang_keyword string, display_text string"), allowMissingColumns=True)
