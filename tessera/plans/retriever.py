"""Retrieval of known statements for an unknown one: corpus, index and query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import model
from tessera.functions import text
from tessera.operators import graph, retrieval, vector_index
from tessera.session import cut
from tessera.sources import yang

DIMENSIONS = 256


def corpus(stmts: DataFrame, per_keyword: int | None = None) -> DataFrame:
    """Documents of statements: node_id, parent_id, yang_keyword, keywords, category,
    skeleton_path, template (masked snippet), tokens (its masks), display_text, module,
    file, line, description.

    Children come by a join on (file, id); equal templates of
    a module count once, the first in the file staying; with ``per_keyword`` only the
    first so many of a keyword stay (a feature of the corpus build)."""
    s = stmts.select("*", F.concat_ws(":", "prefix", "keyword").alias("shown"))
    kids = s.where("parent_id is not null").groupBy("file", F.col("parent_id").alias("stmt_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "shown", "arg"))).alias("kids"))
    d = s.join(kids, ["file", "stmt_id"], "left")
    pieces = F.coalesce(F.transform("kids", lambda k: F.concat_ws(" ", k["shown"], text.mask_argument(F.regexp_replace(k["shown"], "^[^:]*:", ""), F.coalesce(k["arg"], F.lit(""))))), F.array().cast("array<string>"))
    extension = F.col("prefix").isNotNull()
    keywords = F.array_distinct(F.concat(F.array("keyword"), F.coalesce(F.transform("kids", lambda k: F.regexp_replace(k["shown"], "^[^:]*:", "")), F.array().cast("array<string>"))))
    masked = F.concat_ws(" ", F.array("shown"), F.array(text.mask_argument(F.col("keyword"), F.coalesce("arg", F.lit("")))), pieces)
    shape = F.aggregate(F.col("trail"), F.array().cast("array<string>"), lambda a, x: F.when(F.coalesce(F.try_element_at(a, F.lit(-1)) == x, F.lit(False)), a).otherwise(F.concat(a, F.array(x))))
    out = d.select(
        F.concat_ws("#", "file", F.col("stmt_id").cast("string")).alias("node_id"),
        F.when(F.col("parent_id").isNotNull(), F.concat_ws("#", "file", F.col("parent_id").cast("string"))).alias("parent_id"),
        F.col("shown").alias("yang_keyword"),
        keywords.alias("keywords"),
        retrieval.category(F.array("keyword"), list(model.STRUCTURAL), list(model.CONSTRAINT), list(model.ATTRIBUTE), extension, F.col("kids").isNotNull()).alias("category"),
        F.array_join(F.concat(F.array(F.lit("module")), F.slice(shape, F.lit(2), F.greatest(F.size(shape) - 2, F.lit(0)))), "/").alias("skeleton_path"),
        masked.alias("template"),
        F.concat_ws(" ", "shown", F.col("arg")).alias("display_text"),
        "module",
        "file",
        "line",
        "stmt_id",
        F.get(F.transform(F.filter("kids", lambda k: k["shown"] == "description"), lambda k: k["arg"]), F.lit(0)).alias("description"),
    )
    first = out.groupBy("template", "module").agg(F.min(F.struct("file", "stmt_id")).alias("f")).select("f.file", "f.stmt_id")
    out = out.join(first, ["file", "stmt_id"], "left_semi")
    if per_keyword:
        out = retrieval.cap_per_key(out, "yang_keyword", ["file", "stmt_id"], per_keyword).drop("rank")
    return out.withColumn("tokens", tokens_of(F.col("template"))).drop("stmt_id")


def tokens_of(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit("<[A-Z_]+>"), F.lit(0)))


def embed(rows: DataFrame, template: str, vector: str = "vector", dims: int = DIMENSIONS) -> DataFrame:
    """``rows`` with a unit vector of hashed words and pairs of words; the fallback for a
    neural model. Each step is a column of its own, so that none is computed in another's
    loop."""
    rows = rows.withColumn("__w", text.words(F.col(template)))
    pairs = F.zip_with("__w", F.slice("__w", F.lit(2), F.greatest(F.size("__w"), F.lit(1))), lambda a, b: F.concat_ws("_", a, b))
    rows = rows.withColumn("__bins", F.transform(F.concat("__w", pairs), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int")))
    rows = rows.withColumn("__n", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter("__bins", lambda b: b == i)).cast("double")))
    rows = rows.withColumn("__norm", F.sqrt(F.aggregate("__n", F.lit(0.0), lambda s, x: s + x * x)))
    unit = F.transform("__n", lambda x: F.when(F.col("__norm") > 0, x / F.col("__norm")).otherwise(0.0).cast("float"))
    return rows.withColumn(vector, unit).drop("__w", "__bins", "__n", "__norm")


def write_index(docs: DataFrame, folder: str) -> None:
    """The index: Parquet by category and by list of near vectors, so that a category filter
    and a search read their folders only."""
    # cut: a filter over the steps of embed would compute one inside another's loop
    vector_index.write(cut(embed(docs, "template")), folder, "vector", by=("category",))


class Retriever:
    """Queries over an index written by write_index."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.docs = spark, spark.read.parquet(folder)
        self.index = vector_index.VectorIndex(spark, folder, "node_id", "vector")

    def query(self, snippet: str, top_k: int = 10, initial_k: int = 3000, category: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
        """rank, node_id, yang_keyword, score and display_text of the best documents for
        a raw statement: a vector top-k after the category filter, then the fused score
        of the features; alternates of the snippet (a string for an identifier) count
        with their best score."""
        stmts = self.spark.createDataFrame(yang.statement_rows("query", snippet) or [("query", None, 0, None, 0, 0, None, snippet.strip() or "none", None, 1, [snippet.strip() or "none"])], model.STATEMENT)
        q = corpus(stmts).orderBy("line", "node_id").first()
        want = category or q.category
        mixed = "ATTRIBUTE, CONSTRAINT"
        fits = {"STRUCTURAL": ["STRUCTURAL"], mixed: ["ATTRIBUTE", "CONSTRAINT", mixed]}.get(want, [want, mixed])
        results = [self._scored(F.col("category").isin(fits), q, t, initial_k, weights) for t in self._alternates(q.template)]
        best = retrieval.merge_queries(results, "node_id")
        top = retrieval.rerank(best, top_k, "node_id")
        return top.join(self.docs.select("node_id", "yang_keyword", "display_text"), "node_id").select("rank", "node_id", "yang_keyword", "score", "display_text")

    @staticmethod
    def _alternates(template: str) -> list[str]:
        other = template.replace("<IDENTIFIER>", "\0").replace("<STRING>", "<IDENTIFIER>").replace("\0", "<STRING>")
        return list(dict.fromkeys([template, other]))

    def _scored(self, fits: Column, q, template: str, initial_k: int, weights: dict[str, float] | None) -> DataFrame:
        vec = embed(self.spark.range(1).select(F.lit(template).alias("t")), "t").first().vector
        few = self.index.search(vec, initial_k, fits).withColumnRenamed("score", "structure")
        # what has no direction comes last
        few = cut(few.unionByName(self.index.rest().where(fits).withColumn("structure", F.lit(0.0))).orderBy(F.desc("structure"), F.desc("node_id")).limit(initial_k))
        near = graph.neighbours(self.docs, few, ["node_id"], ["parent_id"])
        kw = self.docs.select(F.col("node_id").alias("other_node_id"), F.col("keywords").alias("k"))
        near = near.join(kw, "other_node_id").groupBy("node_id").agg(F.array_distinct(F.flatten(F.collect_list("k"))).alias("near"))
        terms = [w for w in self.spark.range(1).select(text.words(F.lit(q.display_text), 2).alias("w")).first().w]
        lex = retrieval.max_normalised(retrieval.bm25(self.docs, terms, "node_id", "display_text"), "score").withColumnRenamed("score", "bm25") if terms else None
        rows = few.join(near, "node_id", "left")
        rows = rows.join(lex, "node_id", "left") if lex is not None else rows.withColumn("bm25", F.lit(0.0))
        have = F.array(*[F.lit(k) for k in q.keywords])
        features = {
            "structure": F.col("structure"),
            "description": F.when(F.col("description").isNull(), 1.0).otherwise(retrieval.lexical_overlap(F.col("description"), F.lit(q.description or ""))),
            "path_shape": text.path_shape(F.col("skeleton_path"), F.lit(q.skeleton_path)),
            "keywords": retrieval.keyword_overlap(have, F.col("keywords")),
            "category": retrieval.category_score(F.lit(q.category), F.col("category")),
            "neighbours": retrieval.neighbour_score(have, F.coalesce("near", F.array().cast("array<string>")), list(model.STRUCTURAL)),
            "lexical": retrieval.lexical_overlap(F.col("display_text"), F.lit(q.display_text)),
            "bm25": F.col("bm25"),
            "tokens": retrieval.token_match(tokens_of(F.lit(template)), F.col("tokens")),
        }
        return rows.select("node_id", retrieval.fuse(features, weights).alias("score"))

    def identify(self, snippet: str, n: int = 5, least: float = 0.4) -> DataFrame:
        """Known keywords for a statement: best document, its score and the count."""
        found = self.query(snippet, top_k=200).withColumn("id", F.col("rank"))
        best = retrieval.best_per_keyword(found.select("yang_keyword", F.col("id").cast("long").alias("id"), "score"), "yang_keyword", "id", least)
        return best.orderBy(F.desc("score"), "yang_keyword").limit(n)


def uncovered_statements(stmts: DataFrame, rule_subjects: DataFrame) -> DataFrame:
    """Keywords that no rule covers: how often, and the first sample."""
    rows = stmts.select("keyword", F.struct("file", "stmt_id").alias("at"), F.concat_ws(" ", "keyword", "arg").alias("sample"))
    left = rows.join(rule_subjects.select(F.col("subject").alias("keyword")).distinct(), "keyword", "left_anti")
    return left.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), F.min_by("sample", "at").alias("sample"))


