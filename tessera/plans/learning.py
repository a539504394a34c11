"""Rules for keywords that have none, by a loop: compare, take the keywords that stayed
unmarked, find the nearest known one in the index, copy its rules, and compare again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import rules
from tessera.plans import schema_diff
from tessera.plans.retriever import Retriever
from tessera.sources import yang


class RuleTable:
    """Rules in a folder that is only appended to: each row has the version that it came
    with, and the rules of a version are its rows and those of all before it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def append(self, rows: DataFrame, version: int) -> None:
        rows.withColumn("ord", F.col("ord").cast("double")).write.mode("append").parquet(f"{self.folder}/rule_version={version}")

    def read(self, version: int | None = None) -> DataFrame:
        rows = self.spark.read.option("basePath", self.folder).parquet(self.folder)
        return (rows if version is None else rows.where(F.col("rule_version") <= version)).drop("rule_version")


def samples(files: DataFrame, keywords: list[str]) -> dict[str, str]:
    """The first statement of each of a few keywords, as text."""
    stmts = yang.statements(files).where(F.col("keyword").isin(keywords))
    text = F.concat(F.concat_ws(" ", "keyword", "arg"), F.lit(";"))
    rows = stmts.groupBy("keyword").agg(F.min_by(text, F.struct("file", "stmt_id")).alias("text")).collect()  # a row a keyword
    return {r.keyword: r.text for r in rows}


def unmarked_keywords(found: schema_diff.Comparison, table: DataFrame) -> list[str]:
    """Keywords of unmarked changes and details for which there is no rule at all."""
    local = lambda c: F.regexp_replace(c, "^[^:]*:", "").alias("keyword")
    left = found.changes.where(F.col("verdict") == rules.UNMARKED).select(local("keyword")).unionByName(found.details.where(F.col("verdict") == rules.UNMARKED).select(local("subject")))
    known = table.select(F.col("subject").alias("keyword")).distinct()
    return [r.keyword for r in left.distinct().join(known, "keyword", "left_anti").orderBy("keyword").collect()]  # the keywords of a language


def learn(old_files: DataFrame, new_files: DataFrame, store: RuleTable, retriever: Retriever, mode: str = "default", least: float = 0.4) -> tuple[schema_diff.Comparison, list[tuple[int, str, str | None]]]:
    """The comparison after the last round, and what was tried: (version, keyword, the
    keyword whose rules it got, or None). A keyword is tried once, so the loop ends with the
    round that adds no rules. ``store`` has the rules to begin with as version 0."""
    version, tried = 0, {}
    log: list[tuple[int, str, str | None]] = []
    while True:
        table = store.read(version)
        found = schema_diff.compare_files(old_files, new_files, table, mode)
        wanted = [k for k in unmarked_keywords(found, table) if k not in tried]
        said = samples(new_files.unionByName(old_files), wanted) if wanted else {}
        added = None
        for keyword in wanted:
            near = retriever.identify(said.get(keyword, f"{keyword};"), n=50, least=least)
            able = near.select(F.regexp_replace("yang_keyword", "^[^:]*:", "").alias("subject"), "score").where(F.col("subject") != keyword).join(table.select("subject").distinct(), "subject")
            best = able.orderBy(F.desc("score"), "subject").first()
            tried[keyword] = best.subject if best else None
            log.append((version + 1, keyword, tried[keyword]))
            if best:
                copies = rules.clone_rules(table, best.subject, keyword).where(F.col("subject") == keyword)
                added = copies if added is None else added.unionByName(copies)
        if added is None:
            return found, log
        version += 1
        store.append(added, version)
