"""Sinks and scans of comparison reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.schema_diff import Comparison, render

_HEAD = r"^(\d+)\. \((\S+) (added|deleted|changed)\)(?: \[([^\]]*(?:\[[^\]]*\])?[^\]]*)\])?$"
_DETAIL = r"^\s+(\S+) (added|deleted|changed): (.*) -> (.*) \[(.*)\]$"


def write_text(comparison: Comparison, folder: str) -> None:
    """The report as text, in files whose names sort as the lines do: a report of any
    length is written in parallel."""
    lines = render(comparison).select("path", "ord", F.when(F.col("ord") == 0, F.concat("path", F.lit("\n"), "line")).otherwise(F.col("line")).alias("value"))
    lines.sort("path", "ord", "value").select("value").write.text(folder)


def write_sections(comparison: Comparison, folder: str) -> None:
    """Changes with their details as JSON, a folder a section."""
    details = comparison.details.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("subject", "action", "old_value", "new_value", "change", "verdict", "rule_id"))).alias("details"))
    heads = comparison.sections().select("change_id", "section", "keyword", "action", "verdict", "rule_id", F.array("norm_path").alias("paths"), F.col("old.file").alias("old_file"), F.col("old.line").alias("old_line"), F.col("new.file").alias("new_file"), F.col("new.line").alias("new_line"))
    heads.join(details, "change_id", "left").write.partitionBy("section").json(folder)


def write_report(comparison: Comparison, folder: str) -> None:
    """What the report says after all its passes, as JSON: ``grouped`` (a folder a section,
    details with each row), ``concise`` (kind, keyword and paths, with moves told apart)
    and ``places`` (the changes of groupings with all their places of use)."""
    rows = comparison.report()
    rows.write.partitionBy("section").json(f"{folder}/grouped")
    comparison.condensed().select("section", "kind", "keyword", "verdict", "old_path", "new_path").write.json(f"{folder}/concise")
    places = comparison.places().groupBy("change_id", "grouping").agg(F.sort_array(F.collect_set("place")).alias("places"))
    comparison.changes.select("change_id", "keyword", "action", "verdict").join(places, "change_id").drop("change_id").write.json(f"{folder}/places")


def read_text(spark: SparkSession, folder: str) -> DataFrame:
    """(line, kind, keyword, action, old_value, new_value, verdict) of a text report."""
    raw = spark.read.text(folder).select(F.col("value").alias("line"))
    head, detail = F.col("line").rlike(_HEAD), F.col("line").rlike(_DETAIL)
    pick = lambda h, d: F.when(head, F.regexp_extract("line", _HEAD, h) if h else F.lit(None)).when(detail, F.regexp_extract("line", _DETAIL, d))
    return raw.select("line", F.when(head, "change").when(detail, "detail").otherwise("path").alias("kind"), pick(2, 1).alias("keyword"), pick(3, 2).alias("action"), pick(0, 3).alias("old_value"), pick(0, 4).alias("new_value"), pick(4, 5).alias("verdict"))


def without_root(lines: DataFrame, column: str = "value") -> DataFrame:
    """Report lines whose paths do not name the root of the compared tree."""
    return lines.withColumn(column, F.replace(F.col(column), F.lit("root["), F.lit("[")))
