"""The hook for a second opinion on changes, and the loop that learns rules.

A verifier is any function from a pandas frame of changes to a frame with decision and
explanation; it runs on the executors in batches. Without one, only the static classes
decide, and what they cannot decide stays unverified."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import rules

Verifier = Callable[[pd.DataFrame], pd.DataFrame]


def static_decision(change: Column) -> Column:
    """The verdict of a direction that is certain, else null."""
    return F.when(change.isin("relaxed", "equivalent", "expanded"), rules.BC).when(change.isin("narrowed", "incomparable"), rules.NBC)


def outcome(static: Column, decided: Column, original: Column) -> Column:
    """confirmed, conflict or unverified; a static decision counts before any other."""
    final = F.coalesce(static, decided)
    return F.when(final.isNull(), "unverified").when(final == original, "confirmed").otherwise("conflict")


def verify(details: DataFrame, verifier: Verifier | None = None) -> DataFrame:
    """details (detail_id, change, verdict, ...) with decision, explanation and outcome."""
    if verifier is None:
        asked = details.withColumn("decision", F.lit(None).cast("string")).withColumn("explanation", F.lit(None).cast("string"))
    else:
        kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in details.schema.fields), "decision string", "explanation string"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                said = verifier(pdf)
                yield pdf.assign(decision=said["decision"].to_numpy(), explanation=said["explanation"].to_numpy())

        asked = details.mapInPandas(run, kind)
    return asked.withColumn("outcome", outcome(static_decision(F.col("change")), F.col("decision"), F.col("verdict")))


def lookup(details: DataFrame, given: DataFrame) -> DataFrame:
    """details with the decision and explanation that ``given`` (subject, old_value,
    new_value, decision, explanation) has for the same change, and the outcome. Of several
    decisions for a change the least counts; what was never given stays unverified."""
    keys = ["subject", "old_value", "new_value"]
    once = given.groupBy(*keys).agg(F.min(F.struct("decision", "explanation")).alias("__said")).select(*[F.col(c).alias(f"__{c}") for c in keys], "__said")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    out = details.join(once, same, "left").select(*details.columns, F.col("__said.decision").alias("decision"), F.col("__said.explanation").alias("explanation"))
    return out.withColumn("outcome", outcome(static_decision(F.col("change")), F.col("decision"), F.col("verdict")))


def learn_rules(table: DataFrame, unmarked: DataFrame, nearest: Callable[[str], str | None], log_path: str | None = None) -> DataFrame:
    """The rule table with, for each keyword without rules, the rules of the keyword that
    ``nearest`` names. The keywords are those of a report, few by nature. Attempts are
    appended to a log as JSON."""
    known = table.select("subject").distinct()
    wanted = [r.keyword for r in unmarked.select("keyword").distinct().join(known, F.col("keyword") == F.col("subject"), "left_anti").orderBy("keyword").collect()]
    log = []
    for keyword in wanted:
        similar = nearest(keyword)
        log.append((keyword, similar, similar is not None))
        if similar:
            table = rules.clone_rules(table, similar, keyword)
    if log_path and log:
        table.sparkSession.createDataFrame(log, "keyword string, similar string, added boolean").write.mode("append").json(log_path)
    return table
