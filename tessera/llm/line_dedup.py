"""Line dedup by site-relative frequency, in DataFrame functions alone.

Rows are pages of a host. Of each line, the pages of the host that hold it are divided by
all pages of the host; lines beyond a ratio are boilerplate and are dropped from the
pages of that host.

Each page gives a line once, as 128 bits of hash, and the counts by (host, line) are
pre-aggregated before their shuffle, so that a host with a third of all pages deals out
by its lines and not to one task. What a host drops is bounded by its own mean number of
lines over the ratio, so it fits a row. Where all hosts together drop at most
``BROADCAST_LINES`` lines (counted, not guessed), these are broadcast and the texts are
not shuffled; beyond that, pages and lines meet in a join on the host in which Spark can
split a hot host's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import cut

RATIO = 0.1
MIN_PAGES = 3
#: 16 bytes each, so at most 4 MB.
BROADCAST_LINES = 250_000


def _hash(line: Column) -> Column:
    """128 bits as text-free pair of longs."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")) == ""


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, drop): for each host with any, the hashes of its boilerplate lines. Rows
    with a null host are the pages of one host, null."""
    rows = pages.select(host.alias("host"), text.alias("text"))
    total = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    each = rows.select("host", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), _hash))).alias("line"))
    counted = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    kept = counted.join(total.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > ratio * F.col("pages"))
    return kept.groupBy("host").agg(F.collect_list("line").alias("drop"))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with ``text_col`` cleaned, and n_lines and n_dropped added (long).

    A line is dropped if at least ``min_pages`` pages of its host hold it and they are
    more than ``ratio`` of the host's pages. Lines are compared whole, by 128 bits of
    hash (two lines of a host that differ are taken for one with a probability of some
    2**-128 a pair); blank
    lines (only spaces, tabs, CR, VT or FF) are never counted nor dropped. Lines that
    repeat within a page count once and are all dropped. Repeated rows are pages of their
    own. Null texts stay null with no lines; an empty text has one, blank, line. Rows of
    a null host form one host. Other columns pass through; only columns of the names
    n_lines and n_dropped are replaced. An empty table gives no rows."""
    named = cut(boilerplate(pages, F.col(host_col), F.col(text_col), ratio, min_pages).select(F.col("host").alias("__host"), F.col("drop").alias("__drop")))
    if (named.agg(F.sum(F.size("__drop"))).first()[0] or 0) <= BROADCAST_LINES:
        named = F.broadcast(named)
    joined = pages.drop("n_lines", "n_dropped").join(named, F.col(host_col).eqNullSafe(F.col("__host")), "left")
    lines = _lines(F.col(text_col))
    kept = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col("__drop"), _hash(x)))
    clean = F.when(F.col("__drop").isNull() | F.col(text_col).isNull(), lines).otherwise(kept)
    columns = [F.array_join("__kept", "\n").alias(c) if c == text_col else F.col(c) for c in pages.columns if c not in ("n_lines", "n_dropped")]
    out = joined.withColumn("__kept", clean)
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
    return out.select(*columns, n.cast("long").alias("n_lines"), F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines) - F.size("__kept")).cast("long").alias("n_dropped"))


ORACLE = """
WITH lines AS (
  SELECT rn, source, line, pos FROM (
    SELECT rn, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM (SELECT row_number() OVER () AS rn, source, text FROM documents WHERE text IS NOT NULL))),
total AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
counted AS (
  SELECT source, line, count(DISTINCT rn) AS n FROM lines
  WHERE trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) <> '' GROUP BY source, line),
boiler AS (
  SELECT c.source, c.line FROM counted c JOIN total t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= 3 AND c.n > 0.1::DOUBLE * t.pages),
kept AS (
  SELECT l.rn, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.line IS NULL) AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE b.line IS NOT NULL) AS n_dropped
  FROM lines l LEFT JOIN boiler b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line GROUP BY l.rn)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM (SELECT row_number() OVER () AS rn, * FROM documents) d LEFT JOIN kept k USING (rn)
"""
