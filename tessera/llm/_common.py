"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut, shared_folder, ship
from tessera.sources.tables import table

__all__ = ["cut", "filesystem", "fold_of", "sampled_labels", "shared_folder", "ship", "table", "work_folder"]


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def fold_of(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k. A null id is in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k)


def filesystem(uri: str):
    """(file system, path) of a URI for Python code on any machine of the cluster."""
    from pyarrow import fs

    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri[5:]
    return fs.LocalFileSystem(), uri


def sampled_labels(spark: SparkSession, sf_dir: str, column: str, k: int, held_out: int, max_rows: int) -> DataFrame:
    """(doc_id, y): labelled rows outside the held-out fold. Where there are more than
    ``max_rows``, a share of them chosen by a hash of the id, expected to be ``max_rows``
    and so bounded at every size of the input. Repeated ids take the largest label;
    rows without id or label are left out."""
    rows = (
        table(spark, sf_dir, "labels")
        .where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .where(fold_of(F.col("doc_id"), k) != held_out)
        .groupBy("doc_id")
        .agg(F.max(column).cast("int").alias("y"))
    )
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    return rows
