"""Documents of mixed kinds: (path, kind, content) by file extension."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship

KINDS = {"xml": "xml", "txt": "text", "md": "text", "py": "code", "java": "code", "c": "code", "yang": "code", "json": "text", "pdf": "pdf", "docx": "docx"}


def xml_text(text: str) -> str:
    """Tags, attributes and texts of a document, a line each, indented by depth; what is
    no XML comes back as it is."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return text
    out: list[str] = []
    stack = [(root, 0)]
    while stack:
        e, depth = stack.pop()
        attrs = "".join(f" {k}={v}" for k, v in e.attrib.items())
        body = (e.text or "").strip()
        out.append("  " * depth + e.tag + attrs + (f": {body}" if body else ""))
        stack += [(c, depth + 1) for c in reversed(e)]
    return "\n".join(out)


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, length, content (null for kinds whose library is not installed)."""
    ship(spark)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), ext), F.lit("text"))

    @F.pandas_udf("string")
    def dump(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else xml_text(t))

    rows = raw.select("path", kind.alias("kind"), "length", F.when(kind.isin("xml", "text", "code"), F.decode("content", "UTF-8")).alias("text"))
    return rows.select("path", "kind", "length", F.when(F.col("kind") == "xml", dump("text")).when(F.col("kind").isin("text", "code"), F.col("text")).alias("content"))


def read_json_list(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array file; broken records become nulls."""
    return spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
