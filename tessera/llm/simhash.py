"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32 bits. Of two fingerprints that
differ in at most three bits, one segment differs in at most one bit. Each segment is
indexed under its own value and under its 32 one-wildcard variants; an equality join on
these keys finds every such pair, and the Hamming distance then verifies it.

Variants are split by the deleted bit: for one-bit differences only "bit 0" meets
"bit 1", so equal segments meet once (under the whole segment) and not 32 times more.
Equal fingerprints are one node before the join, so exact copies make no pairs; what
shares a key then differs only in the other segment. Where very many fingerprints share a
segment, its keys are cut further: the other segments of a pair differ in at most three
bits, so one of their four bytes is equal, and only rows that share that, too, meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import cut, ship

#: Rows from which a fingerprint is hot, and how many hot ones (16 bytes each) are sent to
#: all tasks; beyond, all rows meet their components in one join that Spark can split.
HOT, BROADCAST_HOT = 1_000, 100_000
#: Fingerprints from which a segment's keys are cut further by the bytes of the other segment.
HOT_SEGMENT = 2_000


def shingle_hashes(text: str | None, k: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle of the lower-cased text, as uint64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(k))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles], np.uint64)


def fingerprint(text: str | None, k: int = 3) -> int:
    """64 bits: bit i is 1 if more than half of the shingle hashes have it; 0 without words."""
    h = shingle_hashes(text, k)
    if not len(h):
        return 0
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded, however long the text
        bits = np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(doc_id, fp long) of each row; fp holds the 64 bits, signed."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), k) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


def _keys(nodes: DataFrame, side: int) -> DataFrame:
    """One row a node and key: bits 0-31 the segment without its deleted bit, 32-37 that
    bit (32: none), 38 the segment. ``side``: only variants whose deleted bit has that value."""
    out = []
    for seg in (0, 1):
        v = F.col("fp").bitwiseAND(0xFFFFFFFF) if seg == 0 else F.shiftrightunsigned("fp", 32)
        base = seg << 38
        keys = [v.bitwiseOR(F.lit(base | (32 << 32)).cast("long"))]
        for i in range(32):
            has = v.bitwiseAND(1 << i) != 0
            ok = has if side else ~has
            keys.append(F.when(ok, v.bitwiseAND(0xFFFFFFFF ^ (1 << i)).bitwiseOR(F.lit(base | (i << 32)).cast("long"))))
        out.append(F.array(*keys))
    both = F.filter(F.concat(*out), lambda x: x.isNotNull())
    return nodes.select("node", "fp", F.explode(both).alias("key"))


def _hot_keys(nodes: DataFrame, size: int) -> DataFrame | None:
    """(hot): the keys of the segments that ``size`` or more fingerprints share, or None
    where there is no such segment."""
    halves = F.array(F.struct(F.lit(0).alias("seg"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("v")), F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned("fp", 32).alias("v")))
    many = cut(nodes.select(F.explode(halves).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size).select("h.seg", "h.v"))
    if not many.limit(1).count():
        return None
    as_node = many.select(F.col("seg").alias("node"), F.when(F.col("seg") == 0, F.col("v")).otherwise(F.shiftleft("v", 32)).alias("fp"))
    keys = _keys(as_node, 0).union(_keys(as_node, 1))
    return cut(keys.where(F.shiftright("key", 38) == F.col("node")).select(F.col("key").alias("hot")).distinct())


def _with_bytes(keyed: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``keyed`` with ``sub``: -1, or for a hot key a row for each byte of the other segment."""
    if hot is None:
        return keyed.withColumn("sub", F.lit(-1))
    if hot.limit(BROADCAST_HOT + 1).count() <= BROADCAST_HOT:
        hot = F.broadcast(hot)
    other = F.when(F.shiftright("key", 38) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    cuts = F.array(*[F.shiftrightunsigned(other, 8 * i).bitwiseAND(255).bitwiseOR(i << 8).cast("int") for i in range(4)])
    return keyed.join(hot, F.col("key") == F.col("hot"), "left").withColumn("sub", F.explode(F.when(F.col("hot").isNull(), F.array(F.lit(-1))).otherwise(cuts))).drop("hot")


def links(nodes: DataFrame, max_distance: int = 3) -> DataFrame:
    """(a, b, distance) of all pairs of nodes (node, fp; fps are distinct) whose
    fingerprints differ in 1 to ``max_distance`` (at most 3) bits; each pair once."""
    if not 1 <= max_distance <= 3:
        raise ValueError("two segments find distances of 1 to 3")
    hot = _hot_keys(nodes, HOT_SEGMENT)
    a = _with_bytes(_keys(nodes, 0), hot).select("key", "sub", F.col("node").alias("na"), F.col("fp").alias("fa"))
    b = _with_bytes(_keys(nodes, 1), hot).select("key", "sub", F.col("node").alias("nb"), F.col("fp").alias("fb"))
    d = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
    whole = F.shiftright("key", 32).bitwiseAND(63) == 32
    return (
        a.join(b, ["key", "sub"])
        .where((d <= max_distance) & (F.col("na") != F.col("nb")))
        .where(~whole | (F.col("na") < F.col("nb")))
        .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), d.alias("distance"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches.
    Labels fall to the least label's label of the neighbours; what a node learns its old
    label learns, too, so that whole trees are hooked and rounds grow with the logarithm
    of the longest path. It ends when none changes; nothing but a count comes to the
    driver."""
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")))
    label = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        # only labels that have a lower one; where these are few, a hot label's nodes stay where they are
        held = label.select(F.col("label").alias("held")).distinct()
        up = label.where("node <> label").join(held, F.col("node") == F.col("held"), "left_semi").select(F.col("node").alias("up"), F.col("label").alias("jump"))
        if up.limit(BROADCAST_HOT + 1).count() <= BROADCAST_HOT:
            up = F.broadcast(up)
        label = label.join(up, F.col("label") == F.col("up"), "left").select("node", "label", F.coalesce("jump", "label").alias("jump"))
        near = both.join(label, both.v == label.node).groupBy("u").agg(F.min("jump").alias("near"))
        step = cut(label.join(near, label.node == near.u).select("node", F.col("label").alias("old"), F.least("jump", "near").alias("low")))
        hook = step.groupBy("old").agg(F.min("low").alias("hook")).select(F.col("old").alias("root"), "hook")
        step = cut(step.join(hook, F.col("node") == F.col("root"), "left").select("node", "old", F.least("low", "hook").alias("label")))
        label = step.select("node", "label")
        if not step.where("old <> label").limit(1).count():
            return label


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_distance: int = 3) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have no words and the fingerprint zero, linked like any other.
    Repeated rows and repeated ids each keep their row; a row with a null id gets the
    component of its fingerprint and links others like any row (null if no row of the
    component has an id). An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = cut(fingerprints(docs, id_col, text_col, k))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    edges = cut(links(nodes.select(F.col("fp").alias("node"), "fp"), max_distance))
    label = components(edges)
    best = label.join(nodes, label.node == nodes.fp).groupBy("label").agg(F.min("rep").alias("least"))
    named = label.join(best, "label").select(F.col("node").alias("fp"), "least")
    known = cut(nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"), "n"))
    hot = known.where(F.col("n") >= HOT).drop("n")
    if hot.limit(BROADCAST_HOT + 1).count() <= BROADCAST_HOT:
        # the many rows of a hot fingerprint meet its component where they are
        met = rows.join(F.broadcast(hot), "fp")
        rest = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(known.where(F.col("n") < HOT).drop("n"), "fp", "left")
        out = met.unionByName(rest)
    else:
        out = rows.join(known.drop("n"), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _fingerprint_of(text: Column) -> Column:
    """The fingerprint of a text column, as 16 hex digits."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f"{fingerprint(t):016x}" for t in texts], dtype=object)

    return run(text)


def _one(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows that share the keys, the one with the least text (nulls first); of
    equal texts, the least of all columns written as JSON. An aggregate, so that partial
    results are made before the shuffle, however many rows share a key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("text", F.to_json(F.struct(*rows.columns)))).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in rows.columns])


def keep_first(docs: DataFrame, max_distance: int = 3) -> DataFrame:
    """The documents that stay: one row of each component, that with the smallest id. Where
    several rows of a component have this id, the one with the least fingerprint, then
    the least text, stays; rows of one id in different components are judged each in its
    own. Rows with a null id stay, one for each text, where no row of their component has
    an id, and go otherwise. Same columns as ``docs``."""
    ship(docs.sparkSession)
    found = cut(simhash_components(docs, max_distance=max_distance))
    keep = cut(found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("fingerprint").alias("__fp")).withColumnRenamed("doc_id", "__keep"))
    again = cut(found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    out = docs.join(keep.select("__keep"), F.col("doc_id") == F.col("__keep"), "left_semi")
    if again.limit(1).count():
        # a row is known by its id alone only where the id is its own
        rows = docs.join(again, F.col("doc_id") == F.col("__again"), "left_semi").withColumn("__fp", _fingerprint_of(F.col("text")))
        rows = rows.join(keep.withColumnRenamed("__fp", "__kept"), (F.col("doc_id") == F.col("__keep")) & (F.col("__fp") == F.col("__kept")), "left_semi")
        out = out.join(again, F.col("doc_id") == F.col("__again"), "left_anti").unionByName(_one(rows.drop("__fp"), ["doc_id"]).select(*docs.columns))
    lost = found.where("doc_id is null and component_id is null").select(F.col("fingerprint").alias("__lost")).distinct()
    if lost.limit(1).count():
        alone = docs.where("doc_id is null").withColumn("__fp", _fingerprint_of(F.col("text")))
        alone = alone.join(lost, F.col("__fp") == F.col("__lost"), "left_semi").drop("__fp")
        kinds = alone.withColumn("__text", F.col("text"))
        out = out.unionByName(_one(kinds, ["__text"]).select(*docs.columns))
    return out
