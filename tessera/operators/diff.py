"""Structural comparison of two versions of keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stored

ADDED, DELETED, CHANGED, UNCHANGED = "added", "deleted", "changed", "unchanged"


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows that share a key, the last by ``order``: an aggregate, so partial sums of
    it are made before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*rows.columns)


def last_of_few(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``last_per_key`` where most keys have one row: the rows are written once, only those
    that share the hash of their key with another are aggregated (and written again); the
    others go through as they are."""
    hashed = stored(rows.withColumn("__hash", F.xxhash64(*keys)))
    shared = stored(hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__hash"))
    if not shared.limit(1).count():
        return hashed.select(*rows.columns)
    last = stored(last_per_key(hashed.join(shared, "__hash", "left_semi").select(*rows.columns), keys, order))
    return hashed.join(shared, "__hash", "left_anti").select(*rows.columns).unionByName(last)


def full_outer_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, action, and old_/new_ of each field: one full outer join on the keys."""
    a = old.select(*keys, F.struct(*fields).alias("__old"))
    b = new.select(*keys, F.struct(*fields).alias("__new"))
    action = F.when(F.col("__old").isNull(), ADDED).when(F.col("__new").isNull(), DELETED).when(F.col("__old").eqNullSafe(F.col("__new")), UNCHANGED).otherwise(CHANGED)
    return a.join(b, keys, "full_outer").select(*keys, action.alias("action"), *[F.col(s)[f].alias(f"{p}_{f}") for f in fields for s, p in (("__old", "old"), ("__new", "new"))])


def only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def properties(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Long form (keys, field, value as text) of the fields that are not null."""
    return rows.select(*keys, F.explode(F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]), lambda p: p["value"].isNotNull())).alias("p")).select(*keys, "p.field", "p.value")


def property_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, action, old_value, new_value) of each property that differs."""
    a = properties(old, keys, fields).withColumnRenamed("value", "old_value")
    b = properties(new, keys, fields).withColumnRenamed("value", "new_value")
    both = a.join(b, [*keys, "field"], "full_outer")
    action = F.when(F.col("old_value").isNull(), ADDED).when(F.col("new_value").isNull(), DELETED).otherwise(CHANGED)
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select(*keys, "field", action.alias("action"), "old_value", "new_value")


def positional_diff(old: DataFrame, new: DataFrame, group: list[str], position: str, value: str) -> DataFrame:
    """Members compared place by place, the longer side's rest added or deleted."""
    a = old.select(*group, F.col(position).alias("pos"), F.struct(F.col(value).alias("v")).alias("o"))
    b = new.select(*group, F.col(position).alias("pos"), F.struct(F.col(value).alias("v")).alias("n"))
    action = F.when(F.col("o").isNull(), ADDED).when(F.col("n").isNull(), DELETED).when(F.col("o").eqNullSafe(F.col("n")), UNCHANGED).otherwise(CHANGED)
    return a.join(b, [*group, "pos"], "full_outer").select(*group, "pos", action.alias("action"), F.col("o.v").alias("old_value"), F.col("n.v").alias("new_value"))


def sibling_index(rows: DataFrame, siblings: list[str], order: list[str]) -> DataFrame:
    """``idx``: place from 0 among rows with the same siblings; null where there is one."""
    w = Window.partitionBy(*siblings)
    return rows.withColumn("idx", F.when(F.count(F.lit(1)).over(w) > 1, F.row_number().over(w.orderBy(*order)) - 1))


def symbolic_diff(old: DataFrame, new: DataFrame, owner: list[str], entries: str) -> DataFrame:
    """Entries (array of struct with name, value and status) compared by owner and name.
    severity: error for a changed value, warning for a status, else info."""
    flat = lambda df, p: df.select(*owner, F.explode(entries).alias("e")).select(*owner, F.col("e.name").alias("name"), F.struct("e.value", "e.status").alias(p))
    both = flat(old, "o").join(flat(new, "n"), [*owner, "name"], "full_outer")
    action = F.when(F.col("o").isNull(), ADDED).when(F.col("n").isNull(), DELETED).otherwise(CHANGED)
    severity = F.when(~F.col("o.value").eqNullSafe(F.col("n.value")) & F.col("o").isNotNull() & F.col("n").isNotNull(), "error").when(~F.col("o.status").eqNullSafe(F.col("n.status")) & F.col("o").isNotNull() & F.col("n").isNotNull(), "warning").otherwise("info")
    return both.where(~F.col("o").eqNullSafe(F.col("n"))).select(*owner, "name", action.alias("action"), severity.alias("severity"), F.col("o.value").alias("old_value"), F.col("n.value").alias("new_value"))


def list_change(old: Column, new: Column, ordered: bool) -> Column:
    """Direction of a change of a list: reordered, narrowed (items went), expanded (items
    came), unchanged. As a set, a new order changes nothing."""
    gone, came = F.size(F.array_except(old, new)) > 0, F.size(F.array_except(new, old)) > 0
    same = (old == new) if ordered else ~(gone | came)
    return F.when(same, UNCHANGED).when(gone, "narrowed").when(came, "expanded").otherwise("reordered")


def list_verdict(old: Column, new: Column, deleted: Column, added: Column) -> Column:
    """Verdict on a constraint that is a list: that for deleted items where any went, else
    that for added ones where any came, else compatible. A missing list has no items."""
    none = F.array().cast("array<string>")
    o, n = F.coalesce(old, none), F.coalesce(new, none)
    gone, came = F.size(F.array_except(o, n)) > 0, F.size(F.array_except(n, o)) > 0
    return F.when(gone, F.coalesce(deleted, F.lit("non-backward-compatible"))).when(came, F.coalesce(added, F.lit("backward-compatible"))).otherwise("backward-compatible")


def item_changed(old: Column, new: Column) -> Column:
    """Whether an item of a list differs by more than prefixes."""
    bare = lambda v: F.regexp_replace(v, r"[A-Za-z_][\w.-]*:(?=[A-Za-z_])", "")
    return ~bare(old).eqNullSafe(bare(new))


def definition_diff(old_refs: DataFrame, new_refs: DataFrame, old_defs: DataFrame, new_defs: DataFrame, owner: list[str], name: str, entries: str) -> DataFrame:
    """Enumeration or bit entries that differ between what the old name and what the new
    name stand for, though the names may be equal: each reference (owner, name) takes the
    entries of its own version's definition (name, entries). Only owners that both
    versions have, with a known definition on both sides."""
    held = lambda refs, defs: refs.select(*owner, name).join(defs.select(name, entries), name).select(*owner, entries)
    o, n = held(old_refs, old_defs), held(new_refs, new_defs)
    return symbolic_diff(o.join(n.select(*owner), owner, "left_semi"), n.join(o.select(*owner), owner, "left_semi"), owner, entries)


def without_type(attributes: Column) -> Column:
    """A map of attributes without ``type``, which is compared on its own."""
    return F.map_filter(attributes, lambda k, _: k != "type")


def rebind(file: Column, line: Column, when_file: Column, when_line: Column) -> tuple[Column, Column]:
    """File and line of a node whose condition was refined in another file: the condition's."""
    moved = when_file.isNotNull() & ~when_file.eqNullSafe(file)
    return F.when(moved, when_file).otherwise(file), F.when(moved, when_line).otherwise(line)
