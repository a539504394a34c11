"""Passes over classified changes: sections, grouping, condensing, child removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import ancestors, fingerprint, parent_path, segments
from tessera.operators.graph import closure
from tessera.operators.rules import BC, NBC, UNMARKED
from tessera.session import stored


def section(missing: Column, own: Column, any_child_nbc: Column) -> Column:
    """Section of a change from its own verdict and its details'."""
    return F.when(missing, "other-errors").when(own.isNull() | (own == UNMARKED), "unmarked").when((own == NBC) | any_child_nbc, "non_compatible").otherwise("compatible")


def categorise(changes: DataFrame, details: DataFrame, change: str = "change_id") -> DataFrame:
    """Changes with their section; details are aggregated before the join."""
    kids = details.groupBy(change).agg(F.max((F.col("verdict") == NBC).cast("int")).alias("__nbc"), F.max(F.col("missing").cast("int")).alias("__gone"))
    joined = changes.join(kids, change, "left")
    return joined.withColumn("section", section(F.coalesce("__gone", F.lit(0)) == 1, F.col("verdict"), F.coalesce("__nbc", F.lit(0)) == 1)).drop("__nbc", "__gone")


def group_duplicates(rows: DataFrame, keys: list[str], path: Column, order: Column, provenance: list[str]) -> DataFrame:
    """One row for changes that are alike but for their path: paths (sorted), n, the path
    of best quality, and each provenance column as a value where all agree, else null
    (its distinct values, sorted, are in ``<column>_all``)."""
    agg = [F.sort_array(F.collect_set(path)).alias("paths"), F.count(F.lit(1)).alias("n"), F.max_by(path, order).alias("best_path")]
    agg += [F.sort_array(F.collect_set(c)).alias(f"{c}_all") for c in provenance]
    out = rows.groupBy(*keys).agg(*agg)
    return out.select("*", *[F.when(F.size(f"{c}_all") == 1, F.get(F.col(f"{c}_all"), F.lit(0))).alias(c) for c in provenance])


def merge_by_source(rows: DataFrame, file: str, line: str, keys: list[str], path: str) -> DataFrame:
    """Rows from one place of a file merge (paths, n); rows without place stay as they are."""
    placed = F.col(file).isNotNull() & F.col(line).isNotNull()
    merged = rows.where(placed).groupBy(*keys, file, line).agg(F.sort_array(F.collect_set(path)).alias("paths"), F.count(F.lit(1)).alias("n"))
    alone = rows.where(~placed).select(*keys, file, line, F.array(path).alias("paths"), F.lit(1).cast("long").alias("n"))
    return merged.unionByName(alone)


def drop_covered_children(rows: DataFrame, path: str, same: list[str]) -> DataFrame:
    """Rows of which no ancestor path is in the rows with the same values of ``same``.
    Ancestors are listed and joined by equality, so no pair of paths is compared."""
    canon = F.array_join(segments(F.col(path)), "/")
    up = rows.select(canon.alias("__p"), *same, F.explode(ancestors(F.col(path))).alias("__a")).distinct()
    tops = rows.select(canon.alias("__a"), *same).distinct()
    covered = up.join(tops, ["__a", *same]).select("__p", *same).distinct()
    return rows.withColumn("__p", canon).join(covered, ["__p", *same], "left_anti").select(*rows.columns)


def promote(changes: DataFrame, details: DataFrame, change: str = "change_id", print_: str = "fingerprint") -> DataFrame:
    """Breaking changes all of whose details have the fingerprint of a compatible one
    become compatible."""
    good = details.where(F.col("verdict") == BC).select(F.col(print_).alias("__f")).distinct()
    known = details.join(good, F.col(print_) == F.col("__f"), "left").groupBy(change).agg(F.bool_and(F.col("__f").isNotNull()).alias("__all"))
    out = changes.join(known, change, "left")
    return out.withColumn("verdict", F.when((F.col("verdict") == NBC) & F.coalesce("__all", F.lit(False)), BC).otherwise(F.col("verdict"))).drop("__all")


def drop_noops(details: DataFrame) -> DataFrame:
    return details.where(~((F.col("action") == "changed") & F.col("old_value").eqNullSafe(F.col("new_value"))))


def split_paths(rows: DataFrame, paths: str = "paths") -> DataFrame:
    """Changed rows with paths below different parents become a row a path."""
    parents = F.size(F.array_distinct(F.transform(F.col(paths), parent_path)))
    lists = F.when((F.col("action") == "changed") & (parents > 1), F.transform(F.col(paths), lambda p: F.array(p))).otherwise(F.array(F.col(paths)))
    return rows.withColumn("__each", F.explode(lists)).withColumn(paths, F.col("__each")).drop("__each")


def fix_lines(rows: DataFrame) -> DataFrame:
    """Added rows have only a new line, deleted ones only an old one."""
    return rows.withColumn("old_line", F.when(F.col("action") != "added", F.col("old_line"))).withColumn("new_line", F.when(F.col("action") != "deleted", F.col("new_line")))


def condense(rows: DataFrame) -> DataFrame:
    """``kind``: of moved nodes (old_path and new_path), renamed where the parents agree
    and reallocated where they do not; else the action."""
    moved = F.col("old_path").isNotNull() & F.col("new_path").isNotNull() & (F.col("old_path") != F.col("new_path"))
    return rows.withColumn("kind", F.when(moved & (parent_path(F.col("old_path")) == parent_path(F.col("new_path"))), "renamed").when(moved, "reallocated").otherwise(F.col("action")))


def uncovered(changes: DataFrame, covered: DataFrame, keyword: str = "keyword", order: str = "change_id") -> DataFrame:
    """The first unmarked change of each keyword that no rule covers."""
    left = changes.where(F.col("verdict") == UNMARKED).join(covered.select(keyword).distinct(), keyword, "left_anti")
    rest = [c for c in left.columns if c != keyword]
    return left.groupBy(keyword).agg(F.min_by(F.struct(*rest), order).alias("r")).select(keyword, "r.*")


def passes(changes: DataFrame, details: DataFrame) -> DataFrame:
    """The rows of a report, after all passes in their order.

    changes: change_id, section, keyword, action, verdict, old_path, new_path, old_file,
    old_line, new_file, new_line. details: change_id, subject, action, old_value,
    new_value, verdict. Result: section, keyword, kind (added, deleted, changed, renamed,
    reallocated), verdict, paths, old_file, old_line, new_file, new_line, details (sorted).

    Only the details of one change, and the paths of changes that one place of a file
    gives, are collected."""
    shown = F.coalesce("new_path", "old_path")
    # unmarked details leave a marked change and form one of their own
    tagged = changes.where(F.col("verdict") != UNMARKED)
    loose = details.where(F.col("verdict") == UNMARKED).join(tagged.where("action = 'changed'").select("change_id"), "change_id", "left_semi")
    apart = tagged.join(loose.select("change_id").distinct(), "change_id", "left_semi").withColumn("section", F.lit("unmarked")).withColumn("verdict", F.lit(UNMARKED))
    rest = details.join(loose.select("change_id").distinct(), "change_id", "left_anti").unionByName(details.where(F.col("verdict") != UNMARKED).join(loose.select("change_id").distinct(), "change_id", "left_semi"))
    apart_id = F.concat(F.lit("unmarked "), F.col("change_id").cast("string"))
    changes = changes.withColumn("change_id", F.col("change_id").cast("string")).unionByName(apart.withColumn("change_id", apart_id))
    details = rest.withColumn("change_id", F.col("change_id").cast("string")).unionByName(loose.withColumn("change_id", apart_id))
    # a breaking change of conditions all of which are known compatible elsewhere is compatible
    condition = F.col("subject").isin("when", "must") & (F.col("action") == "changed")
    marked = details.withColumn("fingerprint", F.when(condition, fingerprint(F.concat_ws("\u0001", "subject", "old_value", "new_value"))))
    promoted = promote(changes, marked)
    changes = promoted.withColumn("section", F.when((F.col("section") == "non_compatible") & (F.col("verdict") == BC), "compatible").otherwise(F.col("section")))
    # details that change nothing go, and then changes without any
    details = drop_noops(details)
    left = details.select("change_id").distinct()
    moved = F.col("old_path").isNotNull() & F.col("new_path").isNotNull() & (F.col("old_path") != F.col("new_path"))
    changes = changes.where((F.col("action") != "changed") | moved).unionByName(changes.where((F.col("action") == "changed") & ~moved).join(left, "change_id", "left_semi"))
    rows = condense(fix_lines(changes))
    said = details.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("subject", "action", "old_value", "new_value", "verdict"))).alias("details"))
    rows = rows.join(said, "change_id", "left").select("*", shown.alias("path"))
    rows = rows.withColumn("details", F.coalesce("details", F.array().cast("array<struct<subject:string,action:string,old_value:string,new_value:string,verdict:string>>")))
    # what one place of a file gives at several paths is one row
    keys = ["section", "keyword", "kind", "verdict", "old_file", "old_line", "new_file", "new_line", "details"]
    placed = F.col("old_file").isNotNull() | F.col("new_file").isNotNull()
    one = rows.where(placed).groupBy(*keys, F.element_at(segments(F.col("path")), -1).alias("last")).agg(F.sort_array(F.collect_set("path")).alias("paths")).drop("last")
    rows = one.unionByName(rows.where(~placed).select(*keys, F.array("path").alias("paths")))
    return drop_type_noise(drop_covered_rows(stored(rows.withColumn("row", F.monotonically_increasing_id())))).drop("row")


def drop_covered_rows(rows: DataFrame) -> DataFrame:
    """Rows (row, keyword, kind, paths) that only repeat what a row above them says: added
    and renamed ones with a path below one of their kind; reallocated ones all of whose
    paths are below reallocated or renamed ones; deleted types, enums and unions below a
    deleted row, unless they are members of a union or an enumeration."""
    each = rows.select("row", "keyword", "kind", F.explode("paths").alias("path"))
    above = each.select("kind", "path").distinct()
    above = above.unionByName(above.where("kind = 'renamed'").withColumn("kind", F.lit("reallocated"))).distinct()
    up = each.select("row", "keyword", "kind", "path", F.explode(ancestors(F.col("path"))).alias("a"))
    covered = up.join(above.select("kind", F.col("path").alias("a")), ["kind", "a"], "left_semi").select("row", "kind", "path", "keyword").distinct()
    inner = F.col("path").rlike("/(union|enum)/")
    few = covered.where("kind in ('added', 'renamed')").unionByName(covered.where(F.col("kind").eqNullSafe("deleted") & F.col("keyword").isin("type", "enum", "union") & ~inner)).select("row")
    whole = covered.where("kind = 'reallocated'").groupBy("row").agg(F.count(F.lit(1)).alias("n")).join(rows.select("row", F.size("paths").alias("all")), "row").where("n = all").select("row")
    return rows.join(few.unionByName(whole).distinct(), "row", "left_anti")


def drop_type_noise(rows: DataFrame) -> DataFrame:
    """Without the breaking rows below a type (its values, bits, members and patterns) whose
    own change is compatible: they only spell that change out."""
    good = rows.where("section = 'compatible' and keyword = 'type' and kind = 'changed'").select("details", F.explode("paths").alias("a")).where(F.exists("details", lambda d: d["subject"] == "name")).select("a").distinct()
    below = rows.where("section = 'non_compatible' and keyword in ('enum', 'bit', 'type')").select("row", F.explode("paths").alias("path"))
    noise = below.join(good, parent_path(F.col("path")) == F.col("a"), "left_semi").select("row").distinct()
    return rows.join(noise, "row", "left_anti")


def enclosing(lines: DataFrame, report: str = "report", at: str = "line", level: str = "level") -> DataFrame:
    """``lines`` with ``parent``, the nearest line before of a lower level in the same
    report (null: none). Levels are as few as a tree is deep, and each is one running
    maximum. A report here is one change with its lines, not a whole file of them."""
    before = Window.partitionBy(report).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    levels = [r[0] for r in lines.select(level).where(F.col(level).isNotNull()).distinct().orderBy(level).collect()]  # a row a level
    nearest = F.lit(None).cast(lines.schema[at].dataType)
    for low in levels[1:]:
        nearest = F.when(F.col(level) == low, F.max(F.when(F.col(level) < low, F.col(at))).over(before)).otherwise(nearest)
    return lines.withColumn("parent", nearest)


def contexts(lines: DataFrame, report: str = "report", at: str = "line", level: str = "level", name: str = "name") -> DataFrame:
    """(report, line, context): the names of the lines that enclose each one, from the
    outermost, joined by slashes; empty where nothing does."""
    placed = enclosing(lines, report, at, level).select(report, at, name, "parent")
    edges = placed.where("parent is not null").select(F.struct(report, at).alias("c"), F.struct(F.col(report), F.col("parent").alias(at)).alias("p"))
    names = placed.select(F.struct(report, at).alias("ancestor"), F.col(name).alias("n"))
    held = closure(edges, "c", "p").join(names, "ancestor").groupBy("child").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "n"))).alias("up"))
    joined = F.array_join(F.transform("up", lambda x: x["n"]), "/")
    return placed.join(held, F.struct(report, at) == F.col("child"), "left").select(report, at, F.coalesce(joined, F.lit("")).alias("context"))
