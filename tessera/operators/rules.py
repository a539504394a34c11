"""The rule engine: an ordered rule table, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BC, NBC, CONDITIONAL, UNMARKED = "backward-compatible", "non-backward-compatible", "conditional-backward-compatible", "[UNMARKED]"
#: Directions that could not be told; they fit neither rules for wider nor for narrower.
UNDECIDED = ("error", "unknown", "needs-analysis")
#: A rule table of at most so many rows is broadcast; a longer one is shuffled by subject.
BROADCAST_RULES = 20_000


def mode_verdict(default: Column, strict: Column, mode: str) -> Column:
    """The verdict of a mode: a rule's own for the strict one where it has it."""
    return F.coalesce(strict, default) if mode == "rfc7950" else F.coalesce(default, strict)


def first_match(details: DataFrame, rules: DataFrame, mode: str = "default", key: str = "detail_id") -> DataFrame:
    """``details`` with rule_id and verdict of the first rule that fits, or [UNMARKED].

    details: key, subject, action, parent (keyword), parent_action, old_value, new_value,
    change (relaxed, narrowed, ... or null). rules: ord, rule_id, subject, parents
    (array, null for any), action, parent_action, value, from_value, to_value, relaxed
    (boolean), verdict, verdict_strict and, optionally, same (boolean: the change has or
    has not to be an equivalent one); a null condition holds always. A change whose
    direction is UNDECIDED fits no rule that asks for one. Rules with
    ``assistance`` hand it on (false where none fits).

    The least fitting order is an aggregate over the key (min_by), not a sort; the rules
    are broadcast when counted small."""
    r = rules.select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])
    if rules.count() <= BROADCAST_RULES:
        r = F.broadcast(r)
    none = lambda c: F.col(f"r_{c}").isNull()
    told = ~F.coalesce(F.col("change").isin(*UNDECIDED), F.lit(False))
    shown = F.when(F.col("action") == "deleted", F.col("old_value")).otherwise(F.col("new_value"))
    fits = (
        (F.col("subject") == F.col("r_subject"))
        & (F.col("action") == F.col("r_action"))
        & (none("parents") | F.array_contains("r_parents", F.col("parent")))
        & (none("parent_action") | (F.col("parent_action") == F.col("r_parent_action")))
        & (none("value") | (shown == F.col("r_value")))
        & (none("from_value") | ((F.col("old_value") == F.col("r_from_value")) & (F.col("new_value") == F.col("r_to_value"))))
        & (none("relaxed") | (told & (F.coalesce(F.col("change").isin("relaxed", "equivalent", "expanded"), F.lit(False)) == F.col("r_relaxed"))))
    )
    if "same" in rules.columns:
        fits = fits & (none("same") | (told & (F.col("change").eqNullSafe(F.lit("equivalent")) == F.col("r_same"))))
    extra = ["assistance"] if "assistance" in rules.columns else []
    found = details.join(r, fits).groupBy(key).agg(F.min_by(F.struct(F.col("r_rule_id").alias("rule_id"), mode_verdict(F.col("r_verdict"), F.col("r_verdict_strict"), mode).alias("verdict"), *[F.col(f"r_{c}").alias(c) for c in extra]), "r_ord").alias("m"))
    return details.join(found, key, "left").select(*details.columns, F.col("m.rule_id").alias("rule_id"), F.coalesce("m.verdict", F.lit(UNMARKED)).alias("verdict"), *[F.coalesce(f"m.{c}", F.lit(False)).alias(c) for c in extra])


def settle_conditional(rows: DataFrame, change: str = "change_id", verdict: str = "verdict", is_parent: str = "is_parent") -> DataFrame:
    """A conditional parent is compatible if all its details are; other rows stay. The
    details are aggregated with partial results and joined to the parents, so a change
    with any number of details is no task of its own."""
    fine = rows.where(~F.col(is_parent)).groupBy(change).agg(F.bool_and(F.coalesce(F.col(verdict) == BC, F.lit(False))).alias("__fine"))
    both = rows.join(fine.withColumnRenamed(change, "__c"), F.col(change) == F.col("__c"), "left")
    settled = F.when(F.col(is_parent) & (F.col(verdict) == CONDITIONAL), F.when(F.coalesce("__fine", F.lit(True)), BC).otherwise(NBC)).otherwise(F.col(verdict))
    return both.withColumn(verdict, settled).select(*rows.columns)


def propagate(rows: DataFrame, change: str = "change_id", action: str = "action", verdict: str = "verdict", is_parent: str = "is_parent") -> DataFrame:
    """A deleted breaking parent breaks every marked detail; a breaking parent whose
    details all are compatible breaks those. One aggregate over the change."""
    nbc = F.col(verdict) == NBC
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    marks = rows.groupBy(change).agg(some(F.col(is_parent) & nbc).alias("__nbc"), some(F.col(is_parent) & (F.col(action) == "deleted")).alias("__gone"), some(~F.col(is_parent) & nbc).alias("__child"))
    both = rows.join(marks.where("__nbc").withColumnRenamed(change, "__c"), F.col(change) == F.col("__c"), "left")
    breaks = ~F.col(is_parent) & (F.col(verdict) != UNMARKED) & F.col("__nbc") & (F.col("__gone") | (~F.col("__child") & (F.col(verdict) == BC)))
    return both.withColumn(verdict, F.when(breaks, NBC).otherwise(F.col(verdict))).select(*rows.columns)


def clone_rules(rules: DataFrame, similar: str, keyword: str) -> DataFrame:
    """The rules and a copy of each one of ``similar`` for ``keyword``, right after it.
    A keyword that has rules already gets no copies."""
    has = rules.where(F.col("subject") == keyword).limit(1).count() > 0
    copies = rules.where((F.col("subject") == similar) & F.lit(not has)).withColumn("subject", F.lit(keyword)).withColumn("ord", F.col("ord") + 0.5)
    return rules.withColumn("ord", F.col("ord").cast("double")).unionByName(copies.withColumn("ord", F.col("ord").cast("double")))


def unresolved(references: DataFrame, names: DataFrame, reference: str, name: str) -> DataFrame:
    """Rows whose reference names nothing."""
    return references.join(names.select(F.col(name).alias("__n")), F.col(reference) == F.col("__n"), "left_anti")


def rules_for(rules: DataFrame, keyword: str) -> DataFrame:
    """(rule_id, text): the rules that name a keyword, as text, with all actions of each."""
    action = F.concat(F.col("action"), F.when(F.col("parent_action").isNotNull(), F.concat(F.lit(" (parent="), "parent_action", F.lit(")"))).otherwise(""))
    each = rules.where(F.col("subject") == keyword).groupBy("rule_id", "kind", "verdict").agg(F.array_join(F.sort_array(F.collect_set(action)), ", ").alias("actions"))
    return each.select("rule_id", F.format_string("Rule ID: %s\nCategory: %s\nActions: %s\nCompatible: %s", "rule_id", "kind", "actions", "verdict").alias("text"))
