"""Rename and move candidates, and the greedy one-to-one choice among them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import identifier_form, jaccard, let, path_shape
from tessera.session import spread, stored

#: Rounds of the greedy choice after which the pairs taken so far are written anew.
CUT_ROUNDS = 16
#: Pairs up to which all are rated; more are rated by parts.
ALL_PAIRS = 2_000_000


def candidates(deleted: DataFrame, added: DataFrame, kind: str, name: str, items: str | None = None, least: float = 0.0, near: tuple[str, ...] = (), key: str = "path") -> DataFrame:
    """Pairs of a deleted (o_*) and an added row (n_*) of one kind: where rows of the same
    name exist, only those; otherwise all of the kind.

    With ``items``, an array column, of these others only (and all) pairs whose items
    have a Jaccard index of at least ``least``; two empty arrays are alike, null meets
    nothing. It bounds the pairs where the score needs shared items, and loses none that
    can reach it. ``near`` names columns; rows of a kind that have one of them in common
    meet, too, once for each pair of ``key``."""
    o = deleted.select(*[F.col(c).alias(f"o_{c}") for c in deleted.columns])
    n = added.select(*[F.col(c).alias(f"n_{c}") for c in added.columns])
    named = o.join(n, (F.col(f"o_{kind}") == F.col(f"n_{kind}")) & (F.col(f"o_{name}") == F.col(f"n_{name}")))
    lone = o.join(added.select(F.col(kind).alias("k"), F.col(name).alias("m")).distinct(), (F.col(f"o_{kind}") == F.col("k")) & (F.col(f"o_{name}") == F.col("m")), "left_anti")
    if items is not None and least > 0:
        other = _similar(lone, n, kind, items, least)
    else:
        other = lone.join(n, F.col(f"o_{kind}") == F.col(f"n_{kind}"))
    for c in near:
        other = other.unionByName(lone.join(n, (F.col(f"o_{kind}") == F.col(f"n_{kind}")) & (F.col(f"o_{c}") == F.col(f"n_{c}"))))
    if near:
        other = other.dropDuplicates([f"o_{kind}", f"o_{key}", f"n_{key}"])
    return named.withColumn("same_name", F.lit(True)).unionByName(other.withColumn("same_name", F.lit(False)))


def _alike(o: DataFrame, n: DataFrame, kind: str, items: str, least: float) -> DataFrame:
    """(k, o_set, n_set): the sets of items of one kind with a Jaccard index of at least
    ``least`` > 0.

    Two such sets share an item among the rarest ``size - ceil(least * size) + 1`` of
    each, so distinct sets meet on these by equality; rows then meet on their sets."""
    sets = lambda df, s: df.select(F.col(f"{s}_{kind}").alias("k"), F.array_sort(F.array_distinct(f"{s}_{items}")).alias("set")).where("set is not null").distinct()
    every = sets(o, "o").union(sets(n, "n")).distinct()
    # "0" stands for the empty set, "1" leads an item
    keys = F.when(F.size("set") == 0, F.array(F.lit("0"))).otherwise(F.transform("set", lambda x: F.concat(F.lit("1"), x)))
    each = every.select("k", "set", F.explode(keys).alias("key"))
    often = each.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n"))
    order = each.join(often, ["k", "key"]).groupBy("k", "set").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("order"))
    size = F.size("order")
    first = stored(order.select("k", "set", F.explode(F.slice("order", F.lit(1), F.least(size, size - F.ceil(F.lit(least) * size - 1e-9).cast("int") + 1))).alias("x")).select("k", "set", F.col("x.key").alias("key")))
    a = first.join(sets(o, "o"), ["k", "set"], "left_semi").select("k", "key", F.col("set").alias("o_set"))
    b = first.join(sets(n, "n"), ["k", "set"], "left_semi").select("k", "key", F.col("set").alias("n_set"))
    return a.join(b, ["k", "key"]).select("k", "o_set", "n_set").distinct().where(jaccard(F.col("o_set"), F.col("n_set"), 1.0, 1.0) >= least - 1e-9)


def _similar(o: DataFrame, n: DataFrame, kind: str, items: str, least: float) -> DataFrame:
    """All pairs of one kind whose items have a Jaccard index of at least ``least`` > 0."""
    alike = _alike(o, n, kind, items, least)
    of = lambda df, s: df.withColumn(f"{s}_set", F.array_sort(F.array_distinct(f"{s}_{items}")))
    left, right = of(o, "o").withColumn("k", F.col(f"o_{kind}")), of(n, "n").withColumn("k", F.col(f"n_{kind}"))
    return left.join(alike, ["k", "o_set"]).join(right, ["k", "n_set"]).select(*o.columns, *n.columns)


def pair_score(same_name: Column, attributes: Column, constraints: Column, path: Column, name: Column) -> Column:
    """Weighted similarity (0 to 100) of a candidate pair, by whether the names agree."""
    # The weights of a same-named and of any other pair.
    named = 0.75 * attributes + 0.15 * constraints + 0.10 * path
    other = 0.60 * attributes + 0.20 * constraints + 0.15 * name + 0.05 * path
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(same_name, named).otherwise(other)))


def least_attributes(threshold: float) -> float:
    """The Jaccard index (0 to 1) of attributes that a pair with other names needs for
    ``pair_score`` to reach ``threshold`` when all else is equal."""
    return (threshold - 20.0 - 15.0 - 5.0) / 60.0


def name_similarity(a: Column, b: Column) -> Column:
    """0 to 100, by the edits between two names without case, hyphens and underscores."""
    x, y = identifier_form(a), identifier_form(b)
    return 100 * (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)))


#: The path parts that refactor_bonus looks at.
_MOVED_PARTS = ("/ipv4-routes/", "/ipv6-routes/", "/loc-rib/", "/adj-rib-", "/bgp-rib/afi-safis/", "/bgp-rib-top/bgp-rib/afi-safis/")


def refactor_bonus(old: Column, new: Column) -> Column:
    """What moves that are known from published models add to a pair's score."""
    # The path parts and what each adds.
    legacy = old.contains("/ipv4-routes/") | old.contains("/ipv6-routes/")
    local = F.when(legacy & new.contains("/loc-rib/"), 15.0).otherwise(0.0)
    adjacent = F.when(legacy & new.contains("/adj-rib-"), -20.0).otherwise(0.0)
    wrapped = F.when(old.contains("/bgp-rib/afi-safis/") & new.contains("/bgp-rib-top/bgp-rib/afi-safis/"), 10.0).otherwise(0.0)
    return local + adjacent + wrapped


def plausible(score: Column, threshold: float, same_name: Column, path: Column, same_parent: Column, name: Column, same_form: Column) -> Column:
    """Whether a pair may be taken: by its score; of one name, by paths that are close; of
    other names, below one parent by close paths and names, or by names that differ in
    case, hyphens and underscores alone. path and name are ratios of 0 to 100."""
    # 70, 90 and 45.
    return (score >= threshold) | (same_name & (path >= 70.0)) | (~same_name & same_parent & (((path >= 90.0) & (name >= 45.0)) | same_form))


def pair_bound(o: DataFrame, n: DataFrame, near: tuple[str, ...]) -> int:
    """An upper bound of how many pairs ``candidates`` gives for the columns name, items and
    ``near`` of rows of a kind, by counts of what they share."""
    keys = [F.array(F.concat(F.lit("name="), "name")), F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda x: F.concat(F.lit("item="), x)), *[F.array(F.concat(F.lit(f"{c}="), c)) for c in near]]
    count = lambda df, c: df.select("kind", F.explode(F.concat(*keys)).alias("key")).where("key is not null").groupBy("kind", "key").agg(F.count(F.lit(1)).alias(c))
    return count(o, "a").join(count(n, "b"), ["kind", "key"]).agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0


def _characters(text: Column) -> Column:
    """The characters of a text as numbers, those that repeat told apart."""
    chars = F.array_sort(F.split(text, ""))
    return F.transform(chars, lambda c, i: F.ascii(c) * 65536 + (i - F.array_position(chars, c) + 1).cast("int"))


def _ratio_bound(s: str) -> Column:
    """No block ratio of two texts is above this: what their characters in any order share."""
    a, b, total = F.col(f"o_{s}_chars"), F.col(f"n_{s}_chars"), F.col(f"o_{s}_length") + F.col(f"n_{s}_length")
    return F.when(total > 0, F.least(F.lit(100.0), 200.0 * F.size(F.array_intersect(a, b)) / total)).otherwise(100.0)


def assign_by_parts(o: DataFrame, n: DataFrame, least: float, near: tuple[str, ...], threshold: float, rated: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``greedy_assign`` takes of the pairs of ``candidates`` that ``rated`` keeps (o, n, score
    and more), without looking at all of them. Rows have path, kind (together a row's key),
    name, items, typed, limits, parent, form.

    Pairs of one parent or one first path segment are rated first. Any other is left out
    only while its best possible score is below what one of its rows has by the greedy
    choice so far: the choice takes that one before, so the pair cannot be taken. The
    others are rated, too, until none is left. Best scores are worked out for classes of
    rows that say the same and whose paths and names have the same characters in any
    order, so few pairs of rows meet."""
    key = lambda s="": F.concat_ws("\u0001", f"{s}path", f"{s}kind")
    head = F.substring_index("path", "/", 1)
    o, n = stored(o.withColumn("head", head)), stored(n.withColumn("head", head))
    lone = stored(o.join(n.select("kind", "name").distinct(), ["kind", "name"], "left_anti"))
    side = lambda df, s: df.select([F.col(c).alias(f"{s}_{c}") for c in df.columns])

    def meet(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
        return a.join(b, reduce(and_, [F.col(f"o_{c}") == F.col(f"n_{c}") for c in on]))

    within = lambda df: df.withColumn("kind_head", F.concat_ws("\u0001", "kind", "head"))
    o_, l_, n_ = side(o, "o"), side(lone, "o"), side(n, "n")
    other = _similar(side(within(lone), "o"), side(within(n), "n"), "kind_head", "items", least).drop("o_kind_head", "n_kind_head")
    for c in near:
        other = other.unionByName(meet(l_, n_, "kind", c) if c == "parent" else meet(l_, n_, "kind", c, "head"))
    other = other.dropDuplicates(["o_kind", "o_path", "n_path"]).withColumn("same_name", F.lit(False))
    seen = stored(rated(meet(o_, n_, "kind", "name", "head").withColumn("same_name", F.lit(True)).unionByName(other)))

    rules = {"name": o, "items": lone, **({"form": lone} if "form" in near else {})}

    def classed(df: DataFrame, has: DataFrame, on: str) -> DataFrame:
        own = [F.array_sort(F.array_distinct(c)).alias(c) for c in ("items", "typed", "limits")]
        marks = F.array(*[F.col("path").contains(p) for p in _MOVED_PARTS]).alias("marks")
        rows = df.withColumn("key", key()).join(has, "key", "left").withColumn("has", F.coalesce("has", F.lit(-1.0)))
        names = F.lit("") if on == "name" else F.coalesce("name", F.lit(""))
        rows = rows.select("key", "has", "path", "kind", "name", "form", "parent", "head", *own, marks, _characters(F.col("path")).alias("path_chars"), F.length("path").alias("path_length"), _characters(names).alias("name_chars"), F.length(names).alias("name_length"))
        what = ["kind", "typed", "limits", "marks", "path_chars", on, *(["name_chars"] if on != "name" else [])]
        return rows.withColumn("class", F.md5(F.to_json(F.struct(*what, F.floor(F.col("has") * 10).alias("has")))))

    looked: DataFrame | None = None
    has: dict[str, DataFrame] = {}
    parts = 2 * o.sparkSession.sparkContext.defaultParallelism
    while True:
        taken = stored(greedy_assign(seen, "o", "n", "score"))
        before, has = has, {s: taken.select(F.col(s).alias("key"), F.col("score").alias("has")) for s in ("o", "n")}
        # what was left out stays out where no row has less than it had
        lost = [before[s].join(has[s].withColumnRenamed("has", "now"), "key", "left").where("now is null or now < has") for s in before]
        if lost and not lost[0].unionByName(lost[1]).limit(1).count():
            return taken
        fresh = []
        for on, left in rules.items():
            sides = [stored(classed(df.where(F.col(on).isNotNull()), has[s], on)) for df, s in ((left, "o"), (n, "n"))]
            kept = ["kind", on, "typed", "limits", "marks", "path_chars", "path_length", "name_chars", "name_length"]
            oc, nc = (side(stored(df.groupBy("class").agg(*[F.first(c).alias(c) for c in kept], F.min("path").alias("path"), F.min("has").alias("has"))), s) for df, s in zip(sides, "on"))
            if on == "items":
                alike = _alike(oc, nc, "kind", "items", least).select(F.col("k").alias("o_kind"), F.col("o_set").alias("o_items"), "n_set")
                oc, nc = oc.join(alike, ["o_kind", "o_items"]).withColumn("o_at", F.col("n_set")), nc.withColumn("n_at", F.col("n_items"))
            else:
                oc, nc = oc.withColumn("o_at", F.col(f"o_{on}")), nc.withColumn("n_at", F.col(f"n_{on}"))
            # many classes share a key, so each key is dealt out
            oc = oc.withColumn("o_part", (F.rand(1) * parts).cast("int")).repartition(parts, "o_kind", "o_at", "o_part")
            nc = nc.withColumn("n_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, "n_kind", "n_at", "n_part")
            met = meet(oc, nc, "kind", "at", "part")
            same = on == "name"
            bounds = F.struct(_ratio_bound("path").alias("path"), (F.lit(0.0) if same else _ratio_bound("name")).alias("name"))

            def best(r: Column) -> Column:
                score = pair_score(F.lit(same), jaccard(F.col("o_typed"), F.col("n_typed")), jaccard(F.col("o_limits"), F.col("n_limits")), r["path"], r["name"])
                return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score + refactor_bonus(F.col("o_path"), F.col("n_path")))) + 1e-6

            value = let(bounds, lambda r: F.struct(best(r).alias("best"), (r["path"] + 1e-6).alias("path")))
            # as rows of a generator, so that filters do not work it out again
            met = met.select("o_class", "n_class", "o_has", "n_has", F.explode(F.array(value)).alias("v")).select("*", "v.best", "v.path")
            able = (F.col("best") >= threshold) | (F.col("path") >= 70.0) if same else F.col("best") >= threshold
            met = stored(met.where(able & (F.col("best") >= F.greatest("o_has", "n_has"))).select("o_class", "n_class", "best"))
            a, b = (side(df.select("class", "key", "has", "head"), s) for df, s in zip(sides, "on"))
            rows = met.join(a, "o_class").join(b, "n_class").where((F.col("best") >= F.greatest("o_has", "n_has")) & ~F.col("o_head").eqNullSafe(F.col("n_head")))
            fresh.append(rows.select(F.col("o_key").alias("o"), F.col("n_key").alias("n"), F.lit(same).alias("same_name")))
        asked = reduce(DataFrame.unionByName, fresh).dropDuplicates(["o", "n"])
        if looked is not None:
            asked = asked.join(looked, ["o", "n"], "left_anti")
        asked = stored(asked)
        if not asked.limit(1).count():
            return taken
        looked = asked.select("o", "n") if looked is None else looked.unionByName(asked.select("o", "n"))
        pairs = asked.join(side(o, "o").withColumn("o", key("o_")), "o").join(side(n, "n").withColumn("n", key("n_")), "n").drop("o", "n")
        seen = stored(seen.unionByName(rated(pairs)).dropDuplicates(["o", "n"]))


def scored_pairs(deleted: DataFrame, added: DataFrame, threshold: float) -> DataFrame:
    """o_id, n_id, score of all pairs of ``candidates`` whose ``pair_score`` is ``threshold``
    at least; rows have id, kind, name, path, items and limits (never null).

    Rows of a kind with the same items and limits are one class. Classes meet on the items
    that they share, each pair at the first of these alone, and are scored once; a pair goes
    on to its rows only if it can reach the threshold with the best path and the best name
    that is not the same. Pairs whose names have one form meet by that form."""
    form = identifier_form(F.col("name"))
    rows = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), "kind", F.col("name").alias(f"{s}_name"), F.col("path").alias(f"{s}_path"), form.alias(f"{s}_form"), F.array_sort(F.array_distinct("items")).alias(f"{s}_set"), F.array_sort(F.array_distinct("limits")).alias(f"{s}_limits"))
    o, n = stored(rows(deleted, "o")), stored(rows(added, "n"))
    length, unnamed = o.select(F.col("o_form").alias("f")).union(n.select("n_form")).agg(F.max(F.length("f")), F.max(F.col("f").isNull())).first()
    near = 100.0 if unnamed else 100.0 * (1 - 1 / max(length or 1, 1))
    least = (threshold - 20.0 - 0.15 * near - 5.0) / 60.0
    attributes, limits = jaccard(F.col("o_set"), F.col("n_set")), jaccard(F.col("o_limits"), F.col("n_limits"))

    def score(df: DataFrame, same: bool, attrs: Column, lims: Column) -> DataFrame:
        value = pair_score(F.lit(same), attrs, lims, 100 * path_shape(F.col("o_path"), F.col("n_path")), name_similarity(F.col("o_name"), F.col("n_name")))
        return df.select("o_id", "n_id", F.round(value, 6).alias("score")).where(F.col("score") >= threshold)

    named = score(o.join(n.withColumn("o_name", F.col("n_name")), ["kind", "o_name"]), True, attributes, limits)
    lone = stored(o.join(n.select("kind", F.col("n_name").alias("o_name")).distinct(), ["kind", "o_name"], "left_anti"))
    formed = lone.join(n.withColumn("o_form", F.col("n_form")), ["kind", "o_form"]).where(attributes >= 100 * least_attributes(threshold) - 1e-7)

    def classes(df: DataFrame, s: str) -> DataFrame:
        one = df.where(F.col(f"{s}_set").isNotNull()).select("kind", F.col(f"{s}_set").alias("set"), F.col(f"{s}_limits").alias("limits")).distinct()
        return stored(one.withColumn(f"{s}_class", F.monotonically_increasing_id()))

    oc, nc = classes(lone, "o"), classes(n, "n")
    # "0" stands for the empty set, "1" leads an item
    keys = F.when(F.size("set") == 0, F.array(F.lit("0"))).otherwise(F.transform("set", lambda x: F.concat(F.lit("1"), x)))
    side = lambda df, s: df.select("kind", f"{s}_class", F.col("set").alias(f"{s}_set"), F.col("limits").alias(f"{s}_limits"), keys.alias(f"{s}_keys")).select("*", F.explode(f"{s}_keys").alias("key"))
    met = side(oc, "o").join(side(nc, "n"), ["kind", "key"]).withColumn("both", F.array_intersect("o_keys", "n_keys")).where(F.get("both", F.lit(0)) == F.col("key"))
    shared = F.size("both")
    met = met.withColumn("attrs", 100.0 * shared / (F.size("o_keys") + F.size("n_keys") - shared)).where(F.col("attrs") >= 100 * least - 1e-7)
    met = met.withColumn("lims", limits)
    if not unnamed:  # a pair without a name has the full score
        met = met.where(0.60 * F.col("attrs") + 0.20 * F.col("lims") + 0.15 * near + 5.0 >= threshold - 1e-6)
    alike = stored(met.select("o_class", "n_class", "attrs", "lims"))
    named_by = lambda df, c, s: df.join(c.select("kind", F.col("set").alias(f"{s}_set"), F.col("limits").alias(f"{s}_limits"), f"{s}_class"), ["kind", f"{s}_set", f"{s}_limits"]).select(f"{s}_class", f"{s}_id", f"{s}_name", f"{s}_path", f"{s}_form")
    other = alike.join(named_by(lone, oc, "o"), "o_class").join(named_by(n, nc, "n"), "n_class").where(F.coalesce(F.col("o_form") != F.col("n_form"), F.lit(True)))
    return named.unionByName(score(formed, False, attributes, limits)).unionByName(score(other.where(F.col("attrs") >= 100 * least_attributes(threshold) - 1e-7), False, F.col("attrs"), F.col("lims")))


def set_similarity(a: Column, b: Column) -> Column:
    return jaccard(a, b)


def greedy_assign(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """The pairs that greedy choice by (score descending, left, right) takes: each id once.

    Under that strict order the choice is the fixpoint of taking pairs that are the best
    for both their sides, and of classes of ties: where lefts all have the same rights
    as their best and these have just the lefts, the i-th left gets the i-th right in
    one round. Each round is aggregates and joins, so no group of pairs is collected in
    one task. Ids are distinct values of their side; pairs without one are left out."""
    rank = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
    rest, taken, n = stored(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn("__rank", rank)), None, 0
    while rest.limit(1).count():
        by_left = rest.groupBy(left).agg(F.min("__rank").alias("__bl"))
        by_right = rest.groupBy(right).agg(F.min("__rank").alias("__br"))
        ranked = stored(rest.join(by_left, left).join(by_right, right))
        dealt = _tied(ranked.select(F.col(left).alias("l"), F.col(right).alias("r"), "__rank", "__bl", "__br"))
        both = ranked.join(dealt.select(F.col("l").alias(left), F.col("r").alias(right), F.lit(True).alias("__dealt")), [left, right], "left")
        mutual = (F.col("__rank") == F.col("__bl")) & (F.col("__rank") == F.col("__br"))
        top = F.col("__rank.s").eqNullSafe(F.col("__bl.s"))
        best = stored(both.where(mutual | (F.col("__dealt") & top)).select(*pairs.columns))
        taken, n = best if taken is None else taken.unionByName(best), n + 1
        if n % CUT_ROUNDS == 0:
            taken = stored(taken)
        rest = stored(rest.join(best.select(left), left, "left_anti").join(best.select(right), right, "left_anti"))
    return pairs.limit(0) if taken is None else taken


def _tied(ranked: DataFrame) -> DataFrame:
    """(l, r) of the classes of ties among pairs l, r, __rank, with the best ranks __bl
    and __br of both sides. A class is named by its score, least left and least right;
    counts then prove that it has all pairs of its lefts and rights, and that neither
    have another best partner."""
    s, l_top, r_top = F.col("__rank.s"), F.col("__bl.s"), F.col("__br.s")
    own = ranked.where(s.eqNullSafe(l_top)).groupBy("l").agg(F.count(F.lit(1)).alias("nl"))
    others = ranked.where(s.eqNullSafe(r_top)).groupBy("r").agg(F.count(F.lit(1)).alias("nr"))
    key = ["cs", "ca", "cb"]
    met = ranked.where(s.eqNullSafe(l_top) & s.eqNullSafe(r_top)).select("l", "r", s.alias("cs"), F.col("__br.l").alias("ca"), F.col("__bl.r").alias("cb")).join(own, "l").join(others, "r")

    def side(i: str, n: str) -> tuple[DataFrame, DataFrame]:
        ids = met.groupBy(*key, i).agg(F.count(F.lit(1)).alias("e"), F.max(n).alias("all"))
        return ids, ids.groupBy(*key).agg(F.count(F.lit(1)).alias(f"ids_{i}"), F.min("e").alias(f"e_{i}"), F.max("all").alias(f"all_{i}"))

    (ls, l_sum), (rs, r_sum) = side("l", "nl"), side("r", "nr")
    whole = l_sum.join(r_sum, key).where("e_l = all_l and e_r = all_r and e_l = ids_r and e_r = ids_l").select(*key)
    at = lambda ids, i: ids.join(whole, key, "left_semi").select(*key, i, F.row_number().over(Window.partitionBy(*key).orderBy(i)).alias("at"))
    return at(ls, "l").join(at(rs, "r"), [*key, "at"]).select("l", "r")


def with_rep(rows: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with ``rep``, the least ``key`` of the rows that say the same else."""
    each = stored(spread(rows).withColumn("__class", F.md5(F.to_json(F.struct(*[c for c in rows.columns if c != key])))))
    return stored(each.join(each.groupBy("__class").agg(F.min(key).alias("rep")), "__class").drop("__class"))


def greedy_assign_copies(pairs: DataFrame, left: str, right: str, score: str, lefts: DataFrame, rights: DataFrame) -> DataFrame:
    """What ``greedy_assign`` takes where each left and right of ``pairs`` stands for rows
    that say the same, without pairing these: ``lefts`` and ``rights`` have (rep, id) of
    the rows.

    The greedy choice is the one stable matching under (score descending, left, right), so
    lefts ask and rights keep the best who asked, until nobody is refused. In a round the
    free rows of a class ask by their ids the first rights that the least of them could
    still have, one each: a right that one of them asks has that one or a better one, and
    never takes a later row of the class. Who finds no right to ask is done. A class meets
    the rows of its rights, not all pairs of rows. An id that has several classes is chosen
    among pairs of rows."""
    side = lambda df, c: stored(df.where("id is not null").select("rep", "id").distinct().join(pairs.select(F.col(c).alias("rep")), "rep", "left_semi"))
    l, r = side(lefts, left), side(rights, right)
    many = lambda df: df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n")
    if many(l).unionByName(many(r)).limit(1).count():
        named = lambda df, c: df.select(F.col("rep").alias(c), F.col("id").alias(f"__{c}"))
        rows = pairs.join(named(l, left), left).join(named(r, right), right).select(F.col(f"__{left}").alias(left), F.col(f"__{right}").alias(right), score).distinct()
        return greedy_assign(rows, left, right, score)
    able = stored(pairs.select(F.col(left).alias("rep"), (-F.col(score)).alias("s"), F.col(right).alias("r_rep")).join(r.select(F.col("rep").alias("r_rep"), F.col("id").alias("r")), "r_rep").drop("r_rep"))
    free = l.select("rep", F.col("id").alias("l"))
    held = stored(able.select("r", F.struct("s", F.lit(None).cast(l.schema["id"].dataType).alias("l"), "rep").alias("has")).limit(0))
    while True:
        asking = free.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.min("l").alias("first"))
        still = able.join(asking, "rep").join(held, "r", "left").where(F.col("has").isNull() | (F.struct("s", F.col("first").alias("l")) < F.struct("has.s", "has.l")))
        at = lambda df, *by: df.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy(*by)))
        asked = at(still, "s", "r").where("at <= n").join(at(free, "l"), ["rep", "at"]).select("r", F.struct("s", "l", "rep").alias("has"))
        every = stored(asked.unionByName(held))
        held = stored(every.groupBy("r").agg(F.min("has").alias("has")))
        free = stored(every.select("has.rep", "has.l").join(held.select("has.l"), "l", "left_anti").select("rep", "l"))
        if not free.limit(1).count():
            return held.select(F.col("has.l").alias(left), F.col("r").alias(right), (-F.col("has.s")).alias(score))


def items_by_name(old: DataFrame, new: DataFrame, owner: str, name: str, items: str, least: float = 55.0) -> DataFrame:
    """owner, old_name, new_name, action of the items of lists. Items of an owner meet by
    name; of the others the greedy choice by the similarity of ``items`` (an array), from
    ``least`` on; the rest is added or deleted. Names are distinct in an owner."""
    o = old.select(owner, F.col(name).alias("old_name"), F.col(items).alias("a"))
    n = new.select(owner, F.col(name).alias("new_name"), F.col(items).alias("b"))
    named = o.withColumn("name", F.col("old_name")).join(n.withColumn("name", F.col("new_name")), [owner, "name"], "full_outer")
    met = named.where("old_name is not null and new_name is not null").select(owner, "old_name", "new_name", F.when(F.array_sort("a") == F.array_sort("b"), "unchanged").otherwise("changed").alias("action"))
    side = lambda c, v: named.where(F.col("new_name" if c == "old_name" else "old_name").isNull()).select(F.col(owner).alias("kind"), F.col(c).alias("name"), F.col(v).alias("items"))
    gone, came = stored(side("old_name", "a")), stored(side("new_name", "b"))
    pairs = candidates(gone, came, "kind", "name", "items", least / 100)
    key = lambda s: F.concat_ws("\u0001", F.col(f"{s}_kind").cast("string"), f"{s}_name")
    scored = pairs.select(key("o").alias("o"), key("n").alias("n"), F.col("o_kind").alias(owner), F.col("o_name").alias("old_name"), F.col("n_name").alias("new_name"), F.round(jaccard(F.col("o_items"), F.col("n_items")), 6).alias("score")).where(F.col("score") >= least)
    taken = stored(greedy_assign(scored, "o", "n", "score").select(owner, "old_name", "new_name", F.lit("changed").alias("action")))
    left = lambda df, c, action: df.select(F.col("kind").alias(owner), F.col("name").alias(c)).join(taken.select(owner, c), [owner, c], "left_anti").select(owner, *[(F.col(x) if x == c else F.lit(None).cast("string")).alias(x) for x in ("old_name", "new_name")], F.lit(action).alias("action"))
    return met.unionByName(taken).unionByName(left(gone, "old_name", "deleted")).unionByName(left(came, "new_name", "added"))


def moved_paths(parents: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (with path) that are below a paired parent (old_path, new_path), with
    ``place``: where each would be had only its nearest paired ancestor moved. Ancestors
    are listed and joined by equality."""
    from tessera.functions.text import ancestors

    up = rows.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "anc")).distinct()
    near = up.join(parents.select(F.col("old_path").alias("anc"), F.col("new_path").alias("moved")), "anc").groupBy("path").agg(F.max_by(F.struct("anc", "moved"), "depth").alias("m"))
    want = near.select("path", F.concat(F.col("m.moved"), F.expr("substring(path, length(m.anc) + 1)")).alias("place"))
    return rows.join(want, "path")


def child_pairs(parents: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    """(old_path, new_path) of nodes below a paired parent with the same suffix: each
    deleted node takes its nearest paired ancestor."""
    want = moved_paths(parents, deleted.select("path").distinct()).select(F.col("path").alias("old_path"), F.col("place").alias("new_path"))
    return want.join(added.select(F.col("path").alias("new_path")).distinct(), "new_path", "left_semi").select("old_path", "new_path")


def drop_aliases(changes: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Without the added rows whose keys (nulls are alike) are those of a row that is
    matched already: a definition that several places use is one statement of a file."""
    seen = matched.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.col("action") == "added"
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return changes.join(seen, same, "left_anti")
