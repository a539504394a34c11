"""Parent-child graphs: neighbours and closures."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import stored


def neighbours(nodes: DataFrame, wanted: DataFrame, id_cols: list[str], parent_cols: list[str]) -> DataFrame:
    """(id..., kind, other...): the parent and the children of each wanted node, by two
    equality joins."""
    want = wanted.select(*[F.col(c).alias(f"w_{c}") for c in id_cols], *[F.col(c).alias(f"p_{c}") for c in parent_cols])
    n = nodes.select(*id_cols, *parent_cols)
    same = lambda a, b: [F.col(x) == F.col(y) for x, y in zip(a, b)]
    fold = lambda conds: reduce(and_, conds)
    mine = [f"w_{c}" for c in id_cols]
    out = [F.col(f"w_{c}").alias(c) for c in id_cols]
    other = [F.col(c).alias(f"other_{c}") for c in id_cols]
    parent = want.join(n, fold(same([f"p_{c}" for c in parent_cols], id_cols))).select(*out, F.lit("parent").alias("kind"), *other)
    child = want.join(n, fold(same(mine, parent_cols))).select(*out, F.lit("child").alias("kind"), *other)
    return parent.unionByName(child)


def closure(edges: DataFrame, child: str, parent: str, max_depth: int | None = None) -> DataFrame:
    """(child, ancestor, depth): every ancestor at its least depth. Known depths double in
    each round: what is 2k away is k away from what is k away. It ends when nothing is at
    the greatest known depth, so rounds grow with the logarithm of the longest path and
    cycles end. ``max_depth``, where given, is part of what is asked for: no ancestor
    beyond it."""
    done = stored(edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).where("child is not null and ancestor is not null").distinct().withColumn("depth", F.lit(1)))
    k = 1
    while max_depth is None or k < max_depth:
        far = done.where(F.col("depth") == k)
        if not far.limit(1).count():
            break
        step = done.select(F.col("child").alias("c"), F.col("ancestor").alias("a"), F.col("depth").alias("more"))
        new = far.join(step, far.ancestor == step.c).groupBy(far.child, step.a.alias("ancestor")).agg(F.min(far.depth + step.more).alias("depth"))
        if max_depth is not None:
            new = new.where(F.col("depth") <= max_depth)
        new = new.join(done.select("child", "ancestor"), ["child", "ancestor"], "left_anti")
        done, k = stored(done.unionByName(new)), 2 * k
    return done


def terminals(nodes: DataFrame, id_col: str, to_col: str, value: str) -> DataFrame:
    """(id, terminal, value): where each node that points to another one ends up, and the
    value there. A node with a null pointer is an end; who runs in a circle or into
    nothing has none."""
    links = nodes.where(F.col(to_col).isNotNull())
    ends = nodes.where(F.col(to_col).isNull()).select(F.col(id_col).alias("terminal"), F.col(value))
    far = closure(links, id_col, to_col).join(ends, F.col("ancestor") == F.col("terminal")).select("child", "terminal", value)
    return links.select(F.col(id_col)).join(far, F.col(id_col) == F.col("child"), "left").select(id_col, "terminal", value)
