"""Exact ranks and running sums without a one-task window.

A window over the whole table, or over one dominant group, is sorted by one
task. Both operators here cut the order into buckets, work inside the buckets
in parallel, and add what the earlier buckets hold. Only the bucket totals (a
fixed number per group) meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as Wd, functions as F


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; no row is lost."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in on])


def ranked(
    df: DataFrame, order: Column, ties: Sequence[str], by: Sequence[str] = (), out: str = "rank",
    total: str | None = None, prefix: int = 4,
) -> DataFrame:
    """0-based position of every row in its group, ordered by a hex hash.

    ``order`` must be an md5 text: its first ``prefix`` digits cut a group, even
    one that holds most rows, into ``16**prefix`` even buckets. ``ties`` settles
    equal hashes. ``total`` names an optional column with the group size.
    """
    by = list(by)
    keyed = df.withColumn("_h", order).withColumn("_b", F.left("_h", F.lit(prefix)))
    sizes = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Wd.partitionBy(*by).orderBy("_b").rowsBetween(Wd.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Wd.partitionBy(*by)))
    within = Wd.partitionBy(*by, "_b").orderBy("_h", *ties)
    numbered = keyed.withColumn("_i", F.row_number().over(within) - 1)
    placed = join_null_safe(numbered, offsets.drop("_n"), [*by, "_b"])
    return placed.withColumn(out, F.col("_before") + F.col("_i")).drop("_h", "_b", "_i", "_before")


def running_sums(
    points: DataFrame, by: Sequence[str], order: str, sums: dict[str, str], totals: dict[str, str],
    buckets: int = 128,
) -> DataFrame:
    """Running sums in descending ``order`` and totals per group.

    ``points`` holds one row per (group, order value). The cut points are
    quantiles of the order values over all groups, so every bucket holds about
    the same share of the points however they are distributed; they form one
    array of ``buckets`` doubles, computed by a scalar subquery. Where the cuts
    fall changes the balance and never the result.
    """
    by = list(by)
    shares = F.expr(f"array({', '.join(f'{i / buckets}D' for i in range(1, buckets))})")
    # Names every column of the points, so that the subquery needs the same
    # shuffle as the branches below and Spark runs it once.
    present = points.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in sums]))
    cuts = present.agg(F.array_distinct(F.percentile_approx(order, shares, 10 * buckets)).alias("c")).scalar()
    # The place of the value among the cuts: subqueries may not enter a lambda.
    placed = F.array_position(F.sort_array(F.array_append(cuts, F.col(order))), F.col(order))
    cut = points.withColumn("_b", placed.cast("int"))
    per_bucket = cut.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    above = Wd.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Wd.unboundedPreceding, -1)
    whole = Wd.partitionBy(*by)
    offsets = per_bucket.select(
        *by, "_b",
        *[F.coalesce(F.sum(f"_s_{c}").over(above), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(whole).alias(name) for c, name in totals.items()],
    )
    down = Wd.partitionBy(*by, "_b").orderBy(F.desc(order)).rowsBetween(Wd.unboundedPreceding, 0)
    inside = cut.withColumns({f"_i_{c}": F.sum(c).over(down) for c in sums})
    joined = join_null_safe(inside, offsets, [*by, "_b"])
    return joined.withColumns({name: F.col(f"_o_{c}") + F.col(f"_i_{c}") for c, name in sums.items()}).drop(
        "_b", *[f"_i_{c}" for c in sums], *[f"_o_{c}" for c in sums]
    )
