"""What several operators here share: materialised steps, scratch column names, numbering and components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as Wd, functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one in the
    session's warehouse, which every executor shares as well."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_steps"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, survives
    lost executors, and gives later plans a measured size."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Column names that the table does not hold (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later expressions may use many times. The one-element
    generator keeps Spark from copying their expressions into every use."""
    fields = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    return df.select("*", F.inline(fields))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def numbered(df: DataFrame, by: Sequence[str], spread: Column, order: Sequence[str | Column], out: str, per_bucket: int = 50_000) -> DataFrame:
    """0-based gapless number of every row in its group, without a window over
    the group: rows fall into buckets by ``spread`` (a uniform double in [0, 1)
    drawn from the row), as many as the group's count asks for; a window numbers
    the rows of a bucket, and the counts of the buckets before it are added.

    ``by`` may hold no nulls. Equal rows get different numbers; the table must be
    stable (written), as it is read twice.
    """
    by = list(by)
    sizes = df.groupBy(*by).agg(F.ceil(F.count("*") / per_bucket).alias("_nb"))
    cut = df.join(sizes, by).withColumn("_b", F.floor(spread * F.col("_nb"))).drop("_nb")
    before = Wd.partitionBy(*by).orderBy("_b").rowsBetween(Wd.unboundedPreceding, -1)
    counts = cut.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    starts = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    within = Wd.partitionBy(*by, "_b").orderBy(*order)
    placed = cut.join(starts, [*by, "_b"])
    return placed.withColumn(out, F.col("_o") + F.row_number().over(within) - 1).drop("_b", "_o")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node
    reachable. Each round every node points its neighbours to the smallest node
    it knows (large stars), then every node links its smaller ones to their
    smallest (small stars), until nothing changes; rounds grow with the
    logarithm of the longest path, and every round is written."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    total = -1
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = written(small.select("e.a", "e.b").filter("a <> b").distinct())
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if state == total:
            break
        edges, total = new, state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
