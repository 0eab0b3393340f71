"""Sampling, shuffling and splitting, all from hashes of the row key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as Wd, functions as F

from ..functions import lexicon
from ..functions.rand import det_index, hash_hex
from ..sources.checkpoint import cut_lineage
from .ranking import ranked


def draw_with_replacement(pool: DataFrame, keys: Sequence[str], n: int, salt: str, out: str = "draw", prefix: int = 4) -> DataFrame:
    """Exactly ``n`` rows drawn from ``pool`` with replacement, numbered in ``out``.

    A draw is a place in the hash order of the rows. First the draws are allotted
    to hash buckets by the counts of these (``16**prefix`` rows at most); then only
    the buckets that were hit are sorted, each on its own, and an equi-join
    fetches the rows. An empty pool gives no rows.
    """
    keyed = pool.withColumn("_h", hash_hex(salt, *[F.col(k) for k in keys])).withColumn("_b", F.left("_h", F.lit(prefix)))
    size = pool.agg(F.count("*").alias("n")).scalar()
    before = Wd.orderBy("_b").rowsBetween(Wd.unboundedPreceding, -1)  # over the counts alone
    counts = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    spans = counts.withColumns({"_low": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_step": F.ceil(size / 16**prefix)})
    # A grid over the places turns the search for the bucket into an equi-join.
    cells = F.sequence(F.floor(F.col("_low") / F.col("_step")), F.floor((F.col("_low") + F.col("_n") - 1) / F.col("_step")))
    spans = spans.select("_b", "_low", "_n", F.explode(cells).alias("_cell"))
    draws = pool.sparkSession.range(n).select(
        F.col("id").alias(out), det_index(F.concat_ws(":", F.lit(salt), "id"), "draw", size).alias("_pos"), F.ceil(size / 16**prefix).alias("_step"),
    ).withColumn("_cell", F.floor(F.col("_pos") / F.col("_step")))
    lands = (F.col("_pos") >= F.col("_low")) & (F.col("_pos") < F.col("_low") + F.col("_n"))
    allotted = cut_lineage(draws.join(spans, "_cell").filter(lands).select(out, "_b", (F.col("_pos") - F.col("_low")).alias("_i")))
    hit = keyed.join(allotted.select("_b").distinct(), "_b", "left_semi")
    inside = hit.withColumn("_i", F.row_number().over(Wd.partitionBy("_b").orderBy("_h", *keys)) - 1)
    return allotted.join(inside, ["_b", "_i"]).drop("_b", "_i", "_h")


def oversample(
    df: DataFrame, key: str, labels: Sequence[str] = tuple(lexicon.RARE_LABELS), n: int = 3000, seed: int = 42
) -> DataFrame:
    """For each label in turn, append ``n`` positives drawn with replacement.

    Later labels draw from the table as grown by earlier ones. ``copy`` tells
    the rows apart: empty for an original, else the path of draws that led here.
    """
    originals = df.withColumn("copy", F.lit(""))
    # Draws look at rare rows only. These and the copies are written once, so the
    # full table is read twice in all and not once per label and step.
    rare = reduce(lambda a, b: a | b, [F.col(label) == 1 for label in labels])
    pool = cut_lineage(originals.filter(rare))
    grown = originals
    for label in labels:
        positives = pool.filter(F.col(label) == 1)
        drawn = draw_with_replacement(positives, [key, "copy"], n, f"{seed}:{label}", "_draw")
        path = F.concat("copy", F.lit(f"/{label}:"), F.col("_draw").cast("string"))
        copies = cut_lineage(drawn.withColumn("copy", path).drop("_draw"))
        pool, grown = pool.unionByName(copies), grown.unionByName(copies)
    return grown


def shuffled(df: DataFrame, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """All rows in hash order: a range-partitioned sort."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(hash_hex(seed, *[F.col(k) for k in keys]), *keys)


def peek(df: DataFrame, key: str, n: int = 3, seed: int = 42) -> DataFrame:
    """``n`` rows at random, fewer if there are fewer: a top-k, not a full sort."""
    return df.orderBy(hash_hex(seed, F.col(key)), key).limit(n)


def label_set(labels: Sequence[str] = tuple(lexicon.LABELS)) -> Column:
    """The labels of a row as one text of digits, the key of stratification."""
    return F.concat(*[F.coalesce(F.col(l).cast("string"), F.lit("-1")) for l in labels])


def stratified_folds(
    df: DataFrame, key: str, k: int = 3, labels: Sequence[str] = tuple(lexicon.LABELS), seed: int = 42,
    prefix: int = 4,
) -> DataFrame:
    """Adds ``fold`` in 0..k-1; rows of one label set are dealt out evenly.

    The commonest set (no label at all) usually holds most rows, so positions
    come from ``ranked`` and not from one window per set.
    """
    strata = df.withColumn("label_set", label_set(labels))
    dealt = ranked(strata, hash_hex(seed, F.col(key)), [key], by=["label_set"], out="_pos", prefix=prefix)
    return dealt.withColumn("fold", (F.col("_pos") % k).cast("int")).drop("_pos")
