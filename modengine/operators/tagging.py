"""Tagging, filters, guards and corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon, tags, text

LABELS = lexicon.LABELS


def with_identity(df: DataFrame, col: str = "text", mode: str = "substring") -> DataFrame:
    return df.withColumn("has_identity", tags.has_identity(F.col(col), mode))


def identity_matches(df: DataFrame, col: str = "text", terms: Sequence[str] = tuple(lexicon.IDENTITY_TERMS)) -> DataFrame:
    """One row per (row, matching term)."""
    return with_terms(df, col, terms).withColumn("term", F.explode("terms")).drop("terms")


def with_terms(df: DataFrame, col: str = "text", terms: Sequence[str] = tuple(lexicon.IDENTITY_TERMS)) -> DataFrame:
    """Adds ``terms``, the identity terms in the text. The text is lowered once, and
    later filters on the terms do not repeat the search."""
    low = df.withColumn("_low", F.explode(F.array(F.lower(text.text_or_empty(F.col(col))))))
    found = low.withColumn("terms", F.explode(F.array(tags.terms_in_lowered(F.col("_low"), terms))))
    return found.drop("_low")


def weak_labels(df: DataFrame, col: str = "text") -> DataFrame:
    """Adds the six keyword labels."""
    low = df.withColumn("_low", F.lower(text.text_or_empty(F.col(col))))
    hits = low.withColumn("_hits", tags.keyword_hits(F.col("_low")))
    return hits.withColumns(tags.labels_of_hits(F.col("_hits"))).drop("_low", "_hits")


def obfuscation_flags(df: DataFrame, col: str = "text") -> DataFrame:
    """Adds one flag per disguise and their disjunction ``is_obfuscated``."""
    flags = tags.obfuscation_flag_columns(F.col(col))
    return df.withColumns(flags).withColumn("is_obfuscated", F.greatest(*[F.col(n) for n in flags]))


def min_tokens(df: DataFrame, n: int = 5, col: str = "clean") -> DataFrame:
    """Rows with at least ``n`` words."""
    return df.filter(text.n_tokens(F.col(col)) >= n)


def drop_empty(df: DataFrame, col: str = "clean") -> DataFrame:
    """Rows whose text is not blank."""
    return df.filter(F.length(text.squeeze_ws(F.col(col))) > 0)


def emptiness_report(df: DataFrame, col: str = "clean") -> DataFrame:
    """How many rows there are, how many stay and how many ``drop_empty`` removes."""
    kept = F.coalesce((F.length(text.squeeze_ws(F.col(col))) > 0), F.lit(False))
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_removed")
    )


def require_rows(df: DataFrame, n: int = 1) -> DataFrame:
    """Raise unless there are ``n`` rows; looks at no more than ``n``."""
    found = df.limit(n).count()
    if found < n:
        raise ValueError(f"need at least {n} rows after filtering, got {found}")
    return df


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise a ValueError that lists the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def to_long(df: DataFrame, keys: Sequence[str], labels: Sequence[str] = tuple(LABELS)) -> DataFrame:
    """Wide label columns to rows (keys…, label, y); -1 where missing."""
    pairs = F.array(*[
        F.struct(F.lit(l).alias("label"), F.coalesce(F.col(l).cast("int"), F.lit(-1)).alias("y")) for l in labels
    ])
    return df.select(*keys, F.inline(pairs))


def judged(df: DataFrame) -> DataFrame:
    """Rows whose label was judged."""
    return df.filter(F.col("y") >= 0)


def label_distribution(df: DataFrame, labels: Sequence[str] = tuple(LABELS)) -> DataFrame:
    """Positives per label: one aggregate over the wide table, then turned."""
    sums = df.agg(*[F.sum((F.col(l) == 1).cast("long")).alias(l) for l in labels])
    return sums.select(_turn(labels, lambda l: {"positives": F.coalesce(F.col(l), F.lit(0))}))


def pos_weights(df: DataFrame, labels: Sequence[str] = tuple(LABELS)) -> DataFrame:
    """Negatives / positives per label; null without positives. Rows whose label
    was not judged (-1 or null) count for neither."""
    sums = df.agg(*[
        F.struct(F.count_if(F.col(l).isin(0, 1)).alias("n"), F.count_if(F.col(l) == 1).alias("pos")).alias(l) for l in labels
    ])
    return sums.select(_turn(labels, lambda l: {
        "total": F.col(l)["n"],
        "positives": F.col(l)["pos"],
        "pos_weight": F.try_divide((F.col(l)["n"] - F.col(l)["pos"]).cast("double"), F.col(l)["pos"].cast("double")),
    }))


def _turn(labels: Sequence[str], values) -> Column:
    return F.inline(F.array(*[
        F.struct(F.lit(l).alias("label"), *[v.alias(n) for n, v in values(l).items()]) for l in labels
    ]))


def length_stats(df: DataFrame, col: str = "clean", exact: bool = True) -> DataFrame:
    """Min, max, mean and median word count.

    The exact median keeps one counter per distinct length, so its state is
    bounded by the longest text and not by the number of texts.
    """
    n = df.select(text.n_tokens(F.col(col)).alias("n"))
    middle = F.median("n") if exact else F.percentile_approx("n", 0.5).cast("double")
    return n.agg(
        F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"),
        F.avg("n").alias("mean_tokens"), middle.alias("median_tokens"),
    )


def cleaning_effectiveness(df: DataFrame, original: str = "text", cleaned: str = "clean") -> DataFrame:
    """Share of words that cleaning removed, in percent with two decimals."""
    sums = df.agg(
        F.coalesce(F.sum(text.n_tokens(F.col(original))), F.lit(0)).alias("original_tokens"),
        F.coalesce(F.sum(text.n_tokens(F.col(cleaned))), F.lit(0)).alias("clean_tokens"),
    )
    o, k = F.col("original_tokens"), F.col("clean_tokens")
    share = F.when(o == 0, F.lit(0.0)).otherwise(F.bround((o - k) / o * 100, 2))
    return sums.withColumn("reduction_pct", share)


def set_totals(df: DataFrame) -> DataFrame:
    """Rows, toxic and clean rows, their share, and different patterns of an attack set."""
    toxic = F.coalesce(F.sum("is_toxic"), F.lit(0))
    return df.agg(
        F.count("*").alias("n_rows"), toxic.alias("n_toxic"), (F.count("*") - toxic).alias("n_clean"),
        F.avg("is_toxic").alias("toxic_share"), F.countDistinct("pattern").alias("n_patterns"),
    )


def set_head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows of an attack set in a given order: a top-k, not a full sort."""
    return df.orderBy(*order).limit(n)


def set_stats(df: DataFrame) -> DataFrame:
    """Rows, toxic rows and toxic share per pattern of an attack set, commonest first."""
    return df.groupBy("pattern").agg(
        F.count("*").alias("n_rows"), F.sum("is_toxic").alias("n_toxic"), F.avg("is_toxic").alias("toxic_share")
    ).orderBy(F.desc("n_rows"), "pattern")
