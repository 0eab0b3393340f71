"""Fairness: the macro and micro metrics by slices of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .metrics import macro_micro


def fairness_gap(preds: DataFrame, flag: str = "has_identity", by: Sequence[str] = ("model",)) -> DataFrame:
    """Macro F1 of rows with and without the flag, and their difference."""
    f1 = macro_micro(preds, [*by, flag])
    on, off = F.col(flag) == 1, F.col(flag) == 0
    return f1.groupBy(*by).agg(
        F.max(F.when(on, F.col("f1_macro"))).alias("with_identity"),
        F.max(F.when(off, F.col("f1_macro"))).alias("without_identity"),
    ).withColumn("gap", F.col("without_identity") - F.col("with_identity"))


def fairness_by_term(preds: DataFrame, terms: str = "terms", by: Sequence[str] = ("model",)) -> DataFrame:
    """Macro F1 per identity term, best first; a term without rows has none.
    ``terms`` names an array of the terms of a row (``tagging.with_terms``, before a
    text's rows multiply). All terms in one pass: a row counts for each it holds."""
    fanned = preds.withColumn("term", F.explode(terms))
    return macro_micro(fanned, [*by, "term"]).select(*by, "term", "f1_macro").orderBy(
        *by, F.desc("f1_macro"), "term"
    )


def slice_by_flags(preds: DataFrame, flags: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """Metrics of the rows where a flag is set, for each flag."""
    names = F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in flags])
    fanned = preds.withColumn("flag", F.explode(F.array_compact(names)))
    return macro_micro(fanned, [*by, "flag"])


def slice_by_length(preds: DataFrame, n_words: str = "n_words", by: Sequence[str] = ("model",)) -> DataFrame:
    """Metrics for texts of fewer than 10, 10 to 50 and more than 50 words."""
    n = F.col(n_words)
    band = F.when(n < 10, "<10").when(n <= 50, "10-50").otherwise(">50")
    return macro_micro(preds.withColumn("length_band", band), [*by, "length_band"])


def slice_by_score(preds: DataFrame, score: str = "p", by: Sequence[str] = ("model",)) -> DataFrame:
    """Metrics per score band: low below 0.3, medium below 0.7, high from there."""
    band = F.when(F.col(score) < 0.3, "low").when(F.col(score) < 0.7, "medium").otherwise("high")
    return macro_micro(preds.withColumn("score_band", band), [*by, "score_band"])
