"""Model comparison and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import join_null_safe

OVERALL = ["f1_macro", "f1_micro", "roc_auc_macro", "roc_auc_micro"]


def winner(a: Column, b: Column, name_a: str, name_b: str) -> Column:
    """The name with the strictly larger value, else Tie."""
    return F.when(b > a, F.lit(name_b)).when(a > b, F.lit(name_a)).otherwise(F.lit("Tie"))


def align_metrics(metrics: DataFrame, name_a: str, name_b: str, on: list[str]) -> DataFrame:
    """Long metrics (model, on…, value) of two models side by side."""
    side = lambda name, out: metrics.filter(F.col("model") == name).select(*on, F.col("value").alias(out))
    both = join_null_safe(side(name_a, "value_a"), side(name_b, "value_b"), on)
    return both.withColumn("winner", winner(F.col("value_a"), F.col("value_b"), name_a, name_b))


def to_metric_rows(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Wide metric columns to rows (keys…, metric, value); null values dropped."""
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(*keys, F.inline(rows)).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def compare_models(overall: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """Winner per overall metric. ``overall`` is (model, f1_macro, …)."""
    rows = to_metric_rows(overall, ["model"], [c for c in OVERALL if c in overall.columns])
    return align_metrics(rows, name_a, name_b, ["metric"])


def compare_per_label(per_label: DataFrame, name_a: str, name_b: str, names: list[str] = ["f1", "roc_auc"]) -> DataFrame:
    """Winner per label and metric. ``per_label`` is (model, label, f1, roc_auc, …)."""
    return align_metrics(to_metric_rows(per_label, ["model", "label"], list(names)), name_a, name_b, ["label", "metric"])


def mean_label_auc(per_label: DataFrame) -> DataFrame:
    """(model, roc_auc_micro) as the mean of the labels' AUC, the stand-in used
    where no pooled AUC was recorded; ``curves.roc_auc`` by model gives that."""
    return per_label.groupBy("model").agg(F.avg("roc_auc").alias("roc_auc_micro"))


def report_tables(per_label: DataFrame) -> DataFrame:
    """Per-label F1, precision, recall and AUC of every model, four decimals."""
    names = ["f1", "precision", "recall", "roc_auc"]
    return per_label.select("model", "label", *[F.format_string("%.4f", F.col(n)).alias(n) for n in names])


def confusion_matrix(counts: DataFrame, keys: list[str] = ["model", "label"]) -> DataFrame:
    """The four counts as rows (keys…, actual, predicted, n)."""
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return counts.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
        for c, (a, p) in cells.items()
    ])))
