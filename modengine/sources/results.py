"""Metric results: writing, and reading the nested and the flat JSON form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import lexicon

_NESTED_SCHEMA = (
    "model string, f1_macro double, f1_micro double, accuracy double, roc_auc_macro double, "
    "per_label_metrics map<string, struct<f1:double, precision:double, recall:double, roc_auc:double, "
    "threshold:double, true_positives:bigint, true_negatives:bigint, false_positives:bigint, false_negatives:bigint>>"
)
OVERALL = ["f1_macro", "f1_micro", "accuracy", "roc_auc_macro"]


def write_results(df: DataFrame, path: str) -> None:
    """JSON rows, one folder per model; only the folders of the models in ``df`` are
    replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_results`` wrote of nested metric records."""
    return spark.read.schema(_NESTED_SCHEMA).json(path)


def read_result_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document {model: record} as rows of nested records."""
    record = _NESTED_SCHEMA.split(", ", 1)[1]
    raw = spark.read.text(path, wholetext=True)
    models = F.from_json("value", f"map<string, struct<{record}>>")
    return raw.select(F.explode(models).alias("model", "r")).select("model", "r.*")


def flatten_nested(records: DataFrame) -> DataFrame:
    """Nested records to rows (model, label, metric, value); the overall metrics
    carry the label ``overall``. One pass: a record unfolds in place."""
    def cell(label, metric, value):
        return F.struct(label.alias("label"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))

    names = [f.name for f in records.schema["per_label_metrics"].dataType.valueType.fields]
    overall = F.array(*[cell(F.lit("overall"), n, F.col(n)) for n in OVERALL])
    labels = F.flatten(F.transform(F.map_entries("per_label_metrics"), lambda e: F.array(*[
        cell(e["key"], n, e["value"][n]) for n in names
    ])))
    return records.select("model", F.inline(F.concat(overall, labels))).filter(F.col("value").isNotNull())


def read_flat_document(spark: SparkSession, path: str, model: str) -> DataFrame:
    """One flat JSON document {eval_<label>_<metric>: value}."""
    raw = spark.read.text(path, wholetext=True)
    values = F.explode(F.from_json("value", "map<string, double>"))
    return flatten_flat(raw.select(F.lit(model).alias("model"), values.alias("metric", "value")))


def flatten_flat(rows: DataFrame) -> DataFrame:
    """Flat keys (model, metric, value) to rows (model, label, metric, value)."""
    labels = sorted(lexicon.LABELS, key=len, reverse=True)
    parts = rf"^eval_(?:({'|'.join(labels)})_)?(.+)$"
    label = F.regexp_extract("metric", parts, 1)
    return rows.filter(F.col("metric").rlike(parts)).select(
        "model", F.when(label == "", "overall").otherwise(label).alias("label"),
        F.regexp_extract("metric", parts, 2).alias("metric"), "value",
    )


def to_flat_map(rows: DataFrame, by: list[str] = ["model"]) -> DataFrame:
    """Rows (by…, metric, value) to one map per group; a report's worth of rows."""
    entries = F.sort_array(F.collect_list(F.struct("metric", "value")))
    return rows.groupBy(*by).agg(F.map_from_entries(entries).alias("metrics"))
