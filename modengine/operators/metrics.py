"""Classification metrics as aggregations over a long score table.

Scores are rows (id, model, label, y, p) and predictions add ``pred``. ``by``
names the columns metrics are kept apart by, besides the label; every metric
starts from counts that are pre-aggregated before the only shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


COUNTS = ["tp", "fp", "fn", "tn"]


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def precision_of() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def recall_of() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def f1_of() -> Column:
    return ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def accuracy_of() -> Column:
    return ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))


# -- predictions --------------------------------------------------------------

LOOKUP_ROWS = 10_000


def looked_up(rows: DataFrame, table: DataFrame | Mapping[str, float], value: str, max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Adds ``value`` from a small table without moving a row; null where it has none.

    A mapping from labels is a literal. A table, keyed by the columns it shares with
    the rows (null is a key like others), folds to one map that Spark computes once,
    as a scalar subquery. It has one row per key, labels times models by nature;
    beyond ``max_rows`` the query fails and says so: join such a table on its keys.
    """
    if isinstance(table, Mapping):
        cases = F.lit(None).cast("double")
        for label, v in table.items():
            cases = F.when(F.col("label") == label, F.lit(float(v))).otherwise(cases)
        return rows.withColumn(value, cases)
    on = [c for c in table.columns if c in rows.columns and c != value]
    key = F.struct(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in on])
    # No more than max_rows + 1 rows reach the task that folds them.
    few = table.select(key.alias("k"), F.col(value).alias("v")).limit(max_rows + 1)
    too_many = F.raise_error(F.lit(f"over {max_rows} rows to look {value} up in; join them instead"))
    folded = F.map_from_entries(F.collect_list(F.struct("k", "v")))
    lookup = few.agg(F.when(F.count("*") <= max_rows, folded).otherwise(too_many)).scalar()
    return rows.withColumn(value, lookup[F.struct(*on)])


def apply_thresholds(scores: DataFrame, thresholds: DataFrame | Mapping[str, float], op: str = ">") -> DataFrame:
    """Adds ``threshold`` and ``pred``. Thresholds are a mapping from labels, or a
    table keyed by any columns of the scores (label, model, slice); see ``looked_up``."""
    found = looked_up(scores, thresholds, "threshold")
    test = {">": F.col("p") > F.col("threshold"), ">=": F.col("p") >= F.col("threshold")}[op]
    return found.withColumn("pred", test.cast("int"))


# -- counts and what follows from them ----------------------------------------

def confusion(preds: DataFrame, by: Sequence[str] = ("model", "label")) -> DataFrame:
    """tp, fp, fn, tn per group; unjudged rows (y = -1) do not count."""
    y, p = F.col("y"), F.col("pred")
    return preds.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"),
    )


def prf(preds: DataFrame, by: Sequence[str] = ("model", "label")) -> DataFrame:
    """Precision, recall, F1 and support per group; 0 where undefined."""
    return confusion(preds, by).select(
        *by, precision_of().alias("precision"), recall_of().alias("recall"), f1_of().alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def label_accuracy(preds: DataFrame, by: Sequence[str] = ("model", "label")) -> DataFrame:
    return confusion(preds, by).select(*by, accuracy_of().alias("accuracy"))


def hamming_accuracy(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Share of right cells over all rows and labels."""
    return confusion(preds, by).select(*by, accuracy_of().alias("accuracy"))


def per_row(preds: DataFrame, by: Sequence[str], id_col: str) -> DataFrame:
    """Counts per row of the label matrix. The labels of a row sit in one input
    partition when they come from one wide row, so partial aggregation folds
    them before the shuffle."""
    y, p = F.col("y"), F.col("pred")
    return preds.filter(y >= 0).groupBy(*by, id_col).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )


def subset_accuracy(preds: DataFrame, by: Sequence[str] = ("model",), id_col: str = "id") -> DataFrame:
    """Share of rows with every label right."""
    right = ((F.col("fp") == 0) & (F.col("fn") == 0)).cast("double")
    return per_row(preds, by, id_col).groupBy(*by).agg(F.avg(right).alias("accuracy"))


def average_rows(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Macro mean over labels and micro from pooled counts, in one aggregate over
    the per-label counts."""
    by = list(by)
    means = {n: F.avg(c) for n, c in {"precision": precision_of(), "recall": recall_of(), "f1": f1_of()}.items()}
    pooled = counts.groupBy(*by).agg(
        *[m.alias(f"{n}_macro") for n, m in means.items()], *[F.sum(c).alias(c) for c in COUNTS]
    )
    return pooled.select(
        *by, "precision_macro", "recall_macro", "f1_macro", precision_of().alias("precision_micro"),
        recall_of().alias("recall_micro"), f1_of().alias("f1_micro"),
    )


def macro_micro(preds: DataFrame, by: Sequence[str] = ("model",), label: str = "label") -> DataFrame:
    return average_rows(confusion(preds, [*by, label]), by)


def classification_report(preds: DataFrame, by: Sequence[str] = ("model",), id_col: str = "id") -> DataFrame:
    """Precision, recall, F1 and support per label, then the micro, macro,
    weighted and samples averages, as rows (by…, row, …)."""
    by = list(by)
    per_label = confusion(preds, [*by, "label"]).withColumns({
        "precision": precision_of(), "recall": recall_of(), "f1": f1_of(), "support": F.col("tp") + F.col("fn"),
    })
    names = ["precision", "recall", "f1"]
    pooled = per_label.groupBy(*by).agg(
        *[F.avg(n).alias(f"macro_{n}") for n in names],
        *[ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(f"weighted_{n}") for n in names],
        *[F.sum(c).alias(c) for c in COUNTS], F.sum("support").alias("support"),
    ).withColumns({"micro_precision": precision_of(), "micro_recall": recall_of(), "micro_f1": f1_of()})
    rows = per_row(preds, by, id_col).groupBy(*by).agg(
        F.avg(precision_of()).alias("precision"), F.avg(recall_of()).alias("recall"), F.avg(f1_of()).alias("f1"),
        F.sum(F.col("tp") + F.col("fn")).alias("support"),
    )
    averages = pooled.select(*by, F.inline(F.array(*[
        F.struct(F.lit(f"{kind} avg").alias("row"), *[F.col(f"{kind}_{n}").alias(n) for n in names], "support")
        for kind in ("micro", "macro", "weighted")
    ])))
    cols = [*by, "row", *names, "support"]
    return (
        per_label.withColumnRenamed("label", "row").select(*cols)
        .unionByName(averages.select(*cols))
        .unionByName(rows.withColumn("row", F.lit("samples avg")).select(*cols))
    )


def extra_metrics(preds: DataFrame, by: Sequence[str] = ("model", "label")) -> DataFrame:
    """Balanced accuracy, Matthews correlation and Cohen's kappa per group.

    Balanced accuracy is the mean recall of the classes that occur. The
    correlation is 0 where a margin is empty; kappa is null where chance alone
    gives full agreement.
    """
    tp, fp, fn, tn = [F.col(c).cast("double") for c in COUNTS]
    n = tp + fp + fn + tn
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    balanced = F.when(sens.isNull(), spec).when(spec.isNull(), sens).otherwise((sens + spec) / 2)
    margins = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    mcc = F.when(margins == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / margins)
    chance = ((tp + fp) / n * ((tp + fn) / n)) + ((fn + tn) / n * ((fp + tn) / n))
    agree = (tp + tn) / n
    kappa = F.when(n == 0, None).otherwise(F.try_divide(agree - chance, 1 - chance))
    return confusion(preds, by).select(
        *by, balanced.alias("balanced_accuracy"), mcc.alias("matthews_corrcoef"), kappa.alias("cohen_kappa")
    )


def weighted_bce(logits: DataFrame, weights: DataFrame | Mapping[str, float], by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean class-weighted binary cross-entropy of logits x with targets y:
    −[w·y·ln σ(x) + (1−y)·ln(1−σ(x))], in a form that does not overflow.
    ``weights`` holds (label, pos_weight) or is a mapping; a missing or null weight counts as 1."""
    x, y = F.col("x"), F.col("y")
    joined = looked_up(logits.filter(y >= 0), weights, "pos_weight")
    w = F.coalesce(F.col("pos_weight"), F.lit(1.0))
    tail = F.log1p(F.exp(-F.abs(x)))
    loss = F.when(y == 1, w * (F.greatest(-x, F.lit(0.0)) + tail)).otherwise(F.greatest(x, F.lit(0.0)) + tail)
    return joined.groupBy(*by).agg(F.avg(loss).alias("loss"))
