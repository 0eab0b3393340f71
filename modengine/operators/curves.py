"""Curves over score thresholds: PR, ROC, AUC and tuned thresholds.

Scores are first folded to one row per (group, distinct score), which is where
tied scores stop being a skew problem; running counts over those rows come from
``ranking.running_sums``. Every function takes the counts of ``curve_counts``,
so several metrics can share one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as Wd, functions as F

from ..functions import lexicon
from .metrics import accuracy_of, f1_of, precision_of, ratio, recall_of
from .ranking import join_null_safe, running_sums

BY = ("model", "label")


def score_points(scores: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """One row per group and distinct score p with its positives and negatives."""
    return scores.filter(F.col("y") >= 0).groupBy(*by, "p").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )


def pool_points(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Points of coarser groups, from the points and not from the scores."""
    return points.groupBy(*by, "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def point_counts(points: DataFrame, by: Sequence[str] = BY, method: str = "two_level", buckets: int = 128) -> DataFrame:
    """Adds the positives and negatives at p or above (``tp``, ``fp``) and in all
    (``n_pos``, ``n_neg``). ``method='window'`` is the plain one-task-per-group form."""
    by = list(by)
    if method == "two_level":
        return running_sums(
            points, by, "p", {"pos": "tp", "neg": "fp"}, {"pos": "n_pos", "neg": "n_neg"}, buckets
        )
    if method != "window":
        raise ValueError(f"unknown method: {method}")
    down = Wd.partitionBy(*by).orderBy(F.desc("p")).rowsBetween(Wd.unboundedPreceding, 0)
    whole = Wd.partitionBy(*by)
    return points.withColumns({
        "n_pos": F.sum("pos").over(whole), "n_neg": F.sum("neg").over(whole),
        "tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down),
    })


def curve_counts(scores: DataFrame, by: Sequence[str] = BY, method: str = "two_level", buckets: int = 128) -> DataFrame:
    """Running counts per group and distinct score of a long score table."""
    return point_counts(score_points(scores, by), by, method, buckets)


def _precision() -> Column:
    return F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))


def _recall() -> Column:
    return F.when(F.col("n_pos") == 0, F.lit(1.0)).otherwise(F.col("tp").cast("double") / F.col("n_pos"))


def _with_end(point: Column, end: Column, is_end: Column) -> Column:
    """The point, and at the end of its group the closing point after it."""
    return F.inline(F.when(is_end, F.array(point, end)).otherwise(F.array(point)))


def pr_curve(counts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Precision and recall of ``p >= threshold`` per distinct score, and the
    closing point (1, 0), whose threshold is null."""
    point = F.struct(F.col("p").alias("threshold"), _precision().alias("precision"), _recall().alias("recall"))
    closing = F.struct(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    lowest = (F.col("tp") == F.col("n_pos")) & (F.col("fp") == F.col("n_neg"))
    return counts.select(*by, _with_end(point, closing, lowest))


def roc_curve(counts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """False and true positive rates per distinct score, and the opening point
    (0, 0) at infinity. Rates are null for a class that does not occur."""
    point = F.struct(
        F.col("p").alias("threshold"), F.try_divide(F.col("fp").cast("double"), F.col("n_neg")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("n_pos")).alias("tpr"),
    )
    opening = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    highest = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    return counts.select(*by, _with_end(point, opening, highest))


def _eps_f1() -> Column:
    p, r = _precision(), _recall()
    return 2 * p * r / (p + r + lexicon.F1_EPSILON)


def best_f1_point(counts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Threshold of the best F1 on the PR curve with its F1, precision, recall;
    the lowest threshold wins ties."""
    point = F.struct(F.col("p").alias("threshold"), F.col("f1").alias("best_f1"), "precision", "recall")
    return counts.withColumns({"precision": _precision(), "recall": _recall(), "f1": _eps_f1()}).groupBy(*by).agg(
        F.max_by(point, F.struct("f1", -F.col("p"))).alias("best")
    ).select(*by, "best.*")


def youden_threshold(counts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Threshold of the largest TPR − FPR, the highest on ties; infinity when no
    score beats predicting nothing. Null for a group with one class."""
    j = F.col("tp").cast("double") / F.col("n_pos") - F.col("fp").cast("double") / F.col("n_neg")
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    best = F.max_by(F.struct("p", "j"), F.struct("j", "p"))
    return counts.withColumn("j", F.when(both, j)).groupBy(*by).agg(best.alias("best")).select(
        *by,
        F.when(F.col("best.j") > 0, F.col("best.p")).when(F.col("best.j").isNotNull(), F.lit(float("inf"))).alias("threshold"),
        F.greatest(F.col("best.j"), F.lit(0.0)).alias("youden"),
    )


def _blend(best_f1: Column, best_j: Column) -> Column:
    """Blended threshold of a ``label`` from the aggregates of its curve: the p of
    the best F1, and the (p, j) of the best j, null for a group with one class."""
    t_roc = F.when(best_j["j"] > 0, best_j["p"]).otherwise(F.lit(float("inf")))
    factor = F.lit(1.0)
    for label, value in lexicon.THRESHOLD_FACTORS.items():
        factor = F.when(F.col("label") == label, F.lit(value)).otherwise(factor)
    low, high = lexicon.THRESHOLD_RANGE
    blend = (lexicon.F1_WEIGHT * best_f1 + lexicon.YOUDEN_WEIGHT * t_roc) * factor
    clipped = F.least(F.greatest(blend, F.lit(low)), F.lit(high))
    return F.when(best_j["j"].isNull(), F.lit(lexicon.SINGLE_CLASS_THRESHOLD)).otherwise(clipped)


def _auc() -> Column:
    # Sums of doubles: a product of counts may exceed 64 bits.
    area = F.sum(F.col("neg").cast("double") * (F.col("tp").cast("double") - F.col("pos") / 2.0))
    return F.try_divide(area, F.max(F.col("n_pos").cast("double") * F.col("n_neg")))


def tuned(counts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Blended threshold and AUC per group, in one aggregate over the curve."""
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    j = F.col("tp").cast("double") / F.col("n_pos") - F.col("fp").cast("double") / F.col("n_neg")
    best = counts.withColumns({"f1": _eps_f1(), "j": F.when(both, j)}).groupBy(*by).agg(
        F.max_by("p", F.struct("f1", -F.col("p"))).alias("_f"),
        F.max_by(F.struct("p", "j"), F.struct("j", "p")).alias("_j"), _auc().alias("roc_auc"),
    )
    return best.select(*by, _blend(F.col("_f"), F.col("_j")).alias("threshold"), "roc_auc")


def blended_thresholds(counts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Weighted mean of the best-F1 and the Youden threshold, scaled per label
    and clipped; a label with one class gets the fixed threshold."""
    return tuned(counts, by).select(*by, "threshold")


def roc_auc(counts: DataFrame, by: Sequence[str] = BY, undefined: str = "null") -> DataFrame:
    """Exact area under the ROC curve, ties counted half. A group with one class
    has none: null, or 0.5 with ``undefined='half'``."""
    auc = F.coalesce(_auc(), F.lit(0.5)) if undefined == "half" else _auc()
    return counts.groupBy(*by).agg(auc.alias("roc_auc"))


def confusion_at(points: DataFrame, thresholds: DataFrame, by: Sequence[str] = BY, op: str = ">") -> DataFrame:
    """tp, fp, fn, tn at a threshold per group, from the score points: no second
    look at the scores. Adds the other columns of ``thresholds``."""
    by = list(by)
    extra = [c for c in thresholds.columns if c not in by]
    on = [c for c in by if c in thresholds.columns]
    hit = {">": F.col("p") > F.col("threshold"), ">=": F.col("p") >= F.col("threshold")}[op]
    joined = join_null_safe(points, thresholds, on)
    zero = F.lit(0)
    return joined.groupBy(*by).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(zero)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(zero)).alias("fp"),
        F.sum(F.when(hit, zero).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, zero).otherwise(F.col("neg"))).alias("tn"),
        *[F.first(c).alias(c) for c in extra],
    )


def macro_of_aucs(undefined: str = "null") -> Column:
    """Mean of ``roc_auc``. ``null`` gives null if any label has none, ``half`` counts
    such a label as 0.5, ``skip`` leaves it out."""
    auc = F.col("roc_auc")
    return {
        "null": F.when(F.count_if(auc.isNull()) == 0, F.avg(auc)),
        "half": F.avg(F.coalesce(auc, F.lit(0.5))),
        "skip": F.avg(auc),
    }[undefined]


def auc_macro(aucs: DataFrame, by: Sequence[str] = ("model",), undefined: str = "null") -> DataFrame:
    """Mean AUC of the labels, by one of the three policies of ``macro_of_aucs``."""
    return aucs.groupBy(*by).agg(macro_of_aucs(undefined).alias("roc_auc_macro"))


def scan_threshold(counts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Best plain F1 over the distinct scores with ``>=``, the lowest threshold on
    ties, the counts at it and the AUC. ``two_classes`` tells whether both occur."""
    f1 = ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos"))
    point = F.struct(
        F.col("p").alias("threshold"), "f1", "tp", "fp", (F.col("n_pos") - F.col("tp")).alias("fn"),
        (F.col("n_neg") - F.col("fp")).alias("tn"), ((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).alias("two_classes"),
    )
    return counts.withColumn("f1", f1).groupBy(*by).agg(
        F.max_by(point, F.struct("f1", -F.col("p"))).alias("best"), _auc().alias("roc_auc")
    ).select(*by, "best.*", "roc_auc")


def scan_report(scores: DataFrame, by: Sequence[str] = ("model",), labels: Sequence[str] = tuple(lexicon.LABELS)) -> DataFrame:
    """Flat metrics (by…, metric, value) of the scanning evaluation.

    Per label, only where both classes occur: f1, precision, recall, accuracy;
    roc_auc is 0.5 elsewhere. Macro means run over all ``labels`` and count a
    missing metric as 0 (0.5 for the AUC). Micro pools every judged label at its
    own threshold, single-class labels included.
    """
    by, keys = list(by), [*by, "label"]
    points = score_points(scores, keys)
    scanned = scan_threshold(point_counts(points, keys), keys)
    names = {"f1": f1_of(), "precision": precision_of(), "recall": recall_of(), "accuracy": accuracy_of()}
    own = scanned.withColumns(
        {n: F.when(F.col("two_classes"), v) for n, v in names.items()}
        | {"roc_auc": F.coalesce("roc_auc", F.lit(0.5))}
    )
    entry = lambda name, n: F.struct(name.alias("metric"), F.col(n).alias("value"))
    per_label = F.array(*[entry(F.concat(F.lit("eval_"), "label", F.lit(f"_{n}")), n) for n in [*names, "roc_auc"]])
    macro = [
        (F.coalesce(F.sum(n), F.lit(0.0)) / len(labels)).alias(f"eval_{n}_macro") for n in ("f1", "precision", "recall")
    ]
    auc_macro = ((F.sum("roc_auc") + 0.5 * (len(labels) - F.count("*"))) / len(labels)).alias("eval_roc_auc_macro")
    # A handful of labels per group: their rows fit one array.
    pooled = own.groupBy(*by).agg(
        *macro, auc_macro, *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
        F.flatten(F.collect_list(per_label)).alias("per_label"),
    ).withColumns({
        "eval_f1_micro": f1_of(), "eval_precision_micro": precision_of(), "eval_recall_micro": recall_of(),
    })
    auc_micro = roc_auc(point_counts(pool_points(points, by), by), by).withColumnRenamed("roc_auc", "eval_roc_auc_micro")
    wide = join_null_safe(pooled, auc_micro, by)
    overall = F.array(*[entry(F.lit(n), n) for n in wide.columns if n.startswith("eval_")])
    return wide.select(*by, F.inline(F.concat("per_label", overall))).filter(F.col("value").isNotNull())
