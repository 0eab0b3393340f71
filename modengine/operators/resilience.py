"""Metric records, resilience against attacks, effect of the defence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as Wd, functions as F

from ..functions import lexicon, tags
from ..functions.text import normalize_obfuscation
from .cleaning import computed_once
from .curves import confusion_at, macro_of_aucs, point_counts, score_points, tuned
from .metrics import apply_thresholds, f1_of, macro_micro, precision_of, ratio, recall_of, subset_accuracy
from .ranking import join_null_safe

PER_LABEL = [
    "f1", "precision", "recall", "roc_auc", "threshold",
    "true_positives", "true_negatives", "false_positives", "false_negatives",
]


def per_label_record(points: DataFrame, thresholds: DataFrame | None = None, by: Sequence[str] = ("model",)) -> DataFrame:
    """One row of metrics and counts per group and label, from score points.

    Thresholds default to the blended ones. Threshold, AUC and the counts at the
    threshold all come from the points, i.e. from one shuffle of the scores.
    """
    keys = [*by, "label"]
    counts = point_counts(points, keys)
    found = tuned(counts, keys)
    if thresholds is not None:
        on = [c for c in thresholds.columns if c in keys]
        found = join_null_safe(found.drop("threshold"), thresholds, on, "left")
    rows = confusion_at(points, found, keys).withColumns(
        {"f1": f1_of(), "precision": precision_of(), "recall": recall_of()}
    )
    return rows.select(
        *keys, "f1", "precision", "recall", "roc_auc", "threshold", F.col("tp").alias("true_positives"),
        F.col("tn").alias("true_negatives"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"),
    )


def per_label_metrics(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """The per-label half of ``metric_record`` as rows, at the blended thresholds."""
    return per_label_record(score_points(scores, [*by, "label"]), by=by)


def metric_record(
    scores: DataFrame, thresholds: DataFrame | None = None, by: Sequence[str] = ("model",), id_col: str = "id",
    nested: bool = False, undefined: str = "null",
) -> DataFrame:
    """The full evaluation of each model: overall metrics and, with ``nested``,
    the per-label records as a map. ``undefined`` says what a label without an AUC
    does to the macro AUC, as in ``auc_macro``: null, half or skip. The scores are read twice: for the points and,
    with the thresholds known, for the rows that have every label right."""
    by, keys = list(by), [*by, "label"]
    labels = per_label_record(score_points(scores, keys), thresholds, by)
    preds = apply_thresholds(scores.filter(F.col("y") >= 0), labels.select(*keys, "threshold"))
    tp, fp, fn = F.sum("true_positives"), F.sum("false_positives"), F.sum("false_negatives")
    parts = [
        F.avg("f1").alias("f1_macro"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1_micro"),
        macro_of_aucs(undefined).alias("roc_auc_macro"),
    ]
    if nested:
        entry = F.struct("label", F.struct(*PER_LABEL).alias("m"))
        parts.append(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("per_label_metrics"))
    overall = labels.groupBy(*by).agg(*parts)
    return join_null_safe(overall, subset_accuracy(preds, by, id_col), by)


def with_ensemble(scores: DataFrame, model_a: str, model_b: str, name: str = "ensemble") -> DataFrame:
    """The scores of both models and, as a third one, their mean per row and label.
    One shuffle brings the two scores of a cell together; all three rows follow
    from it. A cell that one model did not score has no mean."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("p")))
    cells = scores.filter(F.col("model").isin(model_a, model_b)).groupBy("id", "label").agg(
        F.max("y").alias("y"), of(model_a).alias("_a"), of(model_b).alias("_b")
    )
    rows = {model_a: F.col("_a"), model_b: F.col("_b"), name: (F.col("_a") + F.col("_b")) / 2}
    return cells.select("id", "label", "y", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), p.alias("p")) for m, p in rows.items()
    ]))).filter(F.col("p").isNotNull())


def ensemble_avg(a: DataFrame, b: DataFrame, name: str = "ensemble") -> DataFrame:
    """Mean of two models' scores (id, label, y, p) per row and label."""
    right = b.select("id", "label", F.col("p").alias("_p"))
    return a.join(right, ["id", "label"]).select(
        "id", F.lit(name).alias("model"), "label", "y", ((F.col("p") + F.col("_p")) / 2).alias("p")
    )


def evaluate_resilience(scores: DataFrame, model_a: str, model_b: str, nested: bool = False) -> DataFrame:
    """Metric records of two models and their ensemble, each at its own
    thresholds, in one pass over the long table."""
    return metric_record(with_ensemble(scores, model_a, model_b), nested=nested)


def resilience_ratio(preds: DataFrame, by: str = "pattern", clean: str | int = "original", extra: Sequence[str] = ()) -> DataFrame:
    """Macro F1 per attack and its ratio to the macro F1 of the clean rows."""
    extra = list(extra)
    # One row per attack is left, so the window over them is small.
    f1 = macro_micro(preds, [*extra, by]).select(*extra, by, "f1_macro")
    whole = Wd.partitionBy(*(extra or [F.lit(0)]))
    f1 = f1.withColumn("f1_clean", F.max(F.when(F.col(by) == clean, F.col("f1_macro"))).over(whole))
    return f1.withColumn("resilience", F.try_divide("f1_macro", "f1_clean"))


def with_truth(df: DataFrame, col: str = "text", out: str = "truth") -> DataFrame:
    """Adds the keyword labels of a text as one struct, computed before the table is
    fanned out into attacked variants: once per text and not once per variant."""
    found = tags.labels_of_hits(F.col("_hits"))
    low = df.withColumn("_low", F.lower(col)).withColumn("_hits", tags.keyword_hits(F.col("_low")))
    labelled = low.withColumn(out, F.struct(*[found[l].alias(l) for l in lexicon.LABELS])).drop("_low", "_hits")
    return computed_once(labelled, out)


def attack_predictions(
    attacked: DataFrame, key: Sequence[str], original: str = "text", col: str = "attacked", truth: str | None = None,
) -> DataFrame:
    """Keyword labels of the original (y) and of the attacked text (pred), as rows
    (key…, label, y, pred): what a keyword filter loses to an attack. ``truth`` names
    a column of ``with_truth``, which saves labelling the original again."""
    if truth is None:
        attacked, truth = with_truth(attacked, original, "_truth"), "_truth"
    low = attacked.withColumn("_low", F.lower(col)).withColumn("_hits", tags.keyword_hits(F.col("_low")))
    y, p = {l: F.col(f"{truth}.{l}") for l in lexicon.LABELS}, tags.labels_of_hits(F.col("_hits"))
    pairs = F.array(*[F.struct(F.lit(l).alias("label"), y[l].alias("y"), p[l].alias("pred")) for l in lexicon.LABELS])
    return low.select(*key, F.inline(pairs))


def defence_gain(
    attacked: DataFrame, by: Sequence[str] = ("pattern",), original: str = "text", col: str = "attacked", truth: str | None = None,
) -> DataFrame:
    """How many keyword labels of the original an attack hides, and how many of
    them the normalizer brings back, per pattern and label; ``truth`` as in
    ``attack_predictions``."""
    if truth is None:
        attacked, truth = with_truth(attacked, original, "_truth"), "_truth"
    low = attacked.withColumns({"_a": F.lower(col), "_n": normalize_obfuscation(F.col(col))})
    low = low.withColumns({f"_hits{c}": tags.keyword_hits(F.col(c)) for c in ("_a", "_n")})
    parts = {k: tags.labels_of_hits(F.col(f"_hits_{k}")) for k in ("a", "n")}
    parts["y"] = {l: F.col(f"{truth}.{l}") for l in lexicon.LABELS}
    rows = low.select(*by, F.inline(F.array(*[
        F.struct(F.lit(l).alias("label"), *[v[l].alias(k) for k, v in parts.items()]) for l in lexicon.LABELS
    ])))
    y, a, n = F.col("y") == 1, F.col("a") == 1, F.col("n") == 1
    return rows.groupBy(*by, "label").agg(
        F.count_if(y).alias("positives"), F.count_if(y & a).alias("found_attacked"),
        F.count_if(y & n).alias("found_normalized"), F.count_if(~y & a).alias("false_attacked"),
        F.count_if(~y & n).alias("false_normalized"),
    )
