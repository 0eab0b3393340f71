"""Queries of metrics, curves, slices, reports and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon, tags, text as tx
from ..operators import comparison, curves, metrics, models, resilience, sampling, slices, tagging
from ..operators.ranking import join_null_safe
from ..operators.metrics import apply_thresholds
from ..sources import results
from . import inputs as inp
from .inputs import (
    ACC, BASE, BASE_PREDS, COMMENTS, F1, LABELLED, LABELS, MODELS, P, R, counts_sql, curve_sql, div0, labelled,
    macro_micro_sql, predictions, predictions_of, q, rounded, scores, scores_of, sql_rand,
)
from .registry import query
from .text import sql_n_tokens

KEYS = "model, label"
M = list(MODELS)
WITH = f"WITH {BASE}"
WITH_P = f"WITH {BASE_PREDS}"


def rnd(**exprs: str) -> str:
    return ", ".join(f"round({e}, 9) AS {n}" for n, e in exprs.items())


# -- counts -----------------------------------------------------------------------

@query("confusion_counts", f"{WITH_P} {counts_sql(KEYS)}")
def confusion_counts(spark, d):
    return metrics.confusion(predictions(spark, d))


@query("confusion_matrix", f"{WITH_P} SELECT model, label, y AS actual, pred AS predicted, count(*) AS n FROM preds "
                           "GROUP BY ALL")
def confusion_matrix(spark, d):
    cells = comparison.confusion_matrix(metrics.confusion(predictions(spark, d)))
    return cells.filter(F.col("n") > 0)


@query("per_label_prf", f"{WITH_P} SELECT {KEYS}, {rnd(precision=P, recall=R, f1=F1)}, tp + fn AS support "
                        f"FROM ({counts_sql(KEYS)})")
def per_label_prf(spark, d):
    return rounded(metrics.prf(predictions(spark, d)))


@query("per_label_accuracy", f"{WITH_P} SELECT {KEYS}, round(avg((y = pred)::INT), 9) AS accuracy FROM preds GROUP BY {KEYS}")
def per_label_accuracy(spark, d):
    return rounded(metrics.label_accuracy(predictions(spark, d)))


@query("hamming_accuracy", f"{WITH_P} SELECT model, round(avg((y = pred)::INT), 9) AS accuracy FROM preds GROUP BY model")
def hamming_accuracy(spark, d):
    return rounded(metrics.hamming_accuracy(predictions(spark, d)))


@query("subset_accuracy", f"{WITH_P}, r AS (SELECT model, id, bool_and(y = pred) AS ok FROM preds GROUP BY model, id) "
                          "SELECT model, round(avg(ok::INT), 9) AS accuracy FROM r GROUP BY model")
def subset_accuracy(spark, d):
    return rounded(metrics.subset_accuracy(predictions(spark, d)))


_MM = ["precision_macro", "recall_macro", "f1_macro", "precision_micro", "recall_micro", "f1_micro"]


def sql_mm(by: str, source: str = "preds", names=_MM) -> str:
    return f"SELECT {by}, {', '.join(f'round({n}, 9) AS {n}' for n in names)} FROM ({macro_micro_sql(by, source)})"


@query("macro_micro", f"{WITH_P} {sql_mm('model')}")
def macro_micro(spark, d):
    return rounded(metrics.macro_micro(predictions(spark, d)))


_PRF = {"precision": P, "recall": R, "f1": F1}
_POOLED = {n: e.replace("tp", "sum(tp)").replace("fp", "sum(fp)").replace("fn", "sum(fn)") for n, e in _PRF.items()}
_WEIGHTED = {n: f"sum(({e}) * (tp + fn)) / sum(tp + fn)" for n, e in _PRF.items()}
_MEAN = {n: f"avg({e})" for n, e in _PRF.items()}


@query("classification_report",
       f"{WITH_P}, c AS ({counts_sql(KEYS)}), r AS ({counts_sql('model, id')}) "
       f"SELECT model, label AS row, {rnd(**_PRF)}, tp + fn AS support FROM c "
       + "".join(f"UNION ALL SELECT model, '{kind} avg', {rnd(**e)}, sum(tp + fn) FROM {src} GROUP BY model " for kind, e, src in [
           ("micro", _POOLED, "c"), ("macro", _MEAN, "c"), ("weighted", _WEIGHTED, "c"), ("samples", _MEAN, "r")]))
def classification_report(spark, d):
    return rounded(metrics.classification_report(predictions(spark, d)))


@query("extra_metrics",
       f"{WITH_P}, c AS (SELECT {KEYS}, tp::DOUBLE tp, fp::DOUBLE fp, fn::DOUBLE fn, tn::DOUBLE tn, (tp+fp+fn+tn)::DOUBLE n "
       f"FROM ({counts_sql(KEYS)})) SELECT {KEYS}, "
       + rnd(balanced_accuracy="(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2",
             matthews_corrcoef="coalesce((tp * tn - fp * fn) / nullif(sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)), 0), 0)",
             cohen_kappa="((tp + tn) / n - ((tp+fp)*(tp+fn) + (fn+tn)*(fp+tn)) / n / n) "
                         "/ nullif(1 - ((tp+fp)*(tp+fn) + (fn+tn)*(fp+tn)) / n / n, 0)") + " FROM c")
def extra_metrics(spark, d):
    return rounded(metrics.extra_metrics(predictions(spark, d)))


_LOGIT = "(ln(greatest(p, 0.0001)) - ln(greatest(1 - p, 0.0001)))"


def _logits(spark, d):
    p = F.col("p")
    return scores(spark, d).withColumn(
        "x", F.ln(F.greatest(p, F.lit(0.0001))) - F.ln(F.greatest(1 - p, F.lit(0.0001)))
    )


@query("weighted_bce",
       f"{WITH}, w AS (SELECT label, (count(*) FILTER (y = 0))::DOUBLE / count(*) FILTER (y = 1) AS w FROM scores GROUP BY label), "
       f"x AS (SELECT s.*, {_LOGIT} AS x, w FROM scores s JOIN w ON s.label = w.label WHERE y >= 0) "
       "SELECT model, round(avg(-(w * y * ln(1 / (1 + exp(-x))) + (1 - y) * ln(1 - 1 / (1 + exp(-x))))), 9) AS loss "
       "FROM x GROUP BY model")
def weighted_bce(spark, d):
    logits = _logits(spark, d)
    weights = logits.groupBy("label").agg(
        F.try_divide(F.count_if(F.col("y") == 0).cast("double"), F.count_if(F.col("y") == 1)).alias("pos_weight")
    )
    return rounded(metrics.weighted_bce(logits, weights))


@query("sigmoid", f"{WITH} SELECT id, {KEYS}, round(1 / (1 + exp(-{_LOGIT})), 9) AS s FROM scores")
def sigmoid(spark, d):
    return rounded(_logits(spark, d).select("id", "model", "label", models.sigmoid(F.col("x")).alias("s")))


# -- curves -----------------------------------------------------------------------

CURVE = f"c AS ({curve_sql(KEYS)})"
_PREC, _REC = "tp::DOUBLE / (tp + fp)", "CASE WHEN n_pos = 0 THEN 1 ELSE tp::DOUBLE / n_pos END"
_EPS = f"f AS (SELECT *, 2 * pr * re / (pr + re + 1e-8) AS f1 FROM (SELECT *, {_PREC} AS pr, {_REC} AS re FROM c))"
_J = "(tp::DOUBLE / n_pos - fp::DOUBLE / n_neg)"


@query("pr_curve", f"{WITH}, {CURVE} SELECT {KEYS}, p AS threshold, {rnd(precision=_PREC, recall=_REC)} FROM c "
                   f"UNION ALL SELECT DISTINCT {KEYS}, NULL, 1, 0 FROM c")
def pr_curve(spark, d):
    return rounded(curves.pr_curve(curves.curve_counts(scores(spark, d))))


@query("roc_curve", f"{WITH}, {CURVE} SELECT {KEYS}, p AS threshold, {rnd(fpr='fp::DOUBLE / n_neg', tpr='tp::DOUBLE / n_pos')} "
                    f"FROM c UNION ALL SELECT DISTINCT {KEYS}, NULL, 0, 0 FROM c")
def roc_curve(spark, d):
    """The opening point's infinite threshold is given as null."""
    curve = curves.roc_curve(curves.curve_counts(scores(spark, d)))
    finite = F.when(F.col("threshold") != float("inf"), F.col("threshold"))
    return rounded(curve.withColumn("threshold", finite))


_BEST = (
    f"{_EPS}, b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY f1 DESC, p) = 1)"
)


@query("best_f1_threshold", f"{WITH}, {CURVE}, {_BEST} SELECT {KEYS}, p AS threshold FROM b")
def best_f1_threshold(spark, d):
    return curves.best_f1_point(curves.curve_counts(scores(spark, d))).select("model", "label", "threshold")


@query("best_f1_point", f"{WITH}, {CURVE}, {_BEST} SELECT {KEYS}, p AS threshold, {rnd(best_f1='f1', precision='pr', recall='re')} FROM b")
def best_f1_point(spark, d):
    return rounded(curves.best_f1_point(curves.curve_counts(scores(spark, d))))


_YOUDEN = (
    f"j AS (SELECT *, {_J} AS j FROM c), "
    f"yb AS (SELECT {KEYS}, p AS yp, j FROM j QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY j DESC NULLS LAST, p DESC) = 1)"
)


@query("youden_threshold", f"{WITH}, {CURVE}, {_YOUDEN} SELECT {KEYS}, CASE WHEN j > 0 THEN yp END AS threshold, "
                           "round(greatest(j, 0), 9) AS youden FROM yb")
def youden_threshold(spark, d):
    best = curves.youden_threshold(curves.curve_counts(scores(spark, d)))
    finite = F.when(F.col("threshold") != float("inf"), F.col("threshold"))
    return rounded(best.withColumn("threshold", finite))


_BLEND = (
    f"bl AS (SELECT b.model, b.label, CASE WHEN j IS NULL THEN 0.5 ELSE least(greatest((0.7::DOUBLE * p + 0.3::DOUBLE * "
    f"(CASE WHEN yb.j > 0 THEN yp ELSE 'Infinity'::DOUBLE END)) * (CASE b.label WHEN 'toxic' THEN 0.9 WHEN 'severe_toxic' THEN 1.1 "
    f"WHEN 'threat' THEN 1.15 ELSE 1 END)::DOUBLE, 0.1), 0.9) END AS threshold "
    f"FROM b JOIN yb ON b.model = yb.model AND b.label = yb.label)"
)


@query("blended_thresholds", f"{WITH}, {CURVE}, {_BEST}, {_YOUDEN}, {_BLEND} SELECT {KEYS}, round(threshold, 9) AS threshold FROM bl")
def blended_thresholds(spark, d):
    return rounded(curves.blended_thresholds(curves.curve_counts(scores(spark, d))))


def sql_auc(by: str, source: str = "scores") -> str:
    """By trapezoids over consecutive points, with lag."""
    return (
        f"SELECT {by}, sum((fp - fp0) * (tp + tp0) / 2)::DOUBLE / nullif(max(n_pos) * max(n_neg), 0) AS roc_auc FROM "
        f"(SELECT {by}, tp, fp, n_pos, n_neg, coalesce(lag(tp) OVER w, 0) AS tp0, coalesce(lag(fp) OVER w, 0) AS fp0 "
        f"FROM ({curve_sql(by, source)}) WINDOW w AS (PARTITION BY {by} ORDER BY p DESC)) GROUP BY {by}"
    )


@query("roc_auc", f"{WITH} SELECT {KEYS}, round(roc_auc, 9) AS roc_auc FROM ({sql_auc(KEYS)})")
def roc_auc(spark, d):
    return rounded(curves.roc_auc(curves.curve_counts(scores(spark, d))))


@query("auc_macro", f"{WITH} SELECT model, round(avg(roc_auc), 9) AS roc_auc_macro FROM ({sql_auc(KEYS)}) GROUP BY model")
def auc_macro(spark, d):
    return rounded(curves.auc_macro(curves.roc_auc(curves.curve_counts(scores(spark, d)))))


@query("auc_micro", f"{WITH} SELECT model, round(roc_auc, 9) AS roc_auc FROM ({sql_auc('model')})")
def auc_micro(spark, d):
    return rounded(curves.roc_auc(curves.curve_counts(scores(spark, d), ["model"]), ["model"]))


_SCAN = (
    f"sc AS (SELECT *, n_pos - tp AS fn, n_neg - fp AS tn, n_pos > 0 AND n_neg > 0 AS two_classes FROM c "
    f"QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY (2 * tp)::DOUBLE / nullif(tp + fp + n_pos, 0) DESC NULLS LAST, p) = 1)"
)


@query("scan_threshold", f"{WITH}, {CURVE}, {_SCAN} SELECT {KEYS}, p AS threshold, round({F1}, 9) AS f1, tp, fp, fn, tn, two_classes FROM sc")
def scan_threshold(spark, d):
    return rounded(curves.scan_threshold(curves.curve_counts(scores(spark, d))).drop("roc_auc"))


_FLAT = {"f1": F1, "precision": P, "recall": R, "accuracy": ACC}


@query("scan_report",
       f"{WITH}, {CURVE}, {_SCAN}, a AS ({sql_auc(KEYS)}), am AS ({sql_auc('model')}) "
       + " UNION ALL ".join(
           [f"SELECT model, 'eval_' || label || '_{n}' AS metric, round({e}, 9) AS value FROM sc" for n, e in _FLAT.items()]
           + ["SELECT model, 'eval_' || label || '_roc_auc', round(roc_auc, 9) FROM a"]
           + [f"SELECT model, 'eval_{n}_macro', round(avg({_PRF[n]}), 9) FROM sc GROUP BY model" for n in _PRF]
           + [f"SELECT model, 'eval_{n}_micro', round({_POOLED[n]}, 9) FROM sc GROUP BY model" for n in _PRF]
           + ["SELECT model, 'eval_roc_auc_macro', round(avg(roc_auc), 9) FROM a GROUP BY model",
              "SELECT model, 'eval_roc_auc_micro', round(roc_auc, 9) FROM am"]))
def scan_report(spark, d):
    return rounded(curves.scan_report(scores(spark, d)))


# -- records and reports ------------------------------------------------------------

def record_sql(source: str) -> str:
    """CTEs of the per-label record ``rec`` and the overall one ``ov`` over ``source``."""
    return (
        f"c AS ({curve_sql(KEYS, source)}), {_BEST}, {_YOUDEN}, {_BLEND}, "
        f"pb AS (SELECT s.*, (s.p > bl.threshold)::INT AS pred FROM {source} s JOIN bl ON s.model = bl.model "
        f"AND s.label = bl.label WHERE y >= 0), k AS ({counts_sql(KEYS, 'pb')}), au AS ({sql_auc(KEYS, source)}), "
        f"rec AS (SELECT k.model, k.label, {F1} AS f1, {P} AS precision, {R} AS recall, roc_auc, threshold, "
        f"tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives FROM k "
        f"JOIN au ON k.model = au.model AND k.label = au.label JOIN bl ON k.model = bl.model AND k.label = bl.label), "
        f"sub AS (SELECT model, avg(ok::INT) AS accuracy FROM (SELECT model, id, bool_and(y = pred) AS ok FROM pb GROUP BY ALL) GROUP BY model), "
        f"mm AS ({macro_micro_sql('model', 'pb')}), "
        f"ov AS (SELECT mm.model, f1_macro, f1_micro, accuracy, (SELECT avg(roc_auc) FROM rec WHERE rec.model = mm.model) AS roc_auc_macro "
        f"FROM mm JOIN sub ON mm.model = sub.model)"
    )


_COUNT_NAMES = ["true_positives", "true_negatives", "false_positives", "false_negatives"]
_RATE_NAMES = ["f1", "precision", "recall", "roc_auc", "threshold"]
_OVERALL = ["f1_macro", "f1_micro", "accuracy", "roc_auc_macro"]


def same(*names: str) -> str:
    return rnd(**{n: n for n in names})


@query("metric_record", f"{WITH}, {record_sql('scores')} SELECT {KEYS}, {same(*_RATE_NAMES)}, {', '.join(_COUNT_NAMES)} FROM rec")
def metric_record(spark, d):
    return rounded(resilience.per_label_metrics(scores(spark, d)))


@query("metric_record_overall", f"{WITH}, {record_sql('scores')} SELECT model, {same(*_OVERALL)} FROM ov")
def metric_record_overall(spark, d):
    return rounded(resilience.metric_record(scores(spark, d)))


_ENSEMBLE = (
    "ens AS (SELECT a.id, 'ensemble' AS model, a.label, a.y, (a.p + b.p) / 2 AS p FROM scores a JOIN scores b "
    f"ON a.id = b.id AND a.label = b.label AND a.model = {q(M[0])} AND b.model = {q(M[1])})"
)
_THREE = f"{_ENSEMBLE}, three AS (SELECT id, model, label, y, p FROM scores UNION ALL SELECT * FROM ens)"


@query("ensemble_avg", f"{WITH}, {_ENSEMBLE} SELECT id, model, label, y, round(p, 9) AS p FROM ens")
def ensemble_avg(spark, d):
    both = scores(spark, d)
    of = lambda m: both.filter(F.col("model") == m).select("id", "label", "y", "p")
    return rounded(resilience.ensemble_avg(of(M[0]), of(M[1])))


@query("resilience_metrics", f"{WITH}, {_THREE}, {record_sql('three')} SELECT model, {same(*_OVERALL)} FROM ov")
def resilience_metrics(spark, d):
    return rounded(resilience.evaluate_resilience(scores(spark, d), *M))


@query("results_flatten", f"{WITH}, {_THREE}, {record_sql('three')} " + " UNION ALL ".join(
    [f"SELECT model, 'overall' AS label, '{n}' AS metric, round({n}, 9) AS value FROM ov" for n in _OVERALL]
    + [f"SELECT model, label, '{n}', round({n}::DOUBLE, 9) FROM rec" for n in _RATE_NAMES + _COUNT_NAMES]))
def results_flatten(spark, d):
    return rounded(results.flatten_nested(resilience.evaluate_resilience(scores(spark, d), *M, nested=True)))


@query("fit_width", f"{WITH}, a AS (SELECT id, model, list(p ORDER BY label) AS v FROM scores WHERE label < 'severe' GROUP BY ALL) "
                    "SELECT id, model, v[1] AS s0, v[3] AS s2, 0::DOUBLE AS s3, 0::DOUBLE AS s5, 6 AS width FROM a")
def fit_width(spark, d):
    few = scores(spark, d).filter(F.col("label") < "severe").groupBy("id", "model").agg(
        F.array_sort(F.collect_list(F.struct("label", "p"))).alias("v")
    )
    v = models.fit_width(F.transform("v", lambda s: s["p"]))
    wide = few.select("id", "model", v.alias("v"))
    return wide.select("id", "model", *[F.col("v")[i].alias(f"s{i}") for i in (0, 2, 3, 5)], F.size("v").alias("width"))


def _compared(spark, d):
    """Overall metrics of both models: the record and the pooled AUC."""
    long = scores(spark, d)
    pooled = curves.pool_points(curves.score_points(long), ["model"])
    micro = curves.roc_auc(curves.point_counts(pooled, ["model"]), ["model"]).withColumnRenamed("roc_auc", "roc_auc_micro")
    return join_null_safe(resilience.metric_record(long), micro, ["model"])


def _winner_sql(source: str, on: str) -> str:
    return (
        f"SELECT {', '.join(f'a.{k}' for k in on.split(', '))}, round(a.value, 9) AS value_a, round(b.value, 9) AS value_b, "
        f"CASE WHEN b.value > a.value THEN {q(M[1])} WHEN a.value > b.value THEN {q(M[0])} ELSE 'Tie' END AS winner "
        f"FROM {source} a JOIN {source} b ON a.model = {q(M[0])} AND b.model = {q(M[1])} AND "
        + " AND ".join(f"a.{k} = b.{k}" for k in on.split(", "))
    )


@query("model_compare",
       f"{WITH}, {record_sql('scores')}, am AS ({sql_auc('model')}), v AS ("
       + " UNION ALL ".join(f"SELECT model, '{n}' AS metric, {n} AS value FROM ov" for n in ("f1_macro", "f1_micro", "roc_auc_macro"))
       + f" UNION ALL SELECT model, 'roc_auc_micro', roc_auc FROM am) {_winner_sql('v', 'metric')}")
def model_compare(spark, d):
    return rounded(comparison.compare_models(_compared(spark, d), *M))


@query("model_compare_mean_auc",
       f"{WITH} SELECT model, round(avg(roc_auc), 9) AS roc_auc_micro FROM ({sql_auc(KEYS)}) GROUP BY model")
def model_compare_mean_auc(spark, d):
    return rounded(comparison.mean_label_auc(curves.roc_auc(curves.curve_counts(scores(spark, d)))))


@query("model_compare_per_label",
       f"{WITH}, {record_sql('scores')}, v AS (SELECT model, label, 'f1' AS metric, f1 AS value FROM rec UNION ALL "
       f"SELECT model, label, 'roc_auc', roc_auc FROM rec) {_winner_sql('v', 'label, metric')}")
def model_compare_per_label(spark, d):
    return rounded(comparison.compare_per_label(resilience.per_label_metrics(scores(spark, d)), *M))


@query("report_tables", f"{WITH}, {record_sql('scores')} SELECT {KEYS}, "
       + ", ".join(f"printf('%.4f', {n}) AS {n}" for n in _RATE_NAMES[:4]) + " FROM rec")
def report_tables(spark, d):
    return comparison.report_tables(resilience.per_label_metrics(scores(spark, d)))


# -- slices -------------------------------------------------------------------------

def _sliced(spark, d):
    """Predictions with the text's tags, computed once per document."""
    rows = labelled(spark, d).withColumns({
        "has_identity": tags.has_identity(F.col("text")), "n_words": tx.n_tokens(F.col("text")),
    })
    return predictions_of(scores_of(rows, ["text", "has_identity", "n_words"]))


_IDENTITY = "(" + " OR ".join(f"contains(lower(text), {q(t)})" for t in lexicon.IDENTITY_TERMS) + ")::INT"


@query("fairness_identity",
       f"{WITH_P}, s AS (SELECT *, {_IDENTITY} AS has_identity FROM preds), f AS ({macro_micro_sql('model, has_identity', 's')}) "
       "SELECT a.model, round(a.f1_macro, 9) AS with_identity, round(b.f1_macro, 9) AS without_identity, "
       "round(b.f1_macro - a.f1_macro, 9) AS gap FROM f a JOIN f b ON a.model = b.model AND a.has_identity = 1 AND b.has_identity = 0")
def fairness_identity(spark, d):
    return rounded(slices.fairness_gap(_sliced(spark, d).drop("text")))


@query("fairness_by_term",
       f"{WITH_P}, terms AS (SELECT unnest([{inp.sql_list(lexicon.IDENTITY_TERMS)}]) AS term), s AS (SELECT preds.*, term FROM preds "
       f"JOIN terms ON contains(lower(text), term)) {sql_mm('model, term', 's', ['f1_macro'])}")
def fairness_by_term(spark, d):
    rows = tagging.with_terms(labelled(spark, d)).drop("text").filter(F.size("terms") > 0)
    return rounded(slices.fairness_by_term(predictions_of(scores_of(rows, ["terms"]))))


@query("slice_by_flags",
       f"{WITH_P}, s AS (SELECT *, 'has_identity' AS flag FROM preds WHERE {_IDENTITY} = 1 UNION ALL "
       f"SELECT *, 'is_long' FROM preds WHERE {sql_n_tokens('text')} > 100) {sql_mm('model, flag', 's')}")
def slice_by_flags(spark, d):
    preds = _sliced(spark, d).withColumn("is_long", (F.col("n_words") > 100).cast("int"))
    return rounded(slices.slice_by_flags(preds, ["has_identity", "is_long"]))


@query("slice_by_length",
       f"{WITH_P}, n AS (SELECT *, {sql_n_tokens('text')} AS n FROM preds), s AS (SELECT *, CASE WHEN n < 10 THEN '<10' "
       f"WHEN n <= 50 THEN '10-50' ELSE '>50' END AS length_band FROM n) {sql_mm('model, length_band', 's')}")
def slice_by_length(spark, d):
    return rounded(slices.slice_by_length(_sliced(spark, d)))


@query("slice_by_score",
       f"{WITH_P}, s AS (SELECT *, CASE WHEN p < 0.3::DOUBLE THEN 'low' WHEN p < 0.7::DOUBLE THEN 'medium' ELSE 'high' END AS score_band "
       f"FROM preds) {sql_mm('model, score_band', 's')}")
def slice_by_score(spark, d):
    return rounded(slices.slice_by_score(predictions(spark, d)))


# -- sampling -----------------------------------------------------------------------

def _grow(source: str, label: str, n: int) -> str:
    """CTE text of one oversampling step: ``g_<label>`` from ``source``."""
    salt = q(f"42:{label}")
    return (
        f"n_{label} AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', {salt}, doc_id, copy)), doc_id, copy) - 1 AS pos, "
        f"count(*) OVER () AS cnt FROM {source} WHERE {label} = 1), "
        f"d_{label} AS (SELECT i, floor({sql_rand(salt, 'i', q('draw'))} * (SELECT max(cnt) FROM n_{label}))::BIGINT AS pos FROM range({n}) t(i)), "
        f"g_{label} AS (SELECT doc_id, copy, {', '.join(LABELS)} FROM {source} UNION ALL "
        f"SELECT doc_id, copy || '/{label}:' || i, {', '.join(LABELS)} FROM d_{label} JOIN n_{label} USING (pos))"
    )


@query("oversample",
       f"WITH {COMMENTS}, {LABELLED}, g0 AS (SELECT doc_id, '' AS copy, {', '.join(LABELS)} FROM labelled), "
       + ", ".join(_grow(src, label, 3000) for src, label in zip(["g0", "g_threat", "g_identity_hate"], lexicon.RARE_LABELS))
       + f" SELECT * FROM g_{lexicon.RARE_LABELS[-1]}")
def oversample(spark, d):
    return sampling.oversample(labelled(spark, d, text=False), "doc_id")


@query("shuffled", "SELECT doc_id, md5(concat_ws(':', '42', doc_id)) AS h FROM documents")
def shuffled(spark, d):
    docs = inp.table(spark, d, "documents").select("doc_id")
    return sampling.shuffled(docs, "doc_id").withColumn("h", F.md5(F.concat_ws(":", F.lit("42"), F.col("doc_id").cast("string"))))


@query("peek", "SELECT doc_id, text FROM documents ORDER BY md5(concat_ws(':', '42', doc_id)), doc_id LIMIT 3")
def peek(spark, d):
    return sampling.peek(inp.table(spark, d, "documents").select("doc_id", "text"), "doc_id")


@query("stratified_folds",
       f"WITH {COMMENTS}, {LABELLED} SELECT doc_id, concat({', '.join(LABELS)}) AS label_set, "
       f"((row_number() OVER (PARTITION BY {', '.join(LABELS)} ORDER BY md5(concat_ws(':', '42', doc_id)), doc_id) - 1) % 3)::INT AS fold "
       "FROM labelled")
def stratified_folds(spark, d):
    return sampling.stratified_folds(labelled(spark, d, text=False), "doc_id").select("doc_id", "label_set", "fold")
