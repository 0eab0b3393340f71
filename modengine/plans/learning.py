"""Queries of features and models.

Fitted numbers have no SQL form. Queries that return them are checked by
invariants in the tests, and each has a sibling that returns facts SQL can state:
which rows are scored and judged, and that scores, counts and copies agree.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import bundle, cleaning, curves, metrics, models
from ..sources.checkpoint import cut_lineage, new_folder
from .inputs import COMMENTS, LABELLED, LABELS, comments, labelled, q, sql_rand, table
from .registry import query
from .text import sql_n_tokens, sql_thorough

DIM = 64


def vectors(spark, d):
    """(vec_id, features, six labels): labels by the vector's class, overlapping."""
    rows = table(spark, d, "embeddings")
    y = {label: (F.pmod(F.col("label") * (i + 3) + i, F.lit(10)) < 3).cast("int") for i, label in enumerate(LABELS)}
    named = rows.select("vec_id", F.col("embedding").alias("features"), *[c.alias(n) for n, c in y.items()])
    return models.as_features(named, "features")


_EMBED_SQL = f"""
WITH {COMMENTS}, c AS (SELECT doc_id, list_filter(string_split({sql_thorough()}, ' '), lambda w: w <> '') AS ws FROM comments),
axes AS (SELECT doc_id, list_transform(ws, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM}) AS a FROM c)
SELECT doc_id, list_transform(range({DIM}), lambda i: (len(list_filter(a, lambda x: x = i))::DOUBLE / greatest(len(a), 1))::FLOAT) AS features FROM axes
"""


@query("embed_docs", _EMBED_SQL)
def embed_docs(spark, d):
    clean = cleaning.clean_thorough(comments(spark, d))
    return models.embed(clean, "clean", dim=DIM).select("doc_id", "features")


@query("expand_vector", "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}] AS bert_feature_{i}" for i in range(DIM)) + " FROM embeddings")
def expand_vector(spark, d):
    return models.expand_vector(table(spark, d, "embeddings"), "embedding", DIM, keep=["vec_id"])


@query("gbt_scores")
def gbt_scores(spark, d):
    rows = vectors(spark, d)
    fitted = models.fit_multilabel(rows)
    return models.predict_long(fitted, rows, "vec_id", "trees")


@query("score_long")
def score_long(spark, d):
    """Scores of one model turned into predictions at the default thresholds."""
    rows = vectors(spark, d)
    fitted = models.fit_multilabel(rows)
    return metrics.apply_thresholds(models.predict_long(fitted, rows, "vec_id", "trees"), lexicon.DEFAULT_THRESHOLDS)


@query("lr_scores")
def lr_scores(spark, d):
    rows = models.count_terms(cleaning.clean_basic(labelled(spark, d)).drop("text"))
    fitted = models.fit_weighted_linear(rows)
    return models.predict_long(fitted, rows, "doc_id", "linear")


_SPACE = {
    "num_leaves": (4, 8), "maxDepth": (2, 3), "stepSize": (0.05, 0.3), "maxIter": (2, 3),
    "subsamplingRate": (0.8, 1.0), "colsample": (0.6, 1.0),
}


@query("search_report")
def search_report(spark, d):
    return bundle.search(vectors(spark, d), "vec_id", n_iter=2, folds=2, space=_SPACE)[1]


@query("train_evaluate_report")
def train_evaluate_report(spark, d):
    return models.train_and_evaluate(vectors(spark, d), "vec_id", held_out=0.3)["report"]


# -- facts that SQL can state -----------------------------------------------------------

_VECTOR_LABELS = "vectors AS (SELECT vec_id, " + ", ".join(
    f"((((label * {i + 3} + {i}) % 10) + 10) % 10 < 3)::INT AS {label}" for i, label in enumerate(LABELS)) + " FROM embeddings)"


def _long(source: str, key: str) -> str:
    return "l AS (" + " UNION ALL ".join(f"SELECT {key} AS id, {q(n)} AS label, {n} AS y FROM {source}" for n in LABELS) + ")"


_COUNTED = "count(*) AS n_rows, count(*) FILTER (y >= 0) AS n_judged, count(*) FILTER (y = 1) AS n_positive"


def facts(scores, by=("label",)):
    """Rows, judged rows and positives per label, whether all scores are
    probabilities, and whether they rank the positives better than chance."""
    by = list(by)
    counted = scores.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("y") >= 0).alias("n_judged"), F.count_if(F.col("y") == 1).alias("n_positive"),
        (F.count_if(F.col("p").between(0, 1)) == F.count("*")).alias("valid"),
    )
    aucs = curves.roc_auc(curves.curve_counts(scores, by), by)
    return counted.join(aucs, by).withColumn("learns", F.col("roc_auc") > 0.5).drop("roc_auc")


@query("gbt_facts", f"WITH {_VECTOR_LABELS}, {_long('vectors', 'vec_id')} SELECT label, {_COUNTED}, true AS valid, true AS learns FROM l GROUP BY label")
def gbt_facts(spark, d):
    rows = vectors(spark, d)
    return facts(cut_lineage(models.predict_long(models.fit_multilabel(rows), rows, "vec_id", "trees")))


@query("lr_facts", f"WITH {COMMENTS}, {LABELLED}, {_long('labelled', 'doc_id')} SELECT label, {_COUNTED}, true AS valid, true AS learns FROM l GROUP BY label")
def lr_facts(spark, d):
    rows = models.count_terms(cleaning.clean_basic(labelled(spark, d)).drop("text"))
    return facts(cut_lineage(models.predict_long(models.fit_weighted_linear(rows), rows, "doc_id", "linear")))


@query(
    "train_evaluate_facts",
    f"WITH {_VECTOR_LABELS}, {_long('(SELECT * FROM vectors WHERE ' + sql_rand('vec_id', q('held-out:42')) + ' < 0.3)', 'vec_id')} "
    "SELECT label, count(*) FILTER (y = 1) AS support, count(*) AS cells, true AS threshold_is_score, true AS counts_add_up FROM l GROUP BY label",
)
def train_evaluate_facts(spark, d):
    """The held-out evaluation: supports, and that thresholds and counts fit the scores."""
    out = models.train_and_evaluate(vectors(spark, d), "vec_id", held_out=0.3, params={"maxIter": 5})
    hit = out["predictions"].groupBy("label").agg((F.count_if(F.col("p") == F.col("threshold")) > 0).alias("threshold_is_score"))
    counts = metrics.confusion(out["predictions"], ["label"])
    support = out["report"].select(F.col("row").alias("label"), "support")
    cells = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.join(hit, "label").join(support, "label").select(
        "label", "support", cells.alias("cells"), "threshold_is_score", (F.col("tp") + F.col("fn") == F.col("support")).alias("counts_add_up"),
    )


def _draw_sql(name: str) -> str:
    return f"(('0x' || substr(md5('42:' || trial || ':{name}'), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def _whole_sql(name: str) -> str:
    low, high = _SPACE[name]
    return f"({low} + floor({_draw_sql(name)} * {high - low + 1})::INT)"


def _real_sql(name: str, places: int) -> str:
    low, high = _SPACE[name]
    return f"round({low}::DOUBLE + {_draw_sql(name)} * ({high}::DOUBLE - {low}::DOUBLE), {places})"


@query(
    "search_facts",
    f"SELECT trial::INT AS trial, greatest(1, least({_whole_sql('maxDepth')}, ceil(log2({_whole_sql('num_leaves')}))::INT)) AS maxDepth, "
    f"round(exp(ln({_SPACE['stepSize'][0]}::DOUBLE) + {_draw_sql('stepSize')} * (ln({_SPACE['stepSize'][1]}::DOUBLE) - ln({_SPACE['stepSize'][0]}::DOUBLE))), 6) AS stepSize, "
    f"{_whole_sql('maxIter')} AS maxIter, {_real_sql('subsamplingRate', 6)} AS subsamplingRate, {_real_sql('colsample', 4)}::VARCHAR AS featureSubsetStrategy, "
    "true AS valid, (SELECT count(*) FROM embeddings) AS scored FROM range(2) t(trial)",
)
def search_facts(spark, d):
    """The settings tried, whether their scores are shares, and that the best one's
    model on all rows scores every row."""
    rows = vectors(spark, d)
    _, report, best = bundle.search(rows, "vec_id", n_iter=2, folds=2, space=_SPACE)
    scored = best.transform(rows).filter(F.size("_p_trial") == len(LABELS)).count()
    return report.select(*[c for c in report.columns if c != "score"], F.col("score").between(0, 1).alias("valid"), F.lit(scored).cast("long").alias("scored"))


# Fewer and smaller trees than the defaults: the facts do not depend on them.
_SMALL = {"dim": DIM, "trees": {"maxIter": 3, "maxDepth": 3}, "linear": {"maxIter": 5}, "terms": 1 << 12}
_KEPT = (
    f"kept AS (SELECT * FROM (SELECT *, {sql_thorough()} AS clean FROM labelled) WHERE {sql_n_tokens('clean')} >= 5 "
    f"AND {sql_rand('doc_id', q('held-out:42'))} < 0.2)"
)
_THREE = "m(model) AS (VALUES ('trees'), ('linear'), ('ensemble'))"


@query(
    "text_to_report",
    f"WITH {COMMENTS}, {LABELLED}, {_KEPT}, {_long('kept', 'doc_id')}, {_THREE} SELECT model, label, {_COUNTED}, true AS valid, true AS counts_agree, "
    "true AS copy_agrees FROM l, m GROUP BY model, label",
)
def text_to_report(spark, d):
    """Raw texts to the evaluated report; the pipeline is saved, loaded, and scores
    the raw texts again."""
    rows = labelled(spark, d)
    out = bundle.run_pipeline(rows, "doc_id", **_SMALL)
    folder = new_folder(spark, "bundle")
    out["bundle"].save(folder)
    again = bundle.Bundle.load(spark, folder).scores(rows, "doc_id").select("id", "model", "label", F.col("p").alias("again"))
    by = ["model", "label"]
    counted = out["scores"].join(again, ["id", *by], "left").groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("y") >= 0).alias("n_judged"), F.count_if(F.col("y") == 1).alias("n_positive"),
        (F.count_if(F.col("p").between(0, 1)) == F.count("*")).alias("valid"), (F.count_if(F.col("p") == F.col("again")) == F.count("*")).alias("copy_agrees"),
    )
    counts = metrics.confusion(out["predictions"])
    joined = counted.join(counts, by, "left").fillna(0, ["tp", "fp", "fn", "tn"])
    agree = (F.col("tp") + F.col("fn") == F.col("n_positive")) & (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") == F.col("n_judged"))
    return joined.select(*by, "n_rows", "n_judged", "n_positive", "valid", agree.alias("counts_agree"), "copy_agrees")


@query(
    "fitted_resilience",
    f"WITH {COMMENTS}, {LABELLED}, {_long('labelled', 'doc_id')}, {_THREE}, a(pattern) AS (VALUES ('original'), "
    + ", ".join(f"({q(p)})" for p in lexicon.PATTERNS) + f") SELECT model, pattern, {_COUNTED}, true AS valid, true AS loss_agrees, "
    "true AS clean_agrees FROM l, m, a GROUP BY model, pattern",
)
def fitted_resilience(spark, d):
    """Every attack scored by one fitted pipeline in one pass: counts per model and
    pattern, and that the original's rows equal the plain evaluation of the models."""
    rows = labelled(spark, d)
    fitted = bundle.run_pipeline(rows, "doc_id", **_SMALL)["bundle"]
    scores = cut_lineage(bundle.attacked_scores(fitted, rows, "doc_id"))
    by = ["model", "pattern"]
    counted = scores.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("y") >= 0).alias("n_judged"), F.count_if(F.col("y") == 1).alias("n_positive"),
        (F.count_if(F.col("p").between(0, 1)) == F.count("*")).alias("valid"),
    )
    plain = metrics.macro_micro(fitted.predictions(fitted.scores(rows, "doc_id"))).select("model", F.col("f1_macro").alias("plain"))
    ratio = bundle.fitted_resilience(fitted, scores)["ratio"].join(plain, "model")
    near = lambda a, b: F.abs(a - b) < 1e-9
    ratio = ratio.select(
        *by, near(F.col("loss"), F.col("f1_clean") - F.col("f1_macro")).alias("loss_agrees"), near(F.col("f1_clean"), F.col("plain")).alias("clean_agrees"),
    )
    return counted.join(ratio, by)
