"""Features and per-label models on Spark ML."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import lexicon, text
from ..functions.arrow import OfWords
from ..functions.rand import det_rand
from ..sources.checkpoint import cut_lineage
from .curves import best_f1_point, curve_counts
from .metrics import apply_thresholds, classification_report, hamming_accuracy, macro_micro
from .tagging import judged, pos_weights

LABELS = lexicon.LABELS


# -- features -------------------------------------------------------------------

def embed(
    df: DataFrame, col: str = "clean", out: str = "features", encoder: Callable[[list[str]], np.ndarray] | None = None,
    dim: int = 256, max_tokens: int | None = None, batch: int = 32,
) -> DataFrame:
    """Mean token vector of every text, over all its words; ``max_tokens`` cuts the
    texts for an encoder that has such a limit.

    The default encoder sends each word to one of ``dim`` axes, by the first eight
    hex digits of its md5, and averages; a word's axis is found once. Another encoder is a function from a list of texts to a
    matrix, called on Arrow batches; a row's vector must depend on its own text
    only.
    """
    whole = text.text_or_empty(F.col(col))
    if encoder is not None or max_tokens is not None:
        whole = text.squeeze_ws(whole)
    words = df.withColumn("_text", whole if max_tokens is None else text.truncate_tokens(whole, max_tokens))
    if encoder is not None:
        return words.withColumn(out, _encoder_udf(encoder, batch)(F.col("_text"))).drop("_text")
    return words.withColumn(out, _hashed_means(dim)(F.col("_text"))).drop("_text")


def _hashed_means(dim: int):
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def means(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        axis = OfWords(lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim).__getitem__

        def mean(t: str) -> np.ndarray:
            axes = np.fromiter(map(axis, t.split()), np.int64)
            return (np.bincount(axes, minlength=dim) / max(len(axes), 1)).astype(np.float32)

        for batch in batches:
            for start in range(0, len(batch), 256):
                yield pa.array([mean(x.as_py()) for x in batch[start:start + 256]], pa.list_(pa.float32()))

    return means


def _encoder_udf(encoder, batch: int):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            parts = [encoder(s.iloc[i:i + batch].tolist()) for i in range(0, len(s), batch)]
            yield pd.Series([row for p in parts for row in np.asarray(p, dtype="float32")], index=s.index)

    return encode


def expand_vector(df: DataFrame, col: str, dim: int, prefix: str = "bert_feature_", keep: Sequence[str] = ()) -> DataFrame:
    """One column per vector element."""
    return df.select(*keep, *[F.col(col)[i].alias(f"{prefix}{i}") for i in range(dim)])


def fit_width(c: Column, n: int = len(LABELS)) -> Column:
    """Score array padded with zeros or cut to ``n`` entries."""
    return F.slice(F.concat(c, F.array_repeat(F.lit(0.0), n)), 1, n)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


# -- per-label models -------------------------------------------------------------

DEFAULT_PARAMS = {"maxDepth": 5, "maxIter": 20, "stepSize": 0.1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}


def as_features(df: DataFrame, col: str) -> DataFrame:
    """Array column to the vector type of Spark ML."""
    return df.withColumn(col, array_to_vector(F.col(col).cast("array<double>")))


def _on_labels(fit: Callable[[str], PipelineModel], labels: Sequence[str], parallelism: int) -> dict[str, PipelineModel]:
    """Fit the labels side by side: small stages of one fit fill the gaps of another."""
    with ThreadPoolExecutor(parallelism) as pool:
        return dict(zip(labels, pool.map(fit, labels)))


def fit_multilabel(
    df: DataFrame, labels: Sequence[str] = tuple(LABELS), features: str = "features",
    params: Mapping | None = None, seed: int = 42, parallelism: int = 3,
) -> dict[str, PipelineModel]:
    """One boosted-tree classifier per label on a vector column. Rows whose label
    was not judged are left out of that label's fit."""
    settings = {**DEFAULT_PARAMS, **(params or {})}
    df = cut_lineage(df.select(features, *labels))  # features once, not once per label and pass

    def fit(label: str) -> PipelineModel:
        gbt = GBTClassifier(featuresCol=features, labelCol=label, seed=seed, predictionCol="_pred", **settings)
        gbt.setRawPredictionCol("_raw").setProbabilityCol("_prob")
        return Pipeline(stages=[gbt]).fit(df.filter(F.col(label) >= 0).select(features, label))

    return _on_labels(fit, labels, parallelism)


def _terms(dim: int) -> HashingTF:
    return HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim)


def count_terms(df: DataFrame, col: str = "clean", dim: int = 1 << 14) -> DataFrame:
    """The table with hashed term frequencies (``_tf``) in place of its cleaned text,
    written: fits and scores read those, and the text is cleaned once."""
    return cut_lineage(_terms(dim).transform(df.withColumn("_words", text.tokens(F.col(col)))).drop("_words", col))


def fit_weighted_linear(
    df: DataFrame, labels: Sequence[str] = tuple(LABELS), col: str = "clean", dim: int = 1 << 14, max_iter: int = 20,
    reg: float = 0.01, parallelism: int = 3,
) -> dict[str, PipelineModel]:
    """One class-weighted logistic text model per label: hashed term frequencies
    with inverse document frequencies, positives weighted by negatives / positives.
    A table of ``count_terms`` (with the same ``dim``) is taken as it is."""
    # Cleaning and features once for all labels and passes, not once per pass.
    counted = df.select("_tf", *labels) if "_tf" in df.columns else count_terms(df.select(col, *labels), col, dim)
    tf = _terms(dim)
    idf = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted)
    rows = idf.transform(counted).drop("_tf")
    # Six numbers for six models; what reaches the driver does not grow.
    weights = {r["label"]: r["pos_weight"] for r in pos_weights(counted, labels).collect()}

    def fit(label: str) -> PipelineModel:
        weight = F.when(F.col(label) == 1, F.lit(float(weights[label] or 1.0))).otherwise(F.lit(1.0))
        lr = LogisticRegression(
            featuresCol="_tfidf", labelCol=label, weightCol="_weight", maxIter=max_iter, regParam=reg,
            rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_pred",
        ).fit(rows.filter(F.col(label) >= 0).select("_tfidf", label, weight.alias("_weight")))
        return PipelineModel([tf, idf, lr])

    return _on_labels(fit, labels, parallelism)


def predict_long(
    models: Mapping[str, PipelineModel], df: DataFrame, key: str, name: str, text_col: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Positive-class probabilities as rows (id, model, label, y, p).

    All models score the row before it is turned into rows, so the input is read
    once and not once per label, and stages that models share run once. A stage whose
    result the table already holds is passed over.
    """
    held = set(df.columns)
    if text_col is not None:
        df = df.withColumn("_words", text.tokens(F.col(text_col)))
    done = set()
    for label, model in models.items():
        for stage in model.stages:
            if stage.uid not in done and not (stage.hasParam("outputCol") and stage.getOrDefault("outputCol") in held):
                df = stage.transform(df)
                done.add(stage.uid)
        df = df.withColumn(f"_p_{label}", vector_to_array("_prob")[1]).drop("_raw", "_prob", "_pred")
    truth = lambda l: F.coalesce(F.col(l).cast("int"), F.lit(-1)) if l in df.columns else F.lit(-1)
    rows = F.array(*[
        F.struct(F.lit(l).alias("label"), truth(l).alias("y"), F.col(f"_p_{l}").alias("p")) for l in models
    ])
    return df.select(F.col(key).alias("id"), *keep, F.lit(name).alias("model"), F.inline(rows))


def save_models(models: Mapping[str, PipelineModel], path: str) -> None:
    for label, model in models.items():
        model.write().overwrite().save(f"{path}/{label}")


def load_models(path: str, labels: Sequence[str] = tuple(LABELS)) -> dict[str, PipelineModel]:
    return {label: PipelineModel.load(f"{path}/{label}") for label in labels}


# -- search -----------------------------------------------------------------------

class MacroF1Evaluator(Evaluator):
    """Macro F1 of a long score table at a fixed threshold."""

    def __init__(self, threshold: float = 0.5):
        super().__init__()
        self.threshold = threshold

    def _evaluate(self, dataset: DataFrame) -> float:
        preds = dataset.withColumn("pred", (F.col("p") > self.threshold).cast("int"))
        value = macro_micro(judged(preds), ["model"]).agg(F.avg("f1_macro")).first()[0]
        return float(value) if value is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True


# FIXED: search ranges: tree size, depth, learning rate (log-uniform), trees,
# row share, column share.
SEARCH_SPACE = {
    "num_leaves": (20, 150), "maxDepth": (3, 10), "stepSize": (0.01, 0.3), "maxIter": (100, 500),
    "subsamplingRate": (0.6, 1.0), "colsample": (0.6, 1.0),
}


def draw_params(space: Mapping = SEARCH_SPACE, n_iter: int = 25, seed: int = 42) -> list[dict]:
    """Random settings from digests of (seed, trial, name). The number of leaves
    bounds the depth, since Spark trees grow by depth; the column share is Spark's
    feature subset strategy."""
    def u(trial: int, name: str) -> float:
        return int(hashlib.md5(f"{seed}:{trial}:{name}".encode()).hexdigest()[:8], 16) / 2**32

    def whole(trial: int, name: str) -> int:
        low, high = space[name]
        return low + int(u(trial, name) * (high - low + 1))

    def real(trial: int, name: str, places: int) -> float:
        low, high = space[name]
        return round(low + u(trial, name) * (high - low), places)

    def setting(trial: int) -> dict:
        low, high = map(math.log, space["stepSize"])
        return {
            "maxDepth": max(1, min(whole(trial, "maxDepth"), math.ceil(math.log2(whole(trial, "num_leaves"))))),
            "stepSize": round(math.exp(low + u(trial, "stepSize") * (high - low)), 6),
            "maxIter": whole(trial, "maxIter"), "subsamplingRate": real(trial, "subsamplingRate", 6),
            "featureSubsetStrategy": str(real(trial, "colsample", 4)),
        }

    return [setting(trial) for trial in range(n_iter)]


# -- end to end ---------------------------------------------------------------------

def train_and_evaluate(
    df: DataFrame, key: str, labels: Sequence[str] = tuple(LABELS), features: str = "features",
    params: Mapping | None = None, held_out: float = 0.0, seed: int = 42, name: str = "trees",
) -> dict[str, DataFrame | dict]:
    """Train per-label trees, score, tune thresholds by best F1, evaluate.

    ``df`` has the key, a vector column and the labels. Thresholds are tuned on
    the rows that are evaluated: the training rows, or a held-out share. The long
    scores are checkpointed once, because every table below reads them.
    """
    draw = det_rand(F.col(key), f"held-out:{seed}")
    train = df.filter(draw >= held_out) if held_out else df
    test = df.filter(draw < held_out) if held_out else df
    models = fit_multilabel(train, labels, features, params, seed)
    scores = cut_lineage(predict_long(models, test, key, name))
    thresholds = best_f1_point(curve_counts(scores)).select("model", "label", "threshold")
    preds = apply_thresholds(judged(scores), thresholds)
    return {
        "models": models, "scores": scores, "thresholds": thresholds, "predictions": preds,
        "report": classification_report(preds), "overall": macro_micro(preds), "accuracy": hamming_accuracy(preds),
    }
