"""From raw text to a report: cleaners, embeddings and per-label models as stages
of one Spark ML pipeline that is saved and loaded as a whole.

Stages of their own: ``TextCleaner`` (a cleaner by name), ``Words``, ``HashedMeans``
(mean of hashed words), ``WordVectors`` (learnt word vectors, mean weighted by
inverse document frequency) and ``MultiLabel`` (one classifier per label behind one
estimator, so that Spark's tuning sees it as a single model). A ``Bundle`` is the
fitted pipeline with its thresholds beside it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
)
from pyspark.ml.feature import IDF, HashingTF, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters as To
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReader
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import lexicon, text
from ..functions.rand import det_rand
from ..sources.checkpoint import cut_lineage
from . import attacks, cleaning, models
from .curves import best_f1_point, curve_counts
from .metrics import apply_thresholds, classification_report, hamming_accuracy, macro_micro
from .resilience import metric_record, resilience_ratio
from .sampling import stratified_folds
from .tagging import judged, min_tokens, pos_weights, require_rows

LABELS = lexicon.LABELS
CLEANERS = {
    "basic": cleaning.clean_basic, "thorough": cleaning.clean_thorough, "contractions": cleaning.clean_contractions,
}


class _Columns(Params):
    """One column in, one out."""

    inputCol = Param(Params._dummy(), "inputCol", "column read", To.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column added", To.toString)

    def _of(self, param: str):
        return self.getOrDefault(self.getParam(param))


class TextCleaner(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """One of the cleaners, by name."""

    cleaner = Param(Params._dummy(), "cleaner", f"one of {', '.join(CLEANERS)}", To.toString)

    def __init__(self, inputCol: str = "text", outputCol: str = "clean", cleaner: str = "thorough"):
        super().__init__()
        if cleaner not in CLEANERS:
            raise ValueError(f"unknown cleaner: {cleaner}")
        self._set(inputCol=inputCol, outputCol=outputCol, cleaner=cleaner)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return CLEANERS[self._of("cleaner")](dataset, self._of("inputCol"), self._of("outputCol"))


class Words(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """The words of a clean text as an array."""

    def __init__(self, inputCol: str = "clean", outputCol: str = "words"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self._of("outputCol"), text.tokens(text.text_or_empty(F.col(self._of("inputCol")))))


class HashedMeans(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Mean of the words' hashed axes, as a vector."""

    dim = Param(Params._dummy(), "dim", "length of the vector", To.toInt)

    def __init__(self, inputCol: str = "clean", outputCol: str = "features", dim: int = 256):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, dim=dim)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self._of("outputCol")
        return models.as_features(models.embed(dataset, self._of("inputCol"), out, dim=self._of("dim")), out)


# -- learnt word vectors ------------------------------------------------------------------


class _WordVectorParams(_Columns):
    dim = Param(Params._dummy(), "dim", "length of the vectors", To.toInt)
    minCount = Param(Params._dummy(), "minCount", "least occurrences of a word", To.toInt)
    vocabSize = Param(Params._dummy(), "vocabSize", "most words, the commonest", To.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "passes over the texts", To.toInt)
    numPartitions = Param(Params._dummy(), "numPartitions", "tasks that learn side by side", To.toInt)
    seed = Param(Params._dummy(), "seed", "seed", To.toInt)


class WordVectors(Estimator, _WordVectorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns word vectors (Word2Vec) and the words' inverse document frequencies.

    The model holds the ``vocabSize`` commonest words, so its size is bounded
    whatever the corpus holds; a text without known words gets zeros.
    """

    def __init__(self, inputCol: str = "words", outputCol: str = "features", dim: int = 64, minCount: int = 2,
                 vocabSize: int = 20_000, maxIter: int = 1, numPartitions: int = 8, seed: int = 42):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, dim=dim, minCount=minCount, vocabSize=vocabSize, maxIter=maxIter,
                  numPartitions=numPartitions, seed=seed)

    def _fit(self, dataset: DataFrame) -> "WordVectorsModel":
        words, least, most = self._of("inputCol"), self._of("minCount"), self._of("vocabSize")
        of = lambda seen, n: lambda w: F.struct(w.alias("word"), F.lit(seen).alias("df"), F.lit(n).alias("n"))
        each = F.concat(F.transform(F.array_distinct(words), of(1, 0)), F.transform(words, of(0, 1)))
        counts = dataset.select(F.inline(each)).groupBy("word").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
        counts = cut_lineage(counts.filter(F.col("n") >= least))
        # Learning keeps words by a least count only; this one leaves no more than ``most``.
        beyond = counts.orderBy(F.desc("n")).offset(most).limit(1).agg(F.max("n")).first()[0]
        least = least if beyond is None else beyond + 1
        known = counts.filter(F.col("n") >= least)
        empty = WordVectorsModel([], np.zeros((0, self._of("dim")), dtype=np.float32), np.zeros(0, dtype=np.float32))
        if known.isEmpty():
            return self._copyValues(empty)
        word2vec = Word2Vec(
            inputCol=words, outputCol="_v", vectorSize=self._of("dim"), minCount=least, maxIter=self._of("maxIter"),
            seed=self._of("seed"), numPartitions=self._of("numPartitions"),
        ).fit(dataset.filter(F.col(words).isNotNull()).select(words))
        n = dataset.count()
        rows = known.join(word2vec.getVectors(), "word").orderBy("word").collect()  # at most vocabSize
        idf = np.array([np.log((n + 1) / (r["df"] + 1)) + 1 for r in rows], dtype=np.float32)
        vectors = np.array([r["vector"].toArray() for r in rows], dtype=np.float32).reshape(-1, self._of("dim"))
        return self._copyValues(WordVectorsModel([r["word"] for r in rows], vectors, idf))


class WordVectorsModel(Model, _WordVectorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Mean of the word vectors of a text, weighted by inverse document frequency."""

    def __init__(self, vocabulary: Sequence[str] = (), vectors: np.ndarray | None = None, idf: np.ndarray | None = None):
        super().__init__()
        self.vocabulary, self.vectors, self.idf = list(vocabulary), vectors, idf

    def _transform(self, dataset: DataFrame) -> DataFrame:
        dim = self._of("dim")
        shared = dataset.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(self.vocabulary)}, self.vectors, self.idf))

        @F.pandas_udf("array<double>")
        def means(parts: pd.Series) -> pd.Series:
            place, vectors, idf = shared.value
            out = []
            for words in parts:
                at = [place[w] for w in (() if words is None else words) if w in place]
                out.append(np.average(vectors[at], axis=0, weights=idf[at]).astype(np.float64) if at else np.zeros(dim))
            return pd.Series(out)

        return dataset.withColumn(self._of("outputCol"), array_to_vector(means(F.col(self._of("inputCol")))))

    def write(self) -> "_WordVectorsWriter":
        return _WordVectorsWriter(self)

    @classmethod
    def read(cls) -> "_WordVectorsReader":
        return _WordVectorsReader()


class _WordVectorsWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        rows = [(w, v.tolist(), float(i)) for w, v, i in zip(self.instance.vocabulary, self.instance.vectors, self.instance.idf)]
        self.sparkSession.createDataFrame(rows, "word string, vector array<float>, idf float").write.parquet(f"{path}/words")


class _WordVectorsReader(MLReader):
    def load(self, path: str) -> WordVectorsModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/words").orderBy("word").collect()
        model = WordVectorsModel([r["word"] for r in rows], None, np.array([r["idf"] for r in rows], dtype=np.float32))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.vectors = np.array([r["vector"] for r in rows], dtype=np.float32).reshape(-1, model._of("dim"))
        return model


# -- one classifier per label ----------------------------------------------------------------

_TUNED = ("maxDepth", "maxIter", "stepSize", "subsamplingRate", "featureSubsetStrategy")


class _MultiLabelParams(Params):
    kind = Param(Params._dummy(), "kind", "trees or linear", To.toString)
    labels = Param(Params._dummy(), "labels", "label columns; -1 and null are not judged", To.toListString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", To.toString)
    outputCol = Param(Params._dummy(), "outputCol", "array of probabilities, in the order of the labels", To.toString)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", To.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "trees, or steps of the linear fit", To.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate of the trees", To.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows per tree", To.toFloat)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "columns per split", To.toString)
    regParam = Param(Params._dummy(), "regParam", "penalty of the linear fit", To.toFloat)
    parallelism = Param(Params._dummy(), "parallelism", "labels fitted side by side", To.toInt)
    seed = Param(Params._dummy(), "seed", "seed", To.toInt)

    def _of(self, param: str):
        return self.getOrDefault(self.getParam(param))


class MultiLabel(Estimator, _MultiLabelParams, DefaultParamsReadable, DefaultParamsWritable):
    """One classifier per label behind one estimator: boosted trees, or a logistic
    model that weighs positives by negatives / positives. A label is learnt from
    the rows that judge it. The table is read as it is: cut its lineage before."""

    def __init__(self, kind: str = "trees", labels: Sequence[str] = tuple(LABELS), featuresCol: str = "features", outputCol: str = "p_trees", **params):
        super().__init__()
        if kind not in ("trees", "linear"):
            raise ValueError(f"unknown kind: {kind}")
        self._setDefault(**models.DEFAULT_PARAMS, regParam=0.01, parallelism=3, seed=42)
        self._set(kind=kind, labels=list(labels), featuresCol=featuresCol, outputCol=outputCol, **params)

    def _classifier(self, label: str):
        names = dict(featuresCol=self._of("featuresCol"), labelCol=label, rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_pred")
        if self._of("kind") == "trees":
            gbt = GBTClassifier(featuresCol=names["featuresCol"], labelCol=label, seed=self._of("seed"), predictionCol="_pred",
                                **{p: self._of(p) for p in _TUNED})
            return gbt.setRawPredictionCol("_raw").setProbabilityCol("_prob")
        return LogisticRegression(**names, weightCol="_weight", maxIter=self._of("maxIter"), regParam=self._of("regParam"))

    def _fit(self, dataset: DataFrame) -> "MultiLabelModel":
        labels, features = self._of("labels"), self._of("featuresCol")
        weights: dict = {}
        if self._of("kind") == "linear":
            weights = {r["label"]: r["pos_weight"] or 1.0 for r in pos_weights(dataset, labels).collect()}  # a number per label

        def fit(label: str):
            rows = dataset.filter(F.col(label) >= 0).select(features, F.col(label).cast("double").alias(label))
            if weights:
                rows = rows.withColumn("_weight", F.when(F.col(label) == 1, F.lit(float(weights[label]))).otherwise(F.lit(1.0)))
            return self._classifier(label).fit(rows)

        fitted = models._on_labels(fit, labels, self._of("parallelism"))
        return self._copyValues(MultiLabelModel([fitted[label] for label in labels]))


class MultiLabelModel(Model, _MultiLabelParams, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted classifiers; adds one array with a probability per label."""

    def __init__(self, fitted: Sequence = ()):
        super().__init__()
        self.fitted = list(fitted)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, held = dataset, []
        for i, model in enumerate(self.fitted):
            held.append(f"_p_{self.uid}_{i}")
            out = model.transform(out).withColumn(held[-1], vector_to_array("_prob")[1]).drop("_raw", "_prob", "_pred")
        return out.withColumn(self._of("outputCol"), F.array(*[F.col(f"`{c}`") for c in held])).drop(*held)

    def write(self) -> "_MultiLabelWriter":
        return _MultiLabelWriter(self)

    @classmethod
    def read(cls) -> "_MultiLabelReader":
        return _MultiLabelReader()


class _MultiLabelWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        for i, model in enumerate(self.instance.fitted):
            model.write().overwrite().save(f"{path}/label-{i}")


class _MultiLabelReader(MLReader):
    def load(self, path: str) -> MultiLabelModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = MultiLabelModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        of = GBTClassificationModel if model._of("kind") == "trees" else LogisticRegressionModel
        model.fitted = [of.load(f"{path}/label-{i}") for i in range(len(model._of("labels")))]
        return model


def long_scores(
    scored: DataFrame, key: str, outputs: Mapping[str, str], labels: Sequence[str] = tuple(LABELS), keep: Sequence[str] = (),
    ensemble: str | None = None,
) -> DataFrame:
    """Arrays of probabilities (model name: column) as rows (id, keep…, model,
    label, y, p), each input row by itself. With ``ensemble``, the mean of the
    models as one more. A label the table does not hold is not judged (-1)."""
    truth = lambda l: F.coalesce(F.col(l).cast("int"), F.lit(-1)) if l in scored.columns else F.lit(-1)
    cell = lambda name, i, label, p: F.struct(F.lit(name).alias("model"), F.lit(label).alias("label"), truth(label).alias("y"), p.alias("p"))
    cells = [cell(name, i, label, F.col(c)[i]) for name, c in outputs.items() for i, label in enumerate(labels)]
    if ensemble is not None:
        mean = lambda i: sum((F.col(c)[i] for c in outputs.values()), F.lit(0.0)) / len(outputs)
        cells += [cell(ensemble, i, label, mean(i)) for i, label in enumerate(labels)]
    return scored.select(F.col(key).alias("id"), *keep, F.inline(F.array(*cells)))


class MacroF1(models.MacroF1Evaluator):
    """Macro F1 over the labels of a ``MultiLabel`` output at a fixed threshold."""

    def __init__(self, key: str, column: str = "p_trees", labels: Sequence[str] = tuple(LABELS), threshold: float = 0.5):
        super().__init__(threshold)
        self.key, self.column, self.labels = key, column, tuple(labels)

    def _evaluate(self, dataset: DataFrame) -> float:
        return super()._evaluate(long_scores(dataset, self.key, {"trial": self.column}, self.labels))


def search(
    df: DataFrame, key: str, labels: Sequence[str] = tuple(LABELS), features: str = "features", n_iter: int = 25,
    folds: int = 3, space: Mapping = models.SEARCH_SPACE, seed: int = 42, parallelism: int = 3,
) -> tuple[dict, DataFrame, MultiLabelModel]:
    """Random search of tree settings by macro F1, cross-validated over the
    stratified folds by Spark's ``CrossValidator``: one fold table for all trials,
    trials of a fold side by side.

    Returns the best settings, the report (trial, settings…, score) and the model
    of the best settings on all rows.
    """
    table = cut_lineage(stratified_folds(df, key, folds, labels, seed).select(key, features, *labels, "fold"))
    trees = MultiLabel("trees", labels, features, "_p_trial", seed=seed)
    drawn = models.draw_params(space, n_iter, seed)
    grid = [{trees.getParam(name): value for name, value in settings.items()} for settings in drawn]
    validator = CrossValidator(
        estimator=trees, estimatorParamMaps=grid, evaluator=MacroF1(key, "_p_trial", labels), numFolds=folds, foldCol="fold",
        parallelism=parallelism, seed=seed,
    )
    found = validator.fit(table)
    scores = [float(x) for x in found.avgMetrics]
    schema = (
        "trial int, maxDepth int, stepSize double, maxIter int, subsamplingRate double, "
        "featureSubsetStrategy string, score double"
    )
    report = df.sparkSession.createDataFrame([(i, *s.values(), x) for i, (s, x) in enumerate(zip(drawn, scores))], schema)
    return drawn[int(np.argmax(scores))], report, found.bestModel


# -- the bundle --------------------------------------------------------------------------------


@dataclass
class Bundle:
    """A fitted pipeline from raw text to probabilities, and its thresholds
    (model, label, threshold), a few rows."""

    model: PipelineModel
    outputs: dict[str, str]
    labels: list[str]
    thresholds: DataFrame
    text_col: str = "text"
    ensemble: str | None = "ensemble"

    def scores(self, df: DataFrame, key: str, col: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """Long scores of raw texts in ``col``; every stage runs once per row."""
        own = [c for c in self.labels if c in df.columns]
        raw = df.select(key, *keep, *own, F.col(col or self.text_col).alias(self.text_col))
        return long_scores(self.model.transform(raw), key, self.outputs, self.labels, keep, self.ensemble)

    def predictions(self, scores: DataFrame) -> DataFrame:
        return apply_thresholds(judged(scores), self.thresholds, ">=")

    def save(self, path: str) -> None:
        """``model`` (a PipelineModel), ``thresholds`` (Parquet) and ``about`` (JSON)."""
        spark = self.thresholds.sparkSession
        self.model.write().overwrite().save(f"{path}/model")
        self.thresholds.coalesce(1).write.mode("overwrite").parquet(f"{path}/thresholds")
        about = [(list(self.outputs), list(self.outputs.values()), self.labels, self.text_col, self.ensemble)]
        schema = "models array<string>, outputs array<string>, labels array<string>, text_col string, ensemble string"
        spark.createDataFrame(about, schema).coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Bundle":
        schema = "models array<string>, outputs array<string>, labels array<string>, text_col string, ensemble string"
        about = spark.read.schema(schema).json(f"{path}/about").first()
        return Bundle(
            PipelineModel.load(f"{path}/model"), dict(zip(about["models"], about["outputs"])), about["labels"],
            spark.read.parquet(f"{path}/thresholds"), about["text_col"], about["ensemble"],
        )


def run_pipeline(
    df: DataFrame, key: str, text_col: str = "text", labels: Sequence[str] = tuple(LABELS), cleaner: str = "thorough",
    encoder: str = "hashed", dim: int = 256, min_words: int = 5, min_rows: int = 10, held_out: float = 0.2,
    trees: Mapping | None = None, linear: Mapping | None = None, terms: int = 1 << 14, seed: int = 42,
) -> dict:
    """Raw labelled texts to fitted models, thresholds and tables of results.

    Clean, drop texts of fewer than ``min_words`` words, fail below ``min_rows``
    rows, embed (``hashed`` or ``learnt`` word vectors), fit trees on the
    embeddings and a weighted linear model on tf-idf, score the held-out share (all
    rows, if it is 0) with both and their mean, choose each model's thresholds by
    best F1, and evaluate at them. Cleaning and features are computed once and
    checkpointed; all fits and scores read that table.

    Returns ``bundle``, ``scores``, ``predictions``, ``report``, ``overall``, ``accuracy`` and
    ``record``.
    """
    labels = list(labels)
    clean = TextCleaner(text_col, "_clean", cleaner)
    words = Words("_clean", "_tokens")
    embed = HashedMeans("_clean", "_features", dim) if encoder == "hashed" else WordVectors("_tokens", "_features", dim, seed=seed)
    tf, idf = HashingTF(inputCol="_tokens", outputCol="_terms", numFeatures=terms), IDF(inputCol="_terms", outputCol="_tfidf")
    held = (det_rand(F.col(key), f"held-out:{seed}") < held_out) if held_out else F.lit(None).cast("boolean")
    rows = min_tokens(clean.transform(df.select(key, text_col, *labels)), min_words, "_clean")
    rows = cut_lineage(words.transform(rows).select(key, "_clean", "_tokens", *labels, held.alias("_held")))
    require_rows(rows, min_rows)
    learn = rows.filter(~F.col("_held")) if held_out else rows
    require_rows(learn, min_rows)
    features = Pipeline(stages=[embed, tf, idf]).fit(learn)
    table = cut_lineage(features.transform(rows).select(key, "_features", "_tfidf", *labels, "_held"))
    learn = table.filter(~F.col("_held")) if held_out else table
    test = table.filter("_held") if held_out else table
    outputs = {"trees": "_p_trees", "linear": "_p_linear"}
    fitted = [
        MultiLabel("trees", labels, "_features", outputs["trees"], seed=seed, **(trees or {})).fit(learn),
        MultiLabel("linear", labels, "_tfidf", outputs["linear"], seed=seed, **(linear or {})).fit(learn),
    ]
    scores = cut_lineage(long_scores(PipelineModel(fitted).transform(test), key, outputs, labels, ensemble="ensemble"))
    thresholds = cut_lineage(best_f1_point(curve_counts(scores)).select("model", "label", "threshold"))
    bundle = Bundle(PipelineModel([clean, words, *features.stages, *fitted]), outputs, labels, thresholds, text_col)
    preds = bundle.predictions(scores)
    return {
        "bundle": bundle, "scores": scores, "predictions": preds, "report": classification_report(preds), "overall": macro_micro(preds),
        "accuracy": hamming_accuracy(preds), "record": metric_record(scores, thresholds),
    }


def attacked_scores(
    bundle: Bundle, df: DataFrame, key: str, patterns: Sequence[str] = tuple(lexicon.PATTERNS), col: str | None = None,
) -> DataFrame:
    """Scores of every text under every attack and of the text itself (``pattern``
    "original"), by one pass of the fitted pipeline over the fanned-out table."""
    variants = attacks.obfuscation_variants(df, col or bundle.text_col, key, patterns, "_attacked")
    return bundle.scores(variants, key, "_attacked", ["pattern"])


def fitted_resilience(bundle: Bundle, scores: DataFrame) -> dict[str, DataFrame]:
    """What attacks cost fitted models, from the scores of ``attacked_scores``:
    ``ratio`` has the macro F1 per model and pattern at the thresholds of the clean
    evaluation, its ratio to the original's and the loss; ``record`` the metric
    record per model and pattern at the same thresholds."""
    ratio = resilience_ratio(bundle.predictions(scores), extra=["model"])
    return {
        "ratio": ratio.withColumn("loss", F.col("f1_clean") - F.col("f1_macro")),
        "record": metric_record(scores, bundle.thresholds, by=["model", "pattern"]),
    }
