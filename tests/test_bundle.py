"""Raw texts to reports: saved pipelines, learnt encoders, tuning, attacked scores."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from modengine.functions import lexicon
from modengine.operators import bundle, models, resilience

LABELS = ["toxic", "insult"]
SMALL = {"dim": 16, "trees": {"maxIter": 3, "maxDepth": 2}, "linear": {"maxIter": 5}, "terms": 256, "labels": LABELS}


@pytest.fixture(scope="module")
def comments(spark):
    """Toxic texts say one thing, insults another; every tenth label is not judged."""
    say = lambda i: " ".join([f"filler{i % 7} number{i % 11} grey green"] + ["rotten swamp"] * (i % 2) + ["ugly toad"] * (i % 3 == 0))
    rows = [(i, say(i), -1 if i % 10 == 9 else i % 2, int(i % 3 == 0)) for i in range(150)]
    return spark.createDataFrame(rows, "id int, text string, toxic int, insult int")


@pytest.fixture(scope="module")
def fitted(comments):
    return bundle.run_pipeline(comments, "id", **SMALL)


def scores_of(df):
    return {(r["id"], r["model"], r["label"]): (r["y"], r["p"]) for r in df.collect()}


def test_report_follows_the_texts(fitted):
    overall = {r["model"]: r["f1_macro"] for r in fitted["overall"].collect()}
    assert set(overall) == {"trees", "linear", "ensemble"} and overall["linear"] > 0.95 and overall["ensemble"] > 0.9
    n = fitted["scores"].select("id").distinct().count()
    assert 10 < n < 60 and fitted["scores"].count() == n * 6 and fitted["bundle"].thresholds.count() == 6
    assert {r["row"] for r in fitted["report"].collect()} == {*LABELS, "micro avg", "macro avg", "weighted avg", "samples avg"}


def test_loaded_bundle_scores_alike(spark, comments, fitted, tmp_path):
    fitted["bundle"].save(str(tmp_path / "b"))
    loaded = bundle.Bundle.load(spark, str(tmp_path / "b"))
    assert isinstance(loaded.model, PipelineModel) and loaded.labels == LABELS
    again, first = scores_of(loaded.scores(comments, "id")), scores_of(fitted["scores"])
    assert len(again) == 150 * 6 and {k: again[k] for k in first} == first
    assert sorted(map(tuple, loaded.thresholds.collect())) == sorted(map(tuple, fitted["bundle"].thresholds.collect()))
    unlabelled = loaded.scores(comments.select("id", F.col("text").alias("other")), "id", "other")
    assert {k: p for k, (_, p) in scores_of(unlabelled).items()} == {k: p for k, (_, p) in again.items()}
    assert unlabelled.filter("y <> -1").count() == 0


def test_learnt_encoder(spark, comments, tmp_path):
    out = bundle.run_pipeline(comments, "id", encoder="learnt", **SMALL)
    out["bundle"].save(str(tmp_path / "b"))
    again, first = scores_of(bundle.Bundle.load(spark, str(tmp_path / "b")).scores(comments, "id")), scores_of(out["scores"])
    assert {k: again[k] for k in first} == first
    words = spark.createDataFrame([(["a", "b", "a"],), (["c"],), ([],), (None,), (["a"],)], "words array<string>")
    model = bundle.WordVectors("words", "v", dim=4, minCount=1, vocabSize=2, numPartitions=1).fit(words)
    assert len(model.vocabulary) <= 2 and "a" in model.vocabulary
    rows = [r["v"].toArray() for r in model.transform(words).collect()]
    assert not rows[2].any() and not rows[3].any() and rows[0].any()
    assert np.allclose(rows[4], model.vectors[model.vocabulary.index("a")])


def test_small_tables_raise(comments):
    with pytest.raises(ValueError, match="at least 10"):
        bundle.run_pipeline(comments.limit(6), "id", **SMALL)
    with pytest.raises(ValueError, match="at least 10"):
        bundle.run_pipeline(comments.withColumn("text", F.lit("too short")), "id", **SMALL)
    with pytest.raises(ValueError, match="unknown"):
        bundle.TextCleaner(cleaner="none")


def test_stages_in_a_pipeline(spark, comments, tmp_path):
    """The stages are ordinary pipeline stages."""
    stages = [bundle.TextCleaner("text", "c", "basic"), bundle.HashedMeans("c", "f", 8), bundle.MultiLabel("trees", LABELS, "f", "p", maxIter=2)]
    model = Pipeline(stages=stages).fit(comments)
    model.write().overwrite().save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p"))
    assert loaded.transform(comments).select("id", "p").collect() == model.transform(comments).select("id", "p").collect()
    assert set(model.transform(comments).columns) == {*comments.columns, "c", "f", "p"}


def test_search(comments):
    rows = bundle.HashedMeans("text", "features", 8).transform(comments)
    space = models.SEARCH_SPACE | {"maxIter": (1, 3), "maxDepth": (1, 3)}
    best, report, model = bundle.search(rows, "id", LABELS, n_iter=3, folds=2, space=space)
    found = report.collect()
    assert [r["trial"] for r in found] == [0, 1, 2] and all(0 <= r["score"] <= 1 for r in found)
    top = max(found, key=lambda r: (r["score"], -r["trial"]))
    assert best == {k: top[k] for k in best} == models.draw_params(space, 3)[top["trial"]]
    assert model.getOrDefault("maxDepth") == best["maxDepth"] and model.transform(rows).filter("size(_p_trial) = 2").count() == 150


def test_attacked_scores(comments, fitted):
    fit = fitted["bundle"]
    attacked = bundle.attacked_scores(fit, comments, "id")
    per = {r["pattern"]: r["count"] for r in attacked.groupBy("pattern").count().collect()}
    assert per == {p: 150 * 6 for p in ["original", *lexicon.PATTERNS]}
    plain = scores_of(fit.scores(comments, "id"))
    assert scores_of(attacked.filter("pattern = 'original'")) == plain
    out = bundle.fitted_resilience(fit, attacked)
    ratio = {(r["model"], r["pattern"]): r for r in out["ratio"].collect()}
    assert len(ratio) == 33 and all(r["resilience"] == pytest.approx(1) and abs(r["loss"]) < 1e-9 for (_, p), r in ratio.items() if p == "original")
    assert ratio["linear", "case_variation"]["loss"] == pytest.approx(0) and ratio["linear", "leetspeak"]["loss"] > 0.1
    clean = {r["model"]: r["f1_macro"] for r in resilience.metric_record(fit.scores(comments, "id"), fit.thresholds).collect()}
    record = {r["model"]: r["f1_macro"] for r in out["record"].filter("pattern = 'original'").collect()}
    assert record == pytest.approx(clean)
