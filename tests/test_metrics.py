"""Metrics on small tables against brute force, and the invariants they keep."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from modengine.functions import lexicon
from modengine.operators import curves, metrics, resilience, sampling, tagging
from modengine.operators.ranking import ranked
from modengine.functions.rand import hash_hex

SCHEMA = "id int, model string, label string, y int, p double"


def make(seed=1, n=80):
    rng = random.Random(seed)
    rows = []
    for label in lexicon.LABELS:
        for i in range(n):
            y = rng.choice([-1, 0, 0, 1])
            if label == "threat":
                y = min(y, 0)
            p = 0.25 if label == "insult" else round(0.4 * max(y, 0) + 0.6 * rng.random(), 2)
            rows.append((i, "m", label, y, p))
    return rows


ROWS = make()


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def judged(label):
    return [(y, p) for _, _, l, y, p in ROWS if l == label and y >= 0]


def pr_points(label):
    data = judged(label)
    pos = sum(y for y, _ in data)
    for t in sorted({p for _, p in data}):
        tp = sum(y for y, p in data if p >= t)
        n = sum(1 for _, p in data if p >= t)
        yield t, tp / n, (tp / pos if pos else 1.0)


def brute_best(label):
    best = None
    for t, pr, re in pr_points(label):
        f1 = 2 * pr * re / (pr + re + 1e-8)
        if best is None or f1 > best[1]:
            best = (t, f1)
    return best[0]


def brute_auc(label):
    data = judged(label)
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    if not pos or not neg:
        return None
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_two_levels_equal_plain_window(scores):
    names = ["model", "label", "p", "pos", "neg", "tp", "fp", "n_pos", "n_neg"]
    plain = {tuple(r) for r in curves.curve_counts(scores, method="window").select(*names).collect()}
    for buckets in (2, 7, 128):
        two = curves.curve_counts(scores, buckets=buckets).select(*names).collect()
        assert {tuple(r) for r in two} == plain and len(two) == len(plain)


def test_curve_values(scores):
    counts = curves.curve_counts(scores)
    best = {r["label"]: r["threshold"] for r in curves.best_f1_point(counts).collect()}
    auc = {r["label"]: r["roc_auc"] for r in curves.roc_auc(counts).collect()}
    curve = {}
    for r in curves.pr_curve(counts).collect():
        curve.setdefault(r["label"], set()).add((r["threshold"], r["precision"], r["recall"]))
    for label in lexicon.LABELS:
        assert best[label] == brute_best(label)
        assert curve[label] == set(pr_points(label)) | {(None, 1.0, 0.0)}
        want = brute_auc(label)
        assert auc[label] is None if want is None else auc[label] == pytest.approx(want)


def test_constant_scores_and_single_class(scores):
    blended = {r["label"]: r["threshold"] for r in curves.blended_thresholds(curves.curve_counts(scores)).collect()}
    assert blended["insult"] == 0.9  # nothing beats predicting nothing: infinity, clipped
    assert blended["threat"] == 0.5  # one class
    scan = {r["label"]: r for r in curves.scan_threshold(curves.curve_counts(scores)).collect()}
    assert not scan["threat"]["two_classes"] and scan["threat"]["tn"] == 0  # all predicted positive
    macro = curves.roc_auc(curves.curve_counts(scores))
    assert curves.auc_macro(macro).first()["roc_auc_macro"] is None
    assert curves.auc_macro(macro, undefined="half").first()["roc_auc_macro"] > 0


def test_auc_of_reversed_scores(scores):
    auc = {r["label"]: r["roc_auc"] for r in curves.roc_auc(curves.curve_counts(scores)).collect()}
    flipped = scores.withColumn("p", 1 - F.col("p"))
    for r in curves.roc_auc(curves.curve_counts(flipped)).collect():
        if r["roc_auc"] is not None:
            assert r["roc_auc"] == pytest.approx(1 - auc[r["label"]])


def test_record_agrees_with_predictions(spark, scores):
    record = resilience.metric_record(scores, nested=True).first()
    thresholds = curves.blended_thresholds(curves.curve_counts(scores))
    preds = metrics.apply_thresholds(scores.filter("y >= 0"), thresholds)
    for r in metrics.confusion(preds).collect():
        m = record["per_label_metrics"][r["label"]]
        assert (m["true_positives"], m["false_positives"], m["false_negatives"], m["true_negatives"]) == (
            r["tp"], r["fp"], r["fn"], r["tn"])
    assert record["accuracy"] == metrics.subset_accuracy(preds).first()["accuracy"]
    mm = metrics.macro_micro(preds).first()
    assert record["f1_macro"] == pytest.approx(mm["f1_macro"]) and record["f1_micro"] == pytest.approx(mm["f1_micro"])


def test_record_follows_the_policy_for_undefined_aucs(spark):
    rows = [(i, "m", label, y, i / 10) for i in range(6) for label, y in (("toxic", i % 2), ("insult", 0))]
    df = spark.createDataFrame(rows, "id int, model string, label string, y int, p double")
    macro = {u: resilience.metric_record(df, undefined=u).first()["roc_auc_macro"] for u in ("null", "half", "skip")}
    assert macro["null"] is None and macro["half"] == pytest.approx((macro["skip"] + 0.5) / 2)


def test_set_totals_and_head(spark):
    rows = [(i, ["leetspeak", "clean", "unicode"][i % 3], int(i % 3 != 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, pattern string, is_toxic int")
    assert tuple(tagging.set_totals(df).first()) == (30, 20, 10, pytest.approx(2 / 3), 3)
    assert tuple(tagging.set_totals(df.limit(0)).first()) == (0, 0, 0, None, 0)
    assert [r["id"] for r in tagging.set_head(df, ["is_toxic", "id"], 3).collect()] == [1, 4, 7]


def test_partitioning_does_not_matter(scores):
    a = resilience.per_label_metrics(scores.repartition(1)).orderBy("label").collect()
    b = resilience.per_label_metrics(scores.repartition(13, "p")).orderBy("label").collect()
    assert a == b


def test_micro_equals_macro_for_equal_labels(spark):
    rows = [(i, "m", l, i % 2, float(i % 3 == 0)) for i in range(30) for l in ("a", "b")]
    preds = spark.createDataFrame(rows, SCHEMA).withColumn("pred", F.col("p").cast("int"))
    r = metrics.macro_micro(preds).first()
    assert r["f1_macro"] == pytest.approx(r["f1_micro"])


def test_unjudged_only_and_empty(spark):
    none = spark.createDataFrame([(1, "m", "toxic", -1, 0.5)], SCHEMA)
    assert curves.curve_counts(none).count() == 0
    assert resilience.metric_record(none).count() == 0


def test_null_group_keys_are_kept(spark):
    rows = [(1, "m", None, 1, 0.9), (2, "m", None, 0, 0.1), (3, "m", "toxic", 1, 0.2), (4, "m", "toxic", 0, 0.3)]
    auc = {r["label"]: r["roc_auc"] for r in curves.roc_auc(curves.curve_counts(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert auc == {None: 1.0, "toxic": 0.0}


def test_weighted_loss(spark):
    logits = spark.createDataFrame([("m", "a", 1, 2.0), ("m", "a", 0, -800.0)], "model string, label string, y int, x double")
    weights = spark.createDataFrame([("a", 3.0)], "label string, pos_weight double")
    loss = metrics.weighted_bce(logits, weights).first()["loss"]
    assert loss == pytest.approx(3 * math.log1p(math.exp(-2.0)) / 2)


# -- sampling ---------------------------------------------------------------------------

def labelled(spark, n=500):
    rows = spark.range(n)
    return rows.select("id", *[(F.col("id") % (7 + i) == 0).cast("int").alias(l) for i, l in enumerate(lexicon.LABELS)])


def test_rank_is_a_permutation(spark):
    got = ranked(labelled(spark), hash_hex("s", F.col("id")), ["id"], by=["toxic"]).groupBy("toxic").agg(
        F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("rank").alias("d"))
    assert all(r["lo"] == 0 and r["hi"] == r["n"] - 1 and r["d"] == r["n"] for r in got.collect())


def test_oversample_exact_and_layout_free(spark):
    df = labelled(spark)
    out = sampling.oversample(df, "id", n=40)
    assert out.count() == 500 + 3 * 40 and out.select("id", "copy").distinct().count() == out.count()
    for label in lexicon.RARE_LABELS:
        assert out.filter(F.col("copy").rlike(f"/{label}:[0-9]+$")).filter(F.col(label) == 0).count() == 0
    again = sampling.oversample(df.repartition(11), "id", n=40)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in again.collect()}
    assert sampling.oversample(df.filter("threat = 0"), "id", ["threat"], 5).count() == df.filter("threat = 0").count()


def test_draws_are_places_in_hash_order(spark):
    pool = labelled(spark, 300).select("id").cache()
    order = [r["id"] for r in pool.orderBy(F.md5(F.concat_ws(":", F.lit("s"), F.col("id").cast("string")))).collect()]
    seen = {}
    for prefix in (1, 2, 4):
        rows = sampling.draw_with_replacement(pool, ["id"], 700, "s", prefix=prefix).collect()
        seen[prefix] = {r["draw"]: r["id"] for r in rows}
        assert len(rows) == 700 and sorted(seen[prefix]) == list(range(700))
    assert seen[1] == seen[2] == seen[4] and len(set(seen[1].values())) > 200
    place = lambda d: int(int(hashlib.md5(f"s:{d}:draw".encode()).hexdigest()[:8], 16) / 2**32 * 300)
    assert all(order[place(d)] == i for d, i in seen[4].items())
    assert sampling.draw_with_replacement(pool.limit(0), ["id"], 10, "s").count() == 0


def test_folds_are_even(spark):
    sizes = sampling.stratified_folds(labelled(spark), "id").groupBy("label_set", "fold").count().collect()
    by_set = {}
    for r in sizes:
        by_set.setdefault(r["label_set"], [0, 0, 0])[r["fold"]] = r["count"]
    assert all(max(v) - min(v) <= 1 for v in by_set.values())


def test_shuffle_keeps_rows(spark):
    ids = [r["id"] for r in sampling.shuffled(spark.range(100), "id").collect()]
    assert sorted(ids) == list(range(100)) and ids != sorted(ids)


def test_lookups_move_no_row(spark, tmp_path):
    """Thresholds and weights reach a Parquet scan of scores without an exchange,
    with null as a key like others; a table beyond the bound is an error."""
    path = str(tmp_path / "scores")
    spark.createDataFrame(
        [(i, m, l, i % 2, i / 8) for i in range(8) for m in ("a", None) for l in ("x", "y")],
        "id int, model string, label string, y int, p double").write.parquet(path)
    scores = spark.read.parquet(path)
    table = scores.groupBy("model", "label").agg(F.avg("p").alias("threshold"))
    for thresholds in (table, {"x": 0.4375, "y": 0.4375}):
        preds = metrics.apply_thresholds(scores, thresholds)
        rows = preds.collect()
        assert len(rows) == 32 and all(r["pred"] == int(r["p"] > 0.4375) for r in rows)
        plan = preds._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
        assert "Exchange" not in plan and "Join" not in plan
    assert metrics.apply_thresholds(scores, {"x": 0.5}).filter("label = 'y' and pred is not null").count() == 0
    with pytest.raises(Exception, match="over 3 rows"):
        metrics.looked_up(scores, table, "threshold", max_rows=3).collect()
