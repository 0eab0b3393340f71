"""The pipeline on the smallest tables: stage by stage what each promises."""

from __future__ import annotations

import corpus_pipeline
import pytest
from modengine.llm import quality_classifier

from .conftest import DATA, EDGE_SCHEMA, edge_rows


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if number < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        seen.append(docs)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rest = seen[0].join(labels, "doc_id")
    assert rest.filter("quality = 1").count() >= 0.9 * labels.filter("quality = 1").count()
    assert rest.filter("quality = 0").count() <= 0.3 * labels.filter("quality = 0").count()
    assert seen[1].count() == seen[0].count() and seen[1].filter("n_chars <> length(text)").count() == 0
    assert seen[2].count() < seen[1].count() and seen[2].groupBy("doc_id").count().filter("count > 1").count() == 0
    assert seen[4].select("doc_id").distinct().count() == seen[3].select("doc_id").distinct().count()
    assert seen[4].groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_edges(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    edges = spark.createDataFrame(edge_rows(), EDGE_SCHEMA).select(*columns)
    edges.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 0, 0), (10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@pytest.fixture
def many_files(spark):
    """Tables are written and scanned in many parts, as on large clusters."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "64k", "spark.sql.files.maxPartitionBytes": "64k"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_steps_of_a_fit_cost_the_driver_one_stage(spark, many_files, monkeypatch):
    tracker = spark.sparkContext.statusTracker()

    def run():
        seen = set(tracker.getJobIdsForGroup(None))
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
        kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, DATA).select("doc_id").collect()}
        jobs = [[tracker.getStageInfo(s) for s in tracker.getJobInfo(j).stageIds] for j in set(tracker.getJobIdsForGroup(None)) - seen]
        fits = [stages for stages in jobs if any(s and "RDDLossFunction" in s.name for s in stages)]
        return kept, fits, len(jobs) - len(fits)

    kept, fits, others = run()
    assert fits and {len(stages) for stages in fits} == {1}
    assert others <= 70
    # More rows than one task takes: several tasks, the same documents.
    monkeypatch.setattr(quality_classifier, "FIT_ROWS", 20)
    again, fits, _ = run()
    assert again == kept and max(s.numTasks for stages in fits for s in stages if s) > 1


def test_the_plan_that_moves_the_texts_reads_how_often(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = corpus_pipeline.mixture(spark, docs, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Window" not in plan
