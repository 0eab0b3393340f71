"""Every query against its SQL, on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracle
from modengine.plans import inputs, registry

DATA = f"{oracle.DATA}/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert not [n for n in registry.QUERIES if "pipeline" in n]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["has_identity", "n_rows", "n_toxic", "n_judged", "mean_tokens"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    assert oracle.compare(spark, DATA, QUERIES[name], ORACLES[name]) is None


def test_embeddings_have_no_nulls(spark):
    rows = QUERIES["embed_docs"](spark, DATA).collect()
    assert len(rows) == 200
    assert all(len(r["features"]) == 64 and all(v is not None and 0 <= v <= 1 for v in r["features"]) for r in rows)
    assert all(sum(r["features"]) == pytest.approx(1, abs=1e-4) or sum(r["features"]) == 0 for r in rows)


def test_scores_are_probabilities(spark):
    for name in ("gbt_scores", "lr_scores"):
        df = QUERIES[name](spark, DATA)
        assert df.columns == ["id", "model", "label", "y", "p"]
        assert df.filter("p < 0 or p > 1 or p is null").count() == 0
        assert df.groupBy("id").count().filter("count <> 6").count() == 0


def test_no_rule_goes_untested(spark):
    """Every keyword label, obfuscation flag and class of the attack set occurs."""
    for name in ("weak_labels", "obfuscation_flags"):
        df = QUERIES[name](spark, DATA)
        found = df.agg(*[F.max(c).alias(c) for c in df.columns if c not in ("doc_id", "text", "clean")]).first().asDict()
        assert found and all(found.values()), (name, found)
    drawn = QUERIES["attack_set_draws"](spark, DATA).groupBy("class").count().collect()
    assert {r["count"] for r in drawn} == {71} and len(drawn) == 7
    changed = QUERIES["ob_unicode"](spark, DATA).join(inputs.comments(spark, DATA), "doc_id").filter("attacked <> text").count()
    assert changed > 0
