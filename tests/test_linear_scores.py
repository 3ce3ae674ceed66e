"""The features behind linear_scores are hashed once: nothing of its plan runs them again."""

from __future__ import annotations

from tessera.plans import registry
from tests.conftest import SF_SMALL


def test_features_are_read_not_hashed_again(spark, sf_dir=SF_SMALL):
    out = registry.queries()["linear_scores"](spark, sf_dir)
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
