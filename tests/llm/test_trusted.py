"""Operator 1's target is all trusted documents, and its threshold an exact quantile of their scores."""

import numpy as np
import pytest

from sonoglyph.llm import quality_rules as Q


def test_every_trusted_document_counts(spark):
    labels = spark.range(60_000).selectExpr("id doc_id", "1 quality", "0 toxic")
    assert Q.trusted_ids(labels.union(labels)).count() == 60_000


@pytest.mark.parametrize("part", [0.0, 0.005, 0.37, 1.0])
def test_quantile(spark, part):
    values = np.random.default_rng(1).integers(-40, 40, 701) / 7
    scores = spark.createDataFrame([(float(v),) for v in values], "score double").repartition(5)
    assert Q._quantile(scores, part) == pytest.approx(np.quantile(values, part), abs=1e-12)
    assert Q._quantile(scores.where("false"), part) is None
