"""Scores do not move with the ratio of labels in the bounded sample."""

import random

import numpy as np

from glyphmill.llm import quality, toxicity

from .helpers import prose


def test_scores_keep_the_ratio_of_the_table(spark, monkeypatch):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, 30)) for i in range(3000)], "doc_id long, text string")  # texts tell nothing
    labels = spark.createDataFrame([(i, int(i % 10 > 0), int(i % 10 == 0)) for i in range(3000)], "doc_id long, quality int, toxic int")
    for op, rare in ((toxicity, 0.1), (quality, 0.9)):
        monkeypatch.setattr(op, "FIT_ROWS", 150)
        got = np.mean([r.score for r in op.score(docs, op.fit(docs, labels)).collect()])
        assert abs(got - rare) < 0.06, (op.__name__, got)
