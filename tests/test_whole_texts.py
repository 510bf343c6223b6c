"""Queries over tokens read every token of every text."""

import numpy as np
from pyspark.sql import functions as F

from glyphmill.functions import nn
from glyphmill.operators import training as TR
from glyphmill.plans.queries import CONTEXT, QUERIES, long_ids

SF = "/root/testdata/sf0.001"


def test_language_model_scores_every_token(spark):
    n = {r.doc_id: r.n for r in long_ids(spark, SF).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    got = QUERIES["transformer_lm"][0](spark, SF).collect()
    place = [(r.doc_id, r["at"] + r.pos) for r in got]
    assert sorted(place) == sorted((d, i) for d, k in n.items() for i in range(k))
    assert {p for p, r in zip(place, got, strict=True) if r.loss is None} == {(d, k - 1) for d, k in n.items()}


def test_token_beyond_the_context_is_only_a_target(spark):
    weights = nn.random_weights(50, 32, 2, 64)
    ids = list(range(CONTEXT + 1))
    got = sorted(TR.logits(spark.createDataFrame([(0, ids)], "seq long, tokens array<int>"), weights, 2, 4, context=CONTEXT).collect())
    want = nn.language_model(np.array(ids[:CONTEXT]), weights, 2, 4, 10000.0)
    assert len(got) == CONTEXT and np.isclose(got[-1].loss, nn.cross_entropy(want[-1:], np.array([ids[-1]])))
