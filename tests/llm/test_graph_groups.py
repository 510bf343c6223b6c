"""Groups of more near-equal vectors than a node has candidates, near one another."""

import numpy as np
import pytest

from glyphmill.llm import graph_dedup

from .helpers import duck, same_rows, write


def groups(rng, n_groups, size, dim=64):
    """Near-equal vectors around centres at a cosine of 0.97 with the first."""
    first = rng.normal(size=dim)
    first /= np.linalg.norm(first)
    out = []
    for g in range(n_groups):
        side = rng.normal(size=dim)
        side -= side @ first * first
        centre = first if g == 0 else 0.97 * first + (1 - 0.97**2) ** 0.5 * side / np.linalg.norm(side)
        out.append(centre + rng.normal(scale=1e-4, size=(size, dim)))
    return np.concatenate([*out, rng.normal(size=(30, dim))])


@pytest.mark.parametrize("cap", [12_000, 50])
def test_links_between_groups_beyond_the_candidates(spark, tmp_path, monkeypatch, cap):
    monkeypatch.setattr(graph_dedup, "CAP", cap)
    vectors = groups(np.random.default_rng(6), 3, 60)
    where = write(spark, tmp_path, embeddings=spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int"))
    same_rows(graph_dedup.op4_graph_dedup(spark, where), *duck(where, graph_dedup.ORACLE, "embeddings"))


def test_below_the_goal_all_are_compared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_dedup, "search", lambda q, v, *_: np.zeros(0, np.int64))
    monkeypatch.setattr(graph_dedup, "_audit", lambda *_: 0.0)
    vectors = groups(np.random.default_rng(7), 2, 20)
    where = write(spark, tmp_path, embeddings=spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int"))
    same_rows(graph_dedup.op4_graph_dedup(spark, where), *duck(where, graph_dedup.ORACLE, "embeddings"))
