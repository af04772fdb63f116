"""A table of anchors against plain cosines: blocks of both sides, odd vectors, no anchors."""

import math

import numpy as np
import pytest

from scholia.operators import semantic

DDL = "doc_id long, embedding array<float>, literal boolean"


def test_many_anchors_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    sides, anchors = rng.standard_normal((300, 8)).astype(np.float32), rng.standard_normal((10_000, 8)).astype(np.float32)
    rows = [(k % 7, v.tolist(), k % 11 == 0) for k, v in enumerate(sides)]
    monkeypatch.setattr(semantic, "ROWS", 100)
    got = {r.doc_id: (r.best, r.hits) for r in semantic.anchored_hits(spark.createDataFrame(rows, DDL), spark.createDataFrame([(v.tolist(),) for v in anchors], "embedding array<float>"), 0.97, 9).collect()}
    unit = lambda x: x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    sims = (unit(sides) @ unit(anchors).T).max(axis=1)
    for d in range(7):
        own = [sims[k] for k in range(300) if k % 7 == d and k % 11]
        assert got[d] == (pytest.approx(max(own), abs=1e-6), min(9, sum(s >= 0.97 for s in own)))


def test_odd_vectors(spark):
    """Null, empty, zero, null and non-finite components are near to nothing; lengths don't mix; no anchors, no hits."""
    sides = [(1, [1.0, 0.0], False), (2, None, False), (3, [], False), (4, [0.0, 0.0], False), (5, [1.0, None], False), (6, [math.inf, 1.0], False), (7, [0.0, 2.0, 0.0], False), (8, [3.0, 3.0], True), (9, [1.0, 1.0], False)]
    anchors = spark.createDataFrame([([2.0, 0.0],), (None,), ([0.0, 0.0],), ([math.nan, 1.0],), ([0.0, 5.0, 0.0],), ([],)], "embedding array<float>")
    rows = spark.createDataFrame(sides, DDL)
    got = {r.doc_id: (r.best, r.hits) for r in semantic.anchored_hits(rows, anchors, 0.7).collect()}
    assert got == {1: (1.0, 1), **{k: (None, 0) for k in (2, 3, 4, 5, 6)}, 7: (1.0, 1), 9: (round(math.sqrt(0.5), 6), 1)}
    assert {(r.best, r.hits) for r in semantic.anchored_hits(rows, anchors.limit(0), 0.7).collect()} == {(None, 0)}
    assert semantic.anchored_hits(rows.limit(0), anchors, 0.7).count() == 0
