"""Cells of vectors against a full scan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from clausemill.operators import cells as ce
from clausemill.operators import index as ix


def test_cells_are_a_full_scan_and_skip(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.15 * rng.normal(size=(80, 16)) for c in centres] + [rng.normal(size=(40, 16))])
    x = np.concatenate([x, x[:5]])  # copies: ties go by document and order
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(f"d{k % 3}", k, [float(y) for y in v]) for k, v in enumerate(x)] + [("d0", 9999, None)], "stem string, ord long, vector array<double>")
    cells = ce.build(rows)
    assert cells.vectors.count() == len(x) and cells.centres.count() == 31
    share = []
    for at in (0, 200, 970):
        query = [float(y) for y in x[at]]
        for k in (1, 6):
            want = ix.top_hits(None, ix.dense_scores(rows.filter("vector IS NOT NULL"), F.array(*map(F.lit, query))), k).collect()
            assert ix.top_hits(None, ce.top_scores(cells, query, k), k).collect() == want
            p = ce.plan(cells, query, k)
            share.append(p.read / p.of)
    assert min(share) < 0.2


def test_no_vectors(spark):
    cells = ce.build(spark.createDataFrame([("d", 1, None)], "stem string, ord long, vector array<double>"))
    assert ce.top_scores(cells, [1.0, 0.0], 3).collect() == []
