"""Scores of neighbours don't depend on how rows are dealt, and rare dimensions are searched whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quaylog.llm import rp_forest


def test_cosines_are_the_same_in_any_block():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((37, 64)), rng.standard_normal((37, 64))
    whole = rp_forest.cosines(x, y)
    assert all(rp_forest.cosines(x[i : i + 1], y[i : i + 1])[0] == whole[i] for i in range(37))
    assert (rp_forest.cosines(y, x) == whole).all()


def test_rows_are_equal_however_dealt_and_rare_dimensions_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6 if i % 4 else 3).round(1).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def found(parts: int, block: int, share: float | None = None):
        monkeypatch.setattr(rp_forest, "BLOCK", block)
        return sorted(map(tuple, rp_forest.nearest(df.repartition(parts), F.col("vec_id") % 20 == 0, share=share).collect()))

    first = found(1, 8192)
    assert first == found(7, 16)
    # one forest only: the three-dimensional rows are compared with all of theirs
    monkeypatch.setattr(rp_forest, "FORESTS", 1)
    got = [r for r in found(3, 64) if r[0] % 4 == 0]
    want = []
    three = [(i, np.array(v)) for i, v in rows if len(v) == 3 and any(v)]
    for q, v in three:
        if q % 20 == 0:
            scored = sorted((-float(rp_forest.cosines(rp_forest.scaled(v[None]), rp_forest.scaled(w[None]))[0]), i) for i, w in three if i != q)
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:5], 1)]
    assert got == sorted(want)
