"""Rounds over cells against the greedy pass."""

from __future__ import annotations

import numpy as np
import pytest

from tidemill.operators import neardup


def rows(n=2_000, d=12):
    """Chains and clusters of near vectors, copies, two groups of which one is large."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n // 8, d))[rng.integers(0, n // 8, n)] + 0.12 * rng.normal(size=(n, d))
    angle = np.arange(60) * 0.25  # each near to the next only
    x[100:160] = 0
    x[100:160, 0], x[100:160, 1] = np.cos(angle), np.sin(angle)
    x[300:340] = x[7]
    group = np.where(rng.random(n) < 0.8, 1, 2)
    group[100:160] = 1
    return [(i, int(g), v) for i, (g, v) in enumerate(zip(group, x.tolist()))] + [(n, 1, None), (n + 1, None, x[5].tolist()), (n + 2, None, (2 * x[5]).tolist())]


def greedy(data, cosine):
    kept: dict = {}
    out = []
    for k, g, v in data:
        if v is not None:
            u = np.array(v) / np.linalg.norm(v)
            if any(round(float(u @ w), 12) >= cosine for w in kept.setdefault(g, [])):
                continue
            kept[g].append(u)
        out.append((k, g))
    return sorted(out, key=str)


@pytest.mark.parametrize(("cell", "block"), [(neardup.CELL, neardup.BLOCK), (150, 40)])
def test_equals_the_greedy_order(spark, monkeypatch, cell, block):
    """In one cell a group, and in many cells and blocks."""
    monkeypatch.setattr(neardup, "CELL", cell)
    monkeypatch.setattr(neardup, "BLOCK", block)
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").repartition(3)
    got = neardup.dedup_near(df, "label", 0.95).collect()
    want = greedy(data, 0.95)
    assert sorted(((r.vec_id, r.label) for r in got), key=str) == want and len(want) < 1_200
    assert neardup.dedup_near(df.where("false"), "label").count() == 0


def test_tables_follow_the_size():
    assert neardup.tables_for(1_999, 0.95) == (0, 1)
    for n in (10_000, 1_000_000, 100_000_000):
        bits, tables = neardup.tables_for(n, 0.95)
        assert n / 2**bits <= neardup.CELL and tables < 300
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= neardup.MISSED
