"""Curation against its steps by hand, and the adapter's ridge against plain numpy."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.operators import adapter, curation
from tidemill.operators import retrieval as r
from tidemill.plans import evaluation as plans
from tidemill.plans import fixtures

QUESTIONS = [
    (1, "How do I pay?", 1, "plain", 0.9), (2, "how do i PAY", 2, "plain", 0.8), (3, "how do I pay, pay", 1, "chat", 0.7),
    (4, "where is the office of the old town hall", 1, "plain", 0.6), (5, "is there the golden question of all", 2, "chat", 0.5), (6, "Golden question!", 2, "chat", 0.4),
    (7, "a b c", 3, "plain", 0.3), (8, "d e f", 3, "plain", 0.2), (9, "g h i", 3, "chat", 0.1), (10, "j k l", 3, "plain", 0.95), (11, "m n o", 4, "short", 0.5),
]


def test_curation_steps(spark):
    df = spark.createDataFrame(QUESTIONS, "query_id long, question string, chunk_id long, style string, score double")
    df = df.join(tx.hash_embed(df, "query_id", "question"), "query_id").repartition(3)
    golden = spark.createDataFrame([(1, "golden question"), (2, "is there a golden question of all the")], "item_id long, text string")
    ranks = df.select("query_id", F.when(F.col("query_id") == 4, 9).otherwise(2).alias("rank"))
    near = {(x.query_id, x.item_id): x.cosine for x in r.dense(df.select("query_id", F.col("embedding").alias("vector")), tx.hash_embed(golden, "item_id", "text"), "item_id").collect()}
    own = {x.query_id: np.array(x.embedding) for x in df.collect()}
    left = [q for q in QUESTIONS if q[0] != 2]
    distinct = [q for q in left if not (q[0] == 3 and own[1] @ own[3] >= curation.NEAR)]
    clean = [q for q in distinct if q[0] != 6 and max(near[q[0], 1], near[q[0], 2]) < curation.OVERLAP]
    back = [q for q in clean if q[0] != 4]
    kept, counts = curation.curate(df, golden, ranks, cap=2)
    want = {"raw": 11, "exact_duplicate": 10, "near_duplicate": len(distinct), "golden_overlap": len(clean), "round_trip": len(back)}
    assert counts == want | {"over_cap": kept.count()} and len(distinct) > len(clean) > len(back)
    assert {x.query_id for x in kept.where("chunk_id = 3").collect()} == {9, 10}  # styles take turns
    chunks = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 7, 8)], "chunk_id long")
    rows = {(x.section, x.name): x.n for x in curation.filter_report(df, golden, ranks, chunks, cap=2).collect()}
    per = [sum(x.chunk_id == c for x in kept.collect()) for c in (1, 2, 3, 4)]
    assert rows["raw", ""] - sum(n for (s, _), n in rows.items() if s == "dropped") == rows["kept", ""] == sum(per) == sum(n for (s, _), n in rows.items() if s == "kept_by_style")
    assert rows["chunks_without_questions", ""] == 2 + per.count(0) and rows["chunks_by_questions", "2"] == per.count(2)
    assert sum(n for (s, _), n in rows.items() if s == "split") == sum(per)


def test_report_of_all_conversations(spark, sf_dir):
    t = fixtures.Inputs(spark, sf_dir)
    questions, ranks, chunks = plans.generated(t)
    kept, counts = curation.curate(questions, t.benchmark, ranks)
    assert counts["raw"] == questions.count() and counts["over_cap"] == kept.count()
    keys = questions.select(tx.normalized_key(F.col("question")).alias("k")).distinct().count()
    assert counts["exact_duplicate"] == keys and list(counts.values()) == sorted(counts.values(), reverse=True)


def pairs(n=400, d=8):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, d))
    label = rng.integers(0, 20, n)
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    p = centres[label] + 0.3 * rng.normal(size=(n, d))
    return label, (centres[label] + 0.3 * rng.normal(size=(n, d))) @ turn, p


def test_fold_grams_and_ridges(spark):
    """Queries are turned against passages, so an adapter helps; folds' sums and ranks are those of numpy."""
    label, q, p = pairs()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(q.tolist(), p.tolist()))], "query_id long, q array<double>, p array<double>").repartition(4)
    fold = np.array([x.f for x in df.orderBy("query_id").select(adapter.fold_of("query_id").alias("f")).collect()])
    qq, qp = adapter.fold_grams(df)
    for f in range(adapter.FOLDS):
        assert np.allclose(qq[f], q[fold == f].T @ q[fold == f]) and np.allclose(qp[f], q[fold == f].T @ p[fold == f])
    n = len(q)
    vectors = spark.createDataFrame([(1_000 + i, v, int(c)) for i, (v, c) in enumerate(zip(p.tolist(), label))], "vec_id long, embedding array<double>, label int")
    queries = spark.createDataFrame([(i, v, int(c)) for i, (v, c) in enumerate(zip(q.tolist(), label))], "query_id long, vector array<double>, expected int")
    grid = (0.1, 1.0, 100.0)
    got = {x.ridge: (x.mrr, x.chosen) for x in adapter.ridge_report(df, queries, vectors, grid).collect()}
    units = p / np.linalg.norm(p, axis=1, keepdims=True)
    want = {}
    for ridge in (adapter.NONE, *grid):
        total = 0.0
        for i in range(n):
            rest = fold != fold[i]
            m = np.eye(q.shape[1]) if ridge == adapter.NONE else np.linalg.solve(q[rest].T @ q[rest] + ridge * np.eye(q.shape[1]), q[rest].T @ p[rest])
            v = q[i] @ m
            score = np.round(units @ (v / np.linalg.norm(v)), 9)
            rank = 1 + int((score > score[label == label[i]].max()).sum())
            total += 1 / rank if rank <= 10 else 0
        want[ridge] = round(total / n, 6)
    assert {k: v for k, (v, _) in got.items()} == want
    best = max(grid, key=lambda x: (want[x], -x))
    assert [k for k, (_, c) in got.items() if c] == [best] and want[best] > want[adapter.NONE]
    matrix = adapter.chosen_adapter(df, adapter.ridge_report(df, queries, vectors, grid))
    assert np.allclose(matrix, np.linalg.solve(q.T @ q + best * np.eye(8), q.T @ p))


def test_no_ridge_is_chosen_where_none_is_better(spark):
    label, _, p = pairs(200)
    rows = [(i, v, v[::-1]) for i, v in enumerate(p.tolist())]  # pairs that lead away
    df = spark.createDataFrame(rows, "query_id long, q array<double>, p array<double>")
    vectors = spark.createDataFrame([(i, v, int(c)) for i, (v, c) in enumerate(zip(p.tolist(), label))], "vec_id long, embedding array<double>, label int")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("expected"))
    report = adapter.ridge_report(df, queries, vectors, (1.0, 10.0))
    assert not report.where("chosen").count() and adapter.chosen_adapter(df, report) is None


def test_adapters_are_not_copied_for_each_query(spark, monkeypatch):
    """However many queries a batch has: a task holds vectors, not a matrix for each of them."""
    tasks, kind = [], type(spark.range(1))
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema: tasks.append(f) or self)
    queries = spark.createDataFrame([], "query_id long, fold int, vector array<double>")
    rng = np.random.default_rng(3)
    matrices, x, fold = rng.normal(size=(5, 2, 32, 32)), rng.normal(size=(2000, 32)), rng.integers(0, 5, 2000).astype(np.int32)
    adapter._adapted(queries, matrices, (adapter.NONE, 1.0))
    batch = pa.record_batch([pa.array(np.arange(2000)), pa.array(fold), pa.array(x.tolist())], ["query_id", "fold", "vector"])
    tracemalloc.start()
    out = list(tasks[0](iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * x.nbytes
    for part, want in zip(out, (x, np.einsum("nd,nde->ne", x, matrices[fold, 1])), strict=True):
        assert np.allclose(np.array(part.column("vector").to_pylist()), want)
