"""What passes over all pairs of queries and vectors give, and that they send on no pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import evaluation as e
from tidemill.operators import retrieval as r
from tidemill.plans import registry


@pytest.fixture
def small(spark, monkeypatch):
    """(queries, vectors, cosines by query and key) of vectors with equal ones among them, in several blocks and steps."""
    monkeypatch.setattr(r, "BLOCK", 7)
    monkeypatch.setattr(r, "CELLS", 64)
    x = np.random.default_rng(5).normal(size=(90, 4)).round(1)
    x[40:60] = x[:20]
    rows = [(i, v.tolist(), f"g{i % 3}") for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    queries = spark.createDataFrame([(i, v) for i, v, _ in rows if i % 5 == 0], "query_id long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosines = {(q, v): round(float(u[q] @ u[v]), 12) for q in range(0, 90, 5) for v in range(90) if q != v}
    return queries, vectors, cosines


def test_dense_pool_of_blocks(small):
    queries, vectors, cosines = small
    got = {(x.query_id, x.vec_id) for x in r.dense(queries, vectors, "vec_id", pool=6, apart=True).collect()}
    best = {q: sorted((-round(c, 9), v) for (p, v), c in cosines.items() if p == q)[:6] for q in range(0, 90, 5)}
    assert got == {(q, v) for q, own in best.items() for _, v in own}
    assert r.dense(queries, vectors, "vec_id", apart=True).count() == len(cosines)


def test_best_of_each_group(small):
    queries, vectors, cosines = small
    got = {(x.query_id, x.label): round(x.score, 9) for x in r.best_by(queries, vectors, "vec_id", "label").collect()}
    assert got == {(q, f"g{g}"): round(max(c for (p, v), c in cosines.items() if p == q and v % 3 == g), 9) for q in range(0, 90, 5) for g in range(3)}


def test_counts_over_a_bar(small, spark):
    queries, vectors, cosines = small
    bars = spark.createDataFrame([(q, 0.3 + q / 1000) for q in range(0, 90, 5)], "query_id long, bar double")
    got = {x.query_id: x.n for x in r.count_over(queries.join(bars, "query_id"), vectors, "vec_id").collect()}
    assert got == {q: sum(c > 0.3 + q / 1000 for (p, _), c in cosines.items() if p == q) for q in range(0, 90, 5)}


@pytest.mark.parametrize("name", ["best_by", "count_over", "dense"])
def test_what_is_sent_follows_the_queries(small, spark, monkeypatch, name):
    """More parts of vectors make no more tasks a block, and so no more figures a query."""
    queries, vectors, cosines = small
    monkeypatch.setattr(r, "TASKS", 2, raising=False)
    apart = vectors.repartition(30)
    call = {
        "best_by": lambda: r.best_by(queries, apart, "vec_id", "label"),
        "count_over": lambda: r.count_over(queries.selectExpr("*", "0.5D AS bar"), apart, "vec_id"),
        "dense": lambda: r.dense(queries, apart, "vec_id", pool=6),
    }
    sent, kind = [], type(vectors)
    for step in ("groupBy", "withColumn"):
        monkeypatch.setattr(kind, step, lambda self, *a, f=getattr(kind, step): sent.append(self) or f(self, *a))
    call[name]()
    blocks = -(-queries.count() // r.BLOCK)
    assert sent[0].rdd.getNumPartitions() <= blocks * max(r.TASKS, spark.sparkContext.defaultParallelism)


PAIRLESS = ["e2_chunk_mrr", "e4_confusion", "e4_routing_report", "e5_grouped_accuracy", "e8_regression_gate", "j7_scoring_join", "r14_route_nearest", "r15_off_topic", "e1_recall_mrr"]


@pytest.mark.parametrize("name", PAIRLESS)
def test_sends_on_no_pairs(spark, sf_dir, monkeypatch, name):
    dense = r.dense

    def pooled(*args, pool=None, **more):
        assert pool, "all pairs"
        return dense(*args, pool=pool, **more)

    monkeypatch.setattr(r, "dense", pooled)
    assert registry.queries()[name](spark, sf_dir).count()


def test_ridges_send_on_a_pool_a_query(spark, sf_dir, monkeypatch):
    """However many pieces a task has: what is sorted in one task for the ranks does not follow the pairs."""
    monkeypatch.setattr(r, "CELLS", 1 << 10)
    sent, kind = [], type(spark.range(1))
    monkeypatch.setattr(kind, "withColumn", lambda self, name, *a, f=kind.withColumn: (name == "rank" and "cosine" in self.columns and sent.append(self)) or f(self, name, *a))
    asked = 4 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 25 = 0").count()  # three ridges and none
    registry.queries()["r13_select_lambda"](spark, sf_dir)
    assert 0 < sent[0].count() <= 11 * asked * sent[0].rdd.getNumPartitions()


def test_gate_works_the_pairs_out_once(spark, sf_dir, monkeypatch):
    calls = []
    best_by = r.best_by
    monkeypatch.setattr(r, "best_by", lambda *args: calls.append(1) or best_by(*args))
    registry.queries()["e8_regression_gate"](spark, sf_dir).collect()
    assert len(calls) == 1


def test_report_counts_pairs(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("z", "a")], "expected string, predicted string")
    got = e.routing_report(pairs, ["a", "b"], "z", count=True).first()
    assert (round(got.accuracy, 6), got.stolen, got.macro_f1, got.n) == (0.333333, 1, 0.25, 3)


def test_fused_pool_is_that_of_all_pairs(small, spark):
    """Queries with many text hits, with few, with ties, without any, and with hits that have no vector."""
    queries, vectors, _ = small
    rng = np.random.default_rng(3)
    hits = [(q, int(v), float(rng.integers(-1, 6))) for q, n in ((0, 118), (5, 90), (10, 20), (15, 3), (20, 40)) for v in rng.permutation(120)[:n]]
    hits = spark.createDataFrame(hits, "query_id long, vec_id long, bm25 double")
    want = r.pool_of(r.rrf(r.dense(queries, vectors, "vec_id", apart=True), hits, "vec_id"), "vec_id", 5)

    def rows(df):
        return sorted((x.query_id, x.pool_rank, x.vec_id, round(x.fused, 12), x.bm25, x.cosine and round(x.cosine, 9)) for x in df.collect())

    got = r.fused_pool(queries, vectors, hits, "vec_id", 5)
    assert rows(got) == rows(want)


def test_fused_pool_counts_beyond_the_best(small, spark, monkeypatch):
    """With a smaller constant and pool, candidates lie far beyond the best of the other leg."""
    queries, vectors, _ = small
    monkeypatch.setattr(r, "RRF_K", 1)
    hits = spark.createDataFrame([(q, v, float((v * 37 + q) % 89 + 1)) for q in (0, 25, 50) for v in range(90)], "query_id long, vec_id long, bm25 double")
    want = r.pool_of(r.rrf(r.dense(queries, vectors, "vec_id", apart=True), hits, "vec_id"), "vec_id", 5)
    got = r.fused_pool(queries, vectors, hits, "vec_id", 5)
    columns = ["query_id", "vec_id", "pool_rank", "bm25"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_fused_pairs_are_all_pairs(small, spark):
    queries, vectors, _ = small
    hits = [(q, v, float((v * 7 + q) % 5 - 1)) for q in (0, 25, 50) for v in range(0, 120, 3)]
    hits = spark.createDataFrame(hits, "query_id long, vec_id long, bm25 double")
    want = r.rrf(r.dense(queries, vectors, "vec_id", apart=True), hits, "vec_id").select("query_id", "vec_id", "fused")
    got = r.fused_pairs(queries, vectors, hits, "vec_id")
    assert sorted((a, b, round(c, 12)) for a, b, c in got.collect()) == sorted((a, b, round(c, 12)) for a, b, c in want.collect())


@pytest.mark.parametrize("figures", [1, 200, 1 << 20])
def test_fused_pairs_keep_every_row(small, spark, monkeypatch, figures):
    """Keys and query ids that repeat, equal vectors, one that holds a NaN, and hits without a vector or a query; groups of one query, of two, and as many as there are."""
    monkeypatch.setattr(r, "FIGURES", figures, raising=False)
    queries, vectors, _ = small
    odd = [(3, [0.5, 0.1, -0.2, 0.3], "g"), (3, [0.1, 0.1, 0.1, -0.9], "g"), (25, [1.0, 2.0, 3.0, 4.0], "g"), (200, [float("nan"), 1.0, 1.0, 1.0], "g"), (201, None, "g")]
    vectors = vectors.unionByName(spark.createDataFrame(odd, vectors.schema))
    queries = queries.unionByName(spark.createDataFrame([(25, [0.3, 0.2, -0.4, 0.9]), (30, [0.1, 0.2, 0.3, 0.4]), (40, None)], queries.schema))
    hits = spark.createDataFrame([(q, v, float((v * 7 + q) % 5 - 1)) for q in (0, 25, 50, 999) for v in range(0, 220, 3)], "query_id long, vec_id long, bm25 double")
    want = r.rrf(r.dense(queries, vectors, "vec_id", apart=True), hits, "vec_id").select("query_id", "vec_id", "fused")
    got = r.fused_pairs(queries, vectors, hits, "vec_id")
    assert sorted((a, b, round(c, 12)) for a, b, c in got.collect()) == sorted((a, b, round(c, 12)) for a, b, c in want.collect())


def test_fused_pairs_without_hits_are_not_shuffled(spark):
    """Only the pairs of queries with text hits are; the others leave vector by vector, with all queries of a group."""
    x = np.random.default_rng(11).normal(size=(2_000, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    queries = vectors.where("vec_id < 80").selectExpr("vec_id AS query_id", "embedding AS vector")
    hits = spark.createDataFrame([(7, v, float(v)) for v in range(10, 50)], "query_id long, vec_id long, bm25 double")

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = shuffled()
    rows = r.fused_pairs(queries, vectors, hits, "vec_id").toPandas()
    assert len(rows) == 80 * 1_999 and shuffled() - before < len(rows)
    plain = rows[rows.query_id != 7].vec_id.to_numpy()
    assert (plain[1:] != plain[:-1]).sum() < len(plain) / 4


def test_cosines_of_ranks_are_rounded_once():
    scores = np.array([[0.1234567865000004, -0.1584539904997648], [np.nan, -np.inf], [1.0, -1.0]])
    assert r._places_of(scores).tolist() == [[-123456787, 1 - r.OWN, -1_000_000_000], [158453990, r.OWN, 1_000_000_000]]


def test_cosines_are_all_pairs(small):
    """In pieces of more than one step, with equal vectors, a zero and one that holds a NaN."""
    queries, vectors, _ = small
    odd = vectors.sparkSession.createDataFrame([(100, [0.0] * 4, "g"), (101, [float("nan"), 1.0, 1.0, 1.0], "g"), (102, None, "g")], vectors.schema)
    queries, vectors = queries.unionByName(odd.selectExpr("vec_id AS query_id", "embedding AS vector")), vectors.unionByName(odd)
    want = r.dense(queries, vectors, "vec_id", apart=True).withColumn("cosine", F.round("cosine", 6))
    rows = [sorted((x.query_id, x.vec_id, str(x.cosine)) for x in df.collect()) for df in (r.cosines(queries, vectors, "vec_id"), want)]
    assert rows[0] == rows[1] and len(rows[0]) == 20 * 92 - 20


def test_cosines_round_halves_away_from_zero(spark):
    halves = np.array([0.1234565, -0.1234565, 0.1234564999996, -4e-7, 5e-7, 1.0, -1.0, np.nan, -np.inf])
    assert r._half_up(halves, 6).tolist() == [123457, -123457, 123457, 0, 1, 1000000, -1000000, r.NAN, r.APART]


def test_all_pairs_leave_in_order(spark, sf_dir):
    """Equal cosines of a piece follow each other, so that columns of them are small."""
    out = [x.cosine for x in registry.queries()["r3_dense"](spark, sf_dir).collect()]  # one block, one piece
    assert len(out) > 1000 and out == sorted(out)
