"""The query adapter's ridge, chosen by folds of the training pairs from sums that one pass makes.

Sums of products (Gram matrices) add up, so those of the pairs outside a fold are the total less the fold's: every fold
and every ridge is solved from one aggregation, d * d numbers a fold, and pairs are read once whatever the grid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidemill.operators import retrieval as r
from tidemill.operators.search import stored

FOLDS = 5
#: The ridge that stands for no adapter in reports.
NONE = -1.0


def fold_of(key: Column | str, folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")


def fold_grams(pairs: DataFrame, folds: int = FOLDS, key: str = "query_id", q: str = "q", p: str = "p") -> tuple[np.ndarray, np.ndarray]:
    """(Q'Q, Q'P) of each fold of pairs (key, q, p), of shape (folds, d, d); only these reach the driver."""
    rows = pairs.select(fold_of(key, folds).alias("fold"), F.col(q).cast("array<double>").alias("q"), F.col(p).cast("array<double>").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for c in (1, 2))
            for f in np.unique(fold).tolist():
                a, b = x[fold == f], y[fold == f]
                own = sums.setdefault(f, [np.zeros((x.shape[1], x.shape[1])), np.zeros((x.shape[1], y.shape[1]))])
                own[0] += a.T @ a
                own[1] += a.T @ b
        for f, (qq, qp) in sums.items():
            i, j = (g.ravel() for g in np.indices(qq.shape))
            yield pa.record_batch([pa.array(np.full(len(i), f, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(qq.ravel()), pa.array(qp.ravel())], ["fold", "i", "j", "qq", "qp"])

    summed = rows.mapInArrow(run, "fold int, i int, j int, qq double, qp double").groupBy("fold", "i", "j").agg(F.sum("qq").alias("qq"), F.sum("qp").alias("qp"))
    cells = summed.toPandas()
    d = int(cells["i"].max()) + 1 if len(cells) else 0
    out = np.zeros((2, folds, d, d))
    out[:, cells["fold"], cells["i"], cells["j"]] = cells["qq"], cells["qp"]
    return out[0], out[1]


def solved(qq: np.ndarray, qp: np.ndarray, ridge: float) -> np.ndarray:
    return np.linalg.solve(qq + ridge * np.eye(len(qq)), qp)


def _by_fold(x: np.ndarray, fold: np.ndarray, matrices: np.ndarray) -> np.ndarray:
    """Each row of x times the matrix of its fold; no matrix is copied for a row."""
    out = np.empty((len(x), matrices.shape[2]))
    for f in np.unique(fold).tolist():
        out[fold == f] = x[fold == f] @ matrices[f]
    return out


def _adapted(queries: DataFrame, matrices: np.ndarray, ridges: Sequence[float]) -> DataFrame:
    """queries once for each ridge, with the vector as the adapter of the query's own fold makes it; matrices: (fold, ridge, d, d)."""
    sent = queries.sparkSession.sparkContext.broadcast(matrices)
    plain = queries.select("query_id", "fold", F.col("vector").cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            fold = batch.column(1).to_numpy(zero_copy_only=False)
            for k, ridge in enumerate(ridges):
                y = x if ridge == NONE else _by_fold(x, fold, sent.value[:, k])
                ends = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
                yield pa.record_batch([pa.array(np.full(len(batch), ridge)), batch.column(0), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["ridge", "of", "vector"])

    schema = T.StructType([T.StructField("ridge", T.DoubleType()), T.StructField("of", queries.schema["query_id"].dataType), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return plain.mapInArrow(run, schema)


def ridge_report(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, grid: Sequence[float], k: int = 10, folds: int = FOLDS) -> DataFrame:
    """(ridge, mrr, chosen): mean reciprocal rank within k of each ridge, and of none, over queries of folds not fitted on.

    pairs (query_id, q, p); queries (query_id, vector, expected); vectors (vec_id, embedding, label), of which those of the
    expected label, the query's own apart, are right. The ridge with the best figure is chosen, the smaller one of
    equal ones, but none if no one is better than no adapter: a worse adapter is not to be used. A query's rank is one
    more than the number of vectors that score higher than its best right one.
    """
    qq, qp = fold_grams(pairs, folds)
    ridges = [NONE, *sorted(set(grid))]
    d = qq.shape[1]
    matrices = np.array([[np.eye(d) if x == NONE else solved(qq.sum(0) - qq[f], qp.sum(0) - qp[f], x) for x in ridges] for f in range(folds)])
    asked = stored(_adapted(queries.withColumn("fold", fold_of("query_id", folds)), matrices, ridges).withColumn("query_id", F.concat_ws("/", F.col("ridge").cast("string"), F.col("of").cast("string"))))
    near = r.dense(asked, vectors, "vec_id", pool=k + 1).join(asked.select("query_id", "ridge", "of"), "query_id").where(F.col("vec_id") != F.col("of"))
    right = near.join(queries.select(F.col("query_id").alias("of"), "expected"), "of").join(vectors.select("vec_id", "label"), "vec_id")
    score = F.round("cosine", 9)
    mine = F.max(F.when(F.col("label") == F.col("expected"), score)).over(W.partitionBy("ridge", "of"))
    ranks = right.withColumn("mine", mine).where("mine IS NOT NULL").groupBy("ridge", "of").agg((F.count_if(score > F.col("mine")) + 1).alias("rank")).where(F.col("rank") <= k)
    n = queries.count()
    gained = ranks.groupBy("ridge").agg((F.sum(1 / F.col("rank")) / n).alias("mrr"))
    all_ = queries.sparkSession.createDataFrame([(float(x),) for x in ridges], "ridge double").join(gained, "ridge", "left").select("ridge", F.round(F.coalesce("mrr", F.lit(0.0)), 6).alias("mrr"))
    none = F.max(F.when(F.col("ridge") == NONE, F.col("mrr"))).over(W.partitionBy())
    best = F.first("ridge").over(W.partitionBy().orderBy(F.desc("mrr"), "ridge"))
    return all_.withColumn("chosen", (F.col("ridge") == best) & (F.col("mrr") > none))  # a row for each ridge


def chosen_adapter(pairs: DataFrame, report: DataFrame) -> list[list[float]] | None:
    """The adapter of all pairs with the chosen ridge; None if the report refuses all."""
    row = report.where("chosen").first()
    return None if row is None else r.fit_query_adapter(pairs, row["ridge"])
