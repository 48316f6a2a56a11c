"""Approximate nearest neighbours by inner product on robust-pruned graphs.

Distinct vectors are dealt by a hash to shards of about SHARD_NODES, whatever their number; each shard builds one
directed graph, which is written as a table, a row for each node. Then every query visits every shard: a task reads one
shard's nodes and after them the queries, a batch at a time, answers each by beam search, and the answers are merged.
So a task holds one graph and one batch of queries. A graph is built in batches: greedy searches from the medoid propose
neighbours, and robust pruning keeps an edge only where no kept neighbour is closer by the factor ALPHA, so that
edges point in different directions; edges are then added backwards and pruned again where there are too many.

Largest inner product is smallest distance once each vector has one more component that gives all the same
length, which is how the graph measures. The scores returned are of the original vectors in double precision.
Rows with equal vectors share one node, which keeps as many of their smallest ids as an answer can hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemill.llm.common import cut, table

#: Edges of a node, and how much closer another neighbour must be for an edge to go.
DEGREE, ALPHA = 24, 1.2
#: Nodes that a search keeps while building, and while answering.
BUILD_BEAM, BEAM = 40, 96
#: Nodes that are inserted, and queries that are answered, together.
BATCH = 512
#: Nodes of one shard, about.
SHARD_NODES = 5_000


def _distances(a: np.ndarray, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each row of a to its own row of ids; missing ids (-1) are infinitely far."""
    near = points[np.maximum(ids, 0)]
    d = np.einsum("bkd,bkd->bk", near, near) - 2 * np.einsum("bd,bkd->bk", a, near)
    return np.where(ids < 0, np.inf, d)


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the best nodes found for each query, nearest first; -1 where fewer were met."""
    n = len(queries)
    ids = np.full((n, beam), -1, np.int64)
    ids[:, 0] = start
    far = _distances(queries, points, ids)
    done = np.zeros((n, beam), bool)
    live = np.arange(n)
    while len(live):
        open_ = ~done[live] & (ids[live] >= 0)
        any_open = open_.any(1)
        live, open_ = live[any_open], open_[any_open]
        if not len(live):
            break
        first = open_.argmax(1)
        done[live, first] = True
        new = graph[ids[live, first]]
        d = _distances(queries[live], points, new)
        every = np.hstack([ids[live], new])
        dist = np.hstack([far[live], d])
        flag = np.hstack([done[live], np.zeros(new.shape, bool)])
        order = np.lexsort((~flag, every), axis=1)  # of equal ids the one already done stays
        sorted_ids = np.take_along_axis(every, order, 1)
        again = np.zeros(every.shape, bool)
        again[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
        dist = np.where(again, np.inf, np.take_along_axis(dist, order, 1))
        flag = np.take_along_axis(flag, order, 1)
        best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        far[live] = np.take_along_axis(dist, best, 1)
        ids[live] = np.where(np.isinf(far[live]), -1, np.take_along_axis(sorted_ids, best, 1))
        done[live] = np.take_along_axis(flag, best, 1)
    return ids, far


def robust_prune(points: np.ndarray, own: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Up to DEGREE neighbours of each node of ``own`` from its row of ``pool`` (-1: none), diverse and near."""
    near = points[np.maximum(pool, 0)]
    gap = ((near - points[own][:, None]) ** 2).sum(2)
    gap[(pool < 0) | (pool == own[:, None])] = np.inf
    order = np.argsort(gap, axis=1, kind="stable")
    pool, gap, near = np.take_along_axis(pool, order, 1), np.take_along_axis(gap, order, 1), np.take_along_axis(near, order[:, :, None], 1)
    out = np.full((len(own), DEGREE), -1, np.int64)
    count = np.zeros(len(own), np.int64)
    gone = np.isinf(gap)
    gone[:, 1:] |= pool[:, 1:] == pool[:, :-1]
    for k in range(pool.shape[1]):
        take = np.flatnonzero(~gone[:, k] & (count < DEGREE))
        if not len(take):
            continue
        out[take, count[take]] = pool[take, k]
        count[take] += 1
        between = ((near[take, k + 1 :] - near[take, k][:, None]) ** 2).sum(2)
        gone[take, k + 1 :] |= ALPHA * between <= gap[take, k + 1 :]
    return out


def build(points: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """(graph, start): DEGREE edges of each point, -1 where there are fewer, and where searches begin."""
    n, rng = len(points), np.random.default_rng(seed)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, DEGREE), -1, np.int64)
    order = np.r_[start, rng.permutation(np.delete(np.arange(n), start))]
    at, size = 1, 1
    while at < n:
        new = order[at : at + size]
        found, _ = beam_search(points, graph, start, points[new], BUILD_BEAM)
        among = np.full((len(new), min(len(new) - 1, 32)), -1, np.int64)  # the batch sees some of itself too
        if among.shape[1]:
            among[:] = new[rng.integers(0, len(new), among.shape)]
        graph[new] = robust_prune(points, new, np.hstack([found, among]))
        _backwards(points, graph, new)
        at += len(new)
        size = min(BATCH, at)
    for at in range(0, n, BATCH):  # a second pass, now that every point is there
        new = order[at : at + BATCH]
        found, _ = beam_search(points, graph, start, points[new], BUILD_BEAM)
        graph[new] = robust_prune(points, new, np.hstack([found, graph[new]]))
        _backwards(points, graph, new)
    return graph, start


def _backwards(points: np.ndarray, graph: np.ndarray, new: np.ndarray) -> None:
    """Adds the edge back from each neighbour of the new nodes, and prunes where that is too many."""
    heads, tails = np.repeat(new, DEGREE), graph[new].ravel()
    keep = tails >= 0
    heads, tails = heads[keep], tails[keep]
    order = np.argsort(tails, kind="stable")
    heads, tails = heads[order], tails[order]
    nodes, starts, counts = np.unique(tails, return_index=True, return_counts=True)
    width = min(int(counts.max(initial=0)), 4 * DEGREE)
    for part in range(0, int(counts.max(initial=0)), max(1, width)):
        has = counts > part
        take = np.minimum(counts[has] - part, width)
        back = np.full((has.sum(), width), -1, np.int64)
        row = np.repeat(np.arange(len(take)), take)
        column = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        back[row, column] = heads[np.repeat(starts[has] + part, take) + column]
        graph[nodes[has]] = robust_prune(points, nodes[has], np.hstack([graph[nodes[has]], back]))


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def graphs(nodes: DataFrame) -> DataFrame:
    """(shard, dim, v, edges, begins, ids) of nodes (shard, dim, v, ids): the node's edges, by places in the shard.

    Rows come in the order of these places; searches begin at the node that ``begins``.
    """
    kind = nodes.schema["ids"].dataType.simpleString()

    def built(group: pa.Table) -> pa.Table:
        vectors = np.stack(group["v"].to_numpy())
        order = np.lexsort(vectors.T[::-1])
        vectors = vectors[order]
        graph, start = build(_lifted(vectors)[0])
        own = group.take(pa.array(order)).select(["shard", "dim", "v", "ids"])
        own = own.append_column("place", pa.array(np.arange(len(order)), pa.int32()))
        own = own.append_column("begins", pa.array(np.arange(len(order)) == start))
        return own.append_column("edges", pa.array(list(graph.astype(np.int32)), pa.list_(pa.int32())))

    schema = f"shard int, dim int, v array<double>, ids {kind}, place int, begins boolean, edges array<int>"
    return nodes.groupBy("shard", "dim").applyInArrow(built, schema)


def _lifted(exact: np.ndarray) -> tuple[np.ndarray, float]:
    """Points of equal length by one more component, and that length squared."""
    lengths = (exact**2).sum(1)
    return np.hstack([exact, np.sqrt(np.maximum(lengths.max() - lengths, 0))[:, None]]).astype(np.float32), lengths.max()


class Shard:
    """A graph to search, from its nodes' rows."""

    def __init__(self, rows: pa.Table, dim: int) -> None:
        rows = rows.sort_by("place").combine_chunks()
        self.exact = rows["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        self.points = _lifted(self.exact)[0]
        self.graph = rows["edges"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1).astype(np.int64)
        self.start = int(np.flatnonzero(rows["begins"].to_numpy())[0])
        ids = rows["ids"].combine_chunks()
        self.ids, self.counts = ids.flatten(), ids.value_lengths().to_numpy()
        self.begins = np.cumsum(self.counts) - self.counts

    def nearest(self, asked: pa.Table, k: int, beam: int) -> pa.RecordBatch:
        """(query_id, vec_id, score) of the k + 1 best nodes of each query, all their ids but the query's own."""
        q = asked["v"].combine_chunks().flatten().to_numpy().reshape(len(asked), -1)
        wide = np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32)
        found, _ = beam_search(self.points, self.graph, self.start, wide, min(max(beam, k + 1), len(self.points)))
        scores = np.where(found < 0, -np.inf, np.einsum("bd,bkd->bk", q, self.exact[np.maximum(found, 0)]))
        best = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
        node, score = np.take_along_axis(found, best, 1), np.take_along_axis(scores, best, 1)
        row, at = np.nonzero(node >= 0)
        node, score = node[row, at], score[row, at]
        times = self.counts[node]
        ends = np.cumsum(times)
        place = np.repeat(self.begins[node] - ends + times, times) + np.arange(ends[-1] if len(ends) else 0)
        made = pa.table([asked["query_id"].combine_chunks().take(pa.array(np.repeat(row, times))), self.ids.take(pa.array(place)), pa.array(np.repeat(score, times))], ["query_id", "vec_id", "score"])
        return made.filter(pc.not_equal(made["query_id"], made["vec_id"]))


def search(
    vectors: DataFrame, k: int = 20, queries: Column | None = None, key: str = "vec_id", vector: str = "embedding", beam: int = BEAM
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, by largest inner product.

    Queries are the rows where ``queries`` holds (every 20th key if not given); candidates are all rows but those with
    the query's key. Ties go to the smaller key. Vectors that are not usable and rows with a null key take no part;
    vectors meet only those of the same length, however long. Repeated rows count once. With fewer candidates than k,
    all are returned; an empty table gives an empty one. Other columns are left out, so their names don't matter.
    """
    good = usable(F.col(vector)) & F.col(key).isNotNull()
    known = vectors.where(good).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = F.pmod(F.col(key), F.lit(20)) == 0 if queries is None else queries
    asking = vectors.where(good & asked).select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    by_vector = W.partitionBy("v").orderBy("id")
    few = known.distinct().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    nodes = cut(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    count = max(1, math.ceil(nodes.count() / SHARD_NODES))
    shard = F.pmod(F.xxhash64("v"), F.lit(count)).cast("int").alias("shard")
    base = cut(graphs(nodes.select(shard, F.size("v").alias("dim"), "v", "ids")))
    shards = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("shard")
    sent = asking.dropDuplicates(["query_id", "v"]).select(shards, F.size("v").alias("dim"), "query_id", "v")
    kind = known.schema["id"].dataType.simpleString()
    parts = base.unionByName(sent, allowMissingColumns=True).withColumn("query", F.col("place").isNull())
    placed = parts.repartition("shard", "dim").sortWithinPartitions("shard", "dim", "query")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, graph = None, [], None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            where = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("shard", "dim", "query")], 1)
            starts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(1)])
            for begin, end in zip(starts, np.r_[starts[1:], len(rows)]):
                own, query = tuple(where[begin, :2]), bool(where[begin, 2])
                if own != last:
                    last, held, graph = own, [], None
                if not query:
                    held.append(rows.slice(begin, end - begin))
                    continue
                if held:
                    graph, held = Shard(pa.concat_tables(held), int(own[1])), []
                for at in range(begin, end if graph else begin, BATCH):
                    yield from graph.nearest(rows.slice(at, min(BATCH, end - at)), k, beam).to_batches()

    found = placed.mapInArrow(answer, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector."""
    return search(table(spark, sf_dir, "embeddings"))
