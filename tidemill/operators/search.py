"""Search over a stored index: exact hybrid ranks without all pairs, and vector search by inverted lists.

``build_index`` makes one row a chunk: its distinct terms with their counts, its length and its vector; texts are
tokenized once. A block of queries is sent to every task as matrices; a task scores its chunks for both legs at once.

``hybrid_pool`` fuses *ranks* over all candidates, but only the best of each leg leave a task. A chunk among the best
by text may be anywhere by cosine; its place is one more than the number of better chunks, which the tasks count in a
second pass and sum up. Chunks that are in neither leg's best can't score over a bound; queries whose pool does not
lie over it are asked again with more, so that the pool is that of all pairs.

``build_lists`` deals vectors to the nearest of a number of centroids; ``probe`` looks at the lists nearest to a query.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemill.functions import text as tx
from tidemill.operators.retrieval import B, EPSILON, K1, RRF_K, WEIGHT, expand_context, gate_and_rank, rerank, stored

#: Queries of a block, which is broadcast, and scores that a task works out together.
BLOCK, CELLS = 1_000, 1 << 20
#: Best of each leg and query that are kept at first.
LEG = 256
DIM = 64


def _counts(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(row, term, count) of the distinct terms of each row, sorted, and the terms' names."""
    coded = tokens.flatten().dictionary_encode()
    n_terms = max(1, len(coded.dictionary))
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    cells, often = np.unique(row * n_terms + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return cells // n_terms, cells % n_terms, often, coded.dictionary.to_pylist()


def index_rows(chunks: DataFrame, key: str, text: str, keep: list[str] | None = None, dim: int = DIM) -> DataFrame:
    """(key, *keep, length, terms, counts, vector) of each chunk; the vector has the words' hashes, as ``hash_embed``."""
    keep = keep or []
    tokens = chunks.select(F.col(key).alias("key"), *keep, tx.index_tokens(F.col(text)).alias("tokens"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            row, term, often, names = _counts(lists)
            place = np.fromiter((zlib.crc32(w.encode()) % dim for w in names), np.int64, len(names))
            vector = np.zeros((len(batch), dim))
            np.add.at(vector, (row, place[term] if len(names) else term), often)
            norm = np.sqrt((vector * vector).sum(axis=1, keepdims=True))
            vector = np.divide(vector, norm, out=vector, where=norm > 0)
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(batch)))].astype(np.int32)
            ranges = np.arange(0, dim * len(batch) + 1, dim, dtype=np.int32)
            yield pa.record_batch(
                [
                    *batch.columns[:-1],
                    pa.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(names, pa.string()).take(pa.array(term))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(often.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ranges), pa.array(vector.ravel())),
                ],
                [*batch.schema.names[:-1], "length", "terms", "counts", "vector"],
            )

    return tokens.mapInArrow(run, f"{kinds}, length long, terms array<string>, counts array<int>, vector array<double>")


@dataclass
class Index:
    """rows: as ``index_rows``; terms: (term, df); the number of chunks, their mean length, and the floor of negative idf."""

    rows: DataFrame
    terms: DataFrame
    n: int
    mean: float
    floor: float


def summed(rows: DataFrame, terms: DataFrame) -> Index:
    """The index of stored rows and terms; a few figures of the whole reach the driver."""
    n, tokens = rows.agg(F.count("*"), F.sum("length")).first()
    raw = terms.agg(F.avg(_raw_idf(n))).first()[0]
    return Index(rows, terms, n, (tokens or 0) / max(1, n), EPSILON * (raw or 0.0))


def _raw_idf(n: int) -> Column:
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def build_index(chunks: DataFrame, key: str, text: str, keep: list[str] | None = None) -> Index:
    rows = stored(index_rows(chunks, key, text, keep))
    return summed(rows, stored(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))))


@dataclass
class _Asked:
    """A block of queries: for every asked term, which queries have it and with which weight; and the vectors."""

    ids: pa.Array
    terms: pa.Array
    starts: np.ndarray
    sizes: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    vectors: np.ndarray
    mean: float


def _asked(index: Index, queries: DataFrame) -> list[_Asked]:
    """The queries (query_id, query) in blocks; each is bounded, and brought to the driver to be broadcast."""
    rows = index_rows(queries, "query_id", "query")
    terms = rows.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("t.terms").distinct().join(index.terms, F.col("terms") == F.col("term"))
    idf = F.when(_raw_idf(index.n) < 0, F.lit(index.floor)).otherwise(_raw_idf(index.n))
    known = {r["term"]: r["idf"] for r in terms.select("term", idf.alias("idf")).toLocalIterator()}  # the queries' words
    out = []
    number = rows.select("key", "terms", "counts", "vector")
    held: list = []

    def block() -> _Asked:
        ids = pa.array([r["key"] for r in held])
        by: dict[str, list[tuple[int, float]]] = {}
        for q, r in enumerate(held):
            for term, times in zip(r["terms"], r["counts"]):
                if term in known:
                    by.setdefault(term, []).append((q, times * known[term]))
        sizes = np.fromiter(map(len, by.values()), np.int64, len(by))
        flat = [x for own in by.values() for x in own]
        return _Asked(
            ids, pa.array(list(by), pa.string()), np.cumsum(sizes) - sizes, sizes, np.array([q for q, _ in flat], np.int64),
            np.array([w for _, w in flat], float), np.array([r["vector"] for r in held], float).reshape(len(held), -1), index.mean,
        )

    for r in number.toLocalIterator():
        held.append(r)
        if len(held) == BLOCK:
            out.append(block())
            held = []
    return out + [block()] if held else out


def _scores(batch: pa.RecordBatch, asked: _Asked) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, text scores) of each chunk of a batch and each query."""
    n, nq = len(batch), len(asked.ids)
    column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("length", "terms", "counts", "vector")}
    vectors = column["vector"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    row = np.repeat(np.arange(n), column["terms"].value_lengths().to_numpy(zero_copy_only=False))
    found = pc.index_in(column["terms"].flatten(), value_set=asked.terms).fill_null(-1).to_numpy(zero_copy_only=False)
    mine = found >= 0
    row, term, tf = row[mine], found[mine], column["counts"].flatten().to_numpy(zero_copy_only=False)[mine]
    length = column["length"].to_numpy(zero_copy_only=False)[row]
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(asked.mean, 1e-9)))
    sizes = asked.sizes[term]
    ends = np.cumsum(sizes)
    at = np.repeat(asked.starts[term] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
    cells = np.repeat(row, sizes) * nq + asked.query[at]
    text = np.bincount(cells, np.repeat(part, sizes) * asked.weight[at], minlength=n * nq).astype(float).reshape(n, nq)  # ints if there are none
    return np.round(vectors @ asked.vectors.T, 12), text


def _parts(batches: Iterator[pa.RecordBatch], asked: _Asked) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    rows = max(1, CELLS // max(1, len(asked.ids)))
    for batch in batches:
        for at in range(0, len(batch), rows):
            part = batch.slice(at, rows)
            yield part, *_scores(part, asked)


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Which of each column are among its ``most`` best, with ties."""
    if most >= len(scores):
        return np.ones(scores.shape, bool)
    return scores >= np.partition(scores, -most, axis=0)[-most] - 1e-9


@dataclass
class _Best:
    """The best ``most`` of each query and leg, of what a task has seen; ties go by key, so that it is never more."""

    most: int
    queries: int
    held: list[tuple] = field(default_factory=list)
    size: int = 0
    least: tuple[np.ndarray, np.ndarray] | None = None

    def add(self, part: pa.RecordBatch, cosine: np.ndarray, text: np.ndarray, mine: np.ndarray) -> None:
        if self.least is None:
            keep = _best(cosine, self.most) | (_best(text, self.most) & (text > 0))
        else:
            keep = (cosine >= self.least[0]) | ((text >= self.least[1]) & (text > 0))
        i, j = np.nonzero(keep & mine)
        self.held.append((j, cosine[i, j], text[i, j], part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i))))
        self.size += len(j)
        if self.size > 6 * self.most * self.queries:
            self.prune()

    def prune(self) -> None:
        """Leaves the best; ``least`` are the scores that a chunk needs by now to be one of them."""
        q, cosine, text = (np.concatenate([h[k] for h in self.held]) for k in range(3))
        keys, priority = (pa.concat_arrays([h[k] for h in self.held]) for k in (3, 4))
        by_key = keys.to_numpy(zero_copy_only=False)
        keep, least = np.zeros(len(q), bool), []
        for score, among in ((np.round(cosine, 9), np.ones(len(q), bool)), (np.round(text, 9), text > 0)):
            own = np.flatnonzero(among)
            order = own[np.lexsort((by_key[own], -score[own], q[own]))]
            counts = np.bincount(q[order], minlength=self.queries)
            place = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
            keep[order[place < self.most]] = True
            last = np.full(self.queries, -np.inf)
            at = order[place == self.most - 1]
            last[q[at]] = score[at] - 1e-9
            least.append(last)
        at = np.flatnonzero(keep)
        self.held = [(q[at], cosine[at], text[at], keys.take(pa.array(at)), priority.take(pa.array(at)))]
        self.size, self.least = len(at), tuple(least)


def _tops(rows: DataFrame, asked: _Asked, most: int, wanted: np.ndarray) -> DataFrame:
    """(query_id, key, cosine, bm25, priority, dr, br) of the best of either leg; a rank over ``most`` is not known yet."""
    sent = rows.sparkSession.sparkContext.broadcast((asked, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine = sent.value
        best = _Best(most, len(own.ids))
        for part, cosine, text in _parts(batches, own):
            best.add(part, cosine, text, mine)
        if best.held:
            best.prune()
            q, cosine, text, keys, priority = best.held[0]
            yield pa.record_batch([own.ids.take(pa.array(q)), keys, pa.array(cosine), pa.array(text), priority], ["query_id", "key", "cosine", "bm25", "priority"])

    kind = rows.schema["key"].dataType.simpleString()
    asked_kind = "string" if pa.types.is_string(asked.ids.type) else "long"
    found = rows.select("key", "priority", "length", "terms", "counts", "vector").mapInArrow(run, f"query_id {asked_kind}, key {kind}, cosine double, bm25 double, priority double")
    by = W.partitionBy("query_id")
    dr = F.row_number().over(by.orderBy(F.desc(F.round("cosine", 9)), "key"))
    br = F.row_number().over(by.orderBy(F.desc(F.round("bm25", 9)), "key"))
    ranked = found.withColumn("dr", dr).withColumn("br", F.when(F.col("bm25") > 0, br))
    return ranked.where((F.col("dr") <= most) | (F.col("br") <= most))


def _counted(rows: DataFrame, asked: _Asked, tops: DataFrame, most: int) -> DataFrame:
    """tops with all ranks: those beyond ``most`` are counted over all rows."""
    open_ = tops.where((F.col("dr") > most) | (F.col("br") > most)).select("query_id", "key", F.round("cosine", 9).alias("c"), F.round("bm25", 9).alias("b"), "dr", "br").toPandas()
    if not len(open_):
        return tops
    number = {q: i for i, q in enumerate(asked.ids.to_pylist())}
    legs = []
    for rank, score in (("dr", "c"), ("br", "b")):
        own = open_[open_[rank] > most]
        legs.append([(number[q], g[score].to_numpy(), g["key"].to_numpy()) for q, g in own.groupby("query_id")])
    sent = rows.sparkSession.sparkContext.broadcast((asked, legs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wanted = sent.value
        totals = [[np.zeros(len(s), np.int64) for _, s, _ in leg] for leg in wanted]
        for part, cosine, text in _parts(batches, own):
            keys = part.column(0).to_numpy(zero_copy_only=False)
            for leg, scores, total in zip(wanted, (cosine, text), totals):
                for k, (q, s, own_keys) in enumerate(leg):
                    column = np.round(scores[:, q], 9)
                    ordered = np.sort(column)
                    low, high = np.searchsorted(ordered, s, "left"), np.searchsorted(ordered, s, "right")
                    total[k] += len(ordered) - high
                    for x in np.flatnonzero(high > low):  # ties go by key
                        total[k][x] += int((keys[column == s[x]] < own_keys[x]).sum())
        for name, leg, total in zip(("dr", "br"), wanted, totals):
            for (q, _, own_keys), better in zip(leg, total):
                ids = own.ids.take(pa.array(np.full(len(better), q)))
                yield pa.record_batch([pa.array([name] * len(better)), ids, pa.array(own_keys), pa.array(better)], ["leg", "query_id", "key", "better"])

    kinds = {c: tops.schema[c].dataType.simpleString() for c in ("query_id", "key")}
    counted = rows.select("key", "priority", "length", "terms", "counts", "vector").mapInArrow(run, f"leg string, query_id {kinds['query_id']}, key {kinds['key']}, better long")
    places = counted.groupBy("query_id", "key").agg(*[F.sum(F.when(F.col("leg") == leg, F.col("better"))).alias(f"{leg}_better") for leg in ("dr", "br")])
    joined = tops.join(places, ["query_id", "key"], "left")
    return joined.select(
        "query_id", "key", "cosine", "bm25", "priority",
        *[F.coalesce(F.when(F.col(c) > most, F.col(f"{c}_better") + 1), F.col(c)).alias(c) for c in ("dr", "br")],
    )


def hybrid_pool(index: Index, queries: DataFrame, top_k: int, weight: float = WEIGHT, leg: int = LEG) -> DataFrame:
    """(query_id, key, cosine, bm25, priority, fused, pool_rank): each query's best max(4 * top_k, 30) candidates by fused ranks.

    Exactly those that ranking all candidates by both legs gives, with ties by key. Candidates are the index's rows with a
    ``priority``, which multiplies the fused score; statistics of the text are of all rows. Queries (query_id,
    query) without words have only the dense leg.
    """
    candidates = index.rows.where(F.col("priority").isNotNull())
    total, most_priority = candidates.agg(F.count("*"), F.max("priority")).first()
    size, done = max(4 * top_k, 30), []
    for asked in _asked(index, queries) if total else []:
        wanted, most = np.ones(len(asked.ids), bool), leg
        while wanted.any():
            tops = stored(_tops(candidates, asked, most, wanted))
            dr, br = (F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0)) for c in ("dr", "br"))
            fused = ((1 - weight) * dr + weight * br) * F.col("priority")
            rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("fused", 12)), "key"))
            pool = _counted(candidates, asked, tops, most).withColumn("fused", fused).withColumn("pool_rank", rank).where(F.col("pool_rank") <= size)
            pool = stored(pool.select("query_id", "key", "cosine", "bm25", "priority", "fused", "pool_rank"))
            done.append((pool, _settled(pool, tops, asked, most, total, size, weight, most_priority) & wanted))
            wanted, most = wanted & ~done[-1][1], 4 * most
            done[-1] = (pool, asked.ids.filter(pa.array(done[-1][1])))
    if not done:
        kind, key = queries.schema["query_id"].dataType.simpleString(), index.rows.schema["key"].dataType.simpleString()
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, key {key}, cosine double, bm25 double, priority double, fused double, pool_rank int")
    out = None
    for pool, ids in done:
        own = pool.where(F.col("query_id").isin(ids.to_pylist()))  # at most a block
        out = own if out is None else out.unionByName(own)
    return out


def hybrid_search(
    index: Index, queries: DataFrame, chunks: DataFrame, top_k: int = 10, threshold: float = 0.0, weight: float = WEIGHT, radius: int = 1, cap: int = 12,
    scorer: Callable[[DataFrame], Column] | None = None,
) -> DataFrame:
    """(query_id, chunk_id, slot, rank, relevance) of a batch of queries end to end: pool, re-ranking, gate, context.

    chunks (chunk_id, document_id, position) are those of the index; neighbours that are no matches have no rank.
    """
    pool = hybrid_pool(index, queries, top_k, weight).withColumnRenamed("key", "chunk_id")
    ranked = gate_and_rank(rerank(pool, scorer), "chunk_id", threshold, top_k, priority="priority")
    matches = stored(ranked.join(chunks.select("chunk_id", "document_id", "position"), "chunk_id").select("query_id", "chunk_id", "document_id", "position", "rank", "relevance"))
    placed = expand_context(matches, chunks, radius, cap)
    return placed.join(matches.select("query_id", "chunk_id", "rank", "relevance"), ["query_id", "chunk_id"], "left")


def _settled(pool: DataFrame, tops: DataFrame, asked: _Asked, most: int, total: int, size: int, weight: float, priority: float) -> np.ndarray:
    """Queries whose pool no other candidate can get into."""
    if most >= total:
        return np.ones(len(asked.ids), bool)
    last = {r["query_id"]: (r["n"], r["last"]) for r in pool.groupBy("query_id").agg(F.count("*").alias("n"), F.min("fused").alias("last")).collect()}
    more_text = {r["query_id"] for r in tops.groupBy("query_id").agg(F.max("br").alias("br")).where(F.col("br") >= most).collect()}
    out = np.zeros(len(asked.ids), bool)
    for i, q in enumerate(asked.ids.to_pylist()):
        bound = priority * ((1 - weight) + weight * (q in more_text)) / (RRF_K + most + 1)
        n, least = last.get(q, (0, 0.0))
        out[i] = n == size and least > bound + 1e-11
    return out


# Inverted lists of vectors


@dataclass
class Lists:
    """rows: (list, key, unit), the vectors by list; centroids: one unit vector a list."""

    rows: DataFrame
    centroids: np.ndarray
    key: str


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit_centroids(sample: np.ndarray, lists: int, turns: int = 10) -> np.ndarray:
    """Spherical k-means: a list without vectors takes the one worst served."""
    own = _units(sample)
    centroids = own[np.linspace(0, len(own) - 1, lists).astype(int)].copy()
    for _ in range(turns):
        scores = own @ centroids.T
        nearest, best = scores.argmax(axis=1), scores.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, own)
        empty = np.flatnonzero(np.bincount(nearest, minlength=lists) == 0)
        sums[empty] = own[np.argsort(best, kind="stable")[: len(empty)]]
        centroids = _units(sums)
    return centroids


def build_lists(vectors: DataFrame, key: str, lists: int | None = None, sample: int = 20_000, piece: int = 20_000) -> Lists:
    """Vectors (key, embedding) dealt to lists, about the square root of their number, 4,096 at most.

    Centroids are fitted on the ``sample`` vectors with the least hashes of their keys, a bounded number; every vector is
    indexed. Null, empty and zero vectors are near to nothing and left out. The table is written by list and, so that no
    list is too much for a task however many vectors it has, by pieces of about ``piece`` vectors in it.
    """
    spark = vectors.sparkSession
    unit = tx.unit(F.col("embedding"))
    known = vectors.select(F.col(key).alias("key"), unit.alias("unit")).where(F.exists("unit", lambda x: x != 0))
    n = known.count()
    lists = lists or max(1, min(4_096, round(n**0.5)))
    fit = known.orderBy(F.xxhash64("key"), "key").limit(sample).toArrow()["unit"].to_pylist()
    centroids = fit_centroids(np.array(fit, float), min(lists, len(fit))) if fit else np.zeros((0, DIM))
    sent = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            yield pa.record_batch([pa.array((x @ sent.value.T).argmax(axis=1).astype(np.int32)), *batch.columns], ["list", "key", "unit"])

    dealt = known.mapInArrow(run, f"list int, key {known.schema['key'].dataType.simpleString()}, unit array<double>") if fit else known.select(F.lit(0).alias("list"), "key", "unit")
    dealt = stored(dealt)
    sizes = dealt.groupBy("list").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"))  # a row a list
    split = dealt.join(F.broadcast(sizes), "list").withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"))
    return Lists(stored(split.select("list", "piece", "pieces", "key", "unit")), centroids, key)


def probe(index: Lists, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, key, cosine, rank): each query's k nearest by cosine in the ``probes`` lists nearest to it.

    Queries (query_id, vector) go to their lists, and meet them there list by list; a task sends on k a query.
    Ties go to the smaller key. A query may find itself.
    """
    spark, centroids = queries.sparkSession, index.centroids
    sent = spark.sparkContext.broadcast(centroids)
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.select("query_id", tx.unit(F.col("vector")).alias("q")).where(F.exists("q", lambda x: x != 0))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = min(probes, len(sent.value))
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            near = np.argsort(-(x @ sent.value.T), axis=1, kind="stable")[:, :own]
            row = pa.array(np.repeat(np.arange(len(batch)), own))
            yield pa.record_batch([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(row), batch.column(1).take(row)], ["near", "query_id", "q"])

    pieces = index.rows.select(F.col("list").alias("near"), F.col("piece").alias("part")).distinct()
    near = asked.mapInArrow(route, f"near int, query_id {kind}, q array<double>")
    routed = near.join(pieces, "near")

    def run(own: pa.Table, mine: pa.Table) -> pa.Table:
        ids, keys = own["query_id"].combine_chunks(), mine["key"].combine_chunks()
        out: list[pa.Table] = []
        if len(own) and len(mine):
            x = mine["unit"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1)
            q = own["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            step = max(1, CELLS // len(mine))
            for at in range(0, len(q), step):
                scores = np.round(x @ q[at : at + step].T, 12)
                i, j = np.nonzero(_best(scores, k))
                out.append(pa.table([ids.take(pa.array(j + at)), keys.take(pa.array(i)), pa.array(scores[i, j])], ["query_id", "key", "cosine"]))
        return pa.concat_tables(out) if out else pa.table([ids.slice(0, 0), keys.slice(0, 0), pa.array([], pa.float64())], ["query_id", "key", "cosine"])

    schema = f"query_id {kind}, key {index.rows.schema['key'].dataType.simpleString()}, cosine double"
    met = routed.groupBy("near", "part").cogroup(index.rows.groupBy("list", "piece")).applyInArrow(run, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "key"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (query_id, key) that were found."""
    right, all_ = exact.join(found.select("query_id", "key", F.lit(1).alias("hit")), ["query_id", "key"], "left").agg(F.sum("hit"), F.count("*")).first()
    return (right or 0) / all_ if all_ else 1.0


def tuned_probes(index: Lists, queries: DataFrame, k: int, least: float = 0.95, sample: int = 200) -> int:
    """The number of lists to look at, doubled until the recall on at most ``sample`` queries is ``least``, or all lists.

    The sample is of queries alone, with the least hashes; they are compared with all vectors.
    """
    asked = stored(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample))
    exact = stored(probe(index, asked, k, len(index.centroids)))
    probes = 1
    while probes < len(index.centroids) and recall(probe(index, asked, k, probes), exact) < least:
        probes *= 2
    return min(probes, max(1, len(index.centroids)))


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, key: str, k: int, least: float = 0.95) -> DataFrame:
    """(query_id, key, cosine, rank): search by lists, with as many lists as the recall asks for."""
    index = build_lists(vectors, key)
    return probe(index, queries, k, tuned_probes(index, queries, k, least)).withColumnRenamed("key", key)
