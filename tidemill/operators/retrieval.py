"""Hybrid retrieval for batches of queries: an inverted index, vectors, rank fusion, and context."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from tidemill.functions import text as tx
from tidemill.operators.relational import neighbours
from tidemill.streaming.live import work_dir

#: Fixed values of Okapi BM25, of reciprocal rank fusion, and of the share of the text leg.
K1, B, EPSILON, RRF_K, WEIGHT = 1.5, 0.75, 0.25, 60, 0.7
#: Rows of a side that is broadcast, at most.
BROADCAST_ROWS = 20_000
#: Scores that a task works out together.
CELLS = 1 << 20


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the folder that driver and executors share."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df as the broadcast side if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _repeated(chunks: DataFrame, key: str) -> bool:
    """Whether a key has several rows, whose terms count together then."""
    return not chunks.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _counted(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, term, count) of the distinct terms of each row, and the terms' names."""
    coded = tokens.flatten().dictionary_encode()
    n_terms = max(1, len(coded.dictionary))
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))
    cells, often = np.unique(row * n_terms + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return cells // n_terms, cells % n_terms, often, coded.dictionary


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, length) of every distinct term of a chunk; a chunk's length goes with its postings.

    A chunk's terms are counted where it is read. Only where keys repeat are the counts of a key's rows added up.
    """
    tokens = chunks.select(F.col(key), tx.index_tokens(F.col(text)).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                row, term, often, names = _counted(part.column(1))
                lengths = part.column(1).value_lengths().cast(pa.int64())
                take = pa.array(row)
                yield pa.record_batch([names.take(pa.array(term)), part.column(0).take(take), pa.array(often.astype(np.int64)), lengths.take(take)], ["term", key, "tf", "length"])

    own = tokens.mapInArrow(run, f"term string, {key} {chunks.schema[key].dataType.simpleString()}, tf long, length long")
    return own.groupBy("term", key).agg(F.sum("tf").alias("tf"), F.first("length").alias("length")) if _repeated(chunks, key) else own


def tokenized(chunks: DataFrame, key: str, text: str) -> DataFrame:
    return chunks.select(F.col(key), tx.index_tokens(F.col(text)).alias("tokens")).withColumn("length", F.size("tokens").cast("long"))


def document_counts(tokens: DataFrame, key: str) -> DataFrame:
    """(term, df, tokens) of tokenized chunks: in how many each term is; the row of the null term counts all rows and their tokens."""
    each = tokens.select(key, "length", F.explode(F.array_append(F.array_distinct("tokens"), F.lit(None).cast("string"))).alias("term"))
    if _repeated(tokens, key):
        each = each.where("term IS NOT NULL").dropDuplicates(["term", key]).unionByName(each.where("term IS NULL"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("tokens"))


def term_stats(counted: DataFrame) -> DataFrame:
    """(term, df, idf) of document_counts: negative values become EPSILON times the mean over all terms."""
    n = counted.where("term IS NULL").select(F.col("df").alias("n"))  # one row
    raw = counted.where("term IS NOT NULL").crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select(  # one row
        "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf")
    )


#: Queries whose text scores a task works out together.
ASKED = 1_000


def bm25(queries: DataFrame, chunks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key, bm25) of queries (query_id, query) over chunks that share a term.

    A repeated query term counts again. The texts are tokenized once, into a table. Two passes over it: one counts in how many chunks each term is, combined
    before its shuffle, and is stored; in the other a chunk is scored for all queries where it is read, against the asked
    terms with their queries and weights, which go to every task in blocks of ASKED queries. No posting or score is
    shuffled; only where keys repeat are the counts of a key's rows added up first.
    """
    spark = chunks.sparkSession
    tokens = stored(tokenized(chunks, key, text))
    counted = stored(document_counts(tokens, key))
    n, total = counted.where("term IS NULL").agg(F.max("df"), F.max("tokens")).first()
    mean = max((total or 0) / max(1, n or 0), 1e-9)
    words = queries.select("query_id", F.explode(tx.index_tokens(F.col("query"))).alias("term"))
    asked = words.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weighed = asked.join(term_stats(counted), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    wanted = weighed.orderBy("query_id", "term").toArrow()  # the queries' own words
    blocks = [_Terms.of(wanted, at) for at in _cuts(wanted.column("query_id"))]
    sent = spark.sparkContext.broadcast(blocks)
    if _repeated(tokens, key):
        tokens = _joined(tokens, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in sent.value:
                step = max(1, CELLS // 8 // len(own.ids))  # a score has several words behind it
                for at in range(0, len(batch), step):
                    part = batch.slice(at, step)
                    i, j, score = own.scores(part.column(1), part.column(2).to_numpy(zero_copy_only=False), mean)
                    yield pa.record_batch([own.ids.take(pa.array(j)), part.column(0).take(pa.array(i)), pa.array(score)], ["query_id", key, "bm25"])

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {chunks.schema[key].dataType.simpleString()}, bm25 double"
    return tokens.mapInArrow(run, kinds)


def _joined(tokens: DataFrame, key: str) -> DataFrame:
    """(key, tokens, length) with the tokens of all rows of a key, and the length of one of them."""
    return tokens.groupBy(key).agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.first("length").alias("length"))


def _cuts(ids: pa.ChunkedArray) -> list[tuple[int, int]]:
    """Ranges of sorted ids with ASKED different ones each."""
    number = np.cumsum(np.r_[0, pc.not_equal(ids[1:], ids[:-1]).to_numpy()]) // ASKED if len(ids) else np.zeros(0, int)
    starts = np.searchsorted(number, np.arange(number[-1] + 2 if len(number) else 1))
    return list(zip(starts[:-1].tolist(), starts[1:].tolist()))


@dataclass
class _Terms:
    """A block of queries: its words, and for each of them which queries have it and with which weight."""

    ids: pa.Array
    terms: pa.Array
    starts: np.ndarray
    sizes: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(wanted: pa.Table, at: tuple[int, int]) -> _Terms:
        rows = wanted.slice(at[0], at[1] - at[0]).combine_chunks()
        ids, terms = (pc.dictionary_encode(rows.column(c).combine_chunks()) for c in ("query_id", "term"))
        term = terms.indices.to_numpy(zero_copy_only=False)
        order, sizes = np.argsort(term, kind="stable"), np.bincount(term)
        query, weight = ids.indices.to_numpy(zero_copy_only=False)[order], rows.column("weight").to_numpy()[order]
        return _Terms(ids.dictionary, terms.dictionary, np.cumsum(sizes) - sizes, sizes, query, weight)

    def scores(self, tokens: pa.Array, length: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, query, score) of the rows and queries that share a word."""
        n, nq = len(tokens), len(self.ids)
        row = np.repeat(np.arange(n), tokens.value_lengths().to_numpy(zero_copy_only=False))
        found = pc.index_in(tokens.flatten(), value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        cells, tf = np.unique(row[found >= 0] * len(self.terms) + found[found >= 0], return_counts=True)
        row, term = cells // len(self.terms), cells % len(self.terms)
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean))
        sizes = self.sizes[term]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[term] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        pair = np.repeat(row, sizes) * nq + self.query[at]
        score = np.bincount(pair, np.repeat(part, sizes) * self.weight[at], minlength=n * nq)
        both = np.flatnonzero(np.bincount(pair, minlength=n * nq))
        return both // nq, both % nq, score[both].astype(float)


#: Queries of a block, whose vectors are broadcast together, and tasks that a block is sent to at most, if there are not more cores.
BLOCK, TASKS = 4_096, 16


def _blocks(queries: DataFrame, *more: str) -> list[tuple[pa.Table, np.ndarray]]:
    """Queries (query_id, vector, *more) in blocks of about BLOCK rows, each with its unit vectors as one matrix."""
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", *more, tx.unit(F.col("vector")).alias("q"))
    parts = max(1, -(-asked.count() // BLOCK))
    out = []
    for part in range(parts):
        own = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        rows = own.toArrow().combine_chunks()  # bounded by the block's size
        if len(rows) or part == 0:
            flat = rows.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            out.append((rows.drop_columns(["q"]), flat.reshape(len(rows), -1).T if len(rows) else np.zeros((0, 0))))
    return out


def _units(vectors: DataFrame, key: str, *more: str) -> DataFrame:
    return vectors.where(F.col("embedding").isNotNull()).select(F.col(key).alias("key"), tx.unit(F.col("embedding")).alias("v"), *more)


def _in_tasks(units: DataFrame) -> DataFrame:
    """Vectors in a number of tasks that does not grow with them: as each sends on figures for all queries, what is sent follows the queries alone."""
    return units.coalesce(max(TASKS, units.sparkSession.sparkContext.defaultParallelism))


def _steps(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, apart: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of vectors (key, v, ...) with their products with all queries; ``apart`` takes out those of equal ids, as -inf."""
    rows = max(1, CELLS // max(1, len(ids)))
    order = np.argsort(ids, kind="stable") if apart else None
    for batch in batches:
        for at in range(0, len(batch) if len(ids) else 0, rows):
            part = batch.slice(at, rows)
            scores = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1) @ q
            if apart:
                keys = part.column(0).to_numpy(zero_copy_only=False)
                low, high = (np.searchsorted(ids, keys, side, sorter=order) for side in ("left", "right"))
                for i in np.flatnonzero(high > low):
                    scores[i, order[low[i] : high[i]]] = -np.inf
            yield part, scores


def _pool(q: np.ndarray, keys: np.ndarray, cosine: np.ndarray, pool: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the pairs are among the best ``pool`` of their query, what a pair needs to be so); ties go by key."""
    score = np.round(cosine, 9)
    order = np.lexsort((keys, -score, q))
    counts = np.bincount(q, minlength=n)
    place = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
    least = np.full(n, -np.inf)
    last = order[place == pool - 1]
    least[q[last]] = score[last] - 2e-9
    return order[place < pool], least


def dense(queries: DataFrame, vectors: DataFrame, key: str, pool: int | None = None, apart: bool = False) -> DataFrame:
    """(query_id, key, cosine) of queries (query_id, vector) and vectors (key, embedding).

    A stated batch of queries meets all vectors, in blocks of about BLOCK queries: a block is sent to every task as one
    matrix, and a task multiplies a piece of its vectors with it. With ``pool``, each query keeps its best ones, and a
    task sends on no more than the best of all its pieces. ``apart`` leaves out vectors with the query's own id.
    Vectors are all of one length.
    """
    types = {"query_id": queries.schema["query_id"].dataType.simpleString(), "key": vectors.schema[key].dataType.simpleString()}
    units, spark = _units(vectors, key), queries.sparkSession
    if pool is not None:
        units = _in_tasks(units)

    def scored(rows: pa.Table, q: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((rows.column("query_id").combine_chunks(), q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, q = sent.value
            held, size, least = [], 0, np.full(len(own), -np.inf)
            for part, scores in _steps(batches, own.to_numpy(zero_copy_only=False), q, apart):
                i, j = np.nonzero(~np.isneginf(scores) if pool is None else (scores >= least) & ~np.isneginf(scores))
                found = [j, part.column(0).take(pa.array(i)), np.round(scores[i, j], 12)]
                if pool is None:
                    yield pa.record_batch([own.take(pa.array(j)), found[1], pa.array(found[2])], ["query_id", "key", "cosine"])
                    continue
                held.append(found)
                size += len(j)
                if size > 6 * pool * len(own):
                    held, least = pruned(held, len(own))
                    size = len(held[0][0])
            if held:
                j, keys, cosine = pruned(held, len(own))[0][0]
                yield pa.record_batch([own.take(pa.array(j)), keys, pa.array(cosine)], ["query_id", "key", "cosine"])

        def pruned(held: list, n: int) -> tuple[list, np.ndarray]:
            j, cosine = (np.concatenate([h[k] for h in held]) for k in (0, 2))
            keys = pa.concat_arrays([h[1] for h in held])
            at, least = _pool(j, keys.to_numpy(zero_copy_only=False), cosine, pool, n)
            return [[j[at], keys.take(pa.array(at)), cosine[at]]], least

        return units.mapInArrow(run, f"query_id {types['query_id']}, key {types['key']}, cosine double")

    out = reduce(DataFrame.unionByName, [scored(*block) for block in _blocks(queries)])
    if pool is not None:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "key"))
        out = out.withColumn("rank", rank).where(F.col("rank") <= pool).drop("rank")
    return out.withColumnRenamed("key", key)


#: Pairs that a task puts in order together; the number of a pair in its piece has PLACE bits.
PLACE = 24
PAIRS = 1 << PLACE
#: Stand in order behind every figure: those that are no number, and pairs that are left out.
NAN, APART = 1 << 37, 1 << 38


def _half_up(scores: np.ndarray, digits: int) -> np.ndarray:
    """Scores, overwritten, as whole numbers of that many digits, halves away from zero; what is beyond twelve digits is rounded off before, as in dense."""
    part = 10.0 ** (12 - digits)
    whole = np.rint(scores * 1e12)
    np.abs(whole, out=scores)
    scores += part // 2
    scores /= part
    np.floor(scores, out=scores)
    np.copysign(scores, whole, out=scores)
    return np.nan_to_num(scores, copy=False, nan=NAN, posinf=NAN, neginf=APART).astype(np.int64)


def cosines(queries: DataFrame, vectors: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """(query_id, key, cosine) of every query and vector, those of its own id apart; cosines are rounded to ``digits``, halves away from zero.

    What dense gives without a pool, and worked out alike; but a task passes on its pairs in order of their cosines, in pieces of at
    most PAIRS. The result is as large as the pairs, and in columns that are written in this order a cosine takes about one
    byte instead of eight, as equal ones follow each other, and ids about three.
    """
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, cosine double"
    units, spark = _units(vectors, key), queries.sparkSession

    def scored(rows: pa.Table, q: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((rows.column("query_id").combine_chunks(), q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, q = sent.value
            ids, n = own.to_numpy(zero_copy_only=False), np.int32(max(1, len(own)))
            for batch in batches:
                for at in range(0, len(batch), PAIRS // n):
                    piece = batch.slice(at, PAIRS // n)
                    pairs, done = np.empty(len(piece) * len(own), np.int64), 0
                    for _, scores in _steps(iter([piece]), ids, q, True):
                        figures = _half_up(scores.ravel(), digits)
                        pairs[done : done + len(figures)] = (figures << PLACE) + np.arange(done, done + len(figures))
                        done += len(figures)
                    pairs.sort()
                    for start in range(0, np.searchsorted(pairs, APART << PLACE), CELLS):
                        some = pairs[start : start + CELLS]
                        some = some[some < APART << PLACE]
                        place, cosine = (some & (PAIRS - 1)).astype(np.int32), (some >> PLACE) / 10**digits
                        cosine[cosine >= NAN / 10**digits] = np.nan
                        i = place // n
                        yield pa.record_batch([own.take(pa.array(place - i * n)), piece.column(0).take(pa.array(i)), pa.array(cosine)], ["query_id", key, "cosine"])

        return units.mapInArrow(run, kinds)

    return reduce(DataFrame.unionByName, [scored(*block) for block in _blocks(queries)])


def best_by(queries: DataFrame, vectors: DataFrame, key: str, group: str) -> DataFrame:
    """(query_id, group, score): each query's largest cosine to the vectors of each group, those with its own id apart.

    A task keeps one figure for each of its groups and a block's queries, and tasks are bounded (_in_tasks), so that what is
    shuffled follows queries x groups, never pairs or the vectors.
    """
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {group} {vectors.schema[group].dataType.simpleString()}, score double"
    units, spark = _in_tasks(_units(vectors, key, group)), queries.sparkSession

    def scored(rows: pa.Table, q: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((rows.column("query_id").combine_chunks(), q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, q = sent.value
            best: dict = {}
            for part, scores in _steps(batches, own.to_numpy(zero_copy_only=False), q, True):
                groups = part.column(2).dictionary_encode("encode")
                codes = groups.indices.to_numpy(zero_copy_only=False)
                for code, name in enumerate(groups.dictionary.to_pylist()):
                    most = scores[codes == code].max(axis=0)
                    best[name] = np.maximum(best[name], most) if name in best else most
            for name, most in best.items():
                at = np.flatnonzero(np.isfinite(most))
                names = pa.array([name], kind).take(pa.array(np.zeros(len(at), np.int64)))
                yield pa.record_batch([own.take(pa.array(at)), names, pa.array(np.round(most[at], 12))], ["query_id", group, "score"])

        return units.mapInArrow(run, kinds)

    kind = to_arrow_type(vectors.schema[group].dataType)
    out = reduce(DataFrame.unionByName, [scored(*block) for block in _blocks(queries)])
    return out.groupBy("query_id", group).agg(F.max("score").alias("score"))


def count_over(queries: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(query_id, n): of queries (query_id, vector, bar), how many vectors, those of its own id apart, have a larger cosine than the bar."""
    units, spark = _in_tasks(_units(vectors, key)), queries.sparkSession

    def scored(rows: pa.Table, q: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((rows.column("query_id").combine_chunks(), rows.column("bar").to_numpy(), q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, bars, q = sent.value
            n = np.zeros(len(own), np.int64)
            for _, scores in _steps(batches, own.to_numpy(zero_copy_only=False), q, True):
                n += (np.round(scores, 12) > bars).sum(axis=0)
            yield pa.record_batch([own, pa.array(n)], ["query_id", "n"])

        return units.mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, n long")

    out = reduce(DataFrame.unionByName, [scored(*block) for block in _blocks(queries, "bar")])
    return out.groupBy("query_id").agg(F.sum("n").alias("n"))


def best_cosine(vectors: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """(key, best): each vector's largest cosine to one of the others; both have ``embedding``. No row without others.

    The others go to every task as matrices, in blocks of at most about BROADCAST_ROWS; a task sends on one figure a vector.
    """
    sides = others.where(F.col("embedding").isNotNull()).select(tx.unit(F.col("embedding")).alias("v"))
    n = sides.count()
    parts = max(1, -(-n // BROADCAST_ROWS))
    units = vectors.where(F.col("embedding").isNotNull()).select(F.col(key).alias("key"), tx.unit(F.col("embedding")).alias("v"))
    kind = vectors.schema[key].dataType.simpleString()
    scored = []
    for part in range(parts if n else 0):
        block = sides.where(F.pmod(F.xxhash64("v"), F.lit(parts)) == part).distinct().toArrow()
        matrix = np.array(block.column("v").to_pylist(), float).reshape(len(block), -1)
        sent = vectors.sparkSession.sparkContext.broadcast(matrix)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            step = max(1, CELLS // max(1, len(sent.value)))
            for batch in batches if len(sent.value) else ():
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                best = np.concatenate([(x[at : at + step] @ sent.value.T).max(axis=1) for at in range(0, len(x), step)]) if len(x) else np.zeros(0)
                yield pa.record_batch([batch.column(0), pa.array(best)], ["key", "best"])

        scored.append(units.mapInArrow(run, f"key {kind}, best double"))
    if not scored:
        return units.where("false").select(F.col("key").alias(key), F.lit(0.0).alias("best"))
    if len(scored) > 1:
        return reduce(DataFrame.unionByName, scored).groupBy(F.col("key").alias(key)).agg(F.max("best").alias("best"))
    return scored[0].withColumnRenamed("key", key)


def rrf(dense_hits: DataFrame, text_hits: DataFrame, key: str, weight: float = WEIGHT, priority: DataFrame | None = None) -> DataFrame:
    """(query_id, key, cosine, bm25, fused): ranks of both legs fused; text scores of 0 or less don't rank.

    ``priority`` (key, priority) multiplies the fused score.
    """
    by = W.partitionBy("query_id")
    d = dense_hits.withColumn("dr", F.row_number().over(by.orderBy(F.desc(F.round("cosine", 9)), key)))
    b = text_hits.where(F.col("bm25") > 0).withColumn("br", F.row_number().over(by.orderBy(F.desc(F.round("bm25", 9)), key)))
    both = d.join(b, ["query_id", key], "full")
    out = both.select("query_id", key, "cosine", "bm25", _fused(weight).alias("fused"))
    if priority is None:
        return out
    return out.join(priority.select(key, "priority"), key, "left").withColumn("fused", F.col("fused") * F.coalesce("priority", F.lit(1.0)))


def _places(pairs: DataFrame, bars: DataFrame, key: str) -> DataFrame:
    """bars (query_id, key, score) with ``place``: one more than how many pairs (query_id, key, score) come before.

    The larger score comes first, then the smaller key. The bars go to every task; a task sends on a count for each.
    """
    rows = bars.select("query_id", F.col(key).alias("key"), F.round("score", 9).alias("score")).distinct().toPandas()  # candidates beyond a leg's best
    ids = pa.array(sorted(set(rows["query_id"])), pa.from_numpy_dtype(rows["query_id"].dtype)) if len(rows) else pa.array([], pa.int64())
    number = pc.index_in(pa.array(rows["query_id"]), value_set=ids).to_numpy() if len(rows) else np.zeros(0, int)
    sent = bars.sparkSession.sparkContext.broadcast((ids, number, rows["key"].to_numpy(), rows["score"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, keys, scores = sent.value
        n, before = len(number), np.zeros(len(number), np.int64)
        for batch in batches if n else ():
            found = pc.index_in(batch.column(0), value_set=own).fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(found >= 0)
            q = np.r_[number, found[at]]
            key = np.r_[keys, batch.column(1).to_numpy(zero_copy_only=False)[at]]
            score = np.r_[scores, np.round(batch.column(2).to_numpy(zero_copy_only=False)[at], 9)]
            order = np.lexsort((np.arange(len(q)) >= n, key, -score, q))  # a bar before the pair that it is
            seen = np.cumsum(order >= n)
            first = np.searchsorted(q[order], np.arange(len(own)))
            start = np.r_[0, seen][first]
            where = np.flatnonzero(order < n)
            before[order[where]] += seen[where] - start[q[order[where]]]
        yield pa.record_batch([own.take(pa.array(number)), pa.array(keys), pa.array(before)], ["query_id", key_name, "before"])

    key_name = key
    kinds = f"query_id {bars.schema['query_id'].dataType.simpleString()}, {key} {bars.schema[key].dataType.simpleString()}, before long"
    counted = pairs.select("query_id", key, "score").mapInArrow(run, kinds).groupBy("query_id", key).agg((F.sum("before") + 1).alias("place"))
    return bars.join(counted, ["query_id", key])


def fused_pool(queries: DataFrame, vectors: DataFrame, text_hits: DataFrame, key: str, top_k: int, weight: float = WEIGHT) -> DataFrame:
    """(query_id, key, cosine, bm25, fused, pool_rank): what pool_of(rrf(dense, text_hits)) gives, without all pairs.

    queries (query_id, vector), vectors (key, embedding), of which a query's own id is left out; text_hits (query_id,
    key, bm25) are stored. Only the best of each leg are candidates: with ``most`` of them, what is in neither leg's best
    has at most 1 / (RRF_K + most + 1), less than the last of as many text hits as the pool has; with fewer text hits all
    of them are candidates, and the rest of the pool is the best by cosine. Ranks of candidates beyond the best of a
    leg are counted, over the stored hits and over the vectors for queries with text hits.
    """
    size = max(4 * top_k, 30)
    most = max(2 * size, int((RRF_K + size) / weight) - RRF_K) + 8
    by, pair = W.partitionBy("query_id"), ["query_id", key]
    hits = stored(text_hits.where(F.col("bm25") > 0).select(*pair, "bm25"))
    text = stored(hits.withColumn("br", F.row_number().over(by.orderBy(F.desc(F.round("bm25", 9)), key))).where(F.col("br") <= most))
    near = dense(queries, vectors, key, pool=most, apart=True)
    near = stored(near.withColumn("dr", F.row_number().over(by.orderBy(F.desc(F.round("cosine", 9)), key))))
    worded = text.select("query_id").distinct()
    asked = queries.join(checked_broadcast(worded), "query_id", "left_semi")
    far = text.join(near, pair, "left_anti").where(F.col("query_id") != F.col(key)).select(*pair)
    units = _units(vectors, key).withColumnRenamed("key", key).join(checked_broadcast(far, 1 << 20), key)
    far = units.join(asked.select("query_id", tx.unit(F.col("vector")).alias("q")), "query_id").select(*pair, F.round(tx.dot(F.col("q"), F.col("v")), 12).alias("score"))
    far = _places(dense(asked, vectors, key, apart=True).withColumnRenamed("cosine", "score"), stored(far), key)
    rest = near.join(checked_broadcast(worded), "query_id", "left_semi").join(text, pair, "left_anti").select(*pair)
    rest = stored(hits.withColumnRenamed("bm25", "score").join(checked_broadcast(rest, 1 << 20), pair, "left_semi"))
    rest = _places(hits.withColumnRenamed("bm25", "score"), rest, key)
    d = near.select(*pair, "cosine", F.col("dr").cast("long")).unionByName(far.withColumnsRenamed({"score": "cosine", "place": "dr"}))
    b = text.select(*pair, "bm25", F.col("br").cast("long")).unionByName(rest.withColumnsRenamed({"score": "bm25", "place": "br"}))
    both = d.join(b, pair, "full").withColumn("fused", _fused(weight))
    return pool_of(both.select(*pair, "cosine", "bm25", "fused"), key, top_k)


def _fused(weight: float) -> Column:
    return (1 - weight) * F.coalesce(1 / (RRF_K + F.col("dr")), F.lit(0.0)) + weight * F.coalesce(1 / (RRF_K + F.col("br")), F.lit(0.0))


#: Queries that a task ranks, each with all its pairs, and figures of pairs that it keeps for that, at most (four bytes each).
RANKED, FIGURES = 128, 1 << 26
#: Stands in order behind every figure: a query's own row.
OWN = (1 << 31) - 1


def fused_pairs(
    queries: DataFrame,
    vectors: DataFrame,
    text_hits: DataFrame,
    key: str,
    weight: float = WEIGHT,
    asked: DataFrame | None = None,
    finish: Callable[[np.ndarray], np.ndarray] = lambda fused: fused,
) -> DataFrame:
    """(query_id, key, fused): what rrf(dense, text_hits) gives of all pairs, a query's own id left out by cosine.

    Every pair is in the result, and fused scores leave through ``finish``. No pair of a query without text hits is shuffled
    (_ranked); ``asked`` (query_id) names those that may have some, else the hits are read for it. Hits are shuffled
    in packed pieces, and with them the cosines of their queries in four bytes (_ranked_with). Query ids and keys are long.
    """
    hits = text_hits.where(F.col("bm25") > 0).select(F.col("query_id").cast("long"), F.col(key).cast("long"), "bm25")
    asked = stored((hits if asked is None else asked).select(F.col("query_id").cast("long")).distinct())
    queries = queries.withColumn("query_id", F.col("query_id").cast("long"))
    units = stored(_units(vectors, key).where(F.col("key").isNotNull()).withColumn("key", F.col("key").cast("long")))
    plain = _ranked(queries.join(asked, "query_id", "left_anti"), units, key, 1 - weight, finish)
    return plain.unionByName(_ranked_with(hits, queries.join(asked, "query_id", "left_semi"), units, key, weight, finish))


def _places_of(scores: np.ndarray) -> np.ndarray:
    """Cosines (vector, query), rounded to nine digits once, as whole numbers (query, vector) that go up from the best: those that are no number first, OWN last."""
    figures = np.nan_to_num(np.rint(scores * -1e9), copy=False, nan=1 - OWN, posinf=OWN, neginf=1 - OWN)
    return np.ascontiguousarray(figures.astype(np.int32).T)


def _ranked(queries: DataFrame, units: DataFrame, key: str, share: float, finish: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(query_id, key, fused) of queries that only have cosines; units (key, v) are stored.

    Vectors are read anew for each group of queries, instead of pairs being shuffled to them: the task of a group passes
    over them batch by batch and keeps one figure a pair, FIGURES at most (or those of one query). It then passes on its
    pairs vector by vector, each with all queries of the group, and a rank has the same score for every query, so that written
    columns of keys and ids are runs and repeats, and one of scores is two bytes a pair or so.
    """
    spark, blocks = queries.sparkSession, _blocks(queries)
    n, tasks = units.count(), 2 * spark.sparkContext.defaultParallelism
    size = max(1, min(RANKED, FIGURES // max(1, n), -(-sum(len(rows) for rows, _ in blocks) // tasks)))

    def scored(rows: pa.Table, q: np.ndarray) -> DataFrame:
        ids = rows.column("query_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, q = ids[order], q[:, order]
        starts = np.unique(np.searchsorted(ids, ids[::size])).tolist()  # equal ids are one query
        groups = [(ids[x:y], q[:, x:y]) for x, y in zip(starts, [*starts[1:], len(ids)])]
        sent = spark.sparkContext.broadcast(groups)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = iter(batches)
            for first in batches:  # the partition of a group
                ids, q = sent.value[first.column(2)[0].as_py()]
                keys, figures = [], []
                for piece, scores in _steps(chain([first], batches), ids, q, True):
                    keys.append(piece.column(0).to_numpy().copy())  # else the batch stays, with its vectors
                    figures.append(_places_of(scores))
                _rank(ids, np.argsort(np.concatenate(keys), kind="stable"), figures)
                of_rank = finish(share * (1 / (RRF_K + np.arange(1 + max(int(f.max()) for f in figures)))))
                while keys:
                    rank, own = figures.pop().T.reshape(-1), keys.pop()
                    columns = [np.tile(ids, len(own)), np.repeat(own, len(ids)), of_rank[rank]]
                    if not rank.all():
                        columns = [c[rank > 0] for c in columns]
                    yield pa.record_batch([pa.array(c) for c in columns], ["query_id", key, "fused"])

        groups = spark.range(0, len(groups), 1, max(1, len(groups))).withColumnRenamed("id", "part")
        each = units.coalesce(1).hint("shuffle_replicate_nl").crossJoin(groups).select("key", "v", "part")
        return each.mapInArrow(run, f"query_id long, {key} long, fused double")

    return reduce(DataFrame.unionByName, [scored(*block) for block in blocks])


def _rank(ids: np.ndarray, order: np.ndarray, figures: list[np.ndarray]) -> None:
    """Puts ranks from 1 in the place of figures (query, vector), in pieces of vectors whose keys ascend in ``order``; 0 where they are OWN."""
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    for x, y in zip(starts, [*starts[1:], len(ids)]):
        own = np.concatenate([f[x:y] for f in figures], axis=1)[:, order].T.reshape(-1)
        cells = (own.astype(np.int64) << 32) + np.arange(len(own))  # ties go by key
        cells.sort()
        rank = np.empty(len(own), np.int32)
        rank[cells & 0xFFFFFFFF] = np.arange(1, len(own) + 1)
        rank[own == OWN] = 0
        back = np.empty((len(order), y - x), np.int32)
        back[order] = rank.reshape(len(order), -1)
        at = 0
        for f in figures:
            f[x:y] = back[at : at + f.shape[1]].T
            at += f.shape[1]


def _steps_of(keys: np.ndarray) -> bytes:
    """Keys as the steps from one to the next, which are small or alike where keys ascend, and are then shuffled in fewer bytes."""
    return np.diff(keys, prepend=np.int64(0)).tobytes()


def _ranked_with(hits: DataFrame, queries: DataFrame, units: DataFrame, key: str, weight: float, finish: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(query_id, key, fused) of hits (query_id, key, bm25) and the cosines of queries, all of a query in one group."""
    spark = queries.sparkSession
    kinds = "query_id long, keys binary, scores binary"

    def scored(rows: pa.Table, q: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((rows.column("query_id").to_numpy(), q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for piece, scores in _steps(batches, ids, q, True):
                keys, figures = _steps_of(piece.column(0).to_numpy()), _places_of(scores)
                columns = [pa.array(ids), *[pa.array(c, pa.binary()) for c in ([keys] * len(ids), [f.tobytes() for f in figures])]]
                yield pa.record_batch(columns, ["query_id", "keys", "scores"])

        return units.mapInArrow(run, kinds)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, scores = (c.to_numpy() for c in batch.columns)
            order = np.argsort(ids, kind="stable")
            ids, keys, scores = ids[order], keys[order], np.round(scores[order], 9)
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
            cuts = list(zip(starts, [*starts[1:], len(ids)]))
            columns = [pa.array(ids[starts]), pa.array([_steps_of(keys[x:y]) for x, y in cuts], pa.binary()), pa.array([scores[x:y].tobytes() for x, y in cuts], pa.binary())]
            yield pa.record_batch(columns, ["query_id", "keys", "scores"])

    def joined(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
        keys, scores = ([np.frombuffer(x, t) for x in table[c].to_pylist()] for c, t in (("keys", np.int64), ("scores", kind)))
        return np.concatenate([np.zeros(0, np.int64), *map(np.cumsum, keys)]), np.concatenate([np.zeros(0, kind), *scores])

    def ranked(near: pa.Table, text: pa.Table) -> pa.Table:
        (keys, figures), (found, scores) = joined(near, np.int32), joined(text, np.float64)
        keys, figures = keys[figures != OWN], figures[figures != OWN]
        fused, worded = np.empty(len(keys)), np.empty(len(found))
        fused[np.lexsort((keys, figures))] = (1 - weight) * (1 / (RRF_K + np.arange(1, len(keys) + 1)))
        worded[np.lexsort((found, -scores))] = weight * (1 / (RRF_K + np.arange(1, len(found) + 1)))
        order = np.argsort(found)
        at = np.searchsorted(found, keys, sorter=order)
        both = at < len(found)
        both[both] = found[order[at[both]]] == keys[both]
        fused[both] += worded[order[at[both]]]
        alone = ~np.isin(found, keys)
        keys, fused = np.r_[keys, found[alone]], finish(np.r_[fused, worded[alone]])
        order = np.argsort(keys)
        q = (near if len(near) else text)["query_id"][0]
        return pa.table([pa.array(np.full(len(keys), q.as_py())), pa.array(keys[order]), pa.array(fused[order])], ["query_id", key, "fused"])

    packed = reduce(DataFrame.unionByName, [scored(*block) for block in _blocks(queries)])
    texts = hits.select("query_id", key, "bm25").mapInArrow(pack, kinds)
    return packed.groupBy("query_id").cogroup(texts.groupBy("query_id")).applyInArrow(ranked, f"query_id long, {key} long, fused double")


def pool_of(hits: DataFrame, key: str, top_k: int) -> DataFrame:
    """The best max(4 * top_k, 30) of each query by fused score."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("fused", 12)), key))
    return hits.withColumn("pool_rank", rank).where(F.col("pool_rank") <= max(4 * top_k, 30))


def heuristic_score(fused: Column, cosine: Column, text_match: Column) -> Column:
    """What stands in for a re-ranker."""
    return fused + 0.25 * F.coalesce(cosine, F.lit(0.0)) + 0.1 * text_match


def rerank(pool: DataFrame, scorer: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """The pool with ``relevance`` from a scorer, else from the fused score, cosine and text match."""
    own = scorer(pool) if scorer else heuristic_score(F.col("fused"), F.col("cosine"), (F.coalesce("bm25", F.lit(0.0)) > 0).cast("double"))
    return pool.withColumn("relevance", own)


def gate_and_rank(scored: DataFrame, key: str, threshold: float, top_k: int, column: str = "relevance", priority: str | None = None) -> DataFrame:
    """Rows at or over the threshold, ranked by relevance times priority; ``best`` is the best before the gate."""
    best = F.max(column).over(W.partitionBy("query_id"))
    order = F.col(column) * (F.coalesce(priority, F.lit(1.0)) if priority else F.lit(1.0))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round(order, 9)), key))
    passed = scored.withColumn("best", best).where(F.col(column) >= threshold)
    return passed.withColumn("rank", rank).where(F.col("rank") <= top_k)


def expand_context(matches: DataFrame, chunks: DataFrame, radius: int, cap: int) -> DataFrame:
    """(query_id, chunk_id, slot): the best match among its neighbours in reading order, then the others by rank.

    At most ``cap``: neighbours give way to matches where there is not room for all, and the farthest go first. A
    neighbour that is a match itself stays where it is read.
    """
    matches = matches.where(F.col("rank") <= cap)
    first = matches.where("rank = 1").select("query_id", "chunk_id", "document_id", "position")
    near = neighbours(chunks, first.select("document_id", "chunk_id", "position").distinct(), radius)
    around = first.select("query_id", "chunk_id").join(near, "chunk_id").select("query_id", F.col("neighbour_id").alias("chunk_id"), "distance")
    known = matches.select("query_id", "chunk_id", "rank").join(around, ["query_id", "chunk_id"], "full")
    by_turn = W.partitionBy("query_id", F.col("rank").isNull()).orderBy(F.abs("distance"), "distance")
    room = F.lit(cap) - F.count("rank").over(W.partitionBy("query_id"))
    fits = known.withColumn("turn", F.row_number().over(by_turn)).withColumn("room", room).where(F.col("rank").isNotNull() | (F.col("turn") <= F.col("room")))
    place = F.when(F.col("rank") == 1, 0).otherwise(F.coalesce("distance", F.col("rank") + 1_000_000))
    slot = F.row_number().over(W.partitionBy("query_id").orderBy(place))
    return fits.withColumn("slot", slot).select("query_id", "chunk_id", "slot")


def assemble_context(results: DataFrame, most: int) -> DataFrame:
    """(query_id, context): escaped blocks in order up to the first that doesn't fit; a lone first one is cut."""
    def escape(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    block = F.concat(F.lit('<document title="'), escape(F.col("title")), F.lit('">\n'), escape(F.col("content")), F.lit("\n</document>"))
    order = W.partitionBy("query_id").orderBy("rank")
    sized = results.withColumn("block", block).withColumn("end", F.sum(F.length("block") + 1).over(order) - 1)
    fits = F.min((F.col("end") <= most).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) == 1
    kept = sized.withColumn("fits", fits).withColumn("n", F.row_number().over(order)).where(F.col("fits") | (F.col("n") == 1))
    text = F.when(F.col("fits"), F.col("block")).otherwise(F.left("block", F.lit(most)))
    listed = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("block")))).alias("blocks"))
    return listed.select("query_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "\n").alias("context"))


def best_routes(scores: DataFrame, threshold: float, margin: float, default: str) -> DataFrame:
    """(query_id, route, score, lead) from (query_id, route, score) rows of examples.

    The best route wins if it is over the threshold and leads the second by the margin; else the default.
    """
    each = scores.groupBy("query_id", "route").agg(F.max("score").alias("score"))
    ranked = each.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "route")))
    two = ranked.where("n <= 2").groupBy("query_id").agg(
        F.max(F.when(F.col("n") == 1, F.col("route"))).alias("first"),
        F.max(F.when(F.col("n") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("n") == 2, F.col("score"))).alias("second"),
    )
    lead = F.col("score") - F.coalesce("second", F.lit(0.0))
    route = F.when((F.col("score") >= threshold) & (lead >= margin), F.col("first")).otherwise(F.lit(default))
    return two.select("query_id", route.alias("route"), "score", lead.alias("lead"))


def off_topic(lead: Column, best: Column) -> Column:
    """A clear lead of the off-topic route, or no document and no clear lead of another."""
    return (lead >= 0.02) | ((best < 0.001) & (lead > -0.02))


def gram(pairs: DataFrame, q: str = "q", p: str = "p") -> DataFrame:
    """(i, j, qq, qp): sums of products of query and passage components, over all pairs, by one aggregation."""
    each = pairs.select(F.posexplode(q).alias("i", "x"), F.col(q).alias("qs"), F.col(p).alias("ps"))
    cells = each.select("i", "x", F.posexplode(F.arrays_zip(F.col("qs").alias("a"), F.col("ps").alias("b"))).alias("j", "y"))
    return cells.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y.a")).alias("qq"), F.sum(F.col("x") * F.col("y.b")).alias("qp"))


def fit_query_adapter(pairs: DataFrame, ridge: float) -> list[list[float]]:
    """The d x d matrix (Q'Q + ridge I)^-1 Q'P; only d * d sums reach the driver."""
    rows = gram(pairs).collect()
    d = 1 + max((r["i"] for r in rows), default=-1)
    qq, qp = np.zeros((d, d)), np.zeros((d, d))
    for r in rows:
        qq[r["i"], r["j"]], qp[r["i"], r["j"]] = r["qq"], r["qp"]
    return np.linalg.solve(qq + ridge * np.eye(d), qp).tolist()


def apply_adapter(vector: Column, matrix: list[list[float]] | None) -> Column:
    """vector * matrix at length 1; without a matrix only the length changes. The matrix is d x d, a literal."""
    if matrix is None:
        return tx.unit(vector)
    columns = F.array(*[F.array(*[F.lit(float(row[j])) for row in matrix]) for j in range(len(matrix))])
    return tx.unit(F.transform(columns, lambda c: tx.dot(vector, c)))
