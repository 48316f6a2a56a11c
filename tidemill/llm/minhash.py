"""Near-duplicate documents by b-bit MinHash.

A document's signature is the minimum of each of HASHES hash functions over its word shingles. Bands of the full
minima propose candidates; of each minimum only the low BITS bits are kept beyond that, packed as bit planes, so
that a pair's likeness is estimated with a few exclusive-ors and bit counts, corrected for chance agreement. What
the estimate doesn't rule out is confirmed on the full shingle sets.

Documents with equal shingle sets are one class from the start. Within a band's bucket, each class is compared with
the bucket's smallest one only; links found that way merge classes. So a large group of copies costs as many
comparisons as it has members. Classes that share a bucket and are still apart meet in blocks of it: a first pass keeps
those with a partner that the estimate doesn't rule out, a second one has their full sets and returns the links that
join components. Neither returns more rows than it reads, however many pairs are close to the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import cut, lower_words, pieces, shuffles, table
from tidemill.llm.hashing import WordHashes, mix, rolling

#: 32 bands of 4: a pair with likeness 0.8 shares no band with a chance of 4e-8.
BANDS, ROWS = 32, 4
#: Hash functions; the bands take the first ones, the estimate all.
HASHES = 512
#: Low bits kept of each minimum.
BITS = 4
LANES = HASHES // 64
#: An estimate this far below the threshold rules a pair out: almost six standard errors, which takes one pair in 30
#: million at 0.8, no more than share no band.
MARGIN = 0.106
#: Members of a bucket that are compared in one piece, and their shingles (8 MB of hashes).
PIECE, PIECE_SHINGLES = 2048, 1 << 20

_rng = np.random.default_rng(20240101)
_MULTIPLY = _rng.integers(0, 2**32, (HASHES, 1), dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, (HASHES, 1), dtype=np.uint32)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | bytes | None, words: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of lower-cased words; a shorter text is one shingle."""
    found = words.of(lower_words(text))
    if len(found) >= size:
        return np.unique(rolling(found, size))
    return rolling(found, len(found)) + np.uint64(len(found)) if len(found) else np.zeros(0, np.uint64)


def minima(items: np.ndarray) -> np.ndarray:
    """The 32-bit minimum of each hash function over a set that is not empty."""
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    short = (items >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(items), 1024):
        part = short[None, at : at + 1024] * _MULTIPLY
        part += _ADD
        np.minimum(least, part.min(1), out=least)
    return least.astype(np.uint64)


def pack(least: np.ndarray) -> np.ndarray:
    """Bit planes of the low bits of the minima, mixed so that those are even: plane by plane, LANES words each."""
    low = mix(least ^ _SALT)
    planes = [((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8) for b in range(BITS)]
    return np.concatenate([np.packbits(p, bitorder="little").view(np.uint64) for p in planes])


def bands(least: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def signatures(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(key, n, lo, hi, sig, bands) of every row; lo and hi name the shingle set, and are null where it is empty.

    The keys go through as they came, whatever their type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in pieces(batches):
            rows: list[tuple] = []
            for t in batch.column(1).cast(pa.binary()):
                items = shingles(t.as_py(), words, size)
                if len(items):
                    least = minima(items)
                    # an order-free sum and a sum of mixed values
                    names = items.sum().view(np.int64), mix(items ^ _SALT).sum().view(np.int64)
                    rows.append((len(items), *names, pack(least).view(np.int64), bands(least).view(np.int64)))
                else:
                    rows.append((0, None, None, None, None))
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
            yield pa.record_batch([batch.column(0), *columns], ["key", "n", "lo", "hi", "sig", "bands"])

    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n long, lo long, hi long, sig array<long>, bands array<long>"
    )


def estimate(a: Column, b: Column) -> Column:
    """Likeness from packed signatures: agreeing positions, less those that agree by chance."""
    unlike = None
    for lane in range(LANES):
        differs = None
        for plane in range(BITS):
            x = a[plane * LANES + lane].bitwiseXOR(b[plane * LANES + lane])
            differs = x if differs is None else differs.bitwiseOR(x)
        count = F.bit_count(differs)
        unlike = count if unlike is None else unlike + count
    chance = 2.0**-BITS
    return (1 - unlike / F.lit(float(HASHES)) - chance) / (1 - chance)


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, size: int, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets share ``percent`` of their union, with both sizes.

    The texts are shuffled by key once for both joins; a key in many pairs is left to the skew join.
    """
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col(key).isNotNull())
    left = pairs.join(texts.withColumnsRenamed({"key": "a", "text": "text_a"}), "a")
    both = left.join(texts.withColumnsRenamed({"key": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, held = WordHashes(), None, None
        for batch in pieces(batches):
            keep = []
            for x, y in zip(batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())):
                x, y = x.as_py(), y.as_py()
                if y != last:
                    last, held = y, shingles(y, words, size)
                mine = shingles(x, words, size)
                shared = len(np.intersect1d(mine, held, assume_unique=True))
                keep.append(100 * shared >= percent * (len(mine) + len(held) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = docs.schema[key].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node it can reach.

    Large-star and small-star steps in turn, each one aggregation and one join, until nothing changes. The number of
    rounds follows the logarithm of the longest path.
    """
    now, before = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        to_least = down.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(to_least.unionByName(small.select("a", F.col("m").alias("b"))).distinct())


def near_components(
    docs: DataFrame, percent: int = 80, size: int = 5, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Documents are linked where their sets of ``size``-word shingles share at least ``percent`` of their union;
    component_id is the smallest key that can be reached, and kept says whether it is the row's own. A text with
    fewer words is one shingle; null texts and texts without words are linked with nothing. Rows with a null key are
    kept and have a null component. Repeated rows have the same key, hence the same component, and repeat; ties (equal
    sets) go to the smallest key. Texts of any length are taken whole; a task holds one of them, and a bounded number of
    word hashes. An empty table gives an empty one; other columns are left out, so their names don't matter. The input
    must give the same rows each time it is read.
    """
    signed = cut(signatures(docs, size, key, text))
    used = signed.where((F.col("n") > 0) & F.col("key").isNotNull())
    classes = cut(
        used.groupBy("lo", "hi", "n").agg(
            F.min("key").alias("rep"), F.min_by("sig", "key").alias("sig"), F.min_by("bands", "key").alias("bands")
        )
    )
    sigs = classes.select("rep", "sig")
    buckets = classes.select("rep", "n", F.explode("bands").alias("band"))
    least = 0.01 * percent - MARGIN

    def alike(pairs: DataFrame) -> DataFrame:
        a, b = sigs.withColumnsRenamed({"rep": "a", "sig": "sig_a"}), sigs.withColumnsRenamed({"rep": "b", "sig": "sig_b"})
        joined = pairs.join(a, "a").join(b, "b")
        return joined.where(estimate(F.col("sig_a"), F.col("sig_b")) >= least).select("a", "b")

    firsts = buckets.groupBy("band").agg(F.min("rep").alias("first"), F.count("*").alias("members")).where("members > 1")
    met = buckets.join(firsts, "band").where("rep <> first")
    tested = cut(alike(met.select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()))
    stars = cut(confirmed(tested, docs, percent, size, key, text))

    roots = components(stars)
    shared = buckets.join(firsts.select("band"), "band", "left_semi")
    labelled = shared.join(roots, F.col("rep") == F.col("node"), "left").select(
        "band", "rep", "n", F.coalesce("root", "rep").alias("root")
    )
    ends = labelled.groupBy("band").agg(
        F.min("root").alias("from"), F.max("root").alias("to"), F.count("*").alias("members"), F.sum("n").alias("shingles")
    )
    mixed = ends.where(F.col("from") != F.col("to")).select("band", "members", "shingles")
    apart = labelled.drop("n").join(mixed, "band").join(classes.select("rep", "lo", "hi", "sig", "bands"), "rep")
    links = cut(links_in_blocks(not_ruled_out(in_blocks(apart), least), docs, percent, size, key, text, least))
    if links.take(1):
        roots = components(stars.unionByName(links))

    of_class = classes.select("lo", "hi", "n", "rep").join(roots, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("lo", "hi", "n", F.coalesce("root", "rep").alias("component"))
    placed = signed.select("key", "n", "lo", "hi").join(of_class, ["lo", "hi", "n"], "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    return placed.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"),
    )


BLOCK = ["band", "p", "q"]


def in_blocks(members: DataFrame) -> DataFrame:
    """The members of buckets, dealt to blocks (band, p, q) in which each two of a bucket meet once.

    A bucket is cut into pieces of about PIECE members or PIECE_SHINGLES, and each two pieces are a block, so that what
    meets is bounded. Many small blocks share a chunk.
    """
    count = F.greatest(F.ceil(F.col("members") / PIECE), F.ceil(F.col("shingles") / PIECE_SHINGLES)).cast("int")
    mine = F.pmod(F.xxhash64("rep"), count).cast("int")
    dealt = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    return dealt.select(
        "band", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine",
        "rep", "root", "lo", "hi", "sig", "bands",
    )


def chunks(blocks: DataFrame) -> Column:
    return F.pmod(F.xxhash64(*BLOCK), F.lit(16 * shuffles(blocks.sparkSession))).alias("chunk")


def partners(rows: pa.Table, least: float) -> Iterator[tuple[np.ndarray, Iterator[tuple[int, np.ndarray]]]]:
    """Of each block of rows, which are sorted by block and rep: its range, and (i, earlier rows) that may be alike.

    Those have another root, an estimate of ``least`` or more, and no common band before the block's.
    """
    most = int((1 - (least * (1 - 2.0**-BITS) + 2.0**-BITS)) * HASHES + 1e-6)
    sig = rows["sig"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rows), BITS, LANES)
    every = rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(rows), BANDS)
    root = rows["root"].combine_chunks().dictionary_encode().indices.to_numpy()
    mine = rows["mine"].to_numpy()
    where = np.stack([rows[c].to_numpy().astype(np.int64) for c in BLOCK], 1)
    within, turn = where[:, 1] == where[:, 2], (every == where[:, :1]).argmax(1)

    def pairs(begin: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(begin + 1, end):
            js = begin + np.flatnonzero((root[begin:i] != root[i]) & (within[i] | (mine[begin:i] != mine[i])))
            if len(js):
                unlike = np.bitwise_count(np.bitwise_or.reduce(sig[js] ^ sig[i], axis=1)).sum(1)
                js = js[unlike <= most]
                js = js[(every[js] == every[i]).argmax(1) == turn[i]]
                if len(js):
                    yield i, js

    starts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(1)])
    for begin, end in zip(starts, np.r_[starts[1:], len(rows)]):
        if (root[begin:end] != root[begin]).any():
            yield np.arange(begin, end), pairs(begin, end)


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by([(c, "ascending") for c in (*BLOCK, "rep")])


def not_ruled_out(blocks: DataFrame, least: float) -> DataFrame:
    """The rows of blocks that have a partner there."""

    def run(rows: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        keep = np.zeros(len(rows), bool)
        for _, pairs in partners(rows, least):
            for i, js in pairs:
                keep[i] = keep[js] = True
        return rows.drop_columns("chunk").filter(pa.array(keep))

    return blocks.withColumn("chunk", chunks(blocks)).groupBy("chunk").applyInArrow(run, blocks.schema)


def links_in_blocks(
    blocks: DataFrame, docs: DataFrame, percent: int, size: int, key: str, text: str, least: float
) -> DataFrame:
    """Links (a, b), a > b, that join components in a block, by full shingle sets: fewer than the block's rows."""
    blocks = cut(blocks)
    kind = docs.schema[key].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in pieces(batches, 100):
            found = [shingles(t.as_py(), words, size) for t in batch.column(1).cast(pa.binary())]
            lo = [x.sum().view(np.int64) for x in found]
            hi = [mix(x ^ _SALT).sum().view(np.int64) for x in found]
            items = pa.array([x.tobytes() for x in found], pa.binary())
            yield pa.record_batch([batch.column(0), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), items], ["rep", "lo", "hi", "items"])

    wanted = blocks.select("rep").distinct()
    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("text")).join(wanted, "rep", "left_semi")
    named = texts.mapInArrow(sets, f"rep {kind}, lo long, hi long, items binary").dropDuplicates(["rep", "lo", "hi"])
    full = blocks.join(named, ["rep", "lo", "hi"])

    def run(rows: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["items"].combine_chunks()]
        component = rows["root"].combine_chunks().dictionary_encode().indices.to_numpy().copy()
        a, b = [], []
        for own, pairs in partners(rows, least):
            first, sizes = own[0], np.array([len(items[i]) for i in own])
            shingle, ids = np.unique(np.concatenate([items[i] for i in own]), return_inverse=True)
            ends = np.cumsum(sizes)
            of = [ids[e - n : e] for e, n in zip(ends, sizes)]
            marked = np.zeros(len(shingle), bool)
            for i, js in pairs:
                js = js[component[js] != component[i]]
                if not len(js):
                    continue
                lengths = sizes[js - first]
                marked[of[i - first]] = True
                hits = marked[np.concatenate([of[j - first] for j in js])]
                marked[of[i - first]] = False
                both = np.add.reduceat(hits, np.cumsum(lengths) - lengths, dtype=np.int64)
                for j in js[100 * both >= percent * (lengths + sizes[i - first] - both)]:
                    if component[j] != component[i]:
                        component[own[component[own] == component[j]]] = component[i]
                        a.append(i)
                        b.append(j)
        return pa.table([rows["rep"].take(pa.array(a, pa.int64())), rows["rep"].take(pa.array(b, pa.int64()))], ["a", "b"])

    return full.withColumn("chunk", chunks(full)).groupBy("chunk").applyInArrow(run, f"a {kind}, b {kind}")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents on shingles of four words."""
    return near_components(table(spark, sf_dir, "documents"), size=4)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN size p ON p.doc_id = a.doc_id JOIN size q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n
  HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS r FROM documents
  UNION
  SELECT link.x, reach.r FROM reach JOIN link ON link.y = reach.x)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, c.r AS component_id, d.doc_id = c.r AS kept
FROM documents d LEFT JOIN size USING (doc_id)
JOIN (SELECT x, min(r) AS r FROM reach GROUP BY x) c ON c.x = d.doc_id
"""
