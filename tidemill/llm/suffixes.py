"""Removal of every byte that a string of LENGTH bytes covers which starts anywhere else too, by suffix sorting.

Only suffixes that may share LENGTH bytes are sorted. Equal texts are one text that counts twice. Of each window of
LENGTH bytes, the least hash of its runs of ``gram`` bytes names a bucket; equal windows have equal names, so neighbouring
windows with the same minimum and the bytes they cover, a *context*, need to be compared only inside their bucket:

    texts --contexts, by bucket--> buckets of two or more --equal contexts settled--> contexts with others --> suffix arrays

Contexts that occur twice as a whole are repeats in all their windows. The others' bytes go to cells of whole buckets;
there a suffix array is made by bucket-pointer refinement: suffixes begin in buckets of equal first Q bytes, and a bucket is
refined by sorting its suffixes on the bucket pointers at a later offset, which already tell apart as many bytes; the
new pointers are used by the next refinement, so that the known depth doubles until it is LENGTH. Suffixes that still
share a bucket then are repeats.

A bucket that more than MOST distinct contexts share (a line that very many texts have) is not put into one cell: its
contexts are dealt anew by longer runs of bytes (``GRAMS``), in rounds, until every bucket is small. Runs of LENGTH bytes
end this, as all windows of such a bucket are equal.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import cut, shared_dir, shuffles, table
from tidemill.llm.hashing import mix

LENGTH = 200
#: Bytes of the runs that name buckets, at first and in each further round.
GRAMS = (64, 132, 166, 183, 192, 196, 198, 199, 200)
#: Distinct contexts of a bucket that go to one cell, and bytes of a cell, about.
MOST, CELL_BYTES = 2_000, 800_000
#: Bytes that tell buckets apart at first.
Q = 8
#: Windows that are looked at together.
SEGMENT = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)

CONTEXT = "key long, name long, h binary, start int, wins int, times int"


def run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` bytes, from hashes of runs of powers of two."""
    run, length, step = _BYTES[data], 1, np.array([_BASE])
    out, covered = None, 0
    while True:
        if size & length:
            if out is None:
                out, covered = run, length
            else:
                n = len(run) - covered
                out = out[:n] * step + run[covered:]
                covered += length
        if 2 * length > size:
            return mix(out)
        run = run[: len(run) - length] * step + run[length:]
        length, step = 2 * length, step * step


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values."""
    length = 1
    while 2 * length <= width:
        values, length = np.minimum(values[:-length], values[length:]), 2 * length
    return np.minimum(values[: len(values) - width + length], values[width - length :]) if length < width else values


def contexts(text: bytes, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, first window, number of windows) of a text's contexts: neighbouring windows with the same leftmost minimum.

    Two equal windows have it at the same place in them, so they are never in one context.
    """
    most, total = LENGTH - gram + 1, len(text) - LENGTH + 1
    whole = np.frombuffer(text, np.uint8)
    for begin in range(0, total, SEGMENT):
        runs = run_hashes(whole[begin : begin + SEGMENT + LENGTH - 1], gram)
        names = least(runs, most)
        leaves = runs[: len(names) - 1] == names[:-1]  # the minimum is the first run, which the next window has not
        at = np.flatnonzero(np.r_[True, leaves | (names[1:] != names[:-1])])
        yield names[at].view(np.int64), at + begin, np.diff(np.r_[at, len(names)])


def context_name(context: bytes) -> int:
    return xxhash.xxh3_64_intdigest(context) - (1 << 63)


def _context_rows(h: bytes, times: int, text: bytes, gram: int) -> Iterator[pa.RecordBatch]:
    """A row of each distinct context of a text, and rows with ``times`` 0 for windows that the text repeats itself.

    A context that the text has twice counts twice, as that of a text that is there twice.
    """
    for keys, at, sizes in contexts(text, gram):
        names = np.array([context_name(text[a : a + n + LENGTH - 1]) for a, n in zip(at.tolist(), sizes.tolist())], np.int64)
        _, first, which, often = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
        count = np.minimum(times * often[which], 2)[first]
        own = [keys[first], names[first], at[first], sizes[first], count]
        if len(first) < len(names) and times == 1:
            again = often[which] > 1
            edges = np.flatnonzero(np.diff(np.r_[False, again, False]))
            begins, ends = edges[::2], edges[1::2] - 1
            none = np.zeros(len(begins), np.int64)
            marks = [none, none, at[begins], at[ends] + sizes[ends] - at[begins], none]
            own = [np.concatenate(x) for x in zip(own, marks)]
        key, name, start, wins, n = own
        yield pa.record_batch(
            [pa.array(key), pa.array(name), pa.array([h] * len(key), pa.binary()), *[pa.array(x.astype(np.int32)) for x in (start, wins, n)]],
            ["key", "name", "h", "start", "wins", "times"],
        )


def _joined(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def find_contexts(texts: DataFrame) -> DataFrame:
    """The contexts of (h, text, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((h.as_py(), t.as_py(), n.as_py()) for b in batches for h, t, n in zip(*b.columns))
        yield from _joined(made for h, t, n in rows for made in _context_rows(h, min(n, 2), t, GRAMS[0]))

    return texts.select("h", F.col("text").cast("binary").alias("text"), "n").mapInArrow(run, CONTEXT)


def settle(rows: DataFrame) -> DataFrame:
    """rows of buckets with two or more, with ``n``, how often their context is there, ``names``, the bucket's distinct
    contexts, and ``chosen``, true for one row of each context.

    What is known of a context is a table before rows are joined with it, so that Spark can split a frequent one.
    """
    place = F.xxhash64("h", "start")
    named = rows.groupBy("key", "name").agg(F.sum("times").alias("n"), F.min(place).alias("first"))
    of_bucket = named.groupBy("key").agg(F.count("*").alias("names"), F.sum("n").alias("total")).where("total > 1").drop("total")
    known = cut(named.join(of_bucket, "key"))
    return cut(rows.join(known, ["key", "name"]).withColumn("chosen", place == F.col("first")).drop("first"))


def _marks(settled: DataFrame) -> DataFrame:
    """Windows that are repeats since their whole context is; rows that count twice are known already."""
    return settled.where("n > 1 AND times = 1").select("h", "start", "wins")


def _open(settled: DataFrame) -> DataFrame:
    """One row of each context that has others in its bucket; ``times``: 2 if it is settled itself."""
    times = F.least(F.col("n"), F.lit(2)).cast("int")
    return settled.where("names > 1 AND chosen").withColumn("times", times)


def fetch(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with the bytes of each context."""
    of_text = wanted.groupBy("h").agg(F.collect_list(F.struct("key", "names", "start", "wins", "times")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "names", "start", "wins", "times"]
        for b in batches:
            for h, text, found in zip(*(b.column(c) for c in ("h", "text", "found"))):
                own, text = found.values, text.as_py()
                spans = zip(own.field("start").to_pylist(), own.field("wins").to_pylist())
                cuts = [text[s : s + n + LENGTH - 1] for s, n in spans]
                yield pa.record_batch([*map(own.field, names), pa.array([h.as_py()] * len(cuts), pa.binary()), pa.array(cuts, pa.binary())], [*names, "h", "context"])

    both = texts.select("h", F.col("text").cast("binary").alias("text")).join(of_text, "h")
    return cut(both.mapInArrow(lambda b: _joined(run(b), 5_000), "key long, names long, start int, wins int, times int, h binary, context binary"))


def deal_again(hot: DataFrame, gram: int) -> DataFrame:
    """Contexts of hot buckets as smaller ones, in buckets of longer runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                for made in _context_rows(r["h"], r["times"], r["context"], gram):
                    at, sizes = made["start"].to_pylist(), made["wins"].to_pylist()
                    own = pa.array([r["context"][s : s + n + LENGTH - 1] for s, n in zip(at, sizes)], pa.binary())
                    start = pa.array([s + r["start"] for s in at], pa.int32())
                    yield made.set_column(3, "start", start).append_column("context", own)

    dealt = hot.select("h", "start", "times", "context").mapInArrow(lambda b: _joined(run(b), 5_000), CONTEXT + ", context binary")
    return cut(dealt.withColumn("key", F.xxhash64("key", F.lit(gram))))


def refine(pointers: np.ndarray, active: np.ndarray, depth: int, left: np.ndarray, goal: int) -> np.ndarray:
    """Bucket pointers at depth ``goal`` for the suffixes with so many bytes left.

    pointers: for each suffix, the last place of its bucket in the suffix array, where suffixes of a bucket share ``depth``
    bytes. active: suffixes whose bucket holds others. Each bucket is sorted on the pointers ``step`` later, which tell
    ``depth`` more bytes apart, and gets the pointers of its parts; these are what the next call sorts on.
    """
    step = min(depth, goal - depth)
    if not step or not len(active):
        return pointers
    active = active[left[active] >= depth + step]
    pairs = pointers[active] << np.int64(32) | pointers[active + step]
    order = np.argsort(pairs)
    pairs, active = pairs[order], active[order]
    buckets = pairs >> np.int64(32)
    ends = np.flatnonzero(np.r_[pairs[1:] != pairs[:-1], True][: len(pairs)])
    part_end = np.repeat(ends, np.diff(ends, prepend=-1))
    ends_of = np.flatnonzero(np.r_[buckets[1:] != buckets[:-1], True][: len(buckets)])
    bucket_end = np.repeat(ends_of, np.diff(ends_of, prepend=-1))
    pointers = pointers.copy()
    pointers[active] = buckets - (bucket_end - part_end)
    shared = np.diff(ends, prepend=-1) > 1
    return refine(pointers, active[np.repeat(shared, np.diff(ends, prepend=-1))], depth + step, left, goal)


def initial(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pointers, active) of buckets of equal first Q bytes."""
    padded = np.r_[data, np.zeros(Q, np.uint8)].astype(np.uint64)
    grams = np.zeros(len(data), np.uint64)
    for k in range(Q):
        grams = grams << np.uint64(8) | padded[k : k + len(data)]
    own = np.flatnonzero(left >= Q)
    order = np.argsort(grams[own])
    own, grams = own[order], grams[own][order]
    ends = np.flatnonzero(np.r_[grams[1:] != grams[:-1], True][: len(grams)])
    sizes = np.diff(ends, prepend=-1)
    pointers = np.zeros(len(data), np.int64)
    pointers[own] = np.repeat(ends, sizes)
    return pointers, own[np.repeat(sizes > 1, sizes)]


def repeated_windows(found: list[bytes], wins: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """For each context, which of its windows are elsewhere too; contexts with times 2 are there twice."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    begins = np.cumsum(sizes) - sizes
    left = np.repeat(begins + sizes, sizes) - np.arange(sizes.sum())
    pointers, active = initial(np.frombuffer(b"".join(found), np.uint8), left)
    pointers = refine(pointers, active, Q, left, LENGTH)
    ends = np.cumsum(wins)
    windows = np.repeat(begins - ends + wins, wins) + np.arange(wins.sum())
    _, bucket = np.unique(pointers[windows], return_inverse=True)
    weight = np.bincount(bucket, weights=np.repeat(times, wins))
    return np.split(weight[bucket] > 1, ends[:-1])


def sort_cells(found: DataFrame, cells: int) -> DataFrame:
    """(h, start, wins) of the repeats that the cells' suffix arrays show."""

    def run(group: pa.Table) -> pa.Table:
        wins, times = group["wins"].to_numpy().astype(np.int64), group["times"].to_numpy().astype(np.int64)
        marks = repeated_windows(group["context"].to_pylist(), wins, times)
        out: tuple[list, list, list] = ([], [], [])
        for h, start, once, own in zip(group["h"].to_pylist(), group["start"].to_pylist(), (times == 1).tolist(), marks):
            if not once or not own.any():
                continue
            edges = np.flatnonzero(np.diff(np.r_[False, own, False]))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                out[0].append(h)
                out[1].append(start + a)
                out[2].append(b - a)
        return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["h", "start", "wins"])

    cell = F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int")
    return found.select(cell.alias("cell"), "h", "start", "wins", "times", "context").groupBy("cell").applyInArrow(run, "h binary, start int, wins int")


def text_id(text: str):
    """16 bytes of SHA-256."""
    return F.substring(F.unhex(F.sha2(F.col(text), 256)), 1, 16)


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """(h, text, n) of the distinct texts that have a window, as a table whose files are buckets of h.

    Joins on h with it shuffle the other side alone.
    """
    spark = docs.sparkSession
    name = f"tidemill_{uuid.uuid4().hex}"
    # an own column name, since other columns of docs stay out
    own = docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= LENGTH).select(text_id("text").alias("h"), "text")
    counted = own.groupBy("h").agg(F.any_value("text").alias("text"), F.count("*").alias("n"))
    path = f"{shared_dir(spark)}/tidemill/{name}"
    counted.write.bucketBy(shuffles(spark), "h").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, n_removed, n_spans, spans, kept) of each distinct text that loses something; h is ``text_id``."""
    texts = distinct_texts(docs, text)
    every = cut(find_contexts(texts))
    found = every.where("times > 0")
    often = cut(found.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1").select("key"))
    settled = settle(found.join(often, "key", "left_semi"))
    marks, wanted = [every.where("times = 0").select("h", "start", "wins"), _marks(settled)], fetch(texts, _open(settled))
    small = [wanted.where(F.col("names") <= MOST)]
    hot = wanted.where(F.col("names") > MOST)
    for gram in GRAMS[1:]:
        if hot.isEmpty():
            break
        settled = settle(deal_again(hot, gram))
        marks.append(_marks(settled))
        again = _open(settled).select(wanted.columns)
        small.append(again.where(F.col("names") <= MOST) if gram < LENGTH else again)
        hot = again.where(F.col("names") > MOST)
    cases = reduce(DataFrame.unionByName, small)
    size = cases.agg(F.sum(F.octet_length("context"))).first()[0] or 0
    marks.append(sort_cells(cases, max(1, math.ceil(size / CELL_BYTES))))
    by_text = reduce(DataFrame.unionByName, marks).groupBy("h").agg(F.collect_list(F.struct("start", "wins")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, text, n, found in zip(*(b.column(c) for c in ("h", "text", "n", "found"))):
                data = text.as_py()
                gone = np.ones(len(data), bool)
                if n.as_py() == 1:
                    edge, own = np.zeros(len(data) + 1, np.int64), found.values
                    start = own.field("start").to_numpy()
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + own.field("wins").to_numpy() + LENGTH - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                spans = [{"begin": a, "size": z - a} for a, z in zip(edges[::2].tolist(), edges[1::2].tolist())]
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                yield pa.record_batch([pa.array([h.as_py()], pa.binary()), pa.array([int(gone.sum())]), pa.array([len(spans)], pa.int64()), pa.array([spans], _SPANS), pa.array([kept], pa.binary())], ["h", "n_removed", "n_spans", "spans", "kept"])

    joined = texts.select("h", F.col("text").cast("binary").alias("text"), "n").join(by_text, "h", "left")
    return joined.where("n > 1 OR found IS NOT NULL").mapInArrow(lambda b: _joined(run(b), 200), FOUND)


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("size", pa.int32())]))
FOUND = "h binary, n_removed long, n_spans long, spans array<struct<begin:int,size:int>>, kept binary"


def remove_repeated_bytes(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with (n_bytes, n_removed, n_spans, spans, kept): bytes of the text that no string elsewhere repeats.

    A byte goes if a string of LENGTH bytes over it also starts at another place of this or any other text, as the texts are
    given. spans are the maximal runs that go, from byte 0; kept is what is left, as bytes, since a run may begin
    or end inside a character. Null texts are empty; texts under LENGTH bytes stay. Equal texts, and repeated rows,
    go whole; keys play no part. Very long texts are looked at in segments. Columns named like the new ones are
    replaced, others stay; an empty table gives an empty one. Texts are told apart by 128 bits of SHA-256, and
    contexts inside a bucket by 64 bits before their bytes are compared.
    """
    new = ("n_bytes", "n_removed", "n_spans", "spans", "kept")
    found = repeated_spans(docs, text)
    own = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    data = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    left = docs.withColumn("__h", text_id(f"`{text}`")).join(found.withColumnRenamed("h", "__found"), F.col("__h") == F.col("__found"), "left")
    values = _or_whole(found, data)
    return left.select(*own, F.octet_length(data).cast("long").alias("n_bytes"), *values)


def _or_whole(found: DataFrame, data) -> list:
    none = F.array().cast(T.ArrayType(found.schema["spans"].dataType.elementType))
    return [
        F.coalesce(found["n_removed"], F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(found["n_spans"], F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(found["spans"], none).alias("spans"),
        F.coalesce(found["kept"], data).alias("kept"),
    ]


def op11_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents; the texts themselves don't meet what is found, their digests do."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2("kept", 256).alias("kept_sha256")
    found = repeated_spans(docs).select(F.col("h").alias("found"), "n_removed", "n_spans", digest)
    size, whole = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = docs.select("doc_id", size.alias("n_bytes"), whole.alias("whole"))
    h = F.substring(F.unhex("whole"), 1, 16)
    number = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")}
    joined = rows.withColumn("h", h).join(found, F.col("h") == F.col("found"), "left")
    return joined.select("doc_id", "n_bytes", *number.values(), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


#: Texts as hex digits, in parts of 1,000 windows, so that a window is not looked for from the start of a long text.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
parts AS MATERIALIZED (SELECT doc_id, n, p, substr(h, 2000 * p + 1, 2398) AS h FROM (SELECT doc_id, n, h, unnest(range((n - 200) // 1000 + 1)) AS p FROM d WHERE n >= 200)),
win AS MATERIALIZED (SELECT doc_id, 1000 * p + i AS i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, p, h, unnest(range(least(1000, n - 199 - 1000 * p))) AS i FROM parts)),
again AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM again)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM runs GROUP BY doc_id, run),
gone AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM spans GROUP BY doc_id),
left_over AS (
  SELECT doc_id, n, h, n_removed, n_spans, list_transform(range(len(a) + 1), lambda k: [CASE WHEN k = 0 THEN 0 ELSE z[k] END, CASE WHEN k = len(a) THEN n ELSE a[k + 1] END]) AS kept
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(from_hex(CASE WHEN kept IS NULL THEN h ELSE array_to_string(list_transform(kept, lambda s: substr(h, 2 * s[1] + 1, 2 * (s[2] - s[1]))), '') END)) AS kept_sha256
FROM left_over
"""
