"""Removal of passages that repeat an earlier document, by fixed-block anchors.

Every document's words are cut into blocks of BLOCK words from its start; these are the reference index. Every run
of BLOCK words at any position is a probe. A window of 2 * BLOCK - 1 = 13 words holds a whole block wherever it
starts, so where two documents share a window, a probe of one hits a block of the other. Hits are then extended:
the windows around them are compared as a whole, and windows that repeat an earlier document cover its maximal
exact repeats.

    probes and blocks --by hash--> hits --by document--> windows at hits --by hash--> repeats --by document--> text

The four shuffles carry packed arrays, a few bytes a probe, hit or window; the texts are shuffled once and used
twice. Groups are ranges of a hash, so frequent passages are spread by their many words, and a group holds
one or more of its many parts, not all that a key has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import shuffles, table
from tidemill.llm.hashing import WordHashes, mix, rolling
from tidemill.llm.packing import pack_places, split_by, unpack_places

BLOCK = 7
WINDOW = 2 * BLOCK - 1
#: Bytes of text of a part, about; the number of parts and buckets follows the input.
PART_BYTES = 12_000_000
#: Probes that are packed together at most.
BATCH = 4_000_000

_U32 = np.uint64(32)


def _bytes(column: pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _bucket(hashes: np.ndarray, count: int) -> np.ndarray:
    return (((hashes >> _U32) * np.uint64(count)) >> _U32).astype(np.int64)


def _probe_rows(docs: Iterator[tuple[int | None, bytes | None]], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, hashes, places) of all runs of BLOCK words."""
    words = WordHashes()
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        hashes = np.concatenate([h for _, h in held])
        keys = np.repeat(np.array([k for k, _ in held], np.int64), [len(h) for _, h in held])
        places = np.concatenate([np.arange(len(h), dtype=np.uint32) for _, h in held])
        out: tuple[list, list, list] = ([], [], [])
        for bucket, at in split_by(_bucket(hashes, buckets), buckets):
            out[0].append(bucket)
            out[1].append(hashes[at].astype(np.uint32).tobytes())
            out[2].append(pack_places(keys[at], places[at]))
        return pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["bucket", "hashes", "places"])

    for key, text in docs:
        if key is None or not text:
            continue
        runs = rolling(words.of(text.split()), BLOCK)
        if len(runs):
            held.append((key, runs))
            size += len(runs)
        if size >= BATCH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _joined(hashes: list[bytes], places: list[bytes], dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pairs = [unpack_places(p) for p in places]
    return (
        np.concatenate([np.frombuffer(h, dtype) for h in hashes]),
        np.concatenate([k for k, _ in pairs]),
        np.concatenate([p for _, p in pairs]),
    )


def _by_part(keys: np.ndarray, places: np.ndarray, parts: int) -> pa.Table:
    """(part, places) of the documents' places."""
    out: tuple[list, list] = ([], [])
    if len(keys):
        order = np.lexsort((places, keys))
        keys, places = keys[order], places[order]
        for part, at in split_by(np.mod(keys, parts), parts):
            out[0].append(part)
            out[1].append(pack_places(keys[at], places[at]))
    return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["part", "places"])


def _grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, where each group of equal hashes begins, and how many it has."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return order, starts, np.diff(np.r_[starts, len(ordered)])


def _hits(group: pa.Table, parts: int) -> pa.Table:
    """Probes that hit a block of an earlier document, and blocks that a later document's probe hits."""
    hashes, keys, places = _joined(group["hashes"].to_pylist(), group["places"].to_pylist(), np.uint32)
    order, starts, counts = _grouped(hashes)
    keys, places = keys[order], places[order]
    block = places % BLOCK == 0
    earliest = np.minimum.reduceat(np.where(block, keys, np.iinfo(np.int64).max), starts)
    latest = np.maximum.reduceat(keys, starts)
    hit = (keys > np.repeat(earliest, counts)) | (block & (keys < np.repeat(latest, counts)))
    return _by_part(keys[hit], places[hit], parts)


def _repeats(group: pa.Table, parts: int) -> pa.Table:
    """Windows that an earlier document has too."""
    hashes, keys, places = _joined(group["hashes"].to_pylist(), group["places"].to_pylist(), np.uint64)
    order, starts, counts = _grouped(hashes)
    keys, places = keys[order], places[order]
    again = keys > np.repeat(np.minimum.reduceat(keys, starts), counts)
    return _by_part(keys[again], places[again], parts)


def _places_of(found: pa.Table) -> dict[int, np.ndarray]:
    """The distinct places of each document."""
    pairs = [unpack_places(p) for p in found["places"].to_pylist()]
    if not pairs:
        return {}
    keys, places = np.concatenate([k for k, _ in pairs]), np.concatenate([p for _, p in pairs])
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return dict(zip(keys[starts].tolist(), map(np.unique, np.split(places, starts[1:]))))


def _offsets(keys: list, texts: list[bytes | None]) -> list[int]:
    """Where the places of each row begin: 0, but rows of one key with other texts follow each other."""
    rows: dict = {}
    for i, key in enumerate(keys):
        rows.setdefault(key, []).append(i)
    offsets = [0] * len(keys)
    for own in rows.values():
        if len(own) > 1:
            at, begins = 0, {}
            for text in sorted({texts[i] or b"" for i in own}):
                begins[text] = at
                at += len(text.split())
            for i in own:
                offsets[i] = begins[texts[i] or b""]
    return offsets


def _covered(starts: np.ndarray, before: int, after: int, size: int) -> np.ndarray:
    """Whether each of ``size`` places is in start - before ... start + after for some start."""
    starts = starts[starts - before < size]
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, np.maximum(starts - before, 0), 1)
    np.add.at(edge, np.minimum(starts + after + 1, size), -1)
    return np.cumsum(edge[:-1]) > 0


def _window_rows(texts: pa.Table, found: pa.Table, buckets: int) -> pa.Table:
    """(bucket, hashes, places) of the windows that hold a hit, for the documents of a part."""
    words, hits = WordHashes(), _places_of(found)
    seed = np.uint64(0xD6E8FEB86659FD93)
    hashes, other, keys, places = [], [], [], []
    all_keys, all_texts = texts["key"].to_pylist(), _bytes(texts["text"])
    for key, text, offset in zip(all_keys, all_texts, _offsets(all_keys, all_texts)) if hits else ():
        own = hits.get(key)
        if own is None or not text:
            continue
        each = words.of(text.split())
        if len(each) < WINDOW:
            continue
        at = np.flatnonzero(_covered(own, BLOCK - 1, 0, len(each) - WINDOW + 1))
        hashes.append(rolling(each, WINDOW)[at])
        other.append(rolling(mix(each ^ seed), WINDOW)[at])
        keys.append(np.full(len(at), key, np.int64))
        places.append(at + offset)
    out: tuple[list, list, list] = ([], [], [])
    if hashes:
        h, o, k, p = (np.concatenate(x) for x in (hashes, other, keys, places))
        for bucket, at in split_by(_bucket(o, buckets), buckets):
            out[0].append(bucket)
            out[1].append(h[at].tobytes())
            out[2].append(pack_places(k[at], p[at]))
    return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["bucket", "hashes", "places"])


def _kept(texts: pa.Table, found: pa.Table) -> pa.Table:
    """The rows of a part with their words counted and repeats removed."""
    repeats, n_words, n_removed, kept = _places_of(found), [], [], []
    all_keys, all_texts = texts["key"].to_pylist(), _bytes(texts["text"])
    for key, text, offset in zip(all_keys, all_texts, _offsets(all_keys, all_texts)):
        words = (text or b"").split()
        starts = repeats.get(key)
        removed = 0
        n_words.append(len(words))
        if starts is not None:
            starts = starts[(starts >= offset) & (starts < offset + len(words))] - offset
            gone = _covered(starts, 0, WINDOW - 1, len(words))
            removed = int(gone.sum())
            words = [w for w, g in zip(words, gone) if not g]
        n_removed.append(removed)
        kept.append(b" ".join(words))
    return pa.table(
        [
            texts["row"],
            texts["text"],
            pa.array(n_words, pa.int64()),
            pa.array(n_removed, pa.int64()),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ],
        ["row", "text", "n_words", "n_removed", "kept"],
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with (n_words, n_removed, kept): the text's words that repeat no earlier document.

    A word goes if some 13-word window over it, in the text as given, also starts in a document with a smaller key.
    Kept words are joined by one space and are unchanged; null texts have none. Keys are whole numbers; rows with a
    null key lose nothing and are no reference, rows with the same key are not earlier than each other. Columns
    named like the three new ones are replaced; others stay. Texts under 13 words stay as they are, of longer ones every
    word is looked at; of equal texts (ties) the one with the smallest key stays whole, and repeated rows of one key lose
    the same words. An empty table gives an empty one.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(24, math.ceil(size / PART_BYTES))  # rows between buckets and parts are a few large ones, not many small ones
    count = max(2 * shuffles(docs.sparkSession), 2 * parts)
    new = ("n_words", "n_removed", "kept")
    others = [c for c in docs.columns if c not in (*new, text)]
    row = F.struct(F.lit(0).alias("__row"), *[F.col(f"`{c}`") for c in others])
    own = F.pmod(F.coalesce(F.col(key).cast("long"), F.xxhash64(text)), F.lit(parts)).cast("int")
    placed = docs.select(own.alias("part"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"), row.alias("row"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, t) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()))
        yield from _probe_rows(rows, count)

    packed, by_doc = "bucket int, hashes binary, places binary", "part int, places binary"
    hits = placed.select("key", "text").mapInArrow(probe, packed).groupBy("bucket").applyInArrow(lambda g: _hits(g, parts), by_doc)
    by_part = placed.groupBy("part")
    windows = by_part.cogroup(hits.groupBy("part")).applyInArrow(lambda t, h: _window_rows(t, h, count), packed)
    repeats = windows.groupBy("bucket").applyInArrow(lambda g: _repeats(g, parts), by_doc)
    schema = placed.select("row", "text").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    done = by_part.cogroup(repeats.groupBy("part")).applyInArrow(_kept, schema)
    back = [F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in new]
    return done.select(*back, *new)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document when words that repeat an earlier document are gone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
again AS (
  SELECT win.doc_id, win.i FROM win JOIN (SELECT s, min(doc_id) AS first FROM win GROUP BY s) f USING (s)
  WHERE f.first < win.doc_id),
gone AS (
  SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM again) GROUP BY doc_id),
left_over AS (
  SELECT words.doc_id, len(w) AS n_words, coalesce(len(js), 0) AS n_removed,
    list_filter(w, lambda x, i: js IS NULL OR NOT list_contains(js, i)) AS kept
  FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM left_over
"""
