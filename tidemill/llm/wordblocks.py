"""Texts as blocks of word numbers, with the distinct words of all blocks met in one place.

A block is a bounded run of one partition's documents: a dictionary of its distinct words, and each document as the
numbers of its words by position. They are two kinds of rows:

    word_rows:   (bucket, block, words, sizes, numbers, weights)  the dictionaries, dealt by a hash of the word
    stream_rows: (block, n_words, keys, flags, counts, stream)    the documents

``both_rows`` makes them in one pass over the input and writes them; the other two take a pass each and write nothing.

Whatever is known of a word is found once for each distinct word, in the group of its bucket, and sent back to the
blocks that have it, a row for each block and bucket; then a block's documents are put together again by position.
A block's name holds a checksum over its dictionary and its documents, so if the input should not read the same
way twice, the names differ and ``whole`` fails instead of mixing words up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import cut
from tidemill.llm.packing import pack_numbers, split_by, unpack_numbers

#: Words by position, and distinct words, from which a block is full.
BLOCK_WORDS, BLOCK_DISTINCT = 3_000_000, 400_000
WORD_ROWS = "bucket int, block string, words binary, sizes binary, numbers binary, weights binary"


@dataclass
class Block:
    name: str
    keys: list
    flags: list
    streams: list[np.ndarray]
    words: list[bytes]


def _blocks(batches: Iterator[pa.RecordBatch], splitter: Callable) -> Iterator[Block]:
    part, turn = TaskContext.get().partitionId(), 0
    split, keys, flags, streams, size = splitter(), [], [], [], 0

    def full() -> Block:
        check = xxhash.xxh3_64()
        words = split.words
        for w in words:
            check.update(w)
            check.update(b"\0")
        for s in streams:
            check.update(len(s).to_bytes(8, "little"))
        check.update(repr(keys).encode())
        return Block(f"{part}-{turn}-{check.hexdigest()}", keys, flags, streams, words)

    for batch in batches:
        columns = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for key, flag, text in zip(*columns):
            streams.append(split.numbers(text))
            keys.append(key)
            flags.append(bool(flag))
            size += len(streams[-1])
            if size >= BLOCK_WORDS or len(split) >= BLOCK_DISTINCT:
                yield full()
                turn += 1
                split, keys, flags, streams, size = splitter(), [], [], [], 0
    if keys:
        yield full()


def _rows(docs: DataFrame, key: str, text: str, flag: Column | None) -> DataFrame:
    flag = F.lit(True) if flag is None else flag
    return docs.select(F.col(key).alias("key"), flag.alias("flag"), F.col(text).alias("text"))


def _dictionary(block: Block, buckets: int) -> Iterator[tuple]:
    """The block's row of each bucket."""
    press, words = zstandard.ZstdCompressor(level=1), block.words
    counted = [s for s, flag in zip(block.streams, block.flags) if flag]
    weights = np.bincount(np.concatenate([*counted, np.zeros(0, np.uint32)]), minlength=len(words)).astype(np.uint32)
    dealt = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
    for bucket, at in split_by(dealt, buckets):
        own = [words[i] for i in at]
        sizes = np.fromiter(map(len, own), np.uint32, len(own))
        yield (
            bucket, block.name, press.compress(b"".join(own)), pack_numbers(sizes),
            pack_numbers(np.diff(at, prepend=0).astype(np.uint32)), pack_numbers(weights[at]),
        )


def _documents(block: Block) -> tuple:
    counts = np.fromiter(map(len, block.streams), np.uint32, len(block.streams))
    stream = np.concatenate(block.streams).astype(np.uint32)
    return block.name, len(block.words), block.keys, block.flags, pack_numbers(counts), pack_numbers(stream)


_WORD_TYPES = [pa.int32(), pa.string()] + [pa.binary()] * 4
_WORD_NAMES = ["bucket", "block", "words", "sizes", "numbers", "weights"]
_STREAM_NAMES = ["block", "n_words", "keys", "flags", "counts", "stream"]


def _stream_types(key: pa.DataType) -> list[pa.DataType]:
    return [pa.string(), pa.int32(), pa.list_(key), pa.list_(pa.bool_()), pa.binary(), pa.binary()]


def _made(row: tuple, types: list, names: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], k) for v, k in zip(row, types)], names)


def _typed(batches: Iterator[pa.RecordBatch], splitter: Callable) -> Iterator[tuple[Block, pa.DataType]]:
    """Each block, and the type of its keys."""
    kind = pa.null()

    def seen() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for b in batches:
            kind = b.schema.field(0).type
            yield b

    for block in _blocks(seen(), splitter):
        yield block, kind


def word_rows(docs: DataFrame, splitter: Callable, buckets: int, key: str, text: str, flag: Column | None = None) -> DataFrame:
    """The dictionaries; weights are how often the block's flagged documents have each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, splitter):
            for row in _dictionary(block, buckets):
                yield _made(row, _WORD_TYPES, _WORD_NAMES)

    return _rows(docs, key, text, flag).mapInArrow(run, WORD_ROWS)


def stream_rows(docs: DataFrame, splitter: Callable, key: str, text: str, flag: Column | None = None) -> DataFrame:
    """The documents as numbers of words."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, arrow in _typed(batches, splitter):
            yield _made(_documents(block), _stream_types(arrow), _STREAM_NAMES)

    schema = f"block string, n_words int, keys array<{kind}>, flags array<boolean>, counts binary, stream binary"
    return _rows(docs, key, text, flag).mapInArrow(run, schema)


def both_rows(
    docs: DataFrame, splitter: Callable, buckets: int, key: str, text: str, flag: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(word_rows, stream_rows), read back from one table, so that the input is read and split once."""
    kind = docs.schema[key].dataType.simpleString()
    names = [*_WORD_NAMES, *_STREAM_NAMES[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, arrow in _typed(batches, splitter):
            types = [*_WORD_TYPES, *_stream_types(arrow)[1:]]
            for row in _dictionary(block, buckets):
                yield _made((*row, *[None] * 5), types, names)
            name, *rest = _documents(block)
            yield _made((None, name, *[None] * 4, *rest), types, names)

    rest = f"n_words int, keys array<{kind}>, flags array<boolean>, counts binary, stream binary"
    made = cut(_rows(docs, key, text, flag).mapInArrow(run, f"{WORD_ROWS}, {rest}"))
    return made.where("bucket IS NOT NULL").select(_WORD_NAMES), made.where("bucket IS NULL").select(_STREAM_NAMES)


def words_in(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, numbers, weights) of one row of word_rows."""
    data = zstandard.ZstdDecompressor().decompress(row["words"])
    ends = np.cumsum(unpack_numbers(row["sizes"], np.uint32).astype(np.int64)).tolist()
    words = [data[a:b] for a, b in zip([0, *ends], ends)]
    numbers = np.cumsum(unpack_numbers(row["numbers"], np.uint32).astype(np.int64))
    return words, numbers, unpack_numbers(row["weights"], np.uint32)


def numbers_in(row: dict) -> np.ndarray:
    return np.cumsum(unpack_numbers(row["numbers"], np.uint32).astype(np.int64))


def whole(streams: pa.Table, rows: pa.Table) -> dict | None:
    """The only row of a block's streams, if there is one; fails unless every word of the block has come back."""
    own = streams.to_pylist()
    found = sum(len(numbers_in({"numbers": n})) for n in rows["numbers"].to_pylist())
    if len(own) != 1 or found != own[0]["n_words"]:
        raise RuntimeError("the input did not read the same way twice; write it to a table first")
    return own[0]


def documents_in(row: dict) -> Iterator[np.ndarray]:
    """Each document's word numbers, in the order of keys."""
    counts = unpack_numbers(row["counts"], np.uint32).astype(np.int64)
    stream = unpack_numbers(row["stream"], np.uint32)
    return iter(np.split(stream, np.cumsum(counts)[:-1]))
