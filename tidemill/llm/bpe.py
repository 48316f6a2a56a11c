"""Byte-level BPE: every distinct pre-token of the corpus is encoded once.

Documents are split into pre-tokens, numbered by position in blocks (wordblocks). The distinct pre-tokens of all
blocks meet by a hash; there each is encoded once, whatever the number of blocks that have it, and the ids go back
to the blocks, where they are put in place by position. Decoding looks each id up in the table of token bytes,
which is as large as the vocabulary file and is broadcast.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import wordblocks
from tidemill.llm.common import shuffles, table
from tidemill.llm.packing import pack_numbers, unpack_numbers
from tidemill.llm.pretokens import Pretokens

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Tokens of a vocabulary that may be broadcast.
MOST_TOKENS = 1_000_000
#: Documents of one output batch.
OUT = 250


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    if len(ranks) > MOST_TOKENS:
        raise ValueError(f"{len(ranks)} tokens are too many to broadcast")
    return ranks


class _Split(Pretokens):
    @property
    def words(self) -> list[bytes]:
        return [w.encode() for w in self.number]


def _ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class TokenBytes:
    """The table of token bytes, flat."""

    sizes: np.ndarray
    begins: np.ndarray
    flat: np.ndarray

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> TokenBytes:
        tokens = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            tokens[rank] = piece
        sizes = np.array([len(t) for t in tokens], np.int64)
        return cls(sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(tokens), np.uint8))

    def decode(self, ids: np.ndarray) -> bytes:
        return self.flat[_ragged(self.begins[ids], self.sizes[ids])].tobytes()


def encode(
    docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", pattern: str = public_tokenizers.PATTERN, decoded: bool = False
) -> DataFrame:
    """(key, ids) of every whole text: its pre-tokens' ids in order, without special tokens.

    With ``decoded``, also the bytes that the ids decode to, by the task that has put them in place, so that a
    second Python process beside it is not needed.
    Null and empty texts have no ids. Very long texts are taken whole, each within one block; a pre-token may have any
    length. Repeated rows repeat, null keys stay, other columns are left out; an empty table gives an empty one. The input must give the same rows in the same order each time it is read.
    """
    ranks = read_ranks(path or public_tokenizers.path(RANKS))
    spark = docs.sparkSession
    sent, buckets = spark.sparkContext.broadcast(ranks), 2 * shuffles(spark)
    tokens = spark.sparkContext.broadcast(TokenBytes.of(ranks)) if decoded else None

    def splitter() -> _Split:
        return _Split(pattern)

    def encoded(group: pa.Table) -> pa.Table:
        coder = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=sent.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        out: tuple[list, ...] = ([], [], [], [])
        for row in group.to_pylist():
            words, _, _ = wordblocks.words_in(row)
            each = []
            for w in words:
                ids = known.get(w)
                if ids is None:
                    known[w] = ids = coder.encode_ordinary(w.decode())
                each.append(ids)
            out[0].append(row["block"])
            out[1].append(row["numbers"])
            out[2].append(pack_numbers(np.fromiter(map(len, each), np.uint32, len(each))))
            out[3].append(pack_numbers(np.array([i for ids in each for i in ids], np.uint32)))
        kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, k) for v, k in zip(out, kinds)], ["block", "numbers", "counts", "ids"])

    def placed(streams: pa.Table, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        own = wordblocks.whole(streams, rows)
        parts = rows.to_pylist()
        sizes = np.zeros(own["n_words"], np.int64)
        begins = np.zeros(own["n_words"], np.int64)
        flat = [unpack_numbers(r["ids"], np.uint32) for r in parts]
        at = 0
        for r, ids in zip(parts, flat):
            n = wordblocks.numbers_in(r)
            counts = unpack_numbers(r["counts"], np.uint32).astype(np.int64)
            sizes[n] = counts
            begins[n] = at + np.cumsum(counts) - counts
            at += len(ids)
        every = np.concatenate([*flat, np.zeros(0, np.uint32)]).astype(np.int32)
        keys, made = streams["keys"].combine_chunks().flatten(), []
        for k, doc in enumerate(wordblocks.documents_in(own)):
            made.append(every[_ragged(begins[doc], sizes[doc])])
            if len(made) == OUT or k == len(keys) - 1:
                offsets = np.cumsum([0, *map(len, made)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made)))
                columns = [keys[k + 1 - len(made) : k + 1], lists]
                if tokens:
                    columns.append(pa.array([tokens.value.decode(ids) for ids in made], pa.binary()))
                yield pa.record_batch(columns, names)
                made = []

    kind = docs.schema[key].dataType.simpleString()
    names = [key, "ids", *["decoded"] * decoded]
    schema = f"`{key}` {kind}, ids array<int>" + ", decoded binary" * decoded
    words = wordblocks.word_rows(docs, splitter, buckets, key, text)
    ids = words.groupBy("bucket").applyInArrow(encoded, "block string, numbers binary, counts binary, ids binary")
    streams = wordblocks.stream_rows(docs, splitter, key, text)
    return (
        streams.groupBy("block")
        .cogroup(ids.groupBy("block"))
        .applyInArrow(lambda s, r: pa.Table.from_batches(list(placed(s, r))), schema)
    )


def decode(coded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """The rows of coded with ``decoded``, the bytes of their ids; null ids give no bytes.

    A join with the table of token bytes, on the map side. An id that is no token fails.
    """
    ranks = read_ranks(path or public_tokenizers.path(RANKS))
    sent = coded.sparkSession.sparkContext.broadcast(TokenBytes.of(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            values = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            each = [sent.value.decode(part) for part in np.split(values, ends[:-1])] if len(ends) else []
            yield batch.append_column("decoded", pa.array(each, pa.binary()))

    plain = coded.drop("decoded")
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    return coded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and what they decode to."""
    return digests(encode(table(spark, sf_dir, "documents"), decoded=True))
