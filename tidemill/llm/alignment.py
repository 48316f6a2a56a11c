"""Two tokenizations of the same texts, aligned by bytes, with corpus-wide counts of the token pairs that meet.

Where a token of A and one of B both end, a text is cut into groups; a token of each that overlap are linked. Texts are
tokenized by chunks, cut where neither tokenizer can join (before a space that follows no white space), and each
distinct chunk of a block of documents is encoded and aligned once.

The pairs are kept as an inverted index. Documents are numbered inside their block, and for each pair a block has

    docs     a compressed bitmap of the documents that link the pair: their numbers, or bits where these are fewer bytes
    planes   bitmaps of the same kind, the k-th of documents with bit k in their number of further links

Bitmaps of a block's batches are OR-merged while the block is made. Blocks share no document, so their popcounts add up:
documents of a pair are the popcounts of docs, links are those plus 2^k times the popcounts of the planes.
Then the postings return the scores: a block gets the totals of its pairs and adds them up over the bits.

    documents --chunks, blocks--> postings --popcounts by pair--> totals --by block--> postings, scores of documents
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from tokenizers import Tokenizer

from tidemill.llm.common import Numbering, cut, table
from tidemill.llm.packing import pack_numbers, unpack_numbers

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A block of documents is full from so many bytes of text, distinct chunks, or documents (their numbers take 2 bytes).
BLOCK_BYTES, BLOCK_CHUNKS, BLOCK_DOCS = 24_000_000, 500_000, 8_192
#: Bytes of text whose new chunks are encoded together, and pairs of one row of postings.
BATCH_BYTES, PACKET = 2_000_000, 20_000
#: Before a space after something else, neither tokenizer joins: no pre-token of A and no piece of B goes on there.
#: A last space stays with what it follows, as B makes nothing of a space alone.
CHUNKS = re.compile(r"(?<=\S)(?= [\s\S])")


def _byte_level() -> dict[str, int]:
    """The byte of each character by which byte-level vocabularies spell it."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Tokens:
    """Bytes of a vocabulary's tokens, flat."""

    sizes: np.ndarray
    flat: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Tokens:
        return cls(np.array([len(t) for t in tokens], np.int64), np.frombuffer(b"".join(tokens), np.uint8))

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        begins = np.cumsum(self.sizes) - self.sizes
        return self.flat[_ragged(begins[ids], self.sizes[ids])]


def _ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def piece_bytes(piece: str) -> bytes:
    """Bytes of a piece: U+2581 is a space, <0xHH> a byte."""
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes((int(piece[3:5], 16),))
    return piece.replace("▁", " ").encode()


@dataclass
class Pair:
    """Both tokenizers and the bytes of their tokens."""

    a: Tokenizer
    b: sentencepiece.SentencePieceProcessor
    a_tokens: Tokens
    b_tokens: Tokens

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each chunk, which begins with a space; B adds it itself."""
        a = [e.ids for e in self.a.encode_batch(chunks, add_special_tokens=False)]
        return a, self.b.encode([c[1:] for c in chunks], num_threads=1)


@lru_cache(maxsize=1)
def tokenizers(a: str, b: str) -> Pair:
    """The tokenizers of two files, once for each worker; Spark's tasks are the only parallel ones."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    first = Tokenizer.from_file(a)
    first.encode_special_tokens = True
    own, special = _byte_level(), set(first.get_added_tokens_decoder())
    # an added token is never met in a text that is plain text, so its bytes don't matter
    spelled = [first.id_to_token(i) or "" for i in range(first.get_vocab_size())]
    a_tokens = Tokens.of([b"" if i in special else bytes(own[c] for c in t) for i, t in enumerate(spelled)])
    second = sentencepiece.SentencePieceProcessor(model_file=b)
    b_tokens = Tokens.of([piece_bytes(second.id_to_piece(i)) for i in range(second.vocab_size())])
    return Pair(first, second, a_tokens, b_tokens)


def _grown(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for own in ids for i in own), np.int64, int(sizes.sum())), sizes


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of values."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


@dataclass
class Chunks:
    """What is known of a block's distinct chunks, in the order of their numbers."""

    pair: Pair
    number: Numbering = field(default_factory=Numbering)
    spelled: list[str] = field(default_factory=list)
    parts: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    done: int = 0

    def numbers(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, CHUNKS.split(" " + text)), np.uint32)

    def align_new(self) -> None:
        """Encodes and aligns the chunks that have come since the last call."""
        new = list(self.number)[self.done :]
        self.done = len(self.number)
        if not new:
            return
        raw = [c.encode("utf-8", "replace") for c in new]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ids_a, ids_b = self.pair.encode(new)
        (a, n_a), (b, n_b) = _grown(ids_a), _grown(ids_b)
        size_a, size_b = self.pair.a_tokens.sizes[a], self.pair.b_tokens.sizes[b]
        fit = (_sums(size_a, n_a) == lengths) & (_sums(size_b, n_b) == lengths)
        for tokens, ids, counts in ((self.pair.a_tokens, a, n_a), (self.pair.b_tokens, b, n_b)):
            alike = tokens.spelled(ids[np.repeat(fit, counts)]) == np.frombuffer(b"".join(r for r, f in zip(raw, fit) if f), np.uint8)
            fit[np.flatnonzero(fit)[_sums(alike.astype(np.int64), lengths[fit]) != lengths[fit]]] = False
        a, size_a, b, size_b = a[np.repeat(fit, n_a)], size_a[np.repeat(fit, n_a)], b[np.repeat(fit, n_b)], size_b[np.repeat(fit, n_b)]
        n_a, n_b, ends = np.where(fit, n_a, 0), np.where(fit, n_b, 0), np.cumsum(np.where(fit, lengths, 0))
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        both = np.intersect1d(end_a, end_b, assume_unique=True)  # here groups end, and every chunk
        cuts = np.union1d(end_a, end_b)  # two tokens overlap in exactly one of the stretches between these
        links = a[np.searchsorted(end_a, cuts)] * len(self.pair.b_tokens.sizes) + b[np.searchsorted(end_b, cuts)]
        edge = np.r_[0, ends]
        per = [np.diff(np.searchsorted(x, edge, "right")) for x in (both, cuts)]
        self.parts.append((fit, n_a, n_b, *per, links))
        self._spell(a, b, np.searchsorted(end_a, both, "right"), np.searchsorted(end_b, both, "right"), per[0])

    def _spell(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, groups: np.ndarray) -> None:
        names_a, names_b, at = a.astype(str).tolist(), b.astype(str).tolist(), 0
        ends_a, ends_b = to_a.tolist(), to_b.tolist()
        all_groups, i, j = [], 0, 0
        for p, q in zip(ends_a, ends_b):
            all_groups.append(f"{','.join(names_a[i:p])}|{','.join(names_b[j:q])}")
            i, j = p, q
        for n in groups.tolist():
            self.spelled.append(";".join(all_groups[at : at + n]))
            at += n

    def columns(self) -> tuple[np.ndarray, ...]:
        """(fit, n_a, n_b, n_groups, n_links, flat links) of all chunks."""
        return tuple(np.concatenate(x) for x in zip(*self.parts))


def containers(pairs: np.ndarray, docs: np.ndarray, n_pairs: int, n_docs: int) -> list[bytes]:
    """A bitmap of each pair, from sorted (pair, document): numbers of 2 bytes if these are shorter than n_docs bits."""
    width = -(-n_docs // 8)
    counts = np.bincount(pairs, minlength=n_pairs)
    ends = np.cumsum(counts)
    numbers, out = docs.astype("<u2").tobytes(), []
    for begin, end in zip((ends - counts).tolist(), ends.tolist()):
        if 2 * (end - begin) < width:
            out.append(numbers[2 * begin : 2 * end])
        else:
            bits = np.zeros(8 * width, np.uint8)
            bits[docs[begin:end]] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
    return out


def members(bitmaps: list[bytes], n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap, document) of all bits that are set, sorted."""
    width = -(-n_docs // 8)
    sizes = np.fromiter(map(len, bitmaps), np.int64, len(bitmaps))
    dense = np.flatnonzero(sizes == width)
    short = np.where(sizes == width, 0, sizes // 2)
    which = [np.repeat(np.arange(len(bitmaps)), short)]
    docs = [np.frombuffer(b"".join(x for x in bitmaps if len(x) != width), "<u2").astype(np.int64)]
    for at in range(0, len(dense), 256):
        own = dense[at : at + 256]
        bits = np.unpackbits(np.frombuffer(b"".join(bitmaps[i] for i in own), np.uint8).reshape(len(own), width), axis=1, bitorder="little")
        rows, columns = np.nonzero(bits)
        which.append(own[rows])
        docs.append(columns)
    which, docs = np.concatenate(which), np.concatenate(docs)
    order = np.argsort(which, kind="stable")
    return which[order], docs[order]


def popcounts(bitmaps: list[bytes], n_docs: int) -> np.ndarray:
    """How many bits each bitmap has."""
    width = -(-n_docs // 8)
    sizes = np.fromiter(map(len, bitmaps), np.int64, len(bitmaps))
    out = sizes // 2
    dense = np.flatnonzero(sizes == width)
    if len(dense):
        bits = np.frombuffer(b"".join(bitmaps[i] for i in dense), np.uint8).reshape(len(dense), width)
        out[dense] = np.bitwise_count(bits).sum(axis=1)
    return out


def pack_postings(pairs: np.ndarray, docs: list[bytes], planes: list[tuple[np.ndarray, list[bytes]]]) -> bytes:
    """Pairs in ascending order with their bitmaps; planes: (which pairs, their bitmaps) for each bit."""
    parts = [np.diff(pairs, prepend=np.int64(0)), np.fromiter(map(len, docs), np.uint32, len(docs)), b"".join(docs)]
    for which, bitmaps in planes:
        parts += [which.astype(np.uint32), np.fromiter(map(len, bitmaps), np.uint32, len(bitmaps)), b"".join(bitmaps)]
    press = zstandard.ZstdCompressor(level=1)
    packed = [press.compress(p) if isinstance(p, bytes) else pack_numbers(p) for p in parts]
    return b"".join(len(p).to_bytes(8, "little") + p for p in packed)


def unpack_postings(data: bytes) -> tuple[np.ndarray, list[bytes], list[tuple[np.ndarray, list[bytes]]]]:
    parts, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        parts.append(data[at + 8 : at + 8 + size])
        at += 8 + size

    def bitmaps(sizes: bytes, joined: bytes) -> list[bytes]:
        ends = np.cumsum(unpack_numbers(sizes, np.uint32).astype(np.int64)).tolist()
        flat = zstandard.ZstdDecompressor().decompress(joined)
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    planes = [(unpack_numbers(parts[k], np.uint32), bitmaps(parts[k + 1], parts[k + 2])) for k in range(3, len(parts), 3)]
    return np.cumsum(unpack_numbers(parts[0], np.int64)), bitmaps(parts[1], parts[2]), planes


@dataclass
class _Block:
    chunks: Chunks
    keys: list = field(default_factory=list)
    streams: list[np.ndarray] = field(default_factory=list)
    size: int = 0
    fresh: int = 0

    def add(self, key, text: str | None) -> None:
        self.keys.append(key)
        self.streams.append(self.chunks.numbers(text) if text else np.zeros(0, np.uint32))
        self.size += len(text or "")
        self.fresh += len(text or "")
        if self.fresh >= BATCH_BYTES:
            self.chunks.align_new()
            self.fresh = 0

    @property
    def full(self) -> bool:
        return self.size >= BLOCK_BYTES or len(self.chunks.number) >= BLOCK_CHUNKS or len(self.keys) >= BLOCK_DOCS

    def documents(self, spell: bool) -> dict[str, list]:
        """What each document has by itself; texts that do not fit have nothing."""
        fit, n_a, n_b, n_groups, n_links, _ = self.chunks.columns()
        out: dict[str, list] = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")}
        for k, s in enumerate(self.streams):
            if not fit[s].all():
                self.streams[k] = s = s[:0]
            for c, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links)):
                out[c].append(int(values[s].sum()))
            text = ";".join(map(self.chunks.spelled.__getitem__, s.tolist()))
            out["groups_sha256"].append(hashlib.sha256(text.encode()).hexdigest() if text else "")
            out["groups"].append(text if spell else None)
        return out

    def postings(self) -> Iterator[bytes]:
        """Packets of the block's pairs. Call ``documents`` first, which empties the streams of texts that don't fit."""
        *_, n_links, links = self.chunks.columns()
        n_docs, begins = len(self.keys), np.cumsum(n_links) - n_links
        pairs, dense = np.unique(links, return_inverse=True)
        merged: list[tuple[np.ndarray, np.ndarray]] = []
        for first in range(0, n_docs, 512):  # bitmaps of a batch of documents; the batches are OR-merged below
            own = self.streams[first : first + 512]
            docs = np.repeat(np.arange(first, first + len(own)), [len(s) for s in own])
            each, often = np.unique(docs * len(n_links) + np.concatenate(own), return_counts=True)
            doc, chunk = each // len(n_links), (each % len(n_links)).astype(np.int64)
            sizes = n_links[chunk]
            key = dense[_ragged(begins[chunk], sizes)] * n_docs + np.repeat(doc, sizes)
            order = np.argsort(key)
            key = key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            times = np.add.reduceat(np.repeat(often, sizes)[order], starts) if len(key) else key
            merged.append((key[starts], times))
        key = np.concatenate([k for k, _ in merged])
        order = np.argsort(key, kind="stable")
        key, times = key[order], np.concatenate([t for _, t in merged])[order]
        pair, doc = key // n_docs, key % n_docs
        used, pair = np.unique(pair, return_inverse=True)
        for first in range(0, len(used), PACKET):
            a, b = np.searchsorted(pair, (first, first + PACKET))
            own, at, more = pair[a:b] - first, doc[a:b], times[a:b] - 1
            n = min(PACKET, len(used) - first)
            planes = []
            for bit in range(int(more.max()).bit_length()):
                has = (more >> bit) & 1 == 1
                which, inner = np.unique(own[has], return_inverse=True)
                planes.append((which, containers(inner, at[has], len(which), n_docs)))
            yield pack_postings(pairs[used[first : first + n]], containers(own, at, n, n_docs), planes)


_DOC_LISTS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "groups": pa.string()}


def index(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", spell: bool = False) -> DataFrame:
    """The blocks, written: a row of documents each (postings is null), and rows of postings."""
    kind = docs.schema[key].dataType.simpleString()
    lists = ", ".join(f"{c} array<{'string' if t == pa.string() else 'long'}>" for c, t in _DOC_LISTS.items())
    schema = f"block string, n_docs int, keys array<{kind}>, {lists}, postings binary"
    names = ["block", "n_docs", "keys", *_DOC_LISTS, "postings"]

    def rows(block: _Block, name: str, arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
        block.chunks.align_new()
        types = [pa.string(), pa.int32(), pa.list_(arrow), *map(pa.list_, _DOC_LISTS.values()), pa.binary()]

        def made(*values) -> pa.RecordBatch:
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], names)

        if not block.chunks.parts:  # no text has a chunk
            block.chunks.number[" "]
            block.chunks.align_new()
        own = block.documents(spell)
        yield made(name, len(block.keys), block.keys, *own.values(), None)
        for packet in block.postings():
            yield made(name, len(block.keys), None, *[None] * len(_DOC_LISTS), packet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part, turn = tokenizers(a, b), TaskContext.get().partitionId(), 0
        block, arrow = _Block(Chunks(pair)), pa.null()
        for batch in batches:
            arrow = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.add(k, t)
                if block.full:
                    yield from rows(block, f"{part}-{turn}", arrow)
                    block, turn = _Block(Chunks(pair)), turn + 1
        if block.keys:
            yield from rows(block, f"{part}-{turn}", arrow)

    return cut(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema))


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """(block, pair, a, b, docs, links) of every pair of every block, by popcounts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                pairs, bitmaps, planes = unpack_postings(r["postings"])
                docs = popcounts(bitmaps, r["n_docs"])
                links = docs.copy()
                for bit, (which, own) in enumerate(planes):
                    links[which] += popcounts(own, r["n_docs"]) << bit
                name = pa.array([r["block"]]).take(pa.array(np.zeros(len(pairs), np.int32)))
                yield pa.record_batch([name, *map(pa.array, (pairs, docs, links))], ["block", "pair", "docs", "links"])

    found = blocks.where("postings IS NOT NULL").select("block", "n_docs", "postings")
    counted = found.mapInArrow(run, "block string, pair long, docs long, links long")
    return counted.withColumn("a", F.floor(F.col("pair") / n_b).cast("int")).withColumn("b", (F.col("pair") % n_b).cast("int"))


def pair_table(counted: DataFrame) -> DataFrame:
    """(pair, a, b, docs, links, best) of the corpus; best: no pair of the same B token has more links."""
    total = counted.groupBy("pair", "a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    return total.withColumn("best", F.col("links") == F.max("links").over(W.partitionBy("b")))


def align(docs: DataFrame, a: str | None = None, b: str | None = None, key: str = "doc_id", text: str = "text", spell: bool = False) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) of every row of docs.

    A document's text with a space before it is encoded by both; counts of pairs are over all documents, repeated rows
    repeatedly. Null and empty texts, and texts that one of the vocabularies can't give back byte by byte, have no tokens:
    zeros and ''. ``groups`` is null unless ``spell``. Very long texts are taken whole; null and repeated keys stay; ties
    for the best are all best; other columns are left out; an empty table gives an empty one.
    """
    paths = a or public_tokenizers.path(BYTE_BPE), b or public_tokenizers.path(PIECE_BPE)
    n_b = sentencepiece.SentencePieceProcessor(model_file=paths[1]).vocab_size()
    blocks = index(docs, *paths, key, text, spell)
    counted = pair_counts(blocks, n_b)
    totals = pair_table(counted).select("pair", F.col("links").alias("count"), "best")
    known = counted.select("block", "pair").join(totals, "pair")

    def run(own: pa.Table, scores: pa.Table) -> pa.Table:
        rows = own.to_pylist()
        [about] = [r for r in rows if r["postings"] is None]
        n = about["n_docs"]
        pair = scores["pair"].to_numpy()
        order = np.argsort(pair)
        pair, count, best = pair[order], scores["count"].to_numpy()[order], scores["best"].to_numpy()[order].astype(np.int64)
        count_sum, n_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for r in rows:
            if r["postings"] is None:
                continue
            pairs, bitmaps, planes = unpack_postings(r["postings"])
            at = np.searchsorted(pair, pairs)
            if not np.array_equal(pair[np.minimum(at, len(pair) - 1)], pairs):
                raise RuntimeError("a pair has no total")
            for weight, which, maps in ((1, np.arange(len(pairs)), bitmaps), *((1 << k, w, m) for k, (w, m) in enumerate(planes))):
                bitmap, doc = members(maps, n)
                where = at[which[bitmap]]
                np.add.at(count_sum, doc, weight * count[where])
                np.add.at(n_best, doc, weight * best[where])
        lists = [about[c] for c in ("n_a", "n_b", "n_groups", "n_links")]
        values = [own["keys"].combine_chunks().flatten(), *[pa.array(v, pa.int64()) for v in lists], pa.array(n_best), pa.array(count_sum)]
        values += [pa.array(about[c], pa.string()) for c in ("groups_sha256", "groups")]
        return pa.table(values, [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by both tokenizers."""
    return align(table(spark, sf_dir, "documents")).drop("groups").withColumn("doc_id", F.col("doc_id").cast("long"))
