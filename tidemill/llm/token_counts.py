"""Token counts under a unigram model, with one forward pass for each shared prefix.

The distinct pre-tokens that a task meets are inserted into a trie. A node stands for a prefix and holds the best
segmentation of it: score and number of tokens, found once, from the nodes on the path to it. A word's last node holds
the word's count; a word met again is looked up there. A document's count is the sum over its pre-tokens.

Pieces come from a public rank file. Such files hold ranks, not probabilities; by Zipf's law a piece of rank r
gets the log probability -log(r + 3), up to a constant for each piece.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import pieces, table
from tidemill.llm.pretokens import LONG

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Log probability of a byte that is no piece.
UNKNOWN = -30.0
#: Nodes from which a task starts a new trie (about 100 MB), and the longest word that is looked up without a walk.
TRIE_NODES, LONGEST = 500_000, 64


def read_scores(path: str) -> dict[bytes, float]:
    """Log probability of each piece of a rank file; its size is that of the vocabulary."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return {piece: -math.log(rank + 3) for piece, rank in ranks.items()}


class Trie:
    """Prefixes of words, each with the score and the tokens of its best segmentation.

    Of segmentations with equal scores the one with fewer tokens counts. Node 0 is the empty prefix.
    """

    def __init__(self, scores: dict[bytes, float], longest: int) -> None:
        self.scores, self.longest = scores, longest
        self.children: dict[int, int] = {}  # 256 * node + byte
        self.best: list[float] = [0.0]
        self.tokens: list[int] = [0]

    def __len__(self) -> int:
        return len(self.best)

    def insert(self, word: bytes) -> int:
        """The node of a whole word; only the nodes that are new are computed."""
        children, best, tokens, get = self.children, self.best, self.tokens, self.scores.get
        node, path = 0, [0]
        for end, byte in enumerate(word, 1):
            edge = 256 * node + byte
            node = children.get(edge, 0)
            if not node:
                node = children[edge] = len(best)
                before = path[-1]
                top, n = best[before] + UNKNOWN, tokens[before] + 1
                for begin in range(max(0, end - self.longest), end):
                    score = get(word[begin:end])
                    if score is not None:
                        before = path[begin]
                        score += best[before]
                        if score > top or (score == top and tokens[before] + 1 < n):
                            top, n = score, tokens[before] + 1
                best.append(top)
                tokens.append(n)
            path.append(node)
        return node


class Counter:
    """Pre-tokens, tokens and score of texts; starts a new trie where the old one has TRIE_NODES nodes."""

    def __init__(self, scores: dict[bytes, float], longest: int, pattern: str) -> None:
        self.scores, self.longest, self.split = scores, longest, regex.compile(pattern)
        self.renew()

    def renew(self) -> None:
        self.trie = Trie(self.scores, self.longest)
        self.counts: dict[str, tuple[int, float]] = {}  # tokens and score of each word, as its last node has them

    def count(self, text: str | None) -> tuple[int, int, float]:
        text = text or ""
        found = self.split.findall(text) if len(text) < LONG else (m.group() for m in self.split.finditer(text))
        n_pretokens, n_tokens, total, get = 0, 0, 0.0, self.counts.get
        for word in found:
            known = get(word)
            if known is None:
                if len(self.trie) >= TRIE_NODES:
                    self.renew()
                    get = self.counts.get
                end = self.trie.insert(word.encode("utf-8", "replace"))
                known = self.trie.tokens[end], self.trie.best[end]
                if len(word) <= LONGEST:
                    self.counts[word] = known
            n_pretokens += 1
            n_tokens += known[0]
            total += known[1]
        return n_pretokens, n_tokens, total


def token_counts(
    docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", pattern: str | None = None
) -> DataFrame:
    """(key, n_pretokens, n_tokens, score) of every whole text.

    Null and empty texts have no tokens and score 0. Each row is counted by itself, so repeated rows repeat and null
    keys stay. Texts are taken whole, a pre-token at a time; a pre-token of n bytes takes n nodes, which are dropped with
    the trie. Other columns are left out, so their names don't matter; an empty table gives an empty one. No shuffle; a
    task holds one Arrow batch and one trie of about TRIE_NODES nodes.
    """
    scores = read_scores(path or public_tokenizers.path(RANKS))
    longest = max(map(len, scores))
    shape = pattern or public_tokenizers.PATTERN
    sent = docs.sparkSession.sparkContext.broadcast(scores)  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value, longest, shape)
        for batch in pieces(batches):
            found = [counter.count(t.as_py()) for t in batch.column(1)]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))]
            yield pa.record_batch([batch.column(0), *columns], ["key", "n_pretokens", "n_tokens", "score"])

    kind = docs.schema[key].dataType.simpleString()
    counted = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n_pretokens long, n_tokens long, score double"
    )
    return counted.withColumnRenamed("key", key)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"))
