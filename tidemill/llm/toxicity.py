"""Toxicity by compression distance.

Two zstandard dictionaries are trained, each on windows of its own class: one on text of documents with the label,
one on text of documents without it. Both stand behind a larger dictionary trained on other ordinary text, so that
what the classes share compresses alike and cancels out; and since zstandard's training looks for what is frequent,
not for what is peculiar to a class, the toxic one ends with the words that toxic documents use far more often.
A window of a few words that compresses shorter with the toxic dictionary than with the ordinary one speaks for the
label. How many of a document's windows save at least 1, 2, 3 or 4 bytes, and the largest savings, are its figures; a
logistic curve over them, fitted on labelled documents that the dictionaries at hand have not seen, calibrates
these thresholds to a score.

Fitting takes a bounded sample of labelled documents (SAMPLE), whole, to the driver; scoring is one pass over whole
texts without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import lower_words, table

#: Words of a window.
WINDOW = 8
#: Labelled documents of each class at most in the sample.
SAMPLE = 1_000
#: Bytes of the dictionary that both classes stand behind, of each class's own, and of toxic words (tried in this order).
SHARED_BYTES, CLASS_BYTES, TOXIC_BYTES = 15_000, 1_000, (250, 500, 1_000)
#: Longest common piece that training looks for, and what it counts.
SEGMENT, GRAM = 16, 6
#: A toxic word is in this many toxic documents, and this many times as often in them as in others.
LEAST_DOCS, LEAST_RATIO = 3, 5.0
#: A document with at least this score is predicted to be toxic.
THRESHOLD = 0.3
#: Lengths of word fragments, and what is cut from a word's ends.
FRAGMENTS, MARKS = (5,), b".,;:!?|\"'()"
#: Savings in bytes from which a window counts.
SAVINGS = (1, 2, 3, 4)


@dataclass
class Model:
    """Two dictionaries and a fitted curve; a few kilobytes."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)


def words_of(text: str | None) -> list[bytes]:
    return lower_words(text)


def windows_of(words: Sequence[bytes]) -> list[bytes]:
    return [b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)] or [b""]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(
        3, window_log=15, hash_log=13, chain_log=13, min_match=3, strategy=zstandard.STRATEGY_BTULTRA,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def _trained(windows: Sequence[bytes], size: int) -> bytes:
    """A dictionary of ``size`` bytes trained on windows; of too few to train on, their last bytes."""
    try:
        return zstandard.train_dictionary(size, list(windows), k=SEGMENT, d=GRAM, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(windows)[-size:] or b" " * 8


def _dictionaries(toxic: Sequence[str | None], other: Sequence[str | None], seed: int) -> tuple[bytes, bytes, list[bytes]]:
    """The ordinary dictionary, the toxic one, and the words that go to the toxic one's end."""
    rng = np.random.default_rng(seed)
    of_toxic, of_other = ([w for t in texts for w in windows_of(words_of(t))] for texts in (toxic, other))
    of_toxic, of_other = ([own[i] for i in rng.permutation(len(own))] for own in (of_toxic, of_other))
    half = len(of_other) // 2
    shared = _trained(of_other[:half], SHARED_BYTES)
    own = _trained(of_other[half:], CLASS_BYTES), _trained(of_toxic, CLASS_BYTES)
    return own[0] + shared, own[1] + shared, _toxic_parts(toxic, other)


def features(ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor, text: str | None) -> np.ndarray:
    """What the savings of all windows of a text come to."""
    words = words_of(text)
    parts = windows_of(words)
    saved = np.array([len(ordinary.compress(p)) - len(toxic.compress(p)) for p in parts], float)
    top = np.sort(saved)[-3:]
    counts = [(saved >= s).sum() for s in SAVINGS]
    return np.array(
        [top[-1], top.mean(), saved.mean(), *[c / len(parts) for c in counts], *np.sqrt(counts), np.log1p(len(parts))]
    )


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.pair = _compressor(model.ordinary), _compressor(model.toxic)

    def score(self, text: str | None) -> float:
        x = (features(*self.pair, text) - self.model.mean) / self.model.scale
        return float(1 / (1 + np.exp(-np.clip(self.model.weights[0] + x @ self.model.weights[1:], -30, 30))))


def _frequencies(texts: Sequence[str | None]) -> Counter:
    """In how many texts each word and each run of FRAGMENT bytes of a word is; a blank marks a word's ends."""
    found: Counter = Counter()
    for t in texts:
        words = {w.strip(MARKS) for w in words_of(t)}
        parts = {b" " + w + b" " for w in words}
        for n in FRAGMENTS:
            parts |= {p[i : i + n] for w in words for p in (b" " + w,) for i in range(len(p) - n + 1)}
        found.update(parts)
    return found


def fit(texts: Sequence[str | None], labels: Sequence[int], share: float | None = None, seed: int = 0) -> Model:
    """Dictionaries and curve from labelled texts.

    ``share`` is the share of label 1 where the texts come from; theirs, if not given. Without both labels, every
    text's score is about that share.
    """
    y = np.array(labels, float)
    share = float(np.clip((y.mean() if len(y) else 0.0) if share is None else share, 1e-4, 1 - 1e-4))
    half = np.random.default_rng(seed).permutation(len(texts)) % 2  # a half's figures are by dictionaries of the other half

    def dictionaries(used: Sequence[bool]) -> tuple[bytes, bytes, list[bytes]]:
        by_class = ([t for t, v, u in zip(texts, labels, used) if u and (v == 1) == c] for c in (True, False))
        return _dictionaries(*by_class, seed)

    trained = [dictionaries(half != k) for k in (0, 1)]
    best = None
    for size in TOXIC_BYTES:
        pairs = [(_compressor(o), _compressor(t + _within(m, size))) for o, t, m in trained]
        x = np.array([features(*pairs[h], t) for t, h in zip(texts, half)] or np.zeros((0, len(features(*pairs[0], "")))))
        mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = (x - mean) / scale
        weights = _logistic(z, y)
        loss = np.logaddexp(0, (1 - 2 * y) * (weights[0] + z @ weights[1:])).sum()
        if best is None or loss < best[0]:
            best = loss, size, mean, scale, weights
    _, size, mean, scale, weights = best
    drawn = float(np.clip(y.mean() if len(y) else share, 1e-4, 1 - 1e-4))
    weights[0] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    ordinary, toxic, words = dictionaries([True] * len(texts))
    return Model(ordinary, toxic + _within(words, size), mean, scale, weights)


def _within(parts: Sequence[bytes], size: int) -> bytes:
    """The strongest parts that fit, strongest last, where zstandard reaches them most cheaply."""
    ends = np.cumsum([len(p) for p in parts])
    return b"".join(reversed(parts[: int(np.searchsorted(ends, size, side="right"))]))


def _toxic_parts(toxic: Sequence[str | None], other: Sequence[str | None]) -> list[bytes]:
    """Words and fragments that toxic texts use far more often, strongest first."""
    in_toxic, in_other = _frequencies(toxic), _frequencies(other)
    n_toxic, n_other = len(toxic), len(other)
    least = max(LEAST_DOCS, 0.01 * n_toxic)
    ratio = {
        w: n / n_toxic / ((in_other[w] + 1) / (n_other + 1))
        for w, n in in_toxic.items()
        if n >= least and len(w) > 3
    }
    strong = sorted((w for w in ratio if ratio[w] >= LEAST_RATIO), key=lambda w: (-ratio[w], -len(w), w))
    chosen: list[bytes] = []
    for w in strong[:1_000]:
        if not any(w in c for c in chosen):
            chosen.append(w)
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method for logistic regression with a ridge on all but the constant."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    share = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    w[0] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        hold = ridge * np.diag([1e-6] + [1.0] * x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + hold, a.T @ (p - y) + hold @ w)
    return w


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from at most SAMPLE labelled rows of each class that are not held out, by hash order, texts whole.

    Rows with a null key or label are not in the sample; null texts are empty ones. Labelled keys of several documents
    bring all of them. Without labelled rows every score is about 0.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("key").isNotNull() & ~held_out(F.col("key"))
    )
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows, share = [], known.agg(F.avg("label")).first()[0]
    for value in (1, 0):
        order = F.xxhash64("key")
        some = known.where(F.col("label") == value).orderBy(order, "key").limit(SAMPLE)
        rows += texts.join(F.broadcast(some), "key").select("key", "text", "label").collect()
    rows.sort(key=lambda r: (r["key"], r["text"] or "", r["label"]))
    return fit([r["text"] for r in rows], [r["label"] for r in rows], share)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs and ``score``; a column of that name is replaced.

    Null texts count as empty. Every text is scored whole, window by window, whatever its length; equal texts have equal
    scores. Repeated rows and null keys stay; an empty table gives an empty one.
    """
    return docs.withColumn("score", scoring(model)(F.col(text)))


def scoring(model: Model):
    """The score as a column function."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model.scorer()
        for part in texts:
            yield pd.Series([own.score(t) for t in part], dtype="float64")

    return scored


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
