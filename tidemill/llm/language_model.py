"""Scores whole documents with a gated recurrent language model and a unigram base.

The unigram base counts every training word of the corpus: distinct words of all blocks (wordblocks) meet by a hash,
their counts are summed there and go back to the blocks. The recurrent model's output is factored: a softmax over
classes, then one over a class's words. The HEAD most frequent words of all training documents, and the end, are shared
out over classes by frequency, each with a softmax of its own; all other words, unknown ones included, fall into
classes by their last two bytes, within which a word has its share of the corpus counts, (c + 1) / (sum + distinct + 1).
So every word has a probability and what the model knows follows the corpus. A document's state is carried over all its
windows.

The weights are trained in numpy by backpropagation through windows of WINDOW tokens. They start as the unigram model
(biases are the logarithms of corpus counts, the rest small random numbers). Every training document is trained on
whole, once: in each of TURNS turns every task takes its share of its blocks' documents, going on from the weights of
the turn before, and the turn's weights are the tasks' means by tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import wordblocks
from tidemill.llm.common import Numbering, cut, lower_words, shuffles, table
from tidemill.llm.packing import pack_numbers, unpack_numbers

#: Classes with a softmax of their own, words of each, and classes by the end of a word.
CLASSES, WIDTH, ENDINGS = 24, 48, 24
HEAD = CLASSES * WIDTH
HIDDEN, WINDOW = 24, 32
#: Turns of training, each on a part of the documents; streams that are trained on side by side at most; step of Adam.
TURNS, LANES, RATE = 4, 128, 0.005
#: Rows of a softmax that are worked on together.
ROWS = 1024
#: Documents that are scored together, and tokens of each that are looked at together.
TOGETHER, STEPS = 512, 32
#: Numbers of a word's last two bytes, or of its only one.
KINDS = 257 * 256
#: The end of a document, which is also what stands before its first word.
END = 0


class Words:
    """Splits texts into lower-cased words and numbers the distinct ones."""

    def __init__(self) -> None:
        self.number = Numbering()

    def __len__(self) -> int:
        return len(self.number)

    @property
    def words(self) -> list[bytes]:
        return list(self.number)

    def numbers(self, text: str | None) -> np.ndarray:
        found = split(text)
        return np.fromiter(map(self.number.__getitem__, found), np.uint32, len(found))


def split(text: str | None) -> list[bytes]:
    return lower_words(text)


def _kind(word: bytes) -> int:
    return word[-1] + (256 * (word[-2] + 1) if len(word) > 1 else 0)


def _ending(kind: int) -> bytes:
    return bytes([kind // 256 - 1, kind % 256]) if kind >= 256 else bytes([kind])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; where exp is too large for float32 it is infinite, and this 0: callers ignore that overflow."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _step(p: dict, codes: np.ndarray, h: np.ndarray, x: np.ndarray | None = None, gates: np.ndarray | None = None, n: np.ndarray | None = None) -> tuple:
    """(new state, what backpropagation needs) after one input of each lane; x are the inputs' rows, if they are known, and gates and n are written to."""
    x, size, u = p["x"].take(codes, axis=0) if x is None else x, HIDDEN, p["u"]
    gates = np.matmul(h, u[:, : 2 * size], out=gates)
    gates += x[:, : 2 * size]
    _sigmoid(gates)
    z, r = gates[:, :size], gates[:, size:]
    n = np.matmul(r * h, u[:, 2 * size :], out=n)
    n += x[:, 2 * size :]
    n *= 2  # tanh(x) is 2 / (1 + exp(-2x)) - 1
    _sigmoid(n)
    n *= 2
    n -= 1
    new = n - h
    new *= z
    new += h
    return new, (h, gates, n)


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exp, its sums along the last axis), in place and up to a factor of each row, which keeps it in what float32 can hold."""
    if x.size and not (x.max() < 60 and x.min() > -60):
        x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[-1], x.dtype)


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place, along the last axis."""
    x, sums = _exp(x)
    x /= sums[:, None]
    return x


def _chosen(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One value of each row's softmax; x is overwritten."""
    x, sums = _exp(x)
    return x[np.arange(len(x)), at] / sums


def _classes(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < HEAD, codes // WIDTH, CLASSES + codes - HEAD)


def _by_class(kinds: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """(order, runs): rows of the head by class, and (class, slice of that order) of at most ROWS rows each."""
    order = np.argsort(kinds.astype(np.uint8), kind="stable")
    ends = np.searchsorted(kinds[order], np.arange(CLASSES), side="right").tolist()
    runs = [
        (k, slice(at, min(at + ROWS, end))) for k, (begin, end) in enumerate(zip([0, *ends], ends)) for at in range(begin, end, ROWS)
    ]
    return order[: ends[-1]], runs


def _runs(n: int) -> Iterator[slice]:
    """Rows that are worked on together, so that what is made of them stays in the cache."""
    return (slice(at, at + ROWS) for at in range(0, n, ROWS))


def log_probabilities(p: dict, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Natural log of each code's class and, in the head, word, given the state before it."""
    kinds, out = _classes(codes), np.empty(len(codes), p["c"].dtype)
    for part in _runs(len(codes)):
        own = states[part] @ p["c"]
        own += p["cb"]
        out[part] = _chosen(own, kinds[part])
    order, runs = _by_class(kinds)
    own, words, inside = states[order], codes[order] % WIDTH, np.empty(len(order), out.dtype)
    for k, part in runs:
        inner = own[part] @ p["w"][k]
        inner += p["wb"][k]
        inside[part] = _chosen(inner, words[part])
    out[order] *= inside
    return np.log(np.maximum(out, 1e-38))


@np.errstate(over="ignore")
def _gradients(p: dict, inputs: np.ndarray, outputs: np.ndarray, fresh: np.ndarray, used: np.ndarray, h: np.ndarray) -> tuple:
    """Gradients of the mean loss over one window (time, lane), and the state after it."""
    steps, lanes, size, u, kind = len(inputs), inputs.shape[1], HIDDEN, p["u"], h.dtype
    before, states, nears = (np.empty((steps, lanes, size), kind) for _ in range(3))
    gates, x = np.empty((steps, lanes, 2 * size), kind), p["x"].take(inputs, axis=0)
    for t in range(steps):
        before[t] = h * ~fresh[t][:, None] if fresh[t].any() else h
        h, _ = _step(p, inputs[t], before[t], x[t], gates[t], nears[t])
        states[t] = h
    flat, codes = states.reshape(-1, size), outputs.ravel()
    share = (used.ravel() / max(1, used.sum())).astype(kind)[:, None]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    kinds, dflat = _classes(codes), np.empty_like(flat)
    for part in _runs(len(codes)):
        own = flat[part]
        d = own @ p["c"]
        d += p["cb"]
        _softmax(d)[np.arange(len(d)), kinds[part]] -= 1
        d *= share[part]
        g["c"] += own.T @ d
        g["cb"] += d.sum(0)
        dflat[part] = d @ p["c"].T
    order, runs = _by_class(kinds)
    rows, words, weights, inside = flat[order], codes[order] % WIDTH, share[order], np.empty((len(order), size), kind)
    for k, part in runs:
        own = rows[part]
        d = own @ p["w"][k]
        d += p["wb"][k]
        _softmax(d)[np.arange(len(d)), words[part]] -= 1
        d *= weights[part]
        g["w"][k] += own.T @ d
        g["wb"][k] += d.sum(0)
        inside[part] = d @ p["w"][k].T
    dflat[order] += inside
    dstates, dh = dflat.reshape(states.shape), np.zeros_like(h)
    dx = np.empty((steps, lanes, 3 * size), kind)
    slopes, bends = gates * (1 - gates), 1 - nears * nears  # derivatives of both gates and of the new part
    moved = (nears - before) * slopes[:, :, :size]
    turned = before * slopes[:, :, size:]
    bends *= gates[:, :, :size]
    for t in range(steps - 1, -1, -1):
        dh += dstates[t]
        dzr, dn = dx[t, :, : 2 * size], dx[t, :, 2 * size :]
        np.multiply(dh, bends[t], out=dn)
        drh = dn @ u[:, 2 * size :].T
        np.multiply(dh, moved[t], out=dzr[:, :size])
        np.multiply(drh, turned[t], out=dzr[:, size:])
        dh -= dh * gates[t, :, :size]
        drh *= gates[t, :, size:]
        dh += drh
        dh += dzr @ u[:, : 2 * size].T
        if fresh[t].any():
            dh *= ~fresh[t][:, None]
    rows, had = dx.reshape(-1, 3 * size), before.reshape(-1, size)
    g["u"][:, : 2 * size] = had.T @ rows[:, : 2 * size]
    had = had * gates[:, :, size:].reshape(-1, size)
    g["u"][:, 2 * size :] = had.T @ rows[:, 2 * size :]
    cells = (inputs.reshape(-1, 1) * (3 * size) + np.arange(3 * size)).ravel()
    g["x"] = np.bincount(cells, rows.ravel(), g["x"].size).reshape(g["x"].shape).astype(kind)
    return g, h


def _most(counts: dict[bytes, int], n: int) -> dict[bytes, int]:
    """The n most frequent keys, numbered from 1."""
    return {w: i + 1 for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[:n])}


def start(words: np.ndarray, ends: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights that give each word of the head (the end first) and each class of endings its share of the counts.

    x is of inputs, u of the state, c and cb of classes, w and wb of words in a class.
    """
    rng = np.random.default_rng(seed)

    def draw(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.1, shape).astype(np.float32)

    words = np.r_[words, np.zeros(HEAD - len(words))].reshape(CLASSES, WIDTH) + 1.0
    classes = np.r_[words.sum(1), ends + 1.0]
    return {
        "x": draw(HEAD + ENDINGS, 3 * HIDDEN), "u": draw(HIDDEN, 3 * HIDDEN),
        "c": draw(HIDDEN, CLASSES + ENDINGS) / 4, "cb": np.log(classes / classes.sum()).astype(np.float32),
        "w": draw(CLASSES, HIDDEN, WIDTH) / 4, "wb": np.log(words / words.sum(1, keepdims=True)).astype(np.float32),
    }


class Trainer:
    """Goes on training weights in place; what Adam remembers of the gradients is kept between calls."""

    def __init__(self, p: dict) -> None:
        self.p, self.turn = p, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}

    def learn(self, coded: Sequence[np.ndarray]) -> None:
        """One pass over whole documents, each given as its codes and END."""
        p, stream = self.p, np.concatenate(coded)
        lanes = max(4, min(LANES, len(stream) // (WINDOW * 64)))
        first = np.zeros(len(stream), bool)
        first[np.r_[0, np.cumsum([len(c) for c in coded])[:-1]]] = True
        inputs = np.where(first, END, np.r_[END, stream[:-1]])
        per_lane = -(-len(stream) // lanes)
        pad = per_lane * lanes - len(stream)
        dealt = [np.pad(a, (0, pad)).reshape(lanes, per_lane).T for a in (inputs, stream, first, np.ones(len(stream), bool))]
        h = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, per_lane, WINDOW):
            window = [a[at : at + WINDOW] for a in dealt]
            g, h = _gradients(p, window[0], window[1], window[2], window[3], h)
            self.turn += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            rate = RATE * math.sqrt(1 - 0.99**self.turn) / (1 - 0.9**self.turn)
            for k, v in g.items():
                v *= min(1.0, 1.0 / (norm + 1e-8))
                m, s = self.moments[k]
                m *= 0.9
                m += 0.1 * v
                s *= 0.99
                v *= v
                s += 0.01 * v
                p[k] -= rate * m / (np.sqrt(s) + 1e-8)


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    ends = np.cumsum([v.size for v in like.values()])
    return {k: part.reshape(v.shape).astype(np.float32) for (k, v), part in zip(like.items(), np.split(flat, ends[:-1]))}


def train_on_all(weights: dict, blocks: DataFrame) -> dict:
    """Weights after all training documents of blocks (flags, counts, codes), each trained on once and whole."""
    spark = blocks.sparkSession
    schema = "total binary, tokens bigint"

    def summed(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in group["total"])
        return pa.table([pa.array([total.tobytes()], pa.binary()), pa.array([sum(group["tokens"].to_pylist())], pa.int64())], ["total", "tokens"])

    def learner(turn: int, weights: dict):
        sent = spark.sparkContext.broadcast(weights)

        def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, tokens = {k: v.copy() for k, v in sent.value.items()}, 0
            trainer = Trainer(p)
            for batch in batches:
                for i in range(len(batch)):  # a block at a time
                    flags, counts, codes = (batch.column(n)[i].as_py() for n in ("flags", "counts", "codes"))
                    ends = np.cumsum(unpack_numbers(counts, np.uint32).astype(np.int64))[:-1]
                    documents = np.split(unpack_numbers(codes, np.uint16), ends)
                    used = [d for d, flag in zip(documents, flags) if flag]
                    own = [d.astype(np.int64) for d in used[turn::TURNS]]
                    if own:
                        trainer.learn(own)
                        tokens += sum(map(len, own))
            if tokens:
                total = (_flat(p).astype(np.float64) * tokens).tobytes()
                yield pa.record_batch([pa.array([total], pa.binary()), pa.array([tokens], pa.int64())], ["total", "tokens"])

        return learned

    for turn in range(TURNS):
        parts = blocks.select("flags", "counts", "codes").mapInArrow(learner(turn, weights), schema)
        few = F.lit(math.isqrt(shuffles(spark)) + 1)  # a row for each task is summed in two levels
        some = parts.withColumn("part", F.pmod(F.spark_partition_id(), few)).groupBy("part").applyInArrow(summed, schema)
        sums = some.groupBy().applyInArrow(summed, schema).collect()  # one row
        if sums:
            weights = _shaped(np.frombuffer(sums[0]["total"], np.float64) / sums[0]["tokens"], weights)
    return weights


@np.errstate(over="ignore")
def neural_scores(p: dict, documents: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document's codes, its end included; the longest run together."""
    total = np.zeros(len(documents))
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    for at in range(0, len(order), TOGETHER):
        part = order[at : at + TOGETHER]
        lengths = np.array([len(documents[i]) for i in part])
        h, last = np.zeros((len(part), HIDDEN), np.float32), np.full(len(part), END)
        for begin in range(0, int(lengths[0]), STEPS):
            live = int((lengths > begin).sum())
            steps = min(STEPS, int(lengths[0]) - begin)
            codes = np.full((steps, live), -1, np.int64)
            for lane, i in enumerate(part[:live]):
                own = documents[i][begin : begin + steps]
                codes[: len(own), lane] = own
            h, last = h[:live], last[:live]
            states = np.empty((steps, live, HIDDEN), np.float32)
            for t in range(steps):
                h, _ = _step(p, last, h)
                states[t], last = h, np.maximum(codes[t], 0)
            seen = codes >= 0
            logs = np.zeros(codes.shape)
            logs[seen] = log_probabilities(p, states[seen], codes[seen])
            total[part[:live]] += logs.sum(0)
    return total


def held_out(key: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Tokens are lower-cased words and one end; null and empty texts have the end alone. Scores are log10 of the whole
    text's probability. Rows with a null key are training rows; repeated rows count as often as they are there and
    are scored each. Texts of any length are learned from and scored whole; one is never split over blocks. Other columns
    are left out, so their names don't matter; an empty table gives an empty one. The input is read once.
    """
    spark = docs.sparkSession
    buckets = 2 * shuffles(spark)

    def counted(group: pa.Table) -> pa.Table:
        rows, known, totals = group.to_pylist(), Numbering(), np.zeros(0, np.int64)
        placed = []
        for row in rows:
            words, _, weights = wordblocks.words_in(row)
            numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            if len(known) > len(totals):
                totals = np.concatenate([totals, np.zeros(len(known) - len(totals), np.int64)])
            totals[numbers] += weights
            placed.append(numbers)
        words = list(known)
        kinds = np.fromiter((_kind(w) for w in words), np.uint32, len(words))
        seen = np.flatnonzero(totals)
        if len(seen) > HEAD:  # only those that can be among the most frequent ones are put in order
            seen = seen[totals[seen] >= np.partition(totals[seen], -HEAD)[-HEAD]]
        top = sorted(seen.tolist(), key=lambda i: (-totals[i], words[i]))[: HEAD - 1]
        own, at = np.unique(kinds, return_inverse=True)
        sums = {
            "top": [words[i] for i in top], "top_n": totals[top].tolist(), "kinds": own.tolist(),
            "kinds_n": np.bincount(at, totals, len(own)).astype(np.int64).tolist(),
            "kinds_words": np.bincount(at, totals > 0, len(own)).astype(np.int64).tolist(),
        }
        kinds[top] += KINDS * np.arange(1, len(top) + 1, dtype=np.uint32)
        out = [[rows[0]["bucket"]], [None], [None], [None], [None], [sums]]
        for row, numbers in zip(rows, placed):
            values = row["bucket"], row["block"], row["numbers"], pack_numbers(totals[numbers]), pack_numbers(kinds[numbers]), None
            for column, value in zip(out, values):
                column.append(value)
        lists = [("top", pa.binary()), ("top_n", pa.int64()), ("kinds", pa.int64()), ("kinds_n", pa.int64()), ("kinds_words", pa.int64())]
        types = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.struct([(n, pa.list_(k)) for n, k in lists])]
        return pa.table([pa.array(v, k) for v, k in zip(out, types)], ["bucket", "block", "numbers", "counts", "kinds", "sums"])

    words, streams = wordblocks.both_rows(docs, Words, buckets, key, text, ~held_out(F.col(key)))
    n_train = streams.agg(F.sum(F.size(F.filter("flags", lambda x: x)))).first()[0] or 0
    sums_schema = "struct<top: array<binary>, top_n: array<bigint>, kinds: array<bigint>, kinds_n: array<bigint>, kinds_words: array<bigint>>"
    counts = cut(
        words.groupBy("bucket").applyInArrow(counted, f"bucket int, block string, numbers binary, counts binary, kinds binary, sums {sums_schema}")
    )
    sums = counts.where(F.col("block").isNull()).select("bucket", "sums.*")

    def merged(group: pa.Table) -> pa.Table:
        """The most frequent words of several buckets' lists, in one row."""
        rows = [x for r in group.to_pylist() for x in zip(r["top"], r["top_n"], r["bucket"], r["place"])]
        rows = sorted(rows, key=lambda x: (-x[1], x[0]))[: HEAD - 1]
        kinds = pa.binary(), pa.int64(), pa.int32(), pa.int32()
        lists = [pa.array([list(c)], pa.list_(k)) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)]
        return pa.table(lists, ["top", "top_n", "bucket", "place"])

    merged_schema = "top array<binary>, top_n array<bigint>, bucket array<int>, place array<int>"
    same = F.transform("top", lambda _: F.col("bucket")).alias("bucket")
    place = F.transform("top", lambda _, i: i).alias("place")
    part = F.pmod("bucket", F.lit(math.isqrt(buckets))).alias("part")
    tops = sums.select("top", "top_n", same, place, part).groupBy("part").applyInArrow(merged, merged_schema)
    most = tops.groupBy().applyInArrow(merged, merged_schema).collect()  # one row
    names = "top", "top_n", "bucket", "place"
    head = [dict(zip(names, x)) for r in most for x in zip(*(r[n] for n in names))]
    by_kind = sums.select(F.explode(F.arrays_zip("kinds", "kinds_n", "kinds_words")).alias("t")).select("t.*")
    # two bytes have so many values
    rows = by_kind.groupBy("kinds").agg(F.sum("kinds_n").alias("n"), F.sum("kinds_words").alias("words")).collect()
    n, v = sum(r["n"] for r in rows) + n_train, sum(r["words"] for r in rows) + (n_train > 0)
    tails = {r["kinds"]: [r["n"], r["words"]] for r in rows}
    for r in head:
        kind = tails[_kind(bytes(r["top"]))]
        kind[0], kind[1] = kind[0] - r["top_n"], kind[1] - 1
    endings = _most({_ending(k): c for k, (c, _) in tails.items() if c}, ENDINGS - 1)
    ends, class_of = np.zeros((2, ENDINGS)), np.zeros(KINDS, np.uint16)
    for k, own in tails.items():
        class_of[k] = endings.get(_ending(k), 0)
        ends[:, class_of[k]] += own
    outside = np.log10(ends[0] + ends[1] + 1)
    head_of: dict[int, np.ndarray] = {}  # of each bucket, by place there
    for i, r in enumerate(head):
        own = head_of.setdefault(r["bucket"], np.zeros(HEAD - 1, np.uint16))
        own[r["place"]] = i + 1
    none = np.zeros(HEAD - 1, np.uint16)
    first = start(np.array([n_train, *[r["top_n"] for r in head]], float), ends[0])

    def coded(streams: pa.Table, rows: pa.Table) -> pa.Table:
        own = wordblocks.whole(streams, rows)
        c, codes = np.zeros(own["n_words"], np.int64), np.zeros(own["n_words"], np.uint16)
        for row in rows.to_pylist():
            at = wordblocks.numbers_in(row)
            c[at] = unpack_numbers(row["counts"], np.int64)
            kinds = unpack_numbers(row["kinds"], np.uint32)
            place = kinds // KINDS  # 0 if it is not among its bucket's most frequent ones
            in_head = np.where(place > 0, head_of.get(row["bucket"], none)[np.maximum(place, 1) - 1], 0)
            codes[at] = np.where(in_head > 0, in_head, HEAD + class_of[kinds % KINDS])
        logs = np.log10(c + 1.0)
        inside = np.where(codes >= HEAD, logs - outside[np.maximum(codes, HEAD) - HEAD], 0.0)
        n_known, base, within, streams_of = [], [], [], []
        for doc in wordblocks.documents_in(own):
            n_known.append(int((c[doc] > 0).sum()) + (n_train > 0))
            base.append(float(logs[doc].sum() + np.log10(n_train + 1.0) - (len(doc) + 1) * np.log10(n + v + 1.0)))
            within.append(float(inside[doc].sum()))
            streams_of.append(np.append(codes[doc], np.uint16(END)))
        sizes = np.fromiter(map(len, streams_of), np.uint32, len(streams_of))
        columns = [
            streams["block"].combine_chunks(),
            streams["keys"].combine_chunks(),
            pa.array([own["flags"]], pa.list_(pa.bool_())),
            pa.array([n_known], pa.list_(pa.int64())),
            pa.array([base], pa.list_(pa.float64())),
            pa.array([within], pa.list_(pa.float64())),
            pa.array([pack_numbers(sizes)], pa.binary()),
            pa.array([pack_numbers(np.concatenate(streams_of))], pa.binary()),
        ]
        return pa.table(columns, ["block", "keys", "flags", "n_known", "base", "within", "counts", "codes"])

    kind = docs.schema[key].dataType.simpleString()
    back = counts.where(F.col("block").isNotNull()).drop("sums")
    schema = f"block string, keys array<{kind}>, flags array<boolean>, n_known array<bigint>, base array<double>, within array<double>, counts binary, codes binary"
    blocks = cut(streams.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(coded, schema))
    weights = spark.sparkContext.broadcast(train_on_all(first, blocks))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in ("flags", "n_known", "base", "within", "counts", "codes")}
                sizes = unpack_numbers(row["counts"], np.uint32).astype(np.int64)
                documents = np.split(unpack_numbers(row["codes"], np.uint16), np.cumsum(sizes)[:-1])
                neural = neural_scores(weights.value, documents) / np.log(10)
                columns = [
                    batch.column("keys")[i].values,
                    pa.array([not f for f in row["flags"]], pa.bool_()),
                    pa.array(sizes, pa.int64()),
                    pa.array(row["n_known"], pa.int64()),
                    pa.array([n] * len(sizes), pa.int64()),
                    pa.array(row["base"], pa.float64()),
                    pa.array(neural + np.array(row["within"]), pa.float64()),
                ]
                yield pa.record_batch(columns, ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.mapInArrow(scored, schema).withColumnRenamed("key", key)


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score(table(spark, sf_dir, "documents"))
