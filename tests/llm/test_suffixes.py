"""Removal of repeated bytes against a table of all strings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import texts
from tidemill.llm import suffixes


def expected(rows):
    size = suffixes.LENGTH
    data = [(k, (t or "").encode()) for k, t in rows]
    count = Counter(b[i : i + size] for _, b in data for i in range(len(b) - size + 1))
    out = []
    for k, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((k, len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    rows = df.select("doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept").collect()
    assert all(r.n_spans == len(r.spans) and r.n_removed == sum(s.size for s in r.spans) == r.n_bytes - len(r.kept) for r in rows)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows), key=str)


def hard():
    """Self-repeats, periods, overlaps, one character often, repeats of just 199, 200 and 201 bytes, split characters."""
    rng = random.Random(3)

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passage, line = noise(700), noise(230)
    out = ["a" * 1000, "a" * 200, "a" * 199, "ab" * 300, noise(300), noise(150) + passage + noise(90), passage[100:], "ü" * 150 + noise(20), "é" + "ü" * 160]
    out += [noise(rng.randint(5, 90)) + line + noise(rng.randint(5, 90)) for _ in range(40)]
    for n in (199, 200, 201):
        part = noise(n)
        out += [noise(50) + part + noise(60), noise(3) + part]
    twice = noise(260)
    return list(enumerate([*out, noise(80) + twice + noise(10) + twice, noise(400) * 2, *texts()[4][1:], "b" * 400, "b" * 400], 100))


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = suffixes.op11_repeated_bytes(spark, sf_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


@pytest.mark.parametrize("most", [suffixes.MOST, 1])
def test_edges(spark, small, empty, monkeypatch, most):
    """With nearly every bucket hot too, so that contexts are dealt again in all rounds."""
    monkeypatch.setattr(suffixes, "MOST", most)
    rows = texts() + hard()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(suffixes.remove_repeated_bytes(docs)) == expected(rows)
    if most > 1:
        got = suffixes.remove_repeated_bytes(small)
        assert got.columns == [*small.columns, "n_bytes", "n_removed", "n_spans", "spans", "kept"][:8] + ["n_bytes", "n_removed", "n_spans", "spans", "kept"]
        assert found(got) == expected(texts())
        assert suffixes.remove_repeated_bytes(empty).count() == 0


def test_refinement_is_a_suffix_order():
    """Pointers at each depth say which suffixes share so many bytes, and their order is that of the suffixes."""
    rng = random.Random(1)
    data = "".join(rng.choice("ab") for _ in range(400)) + "ab" * 150
    x = np.frombuffer(data.encode(), np.uint8)
    left = len(x) - np.arange(len(x))
    pointers, active = suffixes.initial(x, left)
    for depth in (8, 16, 24, 31, 200):
        got = suffixes.refine(pointers, active, suffixes.Q, left, depth)
        own = [i for i in range(len(x)) if left[i] >= depth]
        for i in own:
            for j in own[::7]:
                a, b = data[i : i + depth], data[j : j + depth]
                assert (got[i] == got[j]) == (a == b) and (got[i] < got[j]) == (a < b)


def test_contexts_cover_every_window_once(monkeypatch):
    for segment in (suffixes.SEGMENT, 97):
        monkeypatch.setattr(suffixes, "SEGMENT", segment)
        for _, t in hard():
            for gram in suffixes.GRAMS:
                at = [(s, n) for _, starts, sizes in suffixes.contexts(t.encode(), gram) for s, n in zip(starts.tolist(), sizes.tolist())]
                assert [i for s, n in at for i in range(s, s + n)] == list(range(len(t.encode()) - suffixes.LENGTH + 1))
                assert all(n <= suffixes.LENGTH - gram + 1 for _, n in at)
