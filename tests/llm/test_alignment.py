"""Alignment of two tokenizations against a plain walk over both."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tests.llm.conftest import texts
from tidemill.llm import alignment

ODD = [
    "two  spaces\n\n and a line\t tab ", " leads", "▁ is no space", "a ▁ b", "<|endoftext|> <s> </s> <unk> <0x41>", "x" * 3000, "\x00 \x1c \x85 z",
    "漢字 かな é é ﬁ Ａ", " ", "  ", "\n", "don't we'll 12 345 ...", "the the the the", "); {\r\n} \r x",
]


@pytest.fixture(scope="module")
def pair():
    return alignment.tokenizers(public_tokenizers.path(alignment.BYTE_BPE), public_tokenizers.path(alignment.PIECE_BPE))


def walked(pair, text):
    """(ids of A, ids of B, groups, links), or nothing where bytes differ."""
    if not text:
        return [], [], [], []
    spelled = alignment._byte_level()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    at = [bytes(spelled[c] for c in pair.a.id_to_token(i)) for i in a]
    bt = [alignment.piece_bytes(pair.b.id_to_piece(i)) for i in b]
    if not b"".join(at) == b"".join(bt) == (" " + text).encode():
        return [], [], [], []
    a_ends, b_ends = np.cumsum([len(t) for t in at]), np.cumsum([len(t) for t in bt])
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(a_ends.tolist()) & set(b_ends.tolist())):
        p, q = int(np.searchsorted(a_ends, end)) + 1, int(np.searchsorted(b_ends, end)) + 1
        groups.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
        for x in range(i, p):
            for y in range(j, q):
                if max(a_ends[x] - len(at[x]), b_ends[y] - len(bt[y])) < min(a_ends[x], b_ends[y]):
                    links.append((a[x], b[y]))
        i, j = p, q
    return a, b, groups, links


def expected(pair, rows):
    each = [(k, *walked(pair, t)) for k, t in rows]
    count = Counter(link for *_, links in each for link in links)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(
        (
            (
                k, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
            )
            for k, a, b, groups, links in each
        ),
        key=str,
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_documents(spark, sf_dir, pair):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = alignment.op12_alignment(spark, sf_dir)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(pair, rows)


def test_edges(spark, small, empty, pair):
    """Nulls, repeats, odd white space, text that looks like special tokens, texts that B can't give back."""
    rows = texts() + [(100 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = alignment.align(docs, spell=True)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str) == expected(pair, rows)
    spelled = {r.doc_id: r.groups for r in got.where("doc_id >= 100").collect()}
    assert all(spelled[100 + i] == ";".join(walked(pair, t)[2]) for i, t in enumerate(ODD))
    assert [spelled[100 + i] for i in (2, 3)] == ["", ""]
    assert sorted((tuple(r) for r in alignment.align(small).select(*COLUMNS).collect()), key=str) == expected(pair, texts())
    assert alignment.align(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r)[:8] for r in alignment.align(blank).collect()) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]


def test_blocks_and_packets_do_not_matter(spark, pair, monkeypatch):
    """Chunks join to what whole texts give, and small batches, packets and blocks to what large ones give."""
    monkeypatch.setattr(alignment, "PACKET", 3)
    for text in [t for _, t in texts() if t] + ODD:
        chunks = alignment.CHUNKS.split(" " + text)
        a, b = pair.encode(chunks)
        if "▁" not in text:
            assert sum(a, []) == pair.a.encode(" " + text, add_special_tokens=False).ids and sum(b, []) == pair.b.encode(text)
    block = alignment._Block(alignment.Chunks(pair))
    for k in range(700):
        block.add(k, f"one two {k % 5} two two one {'three ' * (k % 4)}")
        if k % 3 == 0:
            block.chunks.align_new()
    block.chunks.align_new()
    block.documents(False)
    found, want = Counter(), defaultdict(Counter)
    for packet in block.postings():
        pairs, bitmaps, planes = alignment.unpack_postings(packet)
        for w, which, maps in ((1, np.arange(len(pairs)), bitmaps), *((1 << k, x, m) for k, (x, m) in enumerate(planes))):
            assert alignment.popcounts(maps, 700).tolist() == np.bincount(alignment.members(maps, 700)[0], minlength=len(maps)).tolist()
            for i, d in zip(*alignment.members(maps, 700)):
                found[int(pairs[which[i]]), int(d)] += w
    for k in range(700):
        for a, b in walked(pair, f"one two {k % 5} two two one {'three ' * (k % 4)}")[3]:
            want[a * 32000 + b][k] += 1
    assert found == Counter({(p, d): n for p, own in want.items() for d, n in own.items()})


def test_bitmaps_take_the_shorter_form():
    pairs, docs = np.repeat([0, 1, 2], [3, 500, 1000]), np.r_[[1, 5, 999], np.arange(0, 1000, 2), np.arange(1000)]
    maps = alignment.containers(pairs, docs, 3, 1000)
    assert [len(m) for m in maps] == [6, 125, 125] and alignment.popcounts(maps, 1000).tolist() == [3, 500, 1000]
    assert all(np.array_equal(x, y) for x, y in zip(alignment.members(maps, 1000), (pairs, docs)))
