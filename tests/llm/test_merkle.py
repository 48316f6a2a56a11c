"""The manifest against trees built in one place."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import texts
from tidemill.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        out.append((i - first, [level[k] for k in range(first, min(first + 3, len(level))) if k != i]))
        i //= 3
    return out


def expected(rows):
    """rows: (key, source, leaf, received) in the order of their trees."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([r[2] for r in by[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (key, _, leaf, received) in enumerate(by[s]):
            way, x = siblings(trees[s], i) + siblings(top, k), received
            for place, own in way:
                x = h(*own[:place], x, *own[place:])
            out.append((key, leaf, trees[s][-1][0], top[-1][0], h(*[d for _, own in way for d in own]), x, x == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=str)


def document_rows(docs):
    def leaf(r, text):
        return h(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def received(r):
        odd = r.text is None or r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 2
        return leaf(r, r.text if odd else r.text.replace("\n", ""))

    rows = [(r.doc_id, r.source, leaf(r, r.text), received(r)) for r in docs]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))


@pytest.mark.parametrize("n", [*range(1, 31), 80, 81, 82, 243, 500, 728, 729])
def test_positions_are_those_of_the_log(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    for top in (merkle.levels(n), merkle.HEIGHT):
        log = merkle.append_all(leaves, top)
        level, up = leaves, 0
        while True:
            for index, node in enumerate(level):
                assert log[merkle.position(up, index, n, top)] == node
            if up == top:
                break
            level, up = [merkle.parent(level[i : i + 3]) for i in range(0, len(level), 3)], up + 1
        assert merkle.position(top, 0, n, top) == len(log) - 1
        joined = b"".join(log)
        for i in {0, n // 2, n - 1}:
            assert merkle.fold(leaves[i], merkle.path(joined, i, n, top)) == log[-1]


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = merkle.op13_manifest(spark, sf_dir)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found(got) == expected(document_rows(docs))


def test_edges(spark, small, empty):
    """Null keys and sources, repeated keys and rows, other columns."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    now = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))

    def run(docs):
        return merkle.manifest(docs, "source", "doc_id", merkle.digest(*fields, F.col("text")), merkle.digest(*fields, now))

    assert found(run(small)) == expected(document_rows(small.collect()))
    assert run(empty).count() == 0
    one = small.where("doc_id = 5")
    assert found(run(one)) == expected(document_rows(one.collect())) and found(run(one))[0][4] == h()
    twice = small.unionByName(small).drop("size", "part")
    assert found(run(twice)) == expected(document_rows(twice.collect()))
    assert len(texts()) == small.count()


def test_more_than_one_builder_and_round(spark):
    """A source that fills several builders beside small ones, in any order of rows; any change is found."""
    rows = spark.range(2_400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, "big").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("source"))
    leaf = merkle.digest(F.col("doc_id"), F.col("source"))
    changed = F.when(F.col("doc_id") == 1_500, F.lit(h("other"))).otherwise(leaf)
    got = found(merkle.manifest(rows.repartition(5), "source", "doc_id", leaf, changed))
    want = [(r.doc_id, r.source, h(field(r.doc_id), field(r.source))) for r in rows.orderBy("doc_id").collect()]
    assert got == expected([(*r, h("other") if r[0] == 1_500 else r[2]) for r in want])
    assert [r[0] for r in got if not r[-1]] == [1_500]
