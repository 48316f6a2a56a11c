from __future__ import annotations

import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


def texts():
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(120)]
    near = base[:]
    near[60] = "changed"
    other = [rng.choice(WORDS) for _ in range(90)]
    long = " ".join(rng.choice(WORDS) for _ in range(30_000))
    return [
        (1, None), (2, ""), (3, "one"), (4, "a b c"), (5, " ".join(base)), (6, " ".join(near)), (7, " ".join(base)),
        (8, long), (9, " ".join(other[:40] + base[10:45] + other[40:])), (10, " \t\n "), (11, "Ünïcode ßtraße 漢字 " * 8),
        (12, "don't  stop\n\nnow 's 12 345"), (9, "repeated key with its own text"), (3, "one"), (None, "no key at all"), (13, "x" * 5000),
    ]


@pytest.fixture(scope="session")
def small(spark):
    """Documents with nulls, ties, repeats, long texts and columns whose names operators use themselves."""
    rows = [(k, t, "en", None if i % 5 == 4 else f"s{i % 3}", len(t or ""), i, 1.5, "x", True) for i, (k, t) in enumerate(texts())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, part string, kept boolean"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(small):
    return small.where("false")
