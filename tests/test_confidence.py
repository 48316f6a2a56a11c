"""Factors of an answer's confidence, by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemill.functions import confidence as cf

WORDS = " ".join(f"word{i}" for i in range(20))
CASES = [
    # question, answer, context, found -> alignment, length, coherence, certainty
    ("why so?", WORDS, "", None, (0.3, 1.0, 1.0, 1.0)),
    ("why so?", "one two", " \n ", 0.9, (0.3, 0.2, 1.0, 1.0)),
    ("why so?", "yes", "the and a !", 0.5, (0.5, 0.1, 1.0, 1.0)),
    # half of the content words, a tenth of a tenth in length, a found score over 1
    ("a b c d e f", "apple", "apple banana" + " " * 488, 7.0, (0.4 * 0.5 + 0.3 * 0.1 + 0.3, 1 / 20, 1.0, 1.0)),
    # longer than the context, nothing found
    ("a b c d e f", "xx xx xx", "xx yy", None, (0.4 * 0.5 + 0 + 0.15, 3 / 20, 1.0, 1.0)),
    # connectors in one of two sentences, two phrases of doubt, 3 of 4 words distinct
    (" ".join("abcdefghijklmnop"), "Thus maybe? Maybe perhaps!", None, None, (0.3, 4 / 30, 0.6 * 0.5 + 0.4 * 4 / 4, 0.6)),
    ("", None, None, None, (0.3, 0.0, 1.0, 1.0)),
    ("q", " ".join(["tôi nghĩ có lẽ hình như dường như không rõ"] * 30), "", None, (0.3, 0.0, 1.0, 0.8)),
]


@pytest.mark.parametrize(("question", "answer", "context", "found", "want"), CASES)
def test_factors(spark, question, answer, context, found, want):
    row = spark.createDataFrame([(question, answer, context, found)], "q string, a string, c string, f double")
    parts = cf.factors(F.col("q"), F.col("a"), F.col("c"), F.col("f"))
    got = row.select(*[p.alias(n) for n, p in parts.items()], cf.overall(parts).alias("score")).first()
    assert [round(got[n], 9) for n in parts] == [round(x, 9) for x in want]
    assert got.score == pytest.approx(sum(w * x for w, x in zip(cf.WEIGHTS.values(), want)))


def test_levels(spark):
    rows = spark.createDataFrame([(x,) for x in (0.8, 0.79, 0.6, 0.5, 0.4, 0.39)], "x double").select(cf.level(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["High", "Moderate", "Moderate", "Low", "Low", "Very Low"]
