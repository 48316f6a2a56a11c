"""Curation of generated questions in one run, with what each step drops taken on the way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemill.functions import text as tx
from tidemill.operators import corpus, neardup
from tidemill.operators import retrieval as r
from tidemill.operators.search import stored

#: Cosine from which two questions of a chunk, or a question and an evaluation question, are too near.
NEAR, OVERLAP = 0.95, 0.93
STEPS = ("exact_duplicate", "near_duplicate", "golden_overlap", "round_trip", "over_cap")


def _observed(df: DataFrame, name: str, seen: dict[str, Observation]) -> DataFrame:
    seen[name] = Observation()
    return df.observe(seen[name], F.count("*").alias("n"))


def curate(questions: DataFrame, golden: DataFrame, own_ranks: DataFrame, top: int = 3, cap: int = 5) -> tuple[DataFrame, dict[str, int]]:
    """(kept questions, rows after each step): all steps, each counted where it happens.

    questions (query_id, question, chunk_id, style, score, embedding); golden (item_id, text) of evaluation questions;
    own_ranks (query_id, rank) of each question's own chunk when it is searched for. The first of equal normalized
    questions stays, then of near ones of a chunk; then go those equal or near to an evaluation question, those whose
    chunk is not among the ``top``, and those over ``cap`` a chunk. Counts come from the jobs that write the
    results, two and the rounds of the near duplicates, not from jobs of their own.
    """
    seen: dict[str, Observation] = {}
    keyed = _observed(questions, "raw", seen).withColumn("key", tx.normalized_key(F.col("question")))
    first = F.row_number().over(W.partitionBy("key").orderBy("query_id"))
    exact = stored(_observed(keyed.withColumn("n", first).where("n = 1").drop("n"), STEPS[0], seen))
    apart = neardup.dedup_near(exact, "chunk_id", NEAR, key="query_id").select("query_id")
    distinct = _observed(exact.join(apart, "query_id", "left_semi"), STEPS[1], seen)
    sides = tx.hash_embed(golden, "item_id", "text")
    asked = exact.select("query_id", F.col("embedding").alias("vector"))
    overlap = r.dense(asked, sides, "item_id", pool=1).where(F.round("cosine", 9) >= OVERLAP).select("query_id")
    equal = golden.select(tx.normalized_key(F.col("text")).alias("key")).distinct()
    clean = _observed(distinct.join(overlap, "query_id", "left_anti").join(equal, "key", "left_anti"), STEPS[2], seen)
    back = _observed(clean.join(own_ranks.where(F.col("rank") <= top).select("query_id"), "query_id", "left_semi"), STEPS[3], seen)
    kept = stored(_observed(corpus.cap_per_chunk(back, cap), STEPS[4], seen))
    return kept.drop("key"), {name: o.get["n"] for name, o in seen.items()}


def filter_report(questions: DataFrame, golden: DataFrame, own_ranks: DataFrame, chunks: DataFrame, top: int = 3, cap: int = 5) -> DataFrame:
    """(section, name, n): raw, dropped by step, kept, kept by style, chunks by questions kept, chunks without any, split."""
    kept, left = curate(questions, golden, own_ranks, top, cap)
    split = corpus.train_val_split(kept)
    spark, before = kept.sparkSession, [left["raw"], *[left[s] for s in STEPS]]
    fixed = [("raw", "", before[0])] + [("dropped", s, a - b) for s, a, b in zip(STEPS, before, before[1:])] + [("kept", "", before[-1])]
    per_chunk = kept.groupBy("chunk_id").agg(F.count("*").alias("questions"))
    n = F.count("*").alias("n")
    parts = [
        spark.createDataFrame(fixed, "section string, name string, n long"),
        kept.groupBy("style").agg(n).select(F.lit("kept_by_style").alias("section"), F.col("style").alias("name"), "n"),
        per_chunk.groupBy("questions").agg(n).select(F.lit("chunks_by_questions"), F.col("questions").cast("string"), "n"),
        chunks.select("chunk_id").distinct().join(per_chunk, "chunk_id", "left_anti").agg(n).select(F.lit("chunks_without_questions"), F.lit(""), "n"),
        split.groupBy("validation").agg(n).select(F.lit("split"), F.when(F.col("validation"), "validation").otherwise("train"), "n"),
    ]
    return reduce(DataFrame.union, parts)
