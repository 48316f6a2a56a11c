"""Streams over several batches of files, in any order, against one pass over everything; alerts against goldens."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tests.compare import duckdb_rows, spark_rows
from tidemill.operators import search
from tidemill.plans import fixtures, registry
from tidemill.plans import live as plans
from tidemill.sources import files
from tidemill.streaming import live, rollup, segments

HOUR, DAY = 3600, 86400


def at(day, hour=0, month=1):
    return int(datetime.datetime(2024, month, day, hour, tzinfo=datetime.timezone.utc).timestamp())


def condition(rule, at_s, firing, delivered=True):
    return (rule, "condition", at_s, firing, 0, 0, delivered)


def level(at_s, reached, delivered=True):
    return ("spend", "level", at_s, False, reached, 0, delivered)


def count(at_s, seen, delivered=True):
    return ("uploads", "count", at_s, False, 0, seen, delivered)


CHECKS = [
    # goes on: again after six hours, not before; over once
    condition("a", 0, True), condition("a", HOUR, True), condition("a", 7 * HOUR, True), condition("a", 8 * HOUR, False), condition("a", 9 * HOUR, False),
    condition("b", 5, False),
    # not delivered: tried again, and what was never sent is not over
    condition("c", 0, True, False), condition("c", HOUR, False), condition("c", 2 * HOUR, True, False), condition("c", 3 * HOUR, True), condition("c", 4 * HOUR, False),
    # each level once a month, straight to the higher one in the next, and nothing for the lower one then
    level(at(3), 0), level(at(4), 1), level(at(5), 1), level(at(6), 2, False), level(at(7), 2), level(at(8), 2), level(at(9), 1),
    level(at(1, 1, 2), 2), level(at(2, 1, 2), 1),
    # the first check remembers what was there; then only what is new
    count(at(1), 4), count(at(2), 4), count(at(3), 6, False), count(at(4), 7), count(at(5), 7), count(at(6), 8),
]
ALERTS = [
    ("a", 0, "fired", 0), ("a", 7 * HOUR, "repeated", 0), ("a", 8 * HOUR, "resolved", 0),
    ("c", 3 * HOUR, "fired", 0), ("c", 4 * HOUR, "resolved", 0),
    ("spend", at(4), "reached", 1), ("spend", at(7), "reached", 2), ("spend", at(1, 1, 2), "reached", 2),
    ("uploads", at(4), "failed", 3), ("uploads", at(6), "failed", 1),
]


def test_alerts(spark, tmp_path):
    """In one batch, and in a stream of five that stops and goes on from its state."""
    df = spark.createDataFrame(CHECKS, live.CHECKS)
    assert sorted(map(tuple, live.alert_state_batch(df).collect())) == sorted(ALERTS)
    path, out = str(tmp_path / "checks"), []
    by_time = sorted(CHECKS, key=lambda c: c[2])
    size = -(-len(by_time) // 5)

    def write(batch, _):
        out.extend(map(tuple, batch.collect()))

    for begin in range(0, len(by_time), size):
        spark.createDataFrame(by_time[begin : begin + size], live.CHECKS).coalesce(1).write.mode("append").parquet(path)
        checks = files.file_stream(spark, path, 1)
        query = live.alert_state(checks).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    assert sorted(out) == sorted(ALERTS)


def dealt(df, path, n, key, by_order=None):
    """df in n files, by a hash of the key, or in the order of a column."""
    part = F.pmod(F.xxhash64(key), F.lit(n)) if by_order is None else F.ntile(n).over(by_order) - 1
    rows = df.withColumn("__part", part)
    for i in range(n):
        rows.where(F.col("__part") == i).drop("__part").coalesce(1).write.mode("append").parquet(path)


def test_rollup_of_shuffled_files(spark, tmp_path, sf_dir):
    """Five batches that each touch every day, so all but the first are late: the rollup is that of one pass."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    for name in fixtures.TABLES:
        if name != "conversations":
            (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    dealt(conversations, str(tmp_path / "conversations.parquet"), 5, "turn")
    got = plans.kept_rollup(fixtures.Inputs(spark, str(tmp_path)), files=1)
    assert spark_rows(got) == duckdb_rows(registry.oracles()["a1_daily_rollup"], sf_dir)


def test_rollup_goes_on_and_replaces_only_touched_days(spark, tmp_path):
    def messages(*rows):
        schema = "message_id long, conv_id long, turn int, role string, content string, created_at timestamp, outcome string, confidence double, latency_ms long, cached boolean, guard_reason string"
        return spark.createDataFrame([(i, i, 0, "assistant", "x", datetime.datetime.fromtimestamp(s, datetime.timezone.utc), "answered", 0.5, ms, False, None) for i, s, ms in rows], schema)

    none = messages().limit(0)
    facts = rollup.Facts(
        none.select("created_at"), none.select("created_at", F.lit("s").alias("step"), F.lit("1").alias("value")),
        none.select("created_at", F.lit("m").alias("model"), F.lit(1).alias("prompt"), F.lit(1).alias("completion")),
        spark.createDataFrame([("m", 1, 1)], "model string, price_in int, price_out int").selectExpr("model", "CAST(price_in AS DECIMAL(14,6)) price_in", "CAST(price_out AS DECIMAL(14,6)) price_out"),
    )
    where, path = str(tmp_path / "run"), str(tmp_path / "messages")

    def run(*rows):
        messages(*rows).coalesce(1).write.mode("append").parquet(path)
        got = rollup.keep_rollup(files.file_stream(spark, path, 1), facts, where=where).collect()
        return {r.day: (r.turns, r.p50_ms) for r in got}

    # 17:00 UTC is the next local day
    assert run((1, at(1, 1), 100), (2, at(1, 18), 300), (3, at(9), 500)) == {"2024-01-01": (1, 100), "2024-01-02": (1, 300), "2024-01-09": (1, 500)}
    assert run((4, at(1, 2), 200)) == {"2024-01-01": (2, 150), "2024-01-02": (1, 300), "2024-01-09": (1, 500)}


CHANGES = [
    [(1, "one two two", False, 1), (2, "two three", False, 1), (3, "gone soon", False, 1), (1, "burst loses", False, 0)],
    [(2, "three three four", False, 2), (4, None, False, 1), (5, "", False, 1)],
    [(3, None, True, 3), (9, "never there", True, 1), (6, "one six", False, 1)],
    [(3, "back again two", False, 4), (6, "one six", False, 2)],
    [(1, "one", False, 5), (2, "x", True, 6), (2, "two last", False, 7)],
]
LATEST = {1: "one", 2: "two last", 3: "back again two", 4: None, 5: "", 6: "one six"}


@pytest.mark.parametrize("every", [2, 20])
def test_segments_are_a_full_rebuild(spark, tmp_path, every):
    """After updates and deletions over five batches, with and without compaction; the stream goes on from its state."""
    path, where = str(tmp_path / "changes"), str(tmp_path / "index")
    for changes in CHANGES:
        spark.createDataFrame(changes, "key long, text string, deleted boolean, at long").coalesce(1).write.mode("append").parquet(path)
        got = segments.keep_index(files.file_stream(spark, path, 1), where, every)
    index = got.index()
    assert got.generation() == (2 if every == 2 else 0)
    whole = search.build_index(spark.createDataFrame(list(LATEST.items()), "key long, text string"), "key", "text")
    assert (index.n, index.mean, index.floor) == (whole.n, whole.mean, whole.floor)
    assert {(r.term, r.df) for r in index.terms.collect()} == {(r.term, r.df) for r in whole.terms.collect()}

    def rows(i):
        return sorted((r.key, r.length, sorted(zip(r.terms, r.counts)), r.vector) for r in i.rows.collect())

    assert rows(index) == rows(whole)
    again = CHANGES[-1]
    got.apply(spark.createDataFrame(again, "key long, text string, deleted boolean, at long"), 4)  # a batch that is tried again
    index = got.index()
    assert rows(index) == rows(whole) and index.n == whole.n
    asked = spark.createDataFrame([(1, "one two")], "query_id long, query string")
    found = [search.hybrid_pool(search.Index(i.rows.withColumn("priority", F.lit(1.0)), i.terms, i.n, i.mean, i.floor), asked, 3).orderBy("pool_rank").collect() for i in (index, whole)]
    assert [(r.key, r.fused) for r in found[0]] == [(r.key, r.fused) for r in found[1]]
