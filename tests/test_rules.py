"""SQL and queries that state one rule at any size."""

import duckdb
import pandas as pd

from tests.compare import spark_rows
from tidemill.operators import corpus
from tidemill.plans import registry


def test_rows_are_numbered_once(spark):
    """Ranges are drawn from samples; with small ones, two drawings differ."""
    conf = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(5000).selectExpr("id * 7919 % 5000 AS k", "id * 7919 % 5000 + 1 AS v").repartition(5)
        got = {x.position: x for x in corpus.chunk_table_rows(df, ["k", "v"], "k", 10).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 500
    for p, x in got.items():
        assert (x.rows, x.content) == (f"{10 * p + 1}-{10 * p + 10}", "k | v\n" + "\n".join(f"{n} | {n + 1}" for n in range(10 * p, 10 * p + 10)))


def test_chunks_leave_a_task_in_pieces(monkeypatch):
    """What is made of a batch is bounded by characters, and nothing of it is lost."""
    monkeypatch.setattr(corpus, "PIECE", 100)
    texts = pd.DataFrame({"doc_id": range(20), "text": [None if i == 3 else "one two. " * i for i in range(20)]})
    ran = []

    class Docs:
        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            ran.extend(run(iter([texts])))

    corpus.chunk_by_size(Docs(), 30)
    assert len(ran) > 5
    want = [(i, n, c) for i, t in zip(texts.doc_id, texts.text) for n, c in enumerate(corpus.split_by_size(t or "", 30, False))]
    assert [tuple(x) for df in ran for x in df.itertuples(index=False)] == want


def test_deadlines_of_late_tickets(spark, tmp_path):
    rows = [(c, 1, "user", "x") for c in (0, 6, 18, 600, 6000, 60000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    sql = con.execute(registry.oracles()["j10_working_deadline"]).fetchall()
    cols, got = spark_rows(registry.queries()["j10_working_deadline"](spark, str(tmp_path)))
    assert cols == ["due_s", "ticket_id"] and len(got) == 6
    assert got == sorted(str([str(due), str(ticket)]) for ticket, due in sql)
