"""Text scores and counts of an inverted index, worked out where a text is read."""

import contextlib
import io

import duckdb

from tidemill.operators import retrieval as r
from tidemill.plans.retrieval import INDEX

ROWS = [(1, "Đá và nước, nước"), (2, ""), (3, ", ."), (2, "nước a a"), (4, "a b c"), (5, "Một, hai: ba"), (6, "b b"), (7, "hai c d")]
ASKS = [(0, "nước a a"), (1, "không"), (2, "hai b"), (3, None)]


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def from_sql(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", ASKS)
    return sorted(con.execute(f"WITH {INDEX} {sql}").fetchall())


def test_scores_equal_sql_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(r, "ASKED", 2)
    monkeypatch.setattr(r, "CELLS", 4)
    docs = spark.createDataFrame([x for i, x in enumerate(ROWS) if i != 3], "doc_id long, text string")
    asked = spark.createDataFrame(ASKS, "query_id long, query string")
    got = r.bm25(asked, docs)
    assert sorted((x.query_id, x.doc_id, round(x.bm25, 9)) for x in got.collect()) == from_sql([x for i, x in enumerate(ROWS) if i != 3], "SELECT query_id, doc_id, round(bm25, 9) FROM bm")
    assert "Exchange" not in plan(got)
    assert "Exchange" not in plan(r.postings(docs, "doc_id", "text"))


def test_repeated_keys_count_together(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = sorted((x.doc_id, x.term, x.tf) for x in r.postings(docs, "doc_id", "text").collect())
    assert got == from_sql(ROWS, "SELECT doc_id, term, tf FROM post")
    got = sorted((x.term, x.df, round(x.idf, 9)) for x in r.term_stats(r.document_counts(r.tokenized(docs, "doc_id", "text"), "doc_id")).collect())
    assert got == from_sql(ROWS, "SELECT term, df, round(idf, 9) FROM idf")
    assert {(x.query_id, x.doc_id) for x in r.bm25(spark.createDataFrame(ASKS, "query_id long, query string"), docs).collect()} == set(from_sql(ROWS, "SELECT query_id, doc_id FROM bm"))
