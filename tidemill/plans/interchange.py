"""Queries over sources and operators.interchange."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import parsing, text as tx
from tidemill.operators import corpus, interchange as i, privacy
from tidemill.operators import relational as rel
from tidemill.plans.metrics import COSTED, ROLLUP, rollup, text_day
from tidemill.plans.registry import query
from tidemill.sources import files
from tidemill.streaming.live import work_dir


@query("s1_scan_table", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < DATE '1996-01-01'")
def s1(t):
    return files.scan_table(t.spark, "orders", t.sf_dir, ["o_orderkey", "o_totalprice", "o_orderdate"]).where("o_orderdate < DATE '1996-01-01'").drop("o_orderdate")


@query("s2_read_jsonl", "SELECT event_id, event_type FROM events WHERE event_id % 10 <> 0")
def s2(t):
    """Events as JSON lines, every tenth one cut short, read back by schema."""
    line = F.to_json(F.struct("event_id", "event_type"))
    rows = t.events.select(F.when(F.col("event_id") % 10 == 0, F.left(line, F.lit(9))).otherwise(line).alias("value"))
    return files.parse_events(rows, "event_id long, event_type string")


@query("s4_csv_as_table_text", "SELECT n_nationkey, n_nationkey || ' | ' || coalesce(nullif(n_name, 'FRANCE'), 'nan') || ' | ' || n_regionkey AS line FROM nation")
def s4(t):
    holes = t.nation.withColumn("n_name", F.nullif("n_name", F.lit("FRANCE")))
    return holes.select("n_nationkey", corpus.table_text(holes, ["n_nationkey", "n_name", "n_regionkey"]).alias("line"))


FIRSTS = """firsts AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user' AND trim(text) <> '') AS question, arg_min(text, turn) FILTER (role = 'assistant' AND trim(text) <> '') AS answer
  FROM conversations GROUP BY 1)"""


@query("s5_chat_to_pairs", f"WITH {FIRSTS} SELECT * FROM firsts WHERE question IS NOT NULL AND answer IS NOT NULL")
def s5(t):
    return i.chat_to_pairs(t.conversations)


@query("s6_qa_to_chat")
def s6(t):
    return i.qa_to_chat(t.v_qa.select("question", "answer"), "Answer briefly.")


@query("s7_event_source", "SELECT event_type, count(*) AS n FROM events WHERE length(props) <= 9 GROUP BY 1")
def s7(t):
    return t.events.where(F.length("props") <= 9).where(F.get_json_object("props", "$.k").isNotNull()).groupBy("event_type").agg(F.count("*").alias("n"))


@query("s8_qa_text", f"WITH {FIRSTS} SELECT conv_id, 'Q: ' || question || chr(10) || chr(10) || 'A: ' || answer AS text FROM firsts WHERE question IS NOT NULL AND answer IS NOT NULL")
def s8(t):
    return i.qa_text(i.chat_to_pairs(t.conversations), "conv_id")


@query("s9_export_bundle", """SELECT d.document_id, d.source, d.content_hash, count(c.chunk_id) AS n_chunks, max(c.position) AS last FROM v_documents d LEFT JOIN v_chunks c USING (document_id)
  WHERE d.status = 'ready' AND d.review = 'approved' GROUP BY ALL""")
def s9(t):
    out = i.export_bundle(t.v_documents, t.v_chunks)
    return out.select("document_id", "source", "content_hash", F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("n_chunks"), F.try_element_at("chunks", F.lit(-1))["position"].alias("last"))


@query("s10_import_bundle", """SELECT CASE WHEN tier NOT IN ('anonymous', 'user', 'premium') THEN 'rejected' WHEN (source, content_hash) IN (SELECT (source, content_hash) FROM v_documents WHERE id % 3 = 0) THEN 'skipped' ELSE 'created' END AS result,
  count(*) AS n FROM v_documents WHERE status = 'ready' AND review = 'approved' GROUP BY 1""")
def s10(t):
    bundle = i.export_bundle(t.v_documents, t.v_chunks)
    return i.import_bundle(bundle, t.v_documents.where("id % 3 = 0")).groupBy("result").agg(F.count("*").alias("n"))


@query("s11_upsert_daily", f"WITH {COSTED}, {ROLLUP} SELECT * FROM rollup_")
def s11(t):
    """The daily rollup, of which every other day was stored with wrong figures before, and is replaced."""
    path, right = f"{work_dir(t.spark)}/rollup", text_day(rollup(t))
    odd = F.dayofmonth("day") % 2 == 1
    i.upsert_daily(right.withColumn("turns", F.col("turns") + odd.cast("int")), path)
    i.upsert_daily(right.where(odd), path)
    return text_day(t.spark.read.parquet(path))


@query("s12_merge_counters", "SELECT end_user_id, model, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion FROM v_token_usage GROUP BY 1, 2")
def s12(t):
    keys, values = ["end_user_id", "model"], ["prompt", "completion"]
    part = t.v_token_usage.select(*keys, *values, "usage_id")
    stored = part.where("usage_id % 2 = 0").groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    return i.merge_counters(stored, part.where("usage_id % 2 = 1").drop("usage_id"), keys, values)


@query("s13_eval_export")
def s13(t):
    cited = t.v_citations.groupBy("message_id").agg(F.array_sort(F.collect_set("document_id")).alias("sources"))
    asked = rel.question_before(t.v_messages).join(cited, "message_id").where("question IS NOT NULL")
    return i.eval_export(asked.select(F.col("question").alias("query"), "sources", "created_at"))


@query("p9_query_logs", """SELECT audit_id AS log_id, level FROM (SELECT *, CASE WHEN status_code >= 500 THEN 'ERROR' WHEN status_code >= 400 THEN 'WARNING' ELSE 'INFO' END AS level FROM v_audit)
  WHERE level IN ('WARNING', 'ERROR') AND path LIKE '%doc%' ORDER BY created_at DESC, audit_id LIMIT 100""")
def p9(t):
    level = F.when(F.col("status_code") >= 500, "ERROR").when(F.col("status_code") >= 400, "warning").otherwise("INFO")
    logs = t.v_audit.select(F.col("audit_id").alias("log_id"), level.alias("level"), F.col("path").alias("message"), F.lit("audit").alias("logger"), F.col("created_at").alias("at"))
    return i.query_logs(logs, "WARNING", "DOC", 100).select("log_id", F.upper("level").alias("level"))


@query("p10_named_period", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1995-07-01' AND o_orderdate < DATE '1995-10-01'")
def p10(t):
    period = parsing.named_period(F.lit("quý 3 năm 1995"), F.expr("DATE '1998-08-02'"))
    held = t.orders.withColumn("p", period)
    day = F.col("o_orderdate").cast("date")
    return held.where((day >= F.col("p.start")) & (day < F.col("p.end"))).select("o_orderkey")


@query("p11_parse_amount", "SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) * CASE o_orderkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1 END AS amount FROM orders")
def p11(t):
    unit = F.element_at(F.array(F.lit(" nghìn"), F.lit(" triệu"), F.lit(" đ")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = F.concat(F.replace(F.format_number(F.floor("o_totalprice"), 0), F.lit(","), F.lit(".")), unit)
    return t.orders.select("o_orderkey", parsing.parse_amount(text).cast("double").alias("amount"))


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("u4_add_eval_cases", f"""WITH q AS (SELECT message_id, conv_id, regexp_replace(question, '{_MAIL}', '[EMAIL]', 'g') AS question FROM v_qa JOIN v_messages USING (conv_id, turn))
  SELECT min(message_id) AS message_id, question FROM q WHERE question NOT IN (SELECT question FROM q WHERE conv_id % 5 = 0) GROUP BY question""")
def u4(t):
    """Questions that no case has yet, with mail addresses redacted before they are compared."""
    asked = rel.question_before(t.v_messages).where("question IS NOT NULL").withColumn("sources", F.array(F.lit("a"), F.lit("a")))
    redact = lambda c: F.regexp_replace(c, _MAIL, "[EMAIL]")
    existing = asked.where("conv_id % 5 = 0").select(redact(F.col("question")).alias("question"))
    return i.add_eval_cases(asked, existing, redact).select("message_id", "question")


SPENDERS = i.Template(
    sql="SELECT c_custkey, c_name, c_acctbal FROM {customer} WHERE c_acctbal >= :least AND (:nation IS NULL OR c_nationkey = :nation) ORDER BY c_acctbal DESC, c_custkey",
    arguments={"least": "number", "nation": "number"}, columns=("c_custkey", "c_name"), masked=("c_name",), limit=40,
)


@query("x1_query_template", """SELECT c_custkey, repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4) AS c_name FROM customer WHERE c_acctbal >= 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 41""")
def x1(t):
    return i.run_template(t.spark, SPENDERS, {"customer": t.customer}, {"least": 5000}, "premium")


OWN_ORDERS = i.Template(sql="SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = :user_id ORDER BY o_orderkey", columns=("o_orderkey", "o_totalprice"), bound=("user_id",), limit=100)


@query("x2_own_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey LIMIT 101")
def x2(t):
    return i.run_template(t.spark, OWN_ORDERS, {"orders": t.orders}, {}, "user", bound={"user_id": 7})


@query("x3_pluggable_scorer", "SELECT doc_id, CAST(length(text) % 100 AS DOUBLE) / 100 AS relevance FROM documents")
def x3(t):
    from tidemill.operators import retrieval as r

    pool = t.documents.select("doc_id", "text")
    return r.rerank(pool, lambda df: (F.length("text") % 100).cast("double") / 100).select("doc_id", "relevance")
