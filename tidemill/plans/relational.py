"""Queries over operators.relational."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import relational as r
from tidemill.plans.registry import query

TODAY = "DATE '2024-02-10'"
LIVE = f"""SELECT c.chunk_id, c.document_id, c.position, d.tier, d.effective_from, d.effective_to, d.source, s.priority FROM v_chunks c
  JOIN v_documents d USING (document_id) JOIN v_sources s ON s.name = d.source
  WHERE c.embedding IS NOT NULL AND d.status = 'ready' AND d.review = 'approved' AND d.enabled AND s.enabled
    AND coalesce(d.effective_to, DATE '9999-12-31') >= {TODAY}"""
SEEN = f"""SELECT * FROM ({LIVE}) WHERE tier IN ('anonymous', 'user') AND coalesce(effective_from, DATE '0001-01-01') <= {TODAY}"""


def live(t):
    return r.searchable_chunks(t.v_chunks, t.v_documents, t.v_sources, F.expr(TODAY))


@query("p1_searchable_chunks", f"SELECT chunk_id, document_id, position FROM ({LIVE})")
def p1(t):
    return live(t).select("chunk_id", "document_id", "position")


@query("p2_visible", f"SELECT chunk_id, tier FROM ({SEEN})")
def p2(t):
    return r.visible(live(t), "user", F.expr(TODAY)).select("chunk_id", "tier")


@query("p3_source_filter", f"SELECT chunk_id, source FROM ({LIVE}) WHERE source IN ('src1', 'src4')")
def p3(t):
    return r.in_sources(live(t), ["src1", "src4", "nowhere"]).select("chunk_id", "source")


@query("p4_merge_metadata", """SELECT id, title AS file_name, source, CASE WHEN id % 2 = 0 THEN 'chunk' ELSE 'document' END AS origin FROM v_documents""")
def p4(t):
    base = F.create_map(F.lit("file_name"), F.lit("?"), F.lit("origin"), F.lit("file"))
    own = F.create_map(F.lit("file_name"), F.col("title"), F.lit("source"), F.col("source"), F.lit("origin"), F.lit("document"))
    chunk = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("origin"), F.lit("chunk")))
    merged = t.v_documents.select("id", r.overlay(base, own, chunk).alias("m"))
    return merged.select("id", *[F.col("m")[k].alias(k) for k in ("file_name", "source", "origin")])


@query("p5_list_documents", """SELECT id, title, count(*) OVER () AS total FROM v_documents WHERE status = 'ready' AND title ILIKE '%doc 1%'
  ORDER BY created_at DESC, id LIMIT 20 OFFSET 5""")
def p5(t):
    kept = t.v_documents.where((F.col("status") == "ready") & r.contains_folded(F.col("title"), "doc 1"))
    total = kept.agg(F.count("*").alias("total"))
    return r.page(kept, [F.desc("created_at"), "id"], 20, 5).select("id", "title").crossJoin(total)


@query("p6_list_conversations", """SELECT conv_id, end_user_id FROM v_conversations c WHERE EXISTS (SELECT 1 FROM v_messages m WHERE m.conv_id = c.conv_id AND m.outcome = 'blocked')
  ORDER BY last_activity DESC, conv_id LIMIT 25""")
def p6(t):
    return r.page(r.with_outcome(t.v_conversations, t.v_messages, "blocked"), [F.desc("last_activity"), "conv_id"], 25).select("conv_id", "end_user_id")


@query("p7_list_handoffs", "SELECT ticket_id, status FROM v_handoffs WHERE status = 'open' ORDER BY created_at DESC, ticket_id LIMIT 10")
def p7(t):
    return r.page(t.v_handoffs.where("status = 'open'"), [F.desc("created_at"), "ticket_id"], 10).select("ticket_id", "status")


@query("p8_list_audit", """SELECT audit_id, method, path FROM v_audit WHERE actor ILIKE '%user1%' AND method = upper('post') AND path LIKE '%/users%'
  ORDER BY created_at DESC, audit_id LIMIT 30""")
def p8(t):
    kept = t.v_audit.where(r.contains_folded(F.col("actor"), "user1") & (F.col("method") == "POST") & F.contains("path", F.lit("/users")))
    return r.page(kept, [F.desc("created_at"), "audit_id"], 30).select("audit_id", "method", "path")


@query("p12_answer_drilldown", """SELECT conv_id, count(*) AS n_messages, CAST(sum(length(content)) AS BIGINT) AS chars, count(rating) AS rated
  FROM v_messages m LEFT JOIN v_feedback f USING (message_id, conv_id) GROUP BY conv_id""")
def p12(t):
    rated = t.v_messages.join(t.v_feedback.select("message_id", "rating"), "message_id", "left")
    nested = rated.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content", "rating"))).alias("messages"))
    return nested.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_messages"),
        F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"])).alias("chars"),
        F.size(F.filter("messages", lambda m: m["rating"].isNotNull())).cast("long").alias("rated"),
    )


@query("p13_feedback_inbox", """SELECT f.message_id, f.rating, q.question IS NOT NULL AS has_question FROM v_feedback f
  LEFT JOIN v_qa q ON q.conv_id = f.conv_id AND q.turn = f.turn WHERE f.rating = -1 AND f.reviewed_at IS NULL ORDER BY f.created_at DESC, f.message_id LIMIT 40""")
def p13(t):
    asked = r.question_before(t.v_messages).select("message_id", "question")
    inbox = t.v_feedback.where("rating = -1 AND reviewed_at IS NULL").join(asked, "message_id", "left")
    return r.page(inbox, [F.desc("created_at"), "message_id"], 40).select("message_id", "rating", F.col("question").isNotNull().alias("has_question"))


@query("p14_owned_by", """SELECT conv_id FROM v_conversations WHERE CASE WHEN user_id IS NOT NULL THEN user_id = 'u3' ELSE end_user_id = 'v5' END""")
def p14(t):
    return r.owned_by(t.v_conversations, "u3", "v5").select("conv_id")


@query("j1_chunk_document_source", "SELECT c.chunk_id, d.title, s.priority FROM v_chunks c JOIN v_documents d USING (document_id) JOIN v_sources s ON s.name = d.source")
def j1(t):
    named = t.v_documents.join(t.v_sources, F.col("source") == F.col("name"))
    return t.v_chunks.join(named, "document_id").select("chunk_id", "title", "priority")


@query("j2_source_counts", "SELECT s.name, count(d.id) AS documents FROM v_sources s LEFT JOIN v_documents d ON d.source = s.name AND d.status = 'failed' GROUP BY 1")
def j2(t):
    return r.source_counts(t.v_sources, t.v_documents.where("status = 'failed'"))


@query("j3_semi_join", "SELECT conv_id FROM v_conversations WHERE conv_id IN (SELECT conv_id FROM v_messages WHERE outcome = 'handoff')")
def j3(t):
    return r.with_outcome(t.v_conversations, t.v_messages, "handoff").select("conv_id")


@query("j4_anti_join", "SELECT conv_id FROM v_conversations c WHERE NOT EXISTS (SELECT 1 FROM v_feedback f WHERE f.conv_id = c.conv_id)")
def j4(t):
    return t.v_conversations.join(t.v_feedback, "conv_id", "left_anti").select("conv_id")


@query("j5_question_before", """SELECT a.message_id, q.content AS question FROM (SELECT * FROM v_messages WHERE role = 'assistant') a
  ASOF LEFT JOIN (SELECT * FROM v_messages WHERE role = 'user') q ON a.conv_id = q.conv_id AND a.created_at >= q.created_at""")
def j5(t):
    return r.question_before(t.v_messages).select("message_id", "question")


@query("j6_unnest_citations", "SELECT c.message_id, d.title FROM v_citations c JOIN v_documents d USING (document_id)")
def j6(t):
    lists = t.v_citations.groupBy("message_id").agg(F.collect_list("document_id").alias("ids"))
    return lists.select("message_id", F.explode("ids").alias("document_id")).join(t.v_documents.select("document_id", "title"), "document_id").select("message_id", "title")


@query("j8_range_join", """SELECT d.id, c.day::VARCHAR AS day FROM v_documents d JOIN (SELECT DATE '2024-01-01' + CAST(g AS INTEGER) AS day FROM range(0, 90, 30) t(g)) c
  ON c.day BETWEEN coalesce(d.effective_from, DATE '0001-01-01') AND coalesce(d.effective_to, DATE '9999-12-31')""")
def j8(t):
    days = t.spark.range(0, 90, 30).select(F.expr("date_add(DATE'2024-01-01', CAST(id AS INT))").alias("day"))
    within = F.col("day").between(F.coalesce("effective_from", F.lit("0001-01-01").cast("date")), F.coalesce("effective_to", F.lit("9999-12-31").cast("date")))
    return t.v_documents.join(F.broadcast(days), within).select("id", F.col("day").cast("string").alias("day"))  # three days


@query("j9_neighbours", """SELECT a.chunk_id, b.chunk_id AS neighbour_id, b.position - a.position AS distance FROM v_chunks a JOIN v_chunks b USING (document_id)
  WHERE b.position - a.position BETWEEN -1 AND 1 AND a.chunk_id <> b.chunk_id""")
def j9(t):
    return r.neighbours(t.v_chunks, t.v_chunks, 1)


@query("j10_working_deadline", """
  WITH days AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS n FROM (SELECT DATE '2023-12-25' + CAST(unnest(range((SELECT date_diff('day', DATE '2023-12-25', CAST(max(created_at) AS DATE)) + 60 FROM v_handoffs))) AS INTEGER) AS day)
    WHERE isodow(day) < 6 AND day <> DATE '2024-01-08'),
  slots AS (SELECT day, n, s, n * 32400 + s AS at FROM days, (SELECT 0 AS s) z),
  t AS (SELECT ticket_id, created_at, CAST(created_at AS DATE) AS day, epoch_us(created_at) // 1000000 - epoch_us(CAST(CAST(created_at AS DATE) AS TIMESTAMP)) // 1000000 AS sec FROM v_handoffs),
  p AS (SELECT t.*, (SELECT min(n) FROM days WHERE days.day >= t.day) AS n0, (SELECT count(*) FROM days WHERE days.day = t.day) AS works FROM t),
  q AS (SELECT *, n0 * 32400 + CASE WHEN works = 0 THEN 0 ELSE least(greatest(sec - 28800, 0), 32400) END + 28800 AS total FROM p)
  SELECT q.ticket_id, epoch_us(CAST(days.day AS TIMESTAMP)) // 1000000 + 28800 + q.total - days.n * 32400 AS due_s
  FROM q JOIN days ON days.n = (q.total - 1) // 32400""")
def j10(t):
    return r.working_deadline(t.v_handoffs, 8, 8, 17, ["2024-01-08"]).select("ticket_id", "due_s")


@query("w1_recent_messages", """SELECT conv_id, message_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY created_at DESC, turn DESC) AS n FROM v_messages
  WHERE role IN ('user', 'assistant') AND coalesce(outcome, '') <> 'error') WHERE n <= 4""")
def w1(t):
    return r.recent_messages(t.v_messages, 4).select("conv_id", "message_id")


UNHELPFUL = "coalesce(outcome = 'blocked' OR (outcome = 'answered' AND confidence < 0.35), false)"


@query("w2_repeated_no_answer", f"""SELECT message_id FROM (SELECT message_id, {UNHELPFUL} AS u, lag({UNHELPFUL}) OVER (PARTITION BY conv_id ORDER BY created_at, turn) AS b
  FROM v_messages WHERE role = 'assistant') WHERE u AND b""")
def w2(t):
    return r.repeated_no_answer(t.v_messages).select("message_id")


@query("w3_negative_streak", """SELECT conv_id FROM (SELECT conv_id, rating, row_number() OVER (PARTITION BY conv_id ORDER BY created_at DESC, turn DESC) AS n FROM v_feedback)
  WHERE n <= 2 GROUP BY conv_id HAVING count(*) = 2 AND max(rating) = -1""")
def w3(t):
    return r.negative_streak(t.v_feedback)


@query("w4_open_ticket_once", """SELECT ticket_id FROM (SELECT ticket_id, created_at, max(CASE WHEN status = 'closed' THEN created_at ELSE due_at END)
  OVER (PARTITION BY conv_id ORDER BY created_at, ticket_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM v_handoffs)
  WHERE latest IS NULL OR latest <= created_at""")
def w4(t):
    return r.open_ticket_once(t.v_handoffs).select("ticket_id")


@query("w5_top_per_key", """SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank
  FROM customer) WHERE rank <= 3""")
def w5(t):
    return r.top_per_key(t.customer, "c_nationkey", [F.desc("c_acctbal"), "c_custkey"], 3).select("c_nationkey", "c_custkey", F.col("rank").cast("long").alias("rank"))


@query("w6_keep_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def w6(t):
    return r.keep_first(t.documents.select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id")


@query("w7_best_per_document", "SELECT document_id, max(position) AS position FROM v_chunks GROUP BY document_id")
def w7(t):
    return t.v_chunks.groupBy("document_id").agg(F.max_by("position", "position").alias("position"))


@query("w8_repeated_answers", """SELECT message_id FROM (SELECT message_id, outcome, lag(outcome) OVER (PARTITION BY conv_id ORDER BY created_at, turn) AS b FROM v_messages WHERE role = 'assistant')
  WHERE b = outcome""")
def w8(t):
    """Answers whose outcome is that of the answer before, as texts here never repeat."""
    return r.repeated_answers(t.v_messages.withColumn("content", F.col("outcome"))).select("message_id")


@query("g10_token_replay", """SELECT event_id, jti FROM (SELECT *, first_value(visitor) OVER (PARTITION BY jti ORDER BY ts, event_id) AS o FROM v_token_uses) WHERE visitor <> o""")
def g10(t):
    return r.token_replay(t.v_token_uses).select("event_id", "jti")


@query("c30_supersede", """SELECT d.document_id, CAST(least(coalesce(d.effective_to, DATE '9999-12-31'), n.until) AS VARCHAR) AS effective_to FROM v_documents d JOIN (
  SELECT supersedes_id, min(coalesce(effective_from, CAST(created_at AS DATE)) - 1) AS until FROM v_documents WHERE review = 'approved' AND supersedes_id IS NOT NULL GROUP BY 1) n
  ON n.supersedes_id = d.document_id""")
def c30(t):
    return r.supersede(t.v_documents).withColumn("effective_to", F.col("effective_to").cast("string"))


@query("u1_labelled_union", "SELECT text, 'document' AS label FROM documents UNION ALL SELECT text, 'benchmark' FROM benchmark")
def u1(t):
    return t.documents.select("text", F.lit("document").alias("label")).unionByName(t.benchmark.select("text", F.lit("benchmark").alias("label")))


@query("u2_intersection", "SELECT conv_id FROM v_handoffs INTERSECT SELECT conv_id FROM v_feedback")
def u2(t):
    return t.v_handoffs.select("conv_id").intersect(t.v_feedback.select("conv_id"))


@query("u3_difference", "SELECT conv_id FROM v_conversations EXCEPT SELECT conv_id FROM v_handoffs")
def u3(t):
    return t.v_conversations.select("conv_id").subtract(t.v_handoffs.select("conv_id"))
