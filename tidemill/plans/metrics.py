"""Queries over operators.metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import metrics as m
from tidemill.plans.registry import query

SINCE = "TIMESTAMP '2024-01-05 00:00:00'"
UNTIL = "TIMESTAMP '2024-01-20 00:00:00'"
COSTED = """costed AS (
  SELECT u.*, coalesce(CAST(round_even(u.prompt * p.price_in + u.completion * p.price_out, 0) AS BIGINT), 0) AS cost
  FROM v_token_usage u LEFT JOIN v_prices p USING (model))"""
DAY = "CAST(CAST(created_at + INTERVAL 7 HOUR AS DATE) AS VARCHAR)"
ROLLUP = f"""
  turns AS (SELECT {DAY} AS day, count(*) FILTER (role = 'assistant') AS turns,
      count(*) FILTER (role = 'assistant' AND outcome = 'error') AS errors, count(DISTINCT conv_id) AS conversations,
      quantile_cont(latency_ms, 0.5) AS p50_ms, quantile_cont(latency_ms, 0.95) AS p95_ms,
      count(*) FILTER (role = 'assistant' AND cached) AS cached,
      count(*) FILTER (role = 'assistant' AND confidence < 0.35) AS low_confidence FROM v_messages GROUP BY 1),
  tickets AS (SELECT {DAY} AS day, count(*) AS handoffs FROM v_handoffs GROUP BY 1),
  firsts AS (SELECT {DAY} AS day, quantile_cont(try_cast(value AS DOUBLE), 0.95) AS p95_first_token FROM v_steps WHERE step = 'first_token' GROUP BY 1),
  spent AS (SELECT {DAY} AS day, CAST(sum(prompt + completion) AS BIGINT) AS tokens, CAST(sum(cost) AS BIGINT) AS cost FROM costed GROUP BY 1),
  rollup_ AS (SELECT turns.*, coalesce(handoffs, 0) AS handoffs, p95_first_token, coalesce(tokens, 0) AS tokens, coalesce(cost, 0) AS cost
    FROM turns LEFT JOIN tickets USING (day) LEFT JOIN firsts USING (day) LEFT JOIN spent USING (day))"""
LABELS = f"""labels_ AS (
  SELECT {DAY} AS day, 'outcome' AS kind, coalesce(outcome, 'unknown') AS label, count(*) AS n FROM v_messages WHERE role = 'assistant' GROUP BY ALL
  UNION ALL SELECT {DAY}, 'guard_reason', coalesce(guard_reason, 'unknown'), count(*) FROM v_messages WHERE role = 'assistant' GROUP BY ALL)"""


def costed(t):
    return m.with_cost(t.v_token_usage, t.v_prices)


def rollup(t):
    return m.daily_rollup(t.v_messages, t.v_handoffs, t.v_steps, t.v_token_usage, t.v_prices)


def text_day(df):
    return df.withColumn("day", F.col("day").cast("string"))


@query("a1_daily_rollup", f"WITH {COSTED}, {ROLLUP} SELECT * FROM rollup_")
def a1(t):
    return text_day(rollup(t))


@query("a2_conditional_counts", """
  SELECT count(*) FILTER (outcome = 'answered') AS answered, count(*) FILTER (confidence < 0.35) AS low_confidence,
    count(*) FILTER (cached) AS cached, count(*) FILTER (outcome = 'error') AS errors FROM v_messages WHERE role = 'assistant'""")
def a2(t):
    answers = t.v_messages.where(F.col("role") == "assistant")
    return answers.agg(
        m.count_if(F.col("outcome") == "answered").alias("answered"),
        m.count_if(F.col("confidence") < m.LOW_CONFIDENCE).alias("low_confidence"),
        m.count_if(F.col("cached")).alias("cached"),
        m.count_if(F.col("outcome") == "error").alias("errors"),
    )


@query("a3_breakdowns", f"WITH {LABELS} SELECT * FROM labels_")
def a3(t):
    return text_day(m.breakdowns(t.v_messages, ["outcome", "guard_reason"]))


@query("a4_step_latency", """
  SELECT step, round(quantile_cont(CAST(value AS BIGINT), 0.5), 1) AS p50, round(quantile_cont(CAST(value AS BIGINT), 0.95), 1) AS p95
  FROM v_steps WHERE regexp_full_match(value, '[0-9]{1,9}') GROUP BY step""")
def a4(t):
    return m.step_latency(t.v_steps)


@query("a5_visitor_stats", f"""
  WITH inside AS (SELECT * FROM v_conversations WHERE created_at >= {SINCE} AND created_at < {UNTIL}),
  answers AS (SELECT conv_id, count(*) AS n FROM v_messages WHERE role = 'assistant' GROUP BY 1)
  SELECT (SELECT count(DISTINCT end_user_id) FROM inside) AS visitors,
    (SELECT count(DISTINCT end_user_id) FROM inside WHERE user_id IS NOT NULL) AS signed_in,
    (SELECT count(DISTINCT end_user_id) FROM inside WHERE end_user_id IN (SELECT end_user_id FROM v_conversations WHERE created_at < {SINCE})) AS returning,
    (SELECT count(*) FROM inside JOIN answers USING (conv_id) WHERE n = 1) AS single_turn""")
def a5(t):
    return m.visitor_stats(t.v_conversations, t.v_messages, F.expr(SINCE), F.expr(UNTIL))


@query("a6_traffic", """
  SELECT g // 24 AS weekday, g % 24 AS hour, coalesce(n, 0) AS n FROM range(168) r(g) LEFT JOIN (
    SELECT isodow(ts + INTERVAL 7 HOUR) - 1 AS w, hour(ts + INTERVAL 7 HOUR) AS h, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2) e
  ON e.w = g // 24 AND e.h = g % 24""")
def a6(t):
    return m.traffic(t.events.where("event_type = 'view'"), F.col("ts").cast("timestamp"))


@query("a7_usage_by_day", f"""WITH {COSTED} SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, model, CAST(sum(prompt) AS BIGINT) AS prompt,
  CAST(sum(completion) AS BIGINT) AS completion, CAST(sum(cost) AS BIGINT) AS cost, count(*) AS calls FROM costed GROUP BY 1, 2""")
def a7(t):
    return text_day(m.usage_by_day(costed(t)))


@query("a8_usage_by_purpose", f"WITH {COSTED} SELECT purpose, CAST(sum(prompt + completion) AS BIGINT) AS tokens, CAST(sum(cost) AS BIGINT) AS cost FROM costed GROUP BY 1")
def a8(t):
    return m.usage_by_purpose(costed(t))


@query("a8_cost_by_tier", f"WITH {COSTED} SELECT coalesce(tier, 'anonymous') AS tier, CAST(sum(cost) AS BIGINT) AS cost FROM costed GROUP BY 1")
def a8_tier(t):
    return m.cost_by_tier(costed(t))


@query("a9_outcome_counts", f"SELECT coalesce(outcome, 'unknown') AS outcome, count(*) AS n FROM v_messages WHERE role = 'assistant' AND created_at >= {SINCE} GROUP BY 1")
def a9(t):
    return m.outcome_counts(t.v_messages, F.expr(SINCE))


@query("a9_feedback_counts", f"SELECT CAST(rating AS BIGINT) AS rating, count(*) AS n FROM v_feedback WHERE created_at >= {SINCE} GROUP BY 1")
def a9_feedback(t):
    return t.v_feedback.where(F.col("created_at") >= F.expr(SINCE)).groupBy(F.col("rating").cast("long").alias("rating")).agg(F.count("*").alias("n"))


@query("a9_latency_percentiles", f"""SELECT quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95
  FROM v_messages WHERE role = 'assistant' AND created_at >= {SINCE}""")
def a9_latency(t):
    return m.latency_percentiles(t.v_messages, F.expr(SINCE))


@query("a10_usage_summary", f"""WITH {COSTED}, d AS (SELECT *, CAST(created_at AS DATE) AS day FROM costed)
  SELECT CAST(coalesce(sum(prompt + completion) FILTER (day > DATE '2024-01-13' AND day <= DATE '2024-01-20'), 0) AS BIGINT) AS tokens,
    CAST(coalesce(sum(cost) FILTER (day > DATE '2024-01-13' AND day <= DATE '2024-01-20'), 0) AS BIGINT) AS cost,
    count(*) FILTER (day > DATE '2024-01-13' AND day <= DATE '2024-01-20') AS calls,
    count(DISTINCT end_user_id) FILTER (day > DATE '2024-01-13' AND day <= DATE '2024-01-20') AS visitors,
    CAST(coalesce(sum(cost) FILTER (day >= DATE '2024-01-01' AND day <= DATE '2024-01-20'), 0) AS BIGINT) AS month_cost FROM d""")
def a10(t):
    return m.usage_summary(costed(t), 7, F.expr("DATE '2024-01-20'"))


@query("a11_cost", f"WITH {COSTED} SELECT usage_id, model, cost FROM costed")
def a11(t):
    return costed(t).select("usage_id", "model", "cost")


@query("a12_month_projection", f"""WITH {COSTED}, s AS (SELECT CAST(coalesce(sum(cost), 0) AS BIGINT) AS spent FROM costed
    WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-20 12:00:00')
  SELECT spent, CAST(round_even(CAST(spent AS DOUBLE) * 2678400 / 1684800, 0) AS BIGINT) AS projected FROM s""")
def a12(t):
    return m.month_projection(costed(t), F.expr("TIMESTAMP '2024-01-20 12:00:00'"))


@query("a13_budget_verdicts", f"""WITH {COSTED},
  daily AS (SELECT CAST(created_at AS DATE) AS day, end_user_id, CAST(sum(prompt + completion) AS BIGINT) AS tokens, sum(cost) AS cost FROM costed GROUP BY 1, 2),
  running AS (SELECT day, CAST(sum(sum(cost)) OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS BIGINT) AS month_spent FROM daily GROUP BY day)
  SELECT CAST(day AS VARCHAR) AS day, end_user_id, tokens, month_spent, CASE WHEN month_spent >= 3000000 THEN 'paused'
    WHEN end_user_id IS NULL AND month_spent * 2 >= 3000000 THEN 'anonymous_paused' WHEN tokens >= 1000 THEN 'over_day' ELSE 'ok' END AS verdict
  FROM daily JOIN running USING (day)""")
def a13(t):
    return text_day(m.budget_verdicts(costed(t), 1000, 3_000_000))


@query("a14_limit_breaches", """
  WITH e AS (SELECT event_id, user_id, ts, date_trunc('minute', ts) AS ms, date_trunc('hour', ts) AS hs FROM events),
  n AS (SELECT *, count(*) OVER (PARTITION BY user_id, ms ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS minute_n,
    count(*) OVER (PARTITION BY user_id, hs ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS hour_n FROM e),
  w AS (SELECT *, greatest(CASE WHEN minute_n > 1 THEN epoch_us(ms) // 1000000 + 60 - epoch_us(ts) // 1000000 END,
    CASE WHEN hour_n > 2 THEN epoch_us(hs) // 1000000 + 3600 - epoch_us(ts) // 1000000 END) AS wait FROM n)
  SELECT event_id, user_id, minute_n, hour_n, greatest(wait, 1) AS wait_s FROM w WHERE wait IS NOT NULL""")
def a14(t):
    requests = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return m.limit_breaches(requests, "user_id", 1, 2)


STATUSES = ["ready", "processing", "failed", "archived"]


@query("a15_document_counts", """SELECT s.status, count(d.id) AS n FROM (VALUES ('ready'), ('processing'), ('failed'), ('archived')) s(status)
  LEFT JOIN v_documents d ON d.status = s.status GROUP BY 1""")
def a15(t):
    return m.dense_counts(t.v_documents, "status", STATUSES)


@query("a15_review_counts", """SELECT s.review, count(d.id) AS n FROM (VALUES ('approved'), ('pending'), ('rejected'), ('expired')) s(review)
  LEFT JOIN v_documents d ON d.review = s.review GROUP BY 1""")
def a15_review(t):
    return m.dense_counts(t.v_documents, "review", ["approved", "pending", "rejected", "expired"])


@query("a16_cited_documents", f"""SELECT document_id, count(DISTINCT message_id) AS answers FROM v_citations WHERE created_at >= {SINCE}
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def a16(t):
    return m.cited_documents(t.v_citations, F.expr(SINCE), 20)


@query("a16_thumbs_down_documents", f"""SELECT document_id, count(DISTINCT c.message_id) AS answers FROM v_citations c JOIN v_feedback f USING (message_id)
  WHERE f.rating = -1 AND c.created_at >= {SINCE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def a16_down(t):
    down = t.v_feedback.where("rating = -1").select("message_id")
    return m.cited_documents(t.v_citations.join(down, "message_id", "left_semi"), F.expr(SINCE), 20)


@query("a17_never_cited", f"""SELECT id, title FROM v_documents d WHERE status = 'ready' AND review = 'approved'
  AND NOT EXISTS (SELECT 1 FROM v_citations c WHERE c.document_id = d.document_id AND c.created_at >= {SINCE})""")
def a17(t):
    return m.never_cited(t.v_documents, t.v_citations, F.expr(SINCE)).select("id", "title")


@query("a18_expiring", "SELECT id, CAST(effective_to AS VARCHAR) AS effective_to FROM v_documents WHERE effective_to BETWEEN DATE '2024-02-10' AND DATE '2024-03-11'")
def a18(t):
    return m.expiring(t.v_documents, F.expr("DATE '2024-02-10'")).select("id", F.col("effective_to").cast("string").alias("effective_to"))


@query("a18_scheduled", "SELECT id, CAST(effective_from AS VARCHAR) AS effective_from FROM v_documents WHERE effective_from > DATE '2024-02-10'")
def a18_scheduled(t):
    return m.scheduled(t.v_documents, F.expr("DATE '2024-02-10'")).select("id", F.col("effective_from").cast("string").alias("effective_from"))


@query("a19_answers_citing", "SELECT DISTINCT message_id FROM v_citations WHERE document_id = '12'")
def a19(t):
    listed = t.v_citations.groupBy("message_id").agg(F.collect_set("document_id").alias("documents"))
    return listed.where(F.array_contains("documents", "12")).select("message_id")


@query("a20_audit_summary", "SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in m.AUDIT.items()) + " FROM v_audit")
def a20(t):
    return m.audit_summary(t.v_audit)


@query("a21_failed_login_ips", f"""SELECT client_ip, count(*) AS n FROM v_audit WHERE {m.AUDIT['failed_logins']} AND client_ip IS NOT NULL
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def a21(t):
    return m.failed_login_ips(t.v_audit, 10)


@query("a22_ingestion_stats", """SELECT count(*) FILTER (status = 'processing') AS pending, count(*) FILTER (status = 'processing' AND enabled) AS claimed,
  max(1706745600 - epoch_us(created_at) // 1000000) FILTER (status = 'processing') AS oldest_age_s,
  max(epoch_us(created_at) // 1000000) FILTER (status = 'ready') AS newest_ready_s FROM v_documents""")
def a22(t):
    return m.ingestion_stats(t.v_documents, F.expr("TIMESTAMP '2024-02-01 00:00:00'"))


@query("a23_history_kpis", f"""WITH {COSTED}, {ROLLUP} SELECT CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(cost) AS BIGINT) AS cost,
  (SELECT day FROM rollup_ ORDER BY p95_ms DESC NULLS LAST, day DESC LIMIT 1) AS slowest_day, sum(errors) / sum(turns) AS error_rate, avg(turns) AS turns_per_day,
  1 - sum(handoffs) / sum(conversations) AS containment, sum(cost) / sum(conversations) AS cost_per_conversation FROM rollup_""")
def a23(t):
    return m.history_kpis(text_day(rollup(t)))


@query("a24_monthly_history", f"""WITH {COSTED}, {ROLLUP} SELECT substr(day, 1, 7) AS month, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(cost) AS BIGINT) AS cost,
  max(p95_ms) AS worst_p95_ms, avg(conversations) AS conversations_per_day FROM rollup_ GROUP BY 1""")
def a24(t):
    return m.monthly_history(rollup(t))


@query("a25_breakdown_share", f"""WITH {LABELS} SELECT kind, label, CAST(sum(n) AS BIGINT) AS n, sum(n) * 100.0 / sum(sum(n)) OVER (PARTITION BY kind) AS percent
  FROM labels_ GROUP BY 1, 2""")
def a25(t):
    return m.breakdown_share(m.breakdowns(t.v_messages, ["outcome", "guard_reason"]))


@query("a26_load_report", """SELECT level, count(*) FILTER (result = 'ok') AS completed, count(*) FILTER (result <> 'ok') / count(*) AS refused_share,
  quantile_cont(ttft, 0.5) FILTER (result = 'ok') AS ttft_p50, quantile_cont(ttft, 0.95) FILTER (result = 'ok') AS ttft_p95,
  quantile_cont(e2e, 0.5) FILTER (result = 'ok') AS e2e_p50, quantile_cont(e2e, 0.95) FILTER (result = 'ok') AS e2e_p95 FROM v_load_turns GROUP BY level""")
def a26(t):
    return m.load_report(t.v_load_turns)
