"""Queries over streaming.live: each runs a stream over the event files and compares as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.plans.metrics import COSTED, ROLLUP
from tidemill.plans.registry import query
from tidemill.plans.retrieval import TOKENS
from tidemill.sources.files import event_stream, file_stream
from tidemill.streaming import live, rollup, segments


def stream(t):
    return event_stream(t.spark, f"{t.sf_dir}/events.parquet")


@query("t1_live_turns", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('view', 'click')")
def t1(t):
    return live.finish(live.live_turns(stream(t)), "append").drop("batch")


@query("t2_usage_counters", "SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS hour_s, user_id, count(*) AS requests, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS value FROM events GROUP BY 1, 2")
def t2(t):
    return live.latest(live.finish(live.usage_counters(stream(t)), "update"), ["hour_s", "user_id"])


@query("t3_error_spikes", """WITH w AS (SELECT (epoch_us(ts) // 1000000) // 300 * 300 + 900 - k.k * 300 AS end_s, event_type FROM events, (SELECT unnest(range(3)) AS k) k)
  SELECT end_s, count(*) AS turns, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error') >= 5 AND count(*) FILTER (event_type = 'error') >= 0.2 * count(*) AS spike FROM w GROUP BY 1""")
def t3(t):
    return live.latest(live.finish(live.error_spikes(stream(t)), "update"), ["end_s"])


def alert_checks(events):
    """Checks of three kinds of rules; every tenth alert is not delivered."""
    kind = F.element_at(F.array(F.lit("condition"), F.lit("level"), F.lit("count")), (F.col("user_id") % 3 + 1).cast("int"))
    level = (F.col("value") >= 50).cast("int") + (F.col("value") >= 90).cast("int")
    return events.select(
        F.concat(kind, (F.col("user_id") % 50).cast("string")).alias("rule"), kind.alias("kind"), F.unix_timestamp("ts").alias("at_s"),
        (F.col("event_type") == "error").alias("firing"), level.alias("level"), F.floor(F.col("event_id") / 100).alias("seen"), (F.col("event_id") % 10 != 3).alias("delivered"),
    )


@query("t4_alert_state")
def t4(t):
    return live.finish(live.alert_state(alert_checks(stream(t))), "append").drop("batch")


def kept_rollup(t, files=None):
    """The rollup by a stream over the conversations' files."""
    raw = file_stream(t.spark, f"{t.sf_dir}/conversations.parquet", files)
    return rollup.keep_rollup(t.over(conversations=raw).v_messages, rollup.Facts(t.v_handoffs, t.v_steps, t.v_token_usage, t.v_prices))


@query("t5_rollup_stream", f"WITH {COSTED}, {ROLLUP} SELECT * FROM rollup_")
def t5(t):
    return kept_rollup(t)


@query("t6_first_binding", "SELECT DISTINCT event_id // 3 AS jti FROM events")
def t6(t):
    uses = stream(t).withColumn("jti", F.floor(F.col("event_id") / 3))
    return live.finish(live.first_binding(uses).select("jti"), "append").drop("batch")


def text_changes(conversations):
    """Changes of one text a conversation: each turn replaces it, and every fifth takes it out."""
    return conversations.select(F.col("conv_id").alias("key"), "text", (F.col("turn") % 5 == 4).alias("deleted"), F.col("turn").alias("at"))


@query("t7_incremental_index", f"""WITH now AS (SELECT conv_id, arg_max(text, turn) AS text, max(turn) % 5 = 4 AS deleted FROM conversations GROUP BY 1),
  toks AS (SELECT conv_id, {TOKENS.replace('@', 'text')} AS w FROM now WHERE NOT deleted),
  counted AS (SELECT term, count(*) AS df FROM (SELECT conv_id, unnest(list_distinct(w)) AS term FROM toks) GROUP BY 1)
  SELECT term, df, round(ln((SELECT count(*) FROM toks) - df + 0.5) - ln(df + 0.5), 9) AS raw_idf FROM counted""")
def t7(t):
    """Terms of the texts as they are after all changes, by segments."""
    raw = file_stream(t.spark, f"{t.sf_dir}/conversations.parquet")
    index = segments.keep_index(text_changes(raw)).index()
    return index.terms.select("term", "df", F.round(F.log(F.lit(index.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5), 9).alias("raw_idf"))


@query("t8_overdue", """SELECT ticket_id FROM v_handoffs WHERE status IN ('open', 'assigned') AND due_at > TIMESTAMP '2024-01-05 00:00:00' AND due_at <= TIMESTAMP '2024-01-20 00:00:00'""")
def t8(t):
    return live.overdue(t.v_handoffs, F.expr("TIMESTAMP '2024-01-20 00:00:00'"), F.expr("TIMESTAMP '2024-01-05 00:00:00'")).select("ticket_id")
