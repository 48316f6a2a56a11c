"""Queries over operators.privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import privacy as p
from tidemill.plans.registry import query

CUTOFF = "TIMESTAMP '2024-01-20 00:00:00'"
SUBJECT = """subject AS (SELECT * FROM v_conversations WHERE user_id = 'u3' OR end_user_id = 'v5'
  OR conv_id IN (SELECT conv_id FROM v_handoffs WHERE email = 'person30@mail.example'))"""
PURGED = f"""purged AS (SELECT conv_id FROM v_conversations c WHERE last_activity < {CUTOFF} AND NOT legal_hold
  AND NOT EXISTS (SELECT 1 FROM v_handoffs h WHERE h.conv_id = c.conv_id AND (h.status IN ('open', 'assigned') OR h.legal_hold)))"""


def subject(t):
    return p.subject_conversations(t.v_conversations, t.v_handoffs, "u3", "v5", "person30@mail.example")


def purged(t):
    return p.retention_purge(t.v_conversations, t.v_handoffs, F.expr(CUTOFF))


@query("g1_redact_pii")
def g1(t):
    return p.redact_pii(t.documents.select("doc_id", "text"), "text").select("doc_id", "text", F.to_json("pii").alias("pii"))


@query("g1_redact_email", r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS text FROM documents")
def g1_email(t):
    tag, pattern = p.PII[0]
    return t.documents.select("doc_id", F.regexp_replace("text", pattern, tag).alias("text"))


_FOLDED = "trim(regexp_replace(replace(strip_accents(lower(content)), 'đ', 'd'), '\\s+', ' ', 'g'))"


@query("g2_screen_messages", f"""SELECT message_id, CASE WHEN regexp_matches(x, '{"|".join(p.INJECTION)}') THEN 'block' WHEN regexp_matches(x, '{"|".join(p.HUMAN)}') THEN 'human_requested'
  WHEN regexp_matches(x, '{p.GREETING}') THEN 'greeting' WHEN regexp_matches(x, '{p.THANKS}') THEN 'thanks' ELSE 'allow' END AS verdict FROM (SELECT message_id, {_FOLDED} AS x FROM v_messages)""")
def g2(t):
    return t.v_messages.select("message_id", p.screen(F.col("content")).alias("verdict"))


TOPICS = ["price list", "the answer", "and", "de la"]
_PLAIN = "' ' || trim(regexp_replace(replace(strip_accents(lower(content)), 'đ', 'd'), '[^\\p{L}\\p{N}_]+', ' ', 'g')) || ' '"


@query("g3_match_topics", f"""SELECT message_id, CASE {' '.join(f"WHEN contains(x, ' {t} ') THEN '{t}'" for t in TOPICS)} END AS topic
  FROM (SELECT message_id, {_PLAIN} AS x FROM v_messages)""")
def g3(t):
    return p.match_topics(t.v_messages.select("message_id", "content"), "content", TOPICS).select("message_id", "topic")


@query("g4_redact_secret_keys", """SELECT audit_id, '{"actor":"' || actor || '","password":"***","deep":{"api_key":"***"}}' AS body FROM v_audit""")
def g4(t):
    inner = F.struct(F.col("path").alias("api_key"))
    body = F.to_json(F.struct("actor", F.col("method").alias("password"), inner.alias("deep")))
    return t.v_audit.select("audit_id", p.redact_secret_keys(body).alias("body"))


@query("g5_mask_contacts", """SELECT ticket_id, left(email, 1) || '***@' || split_part(email, '@', 2) AS email, '***' || right(phone, 3) AS phone,
  repeat('*', greatest(length(phone) - 4, 0)) || right(phone, 4) AS last4 FROM v_handoffs""")
def g5(t):
    return t.v_handoffs.select("ticket_id", p.mask_email(F.col("email")).alias("email"), p.mask_phone(F.col("phone")).alias("phone"), p.mask_last4(F.col("phone")).alias("last4"))


@query("g6_hash_keys", "SELECT audit_id, left(sha256(client_ip), 24) AS ip_key FROM v_audit")
def g6(t):
    return t.v_audit.select("audit_id", p.hash_key(F.col("client_ip")).alias("ip_key"))


@query("g7_subject_export", f"""WITH {SUBJECT} SELECT conv_id, count(*) AS n_messages, CAST(sum(length(content)) AS BIGINT) AS chars, count(rating) AS rated
  FROM v_messages m LEFT JOIN v_feedback f USING (message_id, conv_id) WHERE conv_id IN (SELECT conv_id FROM subject) GROUP BY conv_id""")
def g7(t):
    out = p.subject_export(subject(t), t.v_messages, t.v_feedback)
    return out.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_messages"),
        F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"])).alias("chars"),
        F.size(F.filter("messages", lambda m: m["rating"].isNotNull())).cast("long").alias("rated"),
    )


@query("g8_subject_delete", f"WITH {SUBJECT} SELECT conv_id, legal_hold OR conv_id IN (SELECT conv_id FROM v_handoffs WHERE legal_hold) AS held FROM subject")
def g8(t):
    return p.subject_delete(subject(t), t.v_handoffs).select("conv_id", "held")


SUBJECTS = """subjects AS (SELECT user_id AS subject_id, user_id, min(end_user_id) AS visitor_id, 'PERSON' || min(conv_id + conv_id % 2) || '@mail.example' AS email
    FROM v_conversations WHERE user_id IS NOT NULL GROUP BY user_id),
  tk AS (SELECT h.*, c.user_id, c.end_user_id, h.legal_hold OR c.legal_hold AS held FROM v_handoffs h JOIN v_conversations c USING (conv_id)),
  st AS (SELECT DISTINCT s.subject_id, k.ticket_id, k.conv_id, k.held FROM subjects s JOIN tk k ON k.user_id = s.user_id OR k.end_user_id = s.visitor_id OR lower(k.email) = lower(s.email)),
  sc AS (SELECT DISTINCT s.subject_id, c.conv_id, c.legal_hold FROM subjects s JOIN v_conversations c ON c.user_id = s.user_id OR c.end_user_id = s.visitor_id
    OR c.conv_id IN (SELECT conv_id FROM st WHERE st.subject_id = s.subject_id)),
  sh AS (SELECT subject_id, conv_id, legal_hold OR EXISTS (SELECT 1 FROM st WHERE st.subject_id = sc.subject_id AND st.conv_id = sc.conv_id AND st.held) AS held FROM sc)"""


def subjects(t):
    """Every signed-in user, with the first visitor id they had and an e-mail in other letters."""
    number = F.min(F.col("conv_id") + F.col("conv_id") % 2).cast("string")
    known = t.v_conversations.where("user_id IS NOT NULL").groupBy("user_id")
    own = known.agg(F.min("end_user_id").alias("visitor_id"), F.concat(F.lit("PERSON"), number, F.lit("@mail.example")).alias("email"))
    return own.select(F.col("user_id").alias("subject_id"), "user_id", "visitor_id", "email")


@query("g7_subjects_bundle", f"""WITH {SUBJECTS}, told AS (SELECT conv_id, sha256(string_agg(turn || '|' || role || '|' || coalesce(content, '') || '|' || coalesce(CAST(rating AS VARCHAR), '-'), chr(10) ORDER BY turn)) AS messages
    FROM v_messages LEFT JOIN (SELECT message_id, rating FROM v_feedback) USING (message_id) GROUP BY 1)
  SELECT subject_id, conv_id, messages, (SELECT string_agg(ticket_id || ':' || status || ':' || coalesce(reason, '-'), ',' ORDER BY ticket_id) FROM st JOIN v_handoffs h USING (ticket_id)
    WHERE st.subject_id = sc.subject_id AND st.conv_id = sc.conv_id) AS tickets FROM sc LEFT JOIN told USING (conv_id)""")
def g7_bundle(t):
    """All that is kept of every user, nested rows written out."""
    out = p.subjects_export(subjects(t), t.v_conversations, t.v_handoffs, t.v_messages, t.v_feedback)
    message = F.transform("messages", lambda m: F.concat_ws("|", m["turn"].cast("string"), m["role"], F.coalesce(m["content"], F.lit("")), F.coalesce(m["rating"].cast("string"), F.lit("-"))))
    ticket = F.transform("tickets", lambda k: F.concat_ws(":", k["ticket_id"].cast("string"), k["status"], F.coalesce(k["reason"], F.lit("-"))))
    return out.select("subject_id", "conv_id", F.sha2(F.array_join(message, "\n"), 256).alias("messages"), F.array_join(ticket, ",").alias("tickets"))


@query("g8_subjects_delete_counts", f"""WITH {SUBJECTS}, gone AS (SELECT subject_id, conv_id FROM sh WHERE NOT held)
  SELECT subject_id, (SELECT count(*) FROM gone g WHERE g.subject_id = s.subject_id) AS conversations, (SELECT count(*) FROM gone g JOIN v_messages USING (conv_id) WHERE g.subject_id = s.subject_id) AS messages,
    (SELECT count(*) FROM gone g JOIN v_feedback USING (conv_id) WHERE g.subject_id = s.subject_id) AS ratings, (SELECT count(*) FROM st WHERE st.subject_id = s.subject_id AND NOT held) AS tickets,
    (SELECT count(*) FROM sh WHERE sh.subject_id = s.subject_id AND held) AS held_conversations, (SELECT count(*) FROM st WHERE st.subject_id = s.subject_id AND held) AS held_tickets FROM subjects s""")
def g8_counts(t):
    return p.subjects_delete(subjects(t), t.v_conversations, t.v_handoffs, t.v_messages, t.v_feedback)


@query("g9_retention_purge", f"WITH {PURGED} SELECT conv_id FROM purged")
def g9(t):
    return purged(t).select("conv_id")


@query("g9_retention_survivors", f"""WITH {PURGED} SELECT 'messages' AS kind, count(*) AS n FROM v_messages WHERE conv_id NOT IN (SELECT conv_id FROM purged)
  UNION ALL SELECT 'usage', count(*) FROM v_token_usage WHERE conversation_id IS NULL OR conversation_id NOT IN (SELECT conv_id FROM purged)
  UNION ALL SELECT 'audit', count(*) FROM v_audit WHERE created_at >= TIMESTAMP '2025-01-10' - INTERVAL 365 DAY""")
def g9_survivors(t):
    gone = purged(t)
    usage = t.v_token_usage.withColumnRenamed("conversation_id", "conv_id")
    kept = {
        "messages": p.purge_dependents(t.v_messages, gone),
        "usage": p.purge_dependents(usage, gone),
        "audit": p.audit_survivors(t.v_audit, 30, F.expr("TIMESTAMP '2025-01-10 00:00:00'")),
    }
    counts = [df.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, df in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
