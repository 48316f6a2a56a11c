"""Inputs of the registered queries: the tables of a directory, and views derived from them.

Each view is one SQL text for both engines; a few marks stand for what they write differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemill.session import settle

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

#: Seconds of 2024-01-01 00:00 UTC.
BASE = 1704067200

VIEWS = {
    "v_sources": """
        SELECT name, CAST(1.0 + (n % 4) * 0.25 AS DOUBLE) AS priority, n % 10 <> 9 AS enabled
        FROM (SELECT DISTINCT source AS name, CAST(substr(source, 4) AS BIGINT) AS n FROM documents) s""",
    "v_documents": f"""
        SELECT doc_id AS id, CAST(doc_id AS STRING) AS document_id, concat('Doc ', CAST(doc_id AS STRING)) AS title, source,
          CASE WHEN doc_id % 37 = 0 THEN 'failed' WHEN doc_id % 41 = 0 THEN 'processing' ELSE 'ready' END AS status,
          CASE WHEN doc_id % 11 = 0 THEN 'pending' WHEN doc_id % 29 = 0 THEN 'rejected' ELSE 'approved' END AS review,
          doc_id % 13 <> 0 AS enabled,
          CASE WHEN doc_id % 17 < 12 THEN 'anonymous' WHEN doc_id % 17 < 15 THEN 'user' WHEN doc_id % 17 = 15 THEN 'premium' ELSE 'typo' END AS tier,
          CASE WHEN doc_id % 5 = 1 THEN DAY[doc_id % 60] END AS effective_from,
          CASE WHEN doc_id % 7 = 2 THEN DAY[30 + doc_id % 60] END AS effective_to,
          TS[{BASE} - (doc_id % 120) * 86400] AS created_at,
          CASE WHEN doc_id % 50 = 49 THEN CAST(doc_id - 1 AS STRING) END AS supersedes_id,
          SHA[text] AS content_hash
        FROM documents""",
    "v_chunks": """
        SELECT e.vec_id AS chunk_id, CAST(e.vec_id // 5 AS STRING) AS document_id, e.vec_id % 5 AS position, d.text AS content,
          CASE WHEN e.vec_id % 43 <> 0 THEN e.embedding END AS embedding,
          CASE WHEN e.vec_id % 9 < 7 THEN 'm1' WHEN e.vec_id % 9 = 7 THEN 'm2' END AS embedding_model,
          e.vec_id % 19 = 0 AS edited
        FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id""",
    "v_queries": """
        SELECT vec_id AS query_id, embedding AS vector, CAST(label AS BIGINT) AS expected,
          CASE vec_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'chat' ELSE 'short' END AS style,
          CASE WHEN vec_id % 10 = 0 THEN 'off_topic' WHEN vec_id % 10 = 5 THEN 'unanswerable' END AS kind
        FROM embeddings WHERE vec_id % 25 = 0""",
    "v_messages": f"""
        SELECT conv_id * 1000 + turn AS message_id, conv_id, turn, role, text AS content,
          TS[{BASE} + conv_id * 397 * 60 + turn * 41] AS created_at,
          CASE WHEN role = 'assistant' THEN CASE (7 * conv_id + turn) % 10 WHEN 5 THEN 'denied' WHEN 6 THEN 'handoff'
            WHEN 7 THEN 'blocked' WHEN 8 THEN 'error' WHEN 9 THEN NULL ELSE 'answered' END END AS outcome,
          CASE WHEN role = 'assistant' AND (conv_id + turn) % 8 <> 0 THEN CAST((13 * conv_id + 7 * turn) % 100 AS DOUBLE) / 100 END AS confidence,
          CASE WHEN role = 'assistant' THEN 200 + (31 * conv_id + 17 * turn) % 3000 END AS latency_ms,
          role = 'assistant' AND (conv_id + turn) % 6 = 0 AS cached,
          CASE WHEN role = 'assistant' AND (7 * conv_id + turn) % 10 IN (7, 8) THEN
            CASE conv_id % 3 WHEN 0 THEN 'injection' WHEN 1 THEN 'topic' END END AS guard_reason
        FROM conversations WHERE role <> 'system'""",
    "v_conversations": """
        SELECT conv_id, concat('v', CAST(conv_id % 40 AS STRING)) AS end_user_id,
          CASE WHEN conv_id % 3 = 0 THEN concat('u', CAST(conv_id % 25 AS STRING)) END AS user_id,
          conv_id % 23 = 0 AS legal_hold, min(created_at) AS created_at, max(created_at) AS last_activity
        FROM v_messages GROUP BY conv_id""",
    "v_citations": """
        SELECT m.message_id, m.created_at, k.k AS at, CASE WHEN m.conv_id % 31 = 0 AND k.k = 0 THEN 'not-an-id'
            WHEN m.conv_id % 5 = 0 THEN CAST(m.message_id % 97 AS STRING) ELSE CAST((m.message_id + k.k) % 97 AS STRING) END AS document_id
        FROM v_messages m JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) k ON k.k < m.message_id % 4
        WHERE m.outcome = 'answered'""",
    "v_feedback": """
        SELECT message_id, conv_id, turn, CASE WHEN (conv_id * turn) % 3 = 0 THEN -1 ELSE 1 END AS rating, created_at,
          CASE WHEN message_id % 2 = 0 THEN created_at END AS reviewed_at
        FROM v_messages WHERE role = 'assistant' AND (conv_id + turn) % 4 = 1""",
    "v_handoffs": f"""
        SELECT c.conv_id * 10 + k.k AS ticket_id, c.conv_id, CASE (c.conv_id // 6 + k.k) % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'assigned'
            WHEN 2 THEN 'answered' ELSE 'closed' END AS status,
          TS[{BASE} + c.conv_id * 397 * 60 + 600 + k.k * 3600] AS created_at,
          TS[{BASE} + c.conv_id * 397 * 60 + 600 + k.k * 3600 + 28800] AS due_at,
          CASE WHEN c.conv_id % 4 = 0 THEN NULL ELSE concat('person', CAST(c.conv_id AS STRING), '@mail.example') END AS email,
          concat('09', CAST(10000000 + c.conv_id * 37 AS STRING)) AS phone,
          CASE c.conv_id % 3 WHEN 0 THEN 'low_confidence' WHEN 1 THEN 'asked' END AS reason, c.conv_id % 46 = 0 AS legal_hold
        FROM v_conversations c JOIN (SELECT 0 AS k UNION ALL SELECT 1) k ON k.k <= c.conv_id % 2 OR k.k = 0
        WHERE c.conv_id % 6 = 0""",
    "v_token_usage": """
        SELECT event_id AS usage_id, CAST(ts AS TIMESTAMP) AS created_at, CASE WHEN event_id % 97 <> 0 THEN user_id END AS end_user_id,
          CASE WHEN event_id % 53 <> 0 THEN user_id % 100 END AS conversation_id, event_type AS purpose,
          concat('m', CAST(user_id % 3 AS STRING)) AS model, CAST(floor(value) AS BIGINT) AS prompt, JSONINT[props, k] AS completion,
          CASE user_id % 4 WHEN 1 THEN 'user' WHEN 2 THEN 'premium' WHEN 3 THEN 'staff' END AS tier
        FROM events""",
    "v_prices": """
        SELECT 'm0' AS model, CAST(0.15 AS DECIMAL(14, 6)) AS price_in, CAST(0.60 AS DECIMAL(14, 6)) AS price_out
        UNION ALL SELECT 'm1', CAST(1.00 AS DECIMAL(14, 6)), CAST(3.50 AS DECIMAL(14, 6))""",
    "v_steps": """
        SELECT message_id, created_at, s.step, CASE s.step WHEN 'retrieval' THEN CAST(latency_ms // 4 AS STRING)
            WHEN 'generation' THEN CAST(latency_ms // 2 AS STRING) WHEN 'first_token' THEN CAST(latency_ms // 3 AS STRING)
            WHEN 'total' THEN CASE WHEN message_id % 13 = 0 THEN '12345678901' ELSE CAST(latency_ms AS STRING) END
            WHEN 'note' THEN 'text' ELSE '0.5' END AS value
        FROM v_messages JOIN (SELECT 'retrieval' AS step UNION ALL SELECT 'generation' UNION ALL SELECT 'first_token' UNION ALL
          SELECT 'total' UNION ALL SELECT 'note' UNION ALL SELECT 'ratio') s ON s.step NOT IN ('note', 'ratio') OR message_id % 7 = 0
        WHERE role = 'assistant'""",
    "v_audit": """
        SELECT event_id AS audit_id, CAST(ts AS TIMESTAMP) AS created_at,
          CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST' WHEN 'purchase' THEN 'PUT' WHEN 'signup' THEN 'POST' ELSE 'DELETE' END AS method,
          CASE event_id % 12 WHEN 0 THEN '/auth/login' WHEN 1 THEN '/auth/logout' WHEN 2 THEN '/users/5' WHEN 3 THEN '/documents/9'
            WHEN 4 THEN '/documents/9/review' WHEN 5 THEN '/settings' WHEN 6 THEN '/sources/2' WHEN 7 THEN '/export/all'
            WHEN 8 THEN '/keys/1' WHEN 9 THEN '/chunks/3' ELSE '/chat' END AS path,
          CASE WHEN event_id % 5 = 0 THEN 401 WHEN event_id % 7 = 0 THEN 500 WHEN event_id % 11 = 0 THEN 404 ELSE 200 END AS status_code,
          CASE WHEN event_id % 16 <> 0 THEN concat('10.0.', CAST(user_id % 20 AS STRING)) END AS client_ip,
          concat('User', CAST(user_id % 30 AS STRING)) AS actor
        FROM events""",
    "v_token_uses": "SELECT event_id, event_id // 3 AS jti, user_id AS visitor, CAST(ts AS TIMESTAMP) AS ts FROM events",
    "v_scores": """
        SELECT l.doc_id AS case_id, CASE WHEN l.doc_id % 33 <> 0 THEN CAST((l.doc_id * 37 + l.quality * 29) % 100 AS DOUBLE) / 100 END AS score,
          l.quality = 1 AS answerable FROM labels l""",
    "v_qa": """
        SELECT conv_id, turn, content AS answer, question FROM (
          SELECT *, max(CASE WHEN role = 'user' THEN content END) OVER (PARTITION BY conv_id, part) AS question FROM (
            SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM v_messages) m) n
        WHERE role = 'assistant' AND question IS NOT NULL""",
    "v_load_turns": """
        SELECT event_id AS turn_id, user_id % 5 AS level, value AS ttft, value + JSONINT[props, k] AS e2e,
          CASE WHEN event_id % 9 = 0 THEN 'refused' ELSE 'ok' END AS result FROM events""",
}

_MARKS = {
    "spark": {
        "TS": "timestamp_seconds({0})",
        "DAY": "date_add(DATE'2024-01-01', CAST({0} AS INT))",
        "SHA": "sha2({0}, 256)",
        "JSONINT": "CAST(get_json_object({0}, '$.{1}') AS BIGINT)",
    },
    "duckdb": {
        "TS": "make_timestamp(CAST(({0}) * 1000000 AS BIGINT))",
        "DAY": "(DATE '2024-01-01' + CAST({0} AS INTEGER))",
        "SHA": "sha256({0})",
        "JSONINT": "CAST(json_extract_string({0}, '$.{1}') AS BIGINT)",
    },
}


def _written(sql: str, engine: str) -> str:
    def mark(m: re.Match) -> str:
        return _MARKS[engine][m[1]].format(*[a.strip() for a in m[2].split(",")])

    sql = re.sub(r"\b(TS|DAY|SHA|JSONINT)\[([^\]]*)\]", mark, sql)
    return sql.replace("//", "div") if engine == "spark" else sql


def _used(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def duckdb(sql: str) -> str:
    """The query with the views that it uses as common tables before it."""
    need, todo = set(), _used(sql)
    while todo:
        v = todo.pop()
        if v not in need:
            need.add(v)
            todo += [u for u in _used(VIEWS[v]) if u != v]
    ctes = [f"{v} AS ({_written(VIEWS[v], 'duckdb')})" for v in VIEWS if v in need]
    body = _written(sql.strip(), "duckdb")
    if not ctes:
        return body
    if re.match(r"(?i)with\b", body):
        recursive = re.match(r"(?i)with\s+recursive\b", body)
        rest = re.sub(r"(?i)^with(\s+recursive)?\b", "", body, count=1)
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)}, {rest}"
    return f"WITH {', '.join(ctes)} {body}"


class Inputs:
    """Tables and views of a directory as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = settle(spark), sf_dir
        self._held: dict[str, DataFrame] = {}

    def over(self, **tables: DataFrame) -> Inputs:
        """The same inputs with other tables, such as streams, in the place of some."""
        other = Inputs(self.spark, self.sf_dir)
        other._held |= tables
        return other

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in (*TABLES, *VIEWS):
            raise AttributeError(name)
        if name not in self._held:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = _written(VIEWS[name], "spark")
                names = [n for n in (*TABLES, *VIEWS) if n != name and re.search(rf"\b(FROM|JOIN) {n}\b", sql)]
                for n in names:
                    sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
                df = self.spark.sql(sql, **{n: getattr(self, n) for n in names})
            self._held[name] = df
        return self._held[name]
