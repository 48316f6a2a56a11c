"""Queries over operators.retrieval."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemill.functions import confidence as cf
from tidemill.operators import adapter
from tidemill.operators import relational as rel
from tidemill.operators import retrieval as r
from tidemill.operators import search as s
from tidemill.plans.corpus import FOLD
from tidemill.plans.registry import query
from tidemill.plans.relational import TODAY, live

TOKENS = f"list_filter(string_split(trim(regexp_replace({FOLD.format('@')}, '[^\\p{{L}}\\p{{N}}\\p{{Mn}}_]+', ' ', 'g')), ' '), lambda x: x <> '')"
INDEX = f"""toks AS MATERIALIZED (SELECT doc_id, {TOKENS.replace('@', 'text')} AS w FROM documents),
  post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, unnest(w) AS term, len(w) AS length FROM toks) GROUP BY 1, 2),
  stat AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM toks),
  raw AS MATERIALIZED (SELECT term, count(*) AS df, ln((SELECT n FROM stat) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY 1),
  idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
  ask AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS.replace('@', 'text')}) AS term FROM benchmark) GROUP BY 1, 2),
  bm AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT mean FROM stat)))) AS bm25
    FROM post JOIN idf USING (term) JOIN ask USING (term) GROUP BY 1, 2)"""
UNIT = "list_transform({0}, lambda x: x::DOUBLE / sqrt(list_inner_product({0}::DOUBLE[], {0}::DOUBLE[])))"
DENSE = f"""den AS (SELECT q.query_id, v.vec_id, list_inner_product({UNIT.format('q.vector')}, {UNIT.format('v.embedding')}) AS cosine, v.label
  FROM v_queries q, embeddings v WHERE v.vec_id <> q.query_id)"""


def benchmark_queries(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def texts_asked(t):
    """The queries' texts: the benchmark passage of each query vector's number."""
    asked = t.benchmark.select((F.col("item_id") * 25).alias("query_id"), F.col("text").alias("query"))
    return asked.join(t.v_queries.select("query_id"), "query_id", "left_semi")


def text_hits(t):
    """BM25 of the documents for the queries' texts."""
    return r.bm25(texts_asked(t), t.documents).withColumnRenamed("doc_id", "vec_id")


FUSED = f"""{DENSE}, {INDEX.replace('item_id AS query_id', 'item_id * 25 AS query_id')},
  txt AS (SELECT query_id, doc_id AS vec_id, bm25 FROM bm WHERE query_id IN (SELECT query_id FROM v_queries)),
  dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) AS dr FROM den),
  br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, vec_id) AS br FROM txt WHERE bm25 > 0),
  fus AS (SELECT query_id, vec_id, cosine, bm25, (1 - 0.7) * coalesce(1 / (60 + dr), 0) + 0.7 * coalesce(1 / (60 + br), 0) AS fused FROM dr FULL JOIN br USING (query_id, vec_id)),
  pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, vec_id) AS pool_rank FROM fus) WHERE pool_rank <= 30),
  rel AS (SELECT *, fused + 0.25 * coalesce(cosine, 0) + 0.1 * CASE WHEN coalesce(bm25, 0) > 0 THEN 1 ELSE 0 END AS relevance FROM pool),
  gat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 9) DESC, vec_id) AS rank FROM
    (SELECT *, max(relevance) OVER (PARTITION BY query_id) AS best FROM rel) WHERE relevance >= 0.1) WHERE rank <= 5)"""


def pooled(t):
    return r.fused_pool(t.v_queries.select("query_id", "vector"), t.embeddings, text_hits(t), "vec_id", 5)


def gated(t):
    return r.stored(r.gate_and_rank(r.rerank(pooled(t)), "vec_id", 0.1, 5))


@query("r1_build_index", f"WITH {INDEX} SELECT doc_id, term, tf, length FROM post")
def r1(t):
    return r.postings(t.documents, "doc_id", "text").select("doc_id", "term", "tf", "length")


@query("r1_term_stats", f"WITH {INDEX} SELECT term, df, round(idf, 9) AS idf FROM idf")
def r1_stats(t):
    return r.term_stats(r.stored(r.document_counts(r.tokenized(t.documents, "doc_id", "text"), "doc_id"))).withColumn("idf", F.round("idf", 9))


@query("r2_bm25", f"WITH {INDEX} SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM bm")
def r2(t):
    return r.bm25(benchmark_queries(t), t.documents).withColumn("bm25", F.round("bm25", 6))


@query("r3_dense", f"WITH {DENSE} SELECT query_id, vec_id, round(cosine, 6) AS cosine FROM den")
def r3(t):
    return r.cosines(t.v_queries.select("query_id", "vector"), t.embeddings, "vec_id")


@query("j7_scoring_join", f"WITH {DENSE} SELECT query_id, max(round(cosine, 6)) AS best FROM den GROUP BY 1")
def j7(t):
    best = r.best_by(t.v_queries.select("query_id", "vector"), t.embeddings.select("vec_id", "embedding", F.lit(0).alias("any")), "vec_id", "any")
    return best.select("query_id", F.round("score", 6).alias("best"))


@query("r4_rrf", f"WITH {FUSED} SELECT query_id, vec_id, round(fused + 3.1e-13, 9) AS fused FROM fus")
def r4(t):
    """The small summand keeps sums with few decimals, such as 0.0049609375, away from where rounding turns."""
    return r.fused_pairs(t.v_queries.select("query_id", "vector"), t.embeddings, text_hits(t), "vec_id", asked=texts_asked(t), finish=lambda x: np.round(x + 3.1e-13, 9))


@query("r5_pool", f"WITH {FUSED} SELECT query_id, vec_id FROM pool")
def r5(t):
    return pooled(t).select("query_id", "vec_id")


@query("r6_rerank", f"WITH {FUSED} SELECT query_id, vec_id, round(relevance, 6) AS relevance FROM rel")
def r6(t):
    return r.rerank(pooled(t)).select("query_id", "vec_id", F.round("relevance", 6).alias("relevance"))


@query("r7_gate_and_rank", f"WITH {FUSED} SELECT query_id, vec_id, rank, round(best, 6) AS best FROM gat")
def r7(t):
    return gated(t).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("best", 6).alias("best"))


#: Places of a pool's matches and of the best one's neighbours; ``mat`` has (query_id, chunk_id, document_id, position, rank).
EXPAND = """near AS (SELECT m.query_id, c.chunk_id, c.position - m.position AS distance FROM mat m JOIN @chunks c USING (document_id)
    WHERE m.rank = 1 AND abs(c.position - m.position) = 1),
  knw AS (SELECT query_id, chunk_id, rank, distance FROM mat FULL JOIN near USING (query_id, chunk_id)),
  trn AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank IS NULL ORDER BY abs(distance), distance) AS turn, @cap - count(rank) OVER (PARTITION BY query_id) AS room FROM knw),
  slt AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank = 1 THEN 0 ELSE coalesce(distance, rank + 1000000) END) AS slot
    FROM trn WHERE rank IS NOT NULL OR turn <= room)"""


@query("r8_expand_context", f"""WITH {FUSED}, mat AS (SELECT query_id, chunk_id, document_id, position, rank FROM gat JOIN v_chunks ON chunk_id = vec_id),
  {EXPAND.replace('@chunks', 'v_chunks').replace('@cap', '6')} SELECT query_id, chunk_id, slot FROM slt""")
def r8(t):
    matches = gated(t).withColumnRenamed("vec_id", "chunk_id").join(t.v_chunks.select("chunk_id", "document_id", "position"), "chunk_id")
    return r.expand_context(matches, t.v_chunks, 1, 6)


#: CRC-32 of a word as a sum over its bytes; ``crc`` has the table of 256 values in ``t``.
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode(term)), 2), lambda i: CAST('0x' || substr(hex(encode(term)), i, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""
CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"
LINES = "string_split(text, chr(10))"
SEARCH = f"""pas AS (SELECT doc_id * 1000000 + pos AS chunk_id, doc_id, CAST(doc_id AS VARCHAR) AS document_id, pos AS position, line
    FROM (SELECT doc_id, unnest({LINES}) AS line, unnest(range(len({LINES}))) AS pos FROM documents) WHERE trim(line) <> ''),
  fnd AS (SELECT p.*, s.priority, CASE d.tier WHEN 'anonymous' THEN 0 WHEN 'user' THEN 1 ELSE 9 END <= 1 AND coalesce(d.effective_from, DATE '0001-01-01') <= DATE '2024-02-10'
      AND coalesce(d.effective_to, DATE '9999-12-31') >= DATE '2024-02-10' AS seen
    FROM pas p JOIN v_documents d ON d.id = p.doc_id JOIN v_sources s ON s.name = d.source
    WHERE d.status = 'ready' AND d.review = 'approved' AND d.enabled AND s.enabled AND coalesce(d.effective_to, DATE '9999-12-31') >= DATE '2024-02-10'),
  toks AS MATERIALIZED (SELECT chunk_id, seen, priority, {TOKENS.replace('@', 'line')} AS w FROM fnd),
  post AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT chunk_id, unnest(w) AS term, len(w) AS length FROM toks) GROUP BY 1, 2),
  stat AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM toks),
  raw AS MATERIALIZED (SELECT term, count(*) AS df, ln((SELECT n FROM stat) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY 1),
  flo AS MATERIALIZED (SELECT 0.25 * avg(raw) AS floor FROM raw),
  idf AS (SELECT term, CASE WHEN raw < 0 THEN floor ELSE raw END AS idf FROM raw, flo),
  ask AS MATERIALIZED (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS.replace('@', 'text')}) AS term FROM benchmark) GROUP BY 1, 2),
  bm AS (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT mean FROM stat)))) AS bm25
    FROM post JOIN idf USING (term) JOIN ask USING (term) GROUP BY 1, 2),
  {CRC_TABLE},
  plc AS MATERIALIZED (SELECT term, {CRC} % 64 AS p FROM (SELECT term FROM raw UNION SELECT term FROM ask), crc),
  cv AS MATERIALIZED (SELECT chunk_id, p, sum(tf) AS x FROM post JOIN plc USING (term) GROUP BY 1, 2),
  qv AS MATERIALIZED (SELECT query_id, p, sum(times) AS x FROM ask JOIN plc USING (term) GROUP BY 1, 2),
  dts AS MATERIALIZED (SELECT query_id, chunk_id, sum(q.x * c.x) AS dot FROM qv q JOIN cv c USING (p) GROUP BY 1, 2),
  cn AS (SELECT chunk_id, sqrt(sum(x * x)) AS norm FROM cv GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(x * x)) AS norm FROM qv GROUP BY 1),
  den AS (SELECT b.item_id AS query_id, k.chunk_id, k.priority, coalesce(dot / (qn.norm * cn.norm), 0) AS cosine FROM benchmark b CROSS JOIN (SELECT * FROM toks WHERE seen) k
    LEFT JOIN dts ON dts.query_id = b.item_id AND dts.chunk_id = k.chunk_id LEFT JOIN cn ON cn.chunk_id = k.chunk_id LEFT JOIN qn ON qn.query_id = b.item_id),
  both_ AS (SELECT den.*, coalesce(bm25, 0) AS bm25 FROM den LEFT JOIN bm USING (query_id, chunk_id)),
  rks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, chunk_id) AS dr,
      CASE WHEN bm25 > 0 THEN row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, chunk_id) END AS br FROM both_),
  fus AS (SELECT *, ((1 - 0.7) * coalesce(1 / (60 + dr), 0) + 0.7 * coalesce(1 / (60 + br), 0)) * priority AS fused FROM rks),
  pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, chunk_id) AS pool_rank FROM fus) WHERE pool_rank <= 40),
  rel AS (SELECT *, fused + 0.25 * cosine + 0.1 * CASE WHEN bm25 > 0 THEN 1 ELSE 0 END AS relevance FROM pool),
  gat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance * priority, 9) DESC, chunk_id) AS rank FROM rel WHERE relevance >= 0.0) WHERE rank <= 10)"""


def passages(t):
    """The lines of the documents, as chunks; blank ones leave a gap in the positions."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "content"))
    chunk_id, document = (F.col("doc_id") * 1_000_000 + F.col("position")).alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id")
    return lines.where(F.trim("content") != "").select(chunk_id, document, F.col("position").cast("long").alias("position"), "content", F.lit(True).alias("embedding"))


def searched(t):
    """(the index of all passages that can be searched, those passages); the ones a user may see today have a priority."""
    found = rel.searchable_chunks(passages(t), t.v_documents, t.v_sources, F.expr(TODAY))
    seen = found.withColumn("priority", F.when(rel.is_visible("user", F.expr(TODAY)), F.col("priority")))
    return s.build_index(seen, "chunk_id", "content", ["priority"]), found


@query("r9_hybrid_search", f"""WITH {SEARCH}, mat AS (SELECT query_id, chunk_id, document_id, position, rank FROM gat JOIN fnd USING (chunk_id)),
  {EXPAND.replace('@chunks', 'fnd').replace('@cap', '12')} SELECT query_id, chunk_id, slot, gat.rank, round(relevance, 6) AS relevance FROM slt LEFT JOIN gat USING (query_id, chunk_id)""")
def r9(t):
    """Every passage that a user may see today is ranked by both legs; the best one comes with its neighbours."""
    index, found = searched(t)
    hits = s.hybrid_search(index, benchmark_queries(t), found)
    return hits.select("query_id", "chunk_id", F.col("slot").cast("long").alias("slot"), F.col("rank").cast("long").alias("rank"), F.round("relevance", 6).alias("relevance"))


@query("r3_nearest_by_lists")
def r3_lists(t):
    """The 20 nearest of each query vector, itself apart, by inverted lists with a recall of 0.95 on a sample of queries."""
    found = s.nearest(t.spark, t.embeddings, t.v_queries.select("query_id", "vector"), "vec_id", 21)
    others = found.where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return others.withColumn("rank", rank).where("rank <= 20").select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("cosine", 6).alias("cosine"))


@query("r10_assemble_context", f"""WITH {FUSED}, blk AS (SELECT query_id, rank, '<document title="Doc ' || vec_id || '">' || chr(10) || replace(replace(replace(replace(coalesce(d.text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')
    || chr(10) || '</document>' AS block FROM gat LEFT JOIN documents d ON d.doc_id = vec_id),
  ends AS (SELECT *, sum(length(block) + 1) OVER (PARTITION BY query_id ORDER BY rank) - 1 AS e FROM blk),
  fit AS (SELECT *, min(CASE WHEN e <= 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS f FROM ends)
  SELECT query_id, sha256(string_agg(CASE WHEN f = 1 THEN block ELSE left(block, 4000) END, chr(10) ORDER BY rank)) AS context FROM fit WHERE f = 1 OR rank = 1 GROUP BY 1""")
def r10(t):
    texts = t.documents.select(F.col("doc_id").alias("vec_id"), "text")
    matches = gated(t)
    texts = texts.join(r.checked_broadcast(matches.select("vec_id").distinct(), 1 << 20), "vec_id", "left_semi")
    named = matches.join(texts, "vec_id", "left").select(
        "query_id", "rank", F.concat(F.lit("Doc "), F.col("vec_id").cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("content")
    )
    return r.assemble_context(named, 4000).select("query_id", F.sha2("context", 256).alias("context"))


def adapter_pairs(t):
    """Each query vector with the next vector of its label."""
    left = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("q"))
    right = t.embeddings.select((F.col("vec_id") - 10).alias("vec_id"), F.col("embedding").cast("array<double>").alias("p"))
    return left.join(right, "vec_id").select("q", "p")


@query("r11_fit_query_adapter", """WITH p AS (SELECT a.embedding::DOUBLE[] AS q, b.embedding::DOUBLE[] AS p FROM embeddings a JOIN embeddings b ON b.vec_id - 10 = a.vec_id)
  SELECT i, j, round(sum(q[i + 1] * q[j + 1]), 6) AS qq, round(sum(q[i + 1] * p[j + 1]), 6) AS qp FROM p, (SELECT unnest(range(64)) AS i) a, (SELECT unnest(range(64)) AS j) b GROUP BY 1, 2""")
def r11(t):
    cells = r.gram(adapter_pairs(t))
    return cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("qq", 6).alias("qq"), F.round("qp", 6).alias("qp"))


@query("r12_apply_adapter")
def r12(t):
    matrix = r.fit_query_adapter(adapter_pairs(t), 1.0)
    return t.v_queries.select("query_id", r.apply_adapter(F.col("vector"), matrix).alias("vector"))


@query("r13_select_lambda")
def r13(t):
    """Ridges by five folds of the pairs: a query is ranked by adapters that its fold had no part in."""
    left = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = left.join(t.embeddings.select((F.col("vec_id") - 10).alias("query_id"), F.col("embedding").alias("p")), "query_id")
    return adapter.ridge_report(pairs, t.v_queries, t.embeddings, (0.1, 1.0, 10.0))


ROUTES = f"""{DENSE}, rts AS (SELECT query_id, 'route' || label AS route, max(cosine) AS score FROM den GROUP BY 1, 2),
  two AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, route) AS n FROM rts),
  rt AS (SELECT query_id, max(CASE WHEN n = 1 THEN route END) AS first, max(CASE WHEN n = 1 THEN score END) AS score, coalesce(max(CASE WHEN n = 2 THEN score END), 0) AS second FROM two WHERE n <= 2 GROUP BY 1),
  routed AS (SELECT query_id, CASE WHEN score >= 0.3 AND score - second >= 0.02 THEN first ELSE 'rag_question' END AS route, score, score - second AS lead FROM rt)"""


def routed(t):
    examples = t.embeddings.select("vec_id", "embedding", F.concat(F.lit("route"), F.col("label").cast("string")).alias("route"))
    return r.best_routes(r.best_by(t.v_queries.select("query_id", "vector"), examples, "vec_id", "route"), 0.3, 0.02, "rag_question")


@query("r14_route_nearest", f"WITH {ROUTES} SELECT query_id, route, round(score, 6) AS score FROM routed")
def r14(t):
    return routed(t).select("query_id", "route", F.round("score", 6).alias("score"))


@query("r15_off_topic", f"WITH {ROUTES} SELECT query_id, lead >= 0.02 OR (score < 0.001 AND lead > -0.02) AS off_topic FROM routed")
def r15(t):
    return routed(t).select("query_id", r.off_topic(F.col("lead"), F.col("score")).alias("off_topic"))


@query("r16_route_logistic")
def r16(t):
    """Held-out routes by a class-balanced multinomial model of four fifths of the vectors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = t.embeddings.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    weights = rows.groupBy("label").agg((F.lit(1.0) / F.count("*")).alias("weight"))
    weighted = rows.join(F.broadcast(weights), "label")  # a row for each route
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=30).fit(weighted.where("vec_id % 5 <> 0"))
    return model.transform(weighted.where("vec_id % 5 = 0")).select("vec_id", F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("predicted"))


def sql_list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


#: Words that carry content, a band's score, and how many phrases a text has, in DuckDB.
CONTENT = f"list_filter(list_distinct(regexp_extract_all(lower({{0}}), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+')), lambda w: length(w) > 1 AND NOT list_contains({sql_list(cf.STOPWORDS)}, w))"
BAND = "CASE WHEN {0} < {1} THEN {0} / {1} WHEN {0} <= {2} THEN 1.0 ELSE greatest(0.0, 1 - ({0} - {2}) / {2}) END"
PHRASES = "len(list_filter({1}, lambda p: contains({0}, p)))"
CONFIDENCE = rf"""asked AS (SELECT message_id, a.answer, a.question FROM v_qa a JOIN v_messages m ON m.conv_id = a.conv_id AND m.turn = a.turn),
  told AS (SELECT message_id, string_agg(coalesce(d.text, ''), chr(10) ORDER BY c."at") AS context, avg(CAST((message_id * 7 + c."at" * 31) % 97 AS DOUBLE) / 97) AS found
    FROM v_citations c JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.document_id GROUP BY 1),
  txt AS (SELECT message_id, coalesce(answer, '') AS a, coalesce(question, '') AS q, coalesce(context, '') AS c, found FROM asked LEFT JOIN told USING (message_id)),
  kws AS (SELECT *, {CONTENT.format('c')} AS ck, {CONTENT.format('a')} AS ak, len(regexp_extract_all(a, '\S+')) AS an, len(regexp_extract_all(q, '\S+')) AS qn,
      length(a) / length(c) AS ratio, list_filter(regexp_split_to_array(lower(a), '[.!?]+'), lambda s: trim(regexp_replace(s, '\s+', '', 'g')) <> '') AS st, regexp_extract_all(lower(a), '\S+') AS aw,
      {PHRASES.format('lower(a)', sql_list(cf.DOUBT))} AS dn FROM txt),
  fct AS (SELECT message_id,
      CASE WHEN trim(regexp_replace(c, '\s+', '', 'g')) = '' THEN 0.3 WHEN len(ck) = 0 THEN 0.5 ELSE
        0.4 * len(list_intersect(ck, ak)) / len(ck) + 0.3 * {BAND.format('ratio', 0.1, 0.5)} + 0.3 * CASE WHEN found IS NULL THEN 0.5 ELSE least(1.0, found) END END AS alignment,
      CASE WHEN qn <= 5 THEN {BAND.format('an', 10, 50)} WHEN qn <= 15 THEN {BAND.format('an', 20, 100)} ELSE {BAND.format('an', 30, 200)} END AS length,
      CASE WHEN len(st) <= 1 THEN 1.0 ELSE 0.6 * least(1.0, list_sum(list_transform(st, lambda s: {PHRASES.format('s', sql_list(cf.CONNECTORS))})) / len(st)) + 0.4 * len(list_distinct(aw)) / len(aw) END AS coherence,
      CASE WHEN dn <= 3 THEN 1 - 0.2 * dn ELSE greatest(0.0, 1 - 0.1 * (dn - 3)) END AS certainty FROM kws)"""


@query("r17_answer_confidence", f"""WITH {CONFIDENCE}, ovr AS (SELECT *, 0.4 * alignment + 0.2 * length + 0.3 * coherence + 0.1 * certainty AS score FROM fct)
  SELECT message_id, round(CAST(alignment AS DOUBLE), 6) AS alignment, round(CAST(length AS DOUBLE), 6) AS length, round(CAST(coherence AS DOUBLE), 6) AS coherence, round(CAST(certainty AS DOUBLE), 6) AS certainty,
    round(CAST(score AS DOUBLE), 6) AS score, CASE WHEN score >= 0.8 THEN 'High' WHEN score >= 0.6 THEN 'Moderate' WHEN score >= 0.4 THEN 'Low' ELSE 'Very Low' END AS level FROM ovr""")
def r17(t):
    """Every answer against its question and the documents that it cites, with a score for each of them."""
    asked = rel.question_before(t.v_messages).where("question IS NOT NULL").select("message_id", "question", F.col("content").alias("answer"))
    cited = t.v_citations.join(t.documents.select(F.col("doc_id").cast("string").alias("document_id"), "text"), "document_id")
    each = cited.groupBy("message_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("context"),
        F.avg(((F.col("message_id") * 7 + F.col("at") * 31) % 97) / 97).alias("found"),
    )
    parts = cf.factors(F.col("question"), F.col("answer"), F.col("context"), F.col("found"))
    scored = asked.join(each, "message_id", "left").select("message_id", *[p.alias(n) for n, p in parts.items()])
    score = cf.overall({n: F.col(n) for n in parts})
    return scored.withColumn("score", score).select("message_id", *[F.round(n, 6).alias(n) for n in (*parts, "score")], cf.level(F.col("score")).alias("level"))


@query("a27_index_stats", """SELECT d.source, count(*) AS n FROM v_chunks c JOIN v_documents d USING (document_id) JOIN v_sources s ON s.name = d.source
  WHERE c.embedding IS NOT NULL AND d.status = 'ready' AND d.review = 'approved' AND d.enabled AND s.enabled AND coalesce(d.effective_to, DATE '9999-12-31') >= DATE '2024-02-10' GROUP BY 1""")
def a27(t):
    return live(t).groupBy("source").agg(F.count("*").alias("n"))
