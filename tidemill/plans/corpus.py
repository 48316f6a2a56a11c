"""Queries over operators.corpus and the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemill.functions import text as tx
from tidemill.operators import corpus as c
from tidemill.operators import legal, neardup, tables
from tidemill.operators import interchange
from tidemill.plans.registry import query

FOLD = "replace(strip_accents(lower({0})), 'đ', 'd')"
KEY = f"trim(regexp_replace({FOLD.format('text')}, '[^\\p{{L}}\\p{{N}}\\p{{Mn}}_]+', ' ', 'g'))"
LINES = r"array_to_string(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: NOT regexp_full_match(x, '[\s|+:=_-]*')), chr(10))"
QUESTIONS = """questions AS (SELECT query_id, expected AS chunk_id, style, CAST((query_id * 37) % 101 AS DOUBLE) / 101 AS score FROM v_queries)"""


def questions(t):
    score = ((F.col("query_id") * 37) % 101).cast("double") / 101
    return t.v_queries.select("query_id", F.col("expected").alias("chunk_id"), "style", score.alias("score"))


def texts(t):
    return t.documents.select("doc_id", "text")


@query("c1_clean_lines", f"SELECT doc_id, {LINES} AS text FROM documents")
def c1(t):
    return t.documents.select("doc_id", tx.clean_lines(F.col("text")).alias("text"))


@query("c2_fold_text", f"SELECT doc_id, {FOLD.format('text')} AS folded FROM documents")
def c2(t):
    return t.documents.select("doc_id", tx.fold(F.col("text")).alias("folded"))


@query("c3_search_tokens", f"SELECT doc_id, {KEY} AS tokens FROM documents")
def c3(t):
    return t.documents.select("doc_id", F.array_join(tx.search_tokens(F.col("text")), " ").alias("tokens"))


@query("c4_normalize_chat")
def c4(t):
    return t.conversations.select("conv_id", "turn", tx.normalize_chat(F.col("text")).alias("text"))


@query("c5_expand_shorthands")
def c5(t):
    return t.conversations.select("conv_id", "turn", tx.expand_shorthands(F.col("text")).alias("text"))


@query("c6_flag_unaccented", r"""SELECT conv_id, turn, NOT regexp_matches(text, '[^\x00-\x7F]') AND
  len(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w IN ('the', 'of', 'and', 'to', 'in', 'de', 'la'))) >= 3 AS flag FROM conversations""")
def c6(t):
    return t.conversations.select("conv_id", "turn", tx.unaccented(F.col("text"), ["the", "of", "and", "to", "in", "de", "la"]).alias("flag"))


@query("c7_symbol_share", r"""SELECT doc_id, CASE WHEN v > 0 THEN s / v ELSE 1.0 END AS share FROM (SELECT doc_id,
  len(regexp_extract_all(text, '[^\s]')) AS v, len(regexp_extract_all(regexp_replace(text, '\s', '', 'g'), '[\p{C}\p{S}]')) AS s FROM documents)""")
def c7(t):
    return t.documents.select("doc_id", tx.symbol_share(F.col("text")).alias("share"))


@query("c8_content_profile", r"""SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, contains(text, '|') AS has_tables,
  contains(text, '![') AS has_images, regexp_matches(text, 'https?://') AS has_links FROM documents""")
def c8(t):
    return c.content_profile(t.documents)


@query("c9_chunk_by_size")
def c9(t):
    return c.chunk_by_size(texts(t))


@query("c10_chunk_by_heading")
def c10(t):
    return c.chunk_by_heading(texts(t))


#: Text of a turn as a cell: one line, without bars.
CELL = "trim(regexp_replace(coalesce({0}, ''), '[|\\s]+', ' ', 'g'))"


def cell(c):
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[|\s]+", " "))


def in_order(c, by):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c.alias("line")))), lambda x: x["line"]), "\n")


@query("c11_chunk_by_legal_article", f"""WITH art AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {CELL.format('text')} AS body FROM conversations)
  SELECT conv_id, n - 1 AS position, CASE WHEN n <= 3 THEN 'Chương I' ELSE 'Chương II' END AS chapter, CASE WHEN n <= 3 THEN 'Mục 1' END AS section, 'Điều ' || n AS article, NULL AS clause,
    CASE WHEN n <= 3 THEN 'Chương I Quy định ' || conv_id || ' › Mục 1. Phần đầu' ELSE 'Chương II Phần cuối' END || chr(10) || '## Điều ' || n || '. ' || role
    || CASE WHEN regexp_full_match(body, '[\\s|+:=_-]*') THEN '' ELSE chr(10) || body END AS content FROM art""")
def c11(t):
    """Each conversation as a law: turns are articles, three of them in a section of the first chapter, the rest in a second one."""
    turns = t.conversations.withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    second = F.when(F.col("n") == 4, F.lit("**Chương II**\nPhần cuối\n")).otherwise("")
    article = F.concat(second, F.lit("## Điều "), F.col("n").cast("string"), F.lit(". "), "role", F.lit("\n\n"), cell(F.col("text")))
    laws = turns.groupBy("conv_id").agg(in_order(article, "n").alias("articles"))
    text = F.concat(F.lit("Chương I\n\nQuy định "), F.col("conv_id").cast("string"), F.lit("\nMục 1. Phần đầu\n"), "articles")
    return legal.chunk_by_legal_unit(laws.select("conv_id", text.alias("text")), size=1_000_000, key="conv_id")


@query("c12_chunk_qa_pairs", """SELECT conv_id AS doc_id, 0 AS position, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS question, trim(regexp_replace(answer, '\\s+', ' ', 'g')) AS answer FROM (SELECT conv_id,
  arg_min(text, turn) FILTER (role = 'user' AND trim(text) <> '') AS question, arg_min(text, turn) FILTER (role = 'assistant' AND trim(text) <> '') AS answer FROM conversations GROUP BY 1)
  WHERE question IS NOT NULL AND answer IS NOT NULL""")
def c12(t):
    """The first question and answer of each conversation, written out as text and read back."""
    lines = {k: F.regexp_replace(k, r"\s+", " ") for k in ("question", "answer")}
    written = interchange.qa_text(interchange.chat_to_pairs(t.conversations).withColumns(lines), "conv_id")
    return c.chunk_qa_pairs(written.withColumnRenamed("conv_id", "doc_id"))


@query("c12_qa_in_tables", f"""WITH qa AS (SELECT conv_id, turn, {CELL.format('question')} AS q, {CELL.format('answer')} AS a FROM v_qa),
  kept AS (SELECT *, CASE WHEN turn % 4 = 1 THEN 1 ELSE 0 END AS leg FROM qa WHERE turn % 4 = 1 OR (lower(q) NOT IN ('', 'nan', 'none') AND lower(a) NOT IN ('', 'nan', 'none')))
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY leg, turn) - 1 AS position, left(q, 300) AS question, 'Hỏi: ' || q || chr(10) || 'Đáp: ' || a AS content FROM kept""")
def c12_tables(t):
    """Questions and answers of each conversation, partly as a table with numbers, partly as numbered lines, read back."""
    qa = t.v_qa.select("conv_id", "turn", cell(F.col("question")).alias("q"), cell(F.col("answer")).alias("a"))
    number = F.col("turn").cast("string")
    row = F.concat(F.lit("| "), number, F.lit(" | "), "q", F.lit(" | "), "a", F.lit(" |"))
    lines = F.concat(F.lit("**Câu hỏi "), number, F.lit(":** "), "q", F.lit("\n\nTrả lời "), number, F.lit(": "), "a")
    own = qa.groupBy("conv_id").agg(in_order(F.when(F.col("turn") % 4 != 1, row), "turn").alias("table"), in_order(F.when(F.col("turn") % 4 == 1, lines), "turn").alias("lines"))
    text = F.concat(F.lit("Intro\n| No | Câu hỏi | Trả lời |\n|---|:---:|---|\n| | nan | |\n"), "table", F.lit("\n\n"), "lines")
    return tables.chunk_qa(own.select("conv_id", text.alias("text")), "conv_id")


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus"]


@query("c13_chunk_table_rows", """SELECT position, (min(n) + 1) || '-' || (max(n) + 1) AS rows, 'o_orderkey | o_custkey | o_orderstatus' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS content
  FROM (SELECT n, n // 10 AS position, line FROM (SELECT row_number() OVER (ORDER BY o_orderkey, line) - 1 AS n, line FROM (SELECT o_orderkey, o_orderkey || ' | ' || o_custkey || ' | ' || o_orderstatus AS line FROM orders))) GROUP BY position""")
def c13(t):
    return c.chunk_table_rows(t.orders, ORDERS, "o_orderkey", 10)


@query("c13_tables_in_text", f"""WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, '| ' || turn || ' | ' || role || ' | ' || {CELL.format('text')} || ' |' AS line FROM conversations),
  parts AS (SELECT conv_id, 1 + n // 3 AS position, (min(n) + 1) || '-' || (max(n) + 1) AS rows, string_agg(line, chr(10) ORDER BY n) AS body FROM turns GROUP BY conv_id, n // 3),
  ends AS (SELECT conv_id, max(position) + 1 AS position FROM parts GROUP BY 1)
  SELECT conv_id, 0 AS position, NULL AS rows, NULL AS sheet, NULL AS heading, 'Talk of ' || conv_id AS content FROM ends
  UNION ALL SELECT conv_id, position, rows, 'conv ' || conv_id, 'Turns', '### Turns' || chr(10) || '| turn | role | text |' || chr(10) || body FROM parts
  UNION ALL SELECT conv_id, position, NULL, NULL, NULL, 'End of ' || conv_id FROM ends""")
def c13_tables(t):
    """Each conversation as a sheet with a table of its turns between lines of text."""
    row = F.concat(F.lit("| "), F.col("turn").cast("string"), F.lit(" | "), "role", F.lit(" | "), cell(F.col("text")), F.lit(" |"))
    own, number = t.conversations.groupBy("conv_id").agg(in_order(row, "turn").alias("table")), F.col("conv_id").cast("string")
    text = F.concat(
        F.lit("## Sheet: conv "), number, F.lit("\nTalk of "), number, F.lit("\n\n### Turns\n\n| turn | role | text |\n|---|---|---|\n"), "table", F.lit("\n| nan |  | NaN |\n\nEnd of "), number
    )
    return tables.chunk_tables(own.select("conv_id", text.alias("text")), 3, key="conv_id")


@query("c14_pack_rows_by_chars")
def c14(t):
    rows = t.nation.withColumn("line", c.table_text(t.nation, ["n_nationkey", "n_name", "n_regionkey"]))
    return c.pack_rows_by_chars(rows, "n_regionkey", "n_nationkey", "line", 80)


@query("c15_chunk_whole", f"SELECT doc_id, content FROM (SELECT doc_id, {LINES} AS content FROM documents) WHERE length(content) <= 20000 AND content <> ''")
def c15(t):
    return c.chunk_whole(t.documents)


@query("c16_chunk_auto")
def c16(t):
    spec = F.element_at(F.array(*[F.lit(x) for x in ("size", "heading", "whole", "other")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return c.chunk_auto(texts(t), spec)


@query("c17_chunking_report", """SELECT document_id, count(content) AS chunks, CAST(min(length(content)) AS BIGINT) AS shortest, CAST(max(length(content)) AS BIGINT) AS longest, avg(length(content)) AS mean,
  count(*) FILTER (length(content) < 50) AS short, count(*) FILTER (length(content) > 1500) AS long, count(content) - count(DISTINCT content) AS repeated FROM v_chunks GROUP BY document_id""")
def c17(t):
    return c.chunking_report(t.v_chunks)


@query("c18_section_label", """SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 'heading ' || position WHEN chunk_id % 3 = 1 THEN 'c' || document_id ELSE 'c' || document_id || ' · a' || position END AS label FROM v_chunks""")
def c18(t):
    labels = t.v_chunks.select(
        "chunk_id",
        F.when(F.col("chunk_id") % 3 != 0, F.concat(F.lit("c"), "document_id")).alias("chapter"),
        F.when(F.col("chunk_id") % 3 == 2, F.concat(F.lit("a"), F.col("position").cast("string"))).alias("article"),
        F.concat(F.lit("heading "), F.col("position").cast("string")).alias("heading"),
    )
    return labels.select("chunk_id", c.section_label(["chapter", "article"], "heading").alias("label"))


@query("c19_resequence", "SELECT chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY position DESC, chunk_id) - 1 AS position FROM v_chunks WHERE chunk_id % 7 <> 0")
def c19(t):
    return c.resequence(t.v_chunks.where("chunk_id % 7 <> 0"), [F.desc("position"), "chunk_id"]).select("chunk_id", "position")


@query("c20_rechunk_guard", "SELECT document_id FROM v_documents d WHERE NOT EXISTS (SELECT 1 FROM v_chunks c WHERE c.document_id = d.document_id AND c.edited)")
def c20(t):
    return c.rechunk_guard(t.v_documents, t.v_chunks).select("document_id")


@query("c21_dedup_by_hash", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source, content_hash ORDER BY status = 'failed', created_at, id) AS n FROM v_documents) WHERE n = 1")
def c21(t):
    return c.dedup_by_hash(t.v_documents).select("id")


@query("c22_dedup_normalized", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {KEY}")
def c22(t):
    return c.dedup_normalized(t.documents)


@query("c23_dedup_near")
def c23(t):
    return neardup.dedup_near(t.embeddings, "label")


@query("c24_decontaminate", f"SELECT doc_id FROM documents WHERE {KEY} NOT IN (SELECT {KEY} FROM benchmark)")
def c24(t):
    return c.decontaminate(t.documents, t.benchmark).select("doc_id")


@query("c24_decontaminate_near")
def c24_near(t):
    """The whole of C24; c24_decontaminate is its exact part, as its SQL says."""
    return c.decontaminate_near(t.documents, t.benchmark).select("doc_id")


@query("c24_contamination_report")
def c24_report(t):
    return c.contamination_report(t.documents, t.benchmark)


@query("c24_nearest_golden", """SELECT v.vec_id, round(max(list_inner_product(v.embedding::DOUBLE[], g.embedding::DOUBLE[]) / sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))
  / sqrt(list_inner_product(g.embedding::DOUBLE[], g.embedding::DOUBLE[]))), 6) AS nearest FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id < 40) g WHERE v.vec_id >= 40 GROUP BY 1""")
def c24_nearest(t):
    golden = t.embeddings.where("vec_id < 40")
    return c.nearest_golden(t.embeddings.where("vec_id >= 40"), golden).withColumn("nearest", F.round("nearest", 6))


@query("c25_round_trip_filter", """WITH s AS (SELECT q.query_id, q.query_id % 8 = k.k AS own, (q.query_id * 13 + k.k * 29) % 97 AS score FROM v_queries q, (SELECT unnest(range(8)) AS k) k),
  m AS (SELECT s.query_id, count(*) FILTER (s.score > o.score) + 1 AS rank FROM s JOIN s o ON o.query_id = s.query_id AND o.own GROUP BY 1) SELECT query_id, rank FROM m WHERE rank <= 3""")
def c25(t):
    each = t.v_queries.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    scores = each.select("query_id", (F.col("query_id") % 8 == F.col("k")).alias("own"), ((F.col("query_id") * 13 + F.col("k") * 29) % 97).alias("score"))
    return c.round_trip_filter(scores)


@query("c26_cap_per_chunk", f"""WITH {QUESTIONS}, a AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, style ORDER BY score DESC, query_id) AS turn FROM questions)
  SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY turn, style) AS rank FROM a) WHERE rank <= 5""")
def c26(t):
    return c.cap_per_chunk(questions(t)).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("c27_train_val_split")
def c27(t):
    return c.train_val_split(questions(t))


@query("c28_no_repeat_batches")
def c28(t):
    return c.no_repeat_batches(questions(t), 4)


@query("c29_perturb")
def c29(t):
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return c.perturb(rows, ["no_diacritics", "abbreviations", "telex", "typos", "no_spaces", "chat_mix"])


@query("c31_stale_embeddings", "SELECT chunk_id FROM v_chunks WHERE embedding IS NULL OR embedding_model IS DISTINCT FROM 'm1'")
def c31(t):
    return c.stale_embeddings(t.v_chunks, "m1").select("chunk_id")


@query("c32_hash_embed")
def c32(t):
    return tx.hash_embed(t.documents, "doc_id", "text")
