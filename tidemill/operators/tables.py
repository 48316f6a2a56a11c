"""Tables written out in texts, found by one segmentation of the lines, for chunks of rows and of questions and answers.

A table is a run of lines that begin and end with a bar. Lines are numbered in their text, runs are islands of a window
over the lines of a text, and what a row needs of its table (header, caption, sheet) comes by the same windows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemill.functions import text as tx
from tidemill.operators.corpus import split_by_size

#: What stands for an empty cell, and the folded words of question and answer marks and columns.
EMPTY = ("", "nan", "none")
QUESTION_MARKS, ANSWER_MARKS = ("question", "hoi", "cau hoi"), ("answer", "dap", "dap an", "tra loi")
QUESTION_LETTER, ANSWER_LETTER = "q", "a"
QUESTION_COLUMNS, ANSWER_COLUMNS = ("cau hoi", "question", "hoi"), ("tra loi", "answer", "dap")
SHEET, HEADING = r"(?i)^#{1,6}\s*Sheet:\s*(.+\S)", r"^#{1,6}\s+(.*\S)"
#: Longest question and heading that go along with a chunk.
QUESTION_CHARS, HEADING_CHARS = 300, 200


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def segmented(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, line, bare, cells, block, rule, hollow) of every line of every text.

    cells is null outside tables; block numbers the tables of a text; rule: a line under a header; hollow: all cells
    are empty.
    """
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("at", "line")).withColumn("bare", _strip(F.col("line")))
    barred = F.col("bare").rlike(r"^\|.*\|$") & (F.length("bare") > 1)
    cells = F.transform(F.split(F.substr("bare", F.lit(2), F.length("bare") - 2), r"\|"), _strip)
    order = W.partitionBy("key").orderBy("at")
    found = lines.withColumn("cells", F.when(barred, cells))
    begins = F.col("cells").isNotNull() & F.lag("cells").over(order).isNull()
    blocks = found.withColumn("begins", begins).withColumn("block", F.when(F.col("cells").isNotNull(), F.sum(F.col("begins").cast("int")).over(order)))
    rule = F.col("bare").contains("-") & F.col("bare").rlike(r"^\|?[\s:\-|]+\|?$")
    return blocks.withColumn("rule", rule).withColumn("hollow", F.forall("cells", lambda c: F.lower(c).isin(*EMPTY)))


def _mark(letter: str, words: Sequence[str]) -> str:
    """Of a folded line: a letter or word, a number, a colon (after a word also a dot), with what markdown puts around."""
    return rf"^[\s>*_\-]*(?:{letter}\s*\d*\s*:|(?:{'|'.join(words)})\s*\d*\s*[:.])\**\s*"


def _column(header: Column, words: Sequence[str], other: Column) -> Column:
    """The place of the first header cell with one of the words, from 1; 0 if there is none."""
    return F.array_position(F.transform(header, lambda c, i: tx.fold(c).rlike("|".join(words)) & (i + 1 != other)), True).cast("int")


def table_pairs(lines: DataFrame) -> DataFrame:
    """(key, at, question, answer) of tables with a column for each; cells that are empty give none."""
    rows = lines.where(F.col("cells").isNotNull() & ~F.col("rule") & ~F.col("hollow"))
    order = W.partitionBy("key", "block").orderBy("at")
    header = F.first("cells").over(order)
    placed = rows.withColumn("header", header).withColumn("n", F.row_number().over(order)).where("n > 1")
    q = placed.withColumn("q", _column(F.col("header"), QUESTION_COLUMNS, F.lit(0)))
    both = q.withColumn("a", _column(F.col("header"), ANSWER_COLUMNS, F.col("q"))).where((F.col("q") > 0) & (F.col("a") > 0) & (F.greatest("q", "a") <= F.size("cells")))
    pairs = both.select("key", "at", F.element_at("cells", F.col("q")).alias("question"), F.element_at("cells", F.col("a")).alias("answer"))
    return pairs.where(~F.lower("question").isin(*EMPTY) & ~F.lower("answer").isin(*EMPTY))


def line_pairs(lines: DataFrame) -> DataFrame:
    """(key, at, question, answer) of marked lines: a question goes on to its answer, that to the next question.

    A second answer to a question takes the place of the first. Blank lines and tables are passed over.
    """
    plain = lines.where("cells IS NULL AND bare <> ''").withColumn("folded", tx.fold(F.col("line")))
    found = {k: F.regexp_extract("folded", _mark(*m), 0) for k, m in (("q", (QUESTION_LETTER, QUESTION_MARKS)), ("a", (ANSWER_LETTER, ANSWER_MARKS)))}
    kind = F.when(found["q"] != "", "q").when(found["a"] != "", "a")
    size = F.length(F.when(found["q"] != "", found["q"]).otherwise(found["a"]))
    order = W.partitionBy("key").orderBy("at")
    marked = plain.withColumn("kind", kind).withColumn("body", _strip(F.substr("line", size + 1, F.length("line"))))
    paired = marked.withColumn("pair", F.sum((F.col("kind") == "q").cast("int")).over(order)).where("pair > 0")
    own = W.partitionBy("key", "pair")
    answered = paired.withColumn("first", F.min(F.when(F.col("kind") == "a", F.col("at"))).over(own)).withColumn("last", F.max(F.when(F.col("kind") == "a", F.col("at"))).over(own))

    def joined(when: Column, by: str) -> Column:
        return _strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("at", "body")))), lambda x: x["body"]), by))

    grouped = answered.where("first IS NOT NULL").groupBy("key", "pair")
    return grouped.agg(F.min("at").alias("at"), joined(F.col("at") < F.col("first"), " ").alias("question"), joined(F.col("at") >= F.col("last"), "\n").alias("answer")).drop("pair")


def chunk_qa(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, position, question, content) of each pair of a text: those of tables first, then those of marked lines.

    The question is cut to what goes along with a chunk; texts are in NFC, so that folding keeps places.
    """
    lines = segmented(docs, key, text)
    pairs = table_pairs(lines).withColumn("leg", F.lit(0)).unionByName(line_pairs(lines).withColumn("leg", F.lit(1)))
    place = F.row_number().over(W.partitionBy("key").orderBy("leg", "at")) - 1
    content = F.concat(F.lit("Hỏi: "), "question", F.lit("\nĐáp: "), "answer")
    return pairs.select(F.col("key").alias(key), place.cast("long").alias("position"), F.left("question", F.lit(QUESTION_CHARS)).alias("question"), content.alias("content"))


def without_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key) of texts that have no pair: what is rejected."""
    return docs.select(key).join(chunk_qa(docs, key, text).select(key), key, "left_anti")


def chunk_tables(docs: DataFrame, rows: int = 10, size: int = 3_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, position, rows, sheet, heading, content): so many rows a chunk under the table's header; the rest by size.

    A heading right above a table is its caption: it begins all its chunks, and leaves the text before. A heading that
    names a sheet holds for all tables until the next. ``rows`` counts a table's rows that are not empty, from 1; a
    table without any is its header. Chunks of text between tables have no rows, sheet or heading.
    """
    order = W.partitionBy("key").orderBy("at")
    sheet = F.nullif(F.regexp_extract("bare", SHEET, 1), F.lit(""))
    lines = segmented(docs, key, text).withColumn("named", F.when(F.col("cells").isNull(), sheet))
    lines = lines.withColumn("sheet", F.last("named", ignorenulls=True).over(order))
    heads = F.col("cells").isNull() & F.col("named").isNull() & F.col("bare").rlike(HEADING)
    line = F.when(F.col("bare") != "", F.struct("at", "bare", heads.alias("heads")))
    lines = lines.withColumn("above", F.last(line, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    caption = F.when(F.col("begins") & F.col("above.heads"), F.col("above"))
    table = lines.where("cells IS NOT NULL").withColumn("caption", F.first(caption).over(W.partitionBy("key", "block").orderBy("at")))
    inner = W.partitionBy("key", "block").orderBy("at")
    table = table.where("NOT rule").withColumn("header", F.first("bare").over(inner)).withColumn("first", F.row_number().over(inner) == 1)
    kept = table.where("first OR NOT hollow").withColumn("n", F.row_number().over(inner) - 2)  # the header is -1
    of_table = W.partitionBy("key", "block")
    kept = kept.withColumn("most", F.max("n").over(of_table)).where("n >= 0 OR most < 0").withColumn("part", F.floor(F.greatest("n", F.lit(0)) / rows))
    body = F.array_sort(F.collect_list(F.when(F.col("n") >= 0, F.struct("n", "bare"))))
    chunks = kept.groupBy("key", "block", "part").agg(
        F.min("at").alias("at"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.first("sheet").alias("sheet"), F.first("header").alias("header"),
        F.first("caption").alias("caption"), F.transform(body, lambda x: x["bare"]).alias("body"),
    )
    parts = F.array_compact(F.concat(F.array(F.col("caption.bare"), F.col("header")), "body"))
    heading = F.left(F.regexp_extract("caption.bare", HEADING, 1), F.lit(HEADING_CHARS))
    label = F.when(F.col("lo") >= 0, F.concat_ws("-", (F.col("lo") + 1).cast("string"), (F.col("hi") + 1).cast("string")))
    of_rows = chunks.select("key", "at", F.lit(0).alias("piece"), label.alias("rows"), "sheet", heading.alias("heading"), F.array_join(parts, "\n").alias("content"))
    captions = table.where(F.col("caption").isNotNull()).select("key", F.col("caption.at").alias("at")).distinct()
    prose = lines.withColumn("segment", F.sum((F.col("begins") | F.col("named").isNotNull()).cast("int")).over(order))
    prose = prose.where("cells IS NULL AND named IS NULL").join(captions, ["key", "at"], "left_anti")
    texts = prose.groupBy("key", "segment").agg(F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, a, i, c) for k, a, t in zip(pdf["key"], pdf["at"], pdf["text"]) for i, c in enumerate(split_by_size(t.strip(), size, False))]
            yield pd.DataFrame(out, columns=["key", "at", "piece", "content"])

    kind = lines.schema["key"].dataType.simpleString()
    sized = texts.where(_strip(F.col("text")) != "").select("key", "at", "text").mapInPandas(split, f"key {kind}, at int, piece int, content string")
    none = [F.lit(None).cast("string").alias(c) for c in ("rows", "sheet", "heading")]
    all_ = of_rows.unionByName(sized.select("key", "at", "piece", *none, "content"))
    place = F.row_number().over(W.partitionBy("key").orderBy("at", "piece")) - 1
    return all_.select(F.col("key").alias(key), place.cast("long").alias("position"), "rows", "sheet", "heading", "content")
