"""Tables and questions in texts, by hand."""

from __future__ import annotations

from tidemill.operators import tables


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


TEXT = """Intro line.

## Sheet: Prices 2024
Some prose here.

### Fees

| Name | Fee |
|------|:---:|
| A | 1 |
|  | nan |
| B | 2 |
| C | none |
| D | 4 |
after the table
| Lone | header |
|---|---|
# Not above: a table follows text
text between
| x | y |
| 1 | 2 |
## sheet:  Other  
| p |
| q |
"""  # noqa: W291


def test_tables(spark):
    rows = tables.chunk_tables(docs(spark, TEXT, None, "", "no table at all"), 2).orderBy("doc_id", "position").collect()
    lead = "### Fees\n| Name | Fee |"
    assert [(r.rows, r.sheet, r.heading, r.content) for r in rows if r.doc_id == 0] == [
        (None, None, None, "Intro line."), (None, None, None, "Some prose here."),
        ("1-2", "Prices 2024", "Fees", f"{lead}\n| A | 1 |\n| B | 2 |"), ("3-4", "Prices 2024", "Fees", f"{lead}\n| C | none |\n| D | 4 |"),
        (None, None, None, "after the table"), (None, "Prices 2024", None, "| Lone | header |"),
        (None, None, None, "# Not above: a table follows text\ntext between"), ("1-1", "Prices 2024", None, "| x | y |\n| 1 | 2 |"),
        ("1-1", "Other", None, "| p |\n| q |"),
    ]
    assert [r.position for r in rows if r.doc_id == 0] == list(range(9))
    assert [(r.doc_id, r.content) for r in rows if r.doc_id > 0] == [(3, "no table at all")]


def test_long_prose_is_split_by_size(spark):
    text = " ".join(f"Sentence number {i}." for i in range(60)) + "\n| a |\n| 1 |"
    rows = tables.chunk_tables(docs(spark, text), size=200).orderBy("position").collect()
    assert len(rows) > 3 and all(len(r.content) <= 220 for r in rows) and rows[-1].content == "| a |\n| 1 |"
    assert " ".join(r.content for r in rows[:-1]) == " ".join(f"Sentence number {i}." for i in range(60))


QA = """**Q:** How much?
goes on
a. a list item, no answer
A: one
two

> Câu hỏi 3. Ở đâu?
| Câu hỏi thường gặp | x | Câu trả lời |
|---|---|---|
| Why? | - | Because |
| nan | - | no question |
| When? | - | |
| short row |
Trả lời 3: ở đây
Đáp án: không, ở kia
Question: never answered
Answer key:
Hỏi: last?
- Đáp: yes"""


def test_questions(spark):
    rows = tables.chunk_qa(docs(spark, QA, "A: answer without question\nplain", None, "| Question | Note |\n| q | n |")).orderBy("position").collect()
    assert [(r.doc_id, r.position, r.content) for r in rows] == [
        (0, 0, "Hỏi: Why?\nĐáp: Because"), (0, 1, "Hỏi: How much? goes on a. a list item, no answer\nĐáp: one\ntwo"),
        (0, 2, "Hỏi: Ở đâu?\nĐáp: không, ở kia"), (0, 3, "Hỏi: last?\nĐáp: yes"),
    ]
    long = tables.chunk_qa(docs(spark, f"Q: {'x' * 500}\nA: y")).first()
    assert len(long.question) == tables.QUESTION_CHARS and "x" * 500 in long.content
    assert {r.doc_id for r in tables.without_pairs(docs(spark, QA, "nothing", None)).collect()} == {1, 2}
