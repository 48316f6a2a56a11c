"""Chunks of laws of four levels, by hand."""

from __future__ import annotations

from tidemill.operators import legal

LAW = """Luật số 5
ban hành năm nay

# CHƯƠNG I
**NHỮNG QUY ĐỊNH CHUNG**

Điều 1. Phạm vi
Luật này quy định.
1. Khoản một
2. Khoản hai

## Mục 1. Phần đầu
Điều 2a. Đối tượng
Áp dụng cho mọi người.
Chương ii
CÁC QUYỀN
Mục 2. Phần sau
Điều 3. Quyền
| --- |
Có quyền.
Chương III
""" + "dài " * 80 + "\nĐiều 4. Cuối\nHết."
FIRST = "CHƯƠNG I NHỮNG QUY ĐỊNH CHUNG"


def chunks(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return legal.chunk_by_legal_unit(docs, **more).orderBy("doc_id", "position").collect()


def test_articles(spark):
    rows = chunks(spark, [LAW, None, "", " \n ", "không có điều nào"])
    own = [(r.chapter, r.section, r.article, r.content) for r in rows if r.doc_id == 0]
    long = ("Chương III\n" + "dài " * 80).strip()
    assert own == [
        (None, None, None, "Luật số 5\nban hành năm nay"),
        ("Chương I", None, "Điều 1", f"{FIRST}\nĐiều 1. Phạm vi\nLuật này quy định.\n1. Khoản một\n2. Khoản hai"),
        ("Chương I", "Mục 1", "Điều 2a", f"{FIRST} › Mục 1. Phần đầu\nĐiều 2a. Đối tượng\nÁp dụng cho mọi người."),
        # a section of the chapter before no longer holds
        ("Chương II", "Mục 2", "Điều 3", "Chương ii CÁC QUYỀN › Mục 2. Phần sau\nĐiều 3. Quyền\nCó quyền."),
        # a chapter with text of its own is a chunk, and titles what follows by its first line
        ("Chương III", None, None, long), ("Chương III", None, "Điều 4", "Chương III\nĐiều 4. Cuối\nHết."),
    ]
    assert [r.position for r in rows if r.doc_id == 0] == list(range(6)) and all(r.clause is None for r in rows)
    assert [(r.doc_id, r.content) for r in rows if r.doc_id > 0] == [(4, "không có điều nào")]


def test_other_levels(spark):
    clauses = [(r.article, r.clause, r.content) for r in chunks(spark, [LAW], split_at="clause") if r.chapter == "Chương I"]
    assert clauses[:2] == [
        ("Điều 1", "Khoản 1", f"{FIRST} › Điều 1. Phạm vi Luật này quy định.\n1. Khoản một"), ("Điều 1", "Khoản 2", f"{FIRST} › Điều 1. Phạm vi Luật này quy định.\n2. Khoản hai"),
    ]
    chapters = chunks(spark, [LAW], split_at="chapter")
    assert [r.chapter for r in chapters] == [None, "Chương I", "Chương II", "Chương III"] and all(r.section is r.article is None for r in chapters)
    assert chapters[2].content == "Chương ii\nCÁC QUYỀN\nMục 2. Phần sau\nĐiều 3. Quyền\nCó quyền."
    assert chunks(spark, [LAW], breadcrumb=False)[1].content.startswith("Điều 1. Phạm vi\n")


def test_oversize_units_keep_their_titles(spark):
    text = "Chương I\nChung\nĐiều 7. Dài\n" + " ".join(f"Câu số {i}." for i in range(60))
    rows = chunks(spark, [text], size=200)
    assert len(rows) > 3 and {(r.chapter, r.article) for r in rows} == {("Chương I", "Điều 7")}
    assert rows[0].content.startswith("Chương I Chung\nĐiều 7. Dài") and all(r.content.startswith("Chương I Chung › Điều 7. Dài\n") for r in rows[1:])
    assert all(len(r.content) <= 220 for r in rows)
