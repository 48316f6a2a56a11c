"""Laws as chunks: units of chapters, sections, articles and clauses, under the titles of what encloses them.

Lines that open a unit cut a text; a unit is its lines up to the next one. What encloses it is the last unit of each
higher level, unless a still higher one came since: that is known from the last places of all levels, which windows
over the units of a text give, without a walk over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemill.functions import text as tx
from tidemill.operators.corpus import split_by_size

#: Levels from the outermost, the folded marks that open them, with the number as group 1, and their labels.
LEVELS = ("chapter", "section", "article", "clause")
MARKS = (r"^chuong\s+([ivxlcdm]+|\d+)\b", r"^muc\s+(\d+)\b", r"^dieu\s+(\d+[a-z]?)\b", r"^(\d+)\.\s")
LABELS = ("Chương", "Mục", "Điều", "Khoản")
#: A higher unit under so many characters only titles what follows; longest title; what stands between titles.
HEADER_CHARS, TITLE_CHARS, BETWEEN = 200, 150, " › "
_DECORATION = r"^[\s#>*_\-]+"


def _bare(line: Column) -> Column:
    """A line without what markdown puts before it, and without stars and spaces around it."""
    return F.regexp_replace(F.regexp_replace(line, _DECORATION, ""), r"^[ *]+|[ *]+$", "")


def _units(docs: DataFrame, key: str, text: str, depth: int) -> DataFrame:
    """(key, unit, level, number, body, title, titles_only) of every unit; level is null before the first mark."""
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("at", "line"))
    folded = tx.fold(F.regexp_replace("line", _DECORATION, ""))
    numbers = [F.nullif(F.regexp_extract(folded, MARKS[k], 1), F.lit("")) for k in range(depth + 1)]
    level = F.coalesce(*[F.when(n.isNotNull(), k) for k, n in enumerate(numbers)])
    number = F.when(level == 0, F.upper(numbers[0])).otherwise(F.coalesce(*numbers))
    marked = lines.withColumn("level", level).withColumn("number", number)
    marked = marked.withColumn("unit", F.sum(F.col("level").isNotNull().cast("int")).over(W.partitionBy("key").orderBy("at")))
    own = F.array_sort(F.collect_list(F.struct("at", "line")))
    units = marked.groupBy("key", "unit").agg(F.max("level").alias("level"), F.max("number").alias("number"), F.transform(own, lambda x: x["line"]).alias("lines"))
    body = F.array_join("lines", "\n")
    units = units.withColumn("titles_only", F.coalesce((F.col("level") < depth) & (F.length(F.regexp_replace(body, r"^\s+|\s+$", "")) < HEADER_CHARS), F.lit(False)))
    parts = F.filter(F.transform("lines", _bare), lambda x: x != "")
    title = F.left(F.when(F.col("titles_only"), F.array_join(parts, " ")).otherwise(_bare(F.element_at("lines", 1))), F.lit(TITLE_CHARS))
    return units.select("key", "unit", "level", "number", body.alias("body"), title.alias("title"), "titles_only")


def _placed(units: DataFrame, depth: int) -> DataFrame:
    """units with the labels of their own and the enclosing levels, and ``titles``, those of the enclosing ones."""
    order = W.partitionBy("key").orderBy("unit")
    out = units
    for k in range(depth + 1):
        here = F.when(F.col("level") == k, F.struct("unit", "number", "title"))
        out = out.withColumn(f"last{k}", F.last(here, ignorenulls=True).over(order))
    for k in range(depth + 1):
        cut = F.greatest(*[F.coalesce(F.col(f"last{j}.unit"), F.lit(-1)) for j in range(k)], F.lit(-1), F.lit(-1))
        held = (F.col(f"last{k}.unit") > cut) & (F.col("level") >= k)
        label = F.concat(F.lit(LABELS[k] + " "), F.col(f"last{k}.number"))
        out = out.withColumn(LEVELS[k], F.when(held, label)).withColumn(f"title{k}", F.when(held & (F.col("level") > k), F.col(f"last{k}.title")))
    return out.withColumn("titles", F.array_compact(F.array(*[F.col(f"title{k}") for k in range(depth + 1)])))


def chunk_by_legal_unit(docs: DataFrame, split_at: str = "article", size: int = 3_000, breadcrumb: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, position, chapter, section, article, clause, content): a chunk for each unit of the level, and for higher ones with text.

    A chunk begins with the titles of what encloses it. One over ``size`` is cut by size; its later pieces begin with
    the unit's own first line too. Texts without marks are cut by size alone; blank lines and lines of table borders
    go; null and empty texts have no chunks. A text's lines are sorted in one task, as a text is read in one.
    """
    depth = LEVELS.index(split_at)
    units = _placed(_units(docs, key, text, depth), depth).where("NOT titles_only")
    labels = [F.col(n) if k <= depth else F.lit(None).cast("string").alias(n) for k, n in enumerate(LEVELS)]
    above = F.array_join("titles", BETWEEN) if breadcrumb else F.lit("")
    rows = units.select("key", "unit", *labels, F.col("level").isNotNull().alias("opened"), above.alias("above"), tx.clean_lines(F.col("body")).alias("body"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                body = r["body"].strip()
                pieces, later = [body], r["above"]
                if len(body) + len(r["above"]) > size:
                    if breadcrumb and r["opened"]:
                        later = BETWEEN.join(x for x in (r["above"], body.split("\n", 1)[0].strip()) if x)
                    pieces = split_by_size(body, max(size - len(later), size // 2), False)
                for i, piece in enumerate(pieces):
                    before = r["above"] if i == 0 else later
                    out.append((r["key"], r["unit"], i, *[r[n] for n in LEVELS], f"{before}\n{piece}" if before else piece))
            yield pd.DataFrame(out, columns=["key", "unit", "piece", *LEVELS, "content"])

    kind = docs.schema[key].dataType.simpleString()
    made = rows.where(F.regexp_replace("body", r"\s+", "") != "").mapInPandas(split, f"key {kind}, unit long, piece int, {', '.join(f'{n} string' for n in LEVELS)}, content string")
    place = F.row_number().over(W.partitionBy("key").orderBy("unit", "piece")) - 1
    return made.select(F.col("key").alias(key), place.cast("long").alias("position"), *LEVELS, "content")
