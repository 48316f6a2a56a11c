"""Chunking, deduplication and curation of a corpus."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemill.functions import text as tx
from tidemill.operators.retrieval import best_cosine, stored

#: A chunk is never longer than this, whatever the strategy.
MOST_CHARS = 20_000
#: Characters of texts whose chunks leave a task together.
PIECE = 2_000_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_HEADING = re.compile(r"^(#{1,6})\s+(\S.*)$")


def content_profile(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(
        "doc_id",
        F.length(text).cast("long").alias("chars"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.contains(text, F.lit("|")).alias("has_tables"),
        F.contains(text, F.lit("![")).alias("has_images"),
        text.rlike("https?://").alias("has_links"),
    )


def pack(parts: Iterator[str], size: int, overlap: bool = False, glue: str = " ") -> list[str]:
    """Parts joined greedily up to ``size`` characters; ``overlap`` repeats the last part in the next chunk."""
    out, held, length = [], [], 0
    for part in parts:
        if held and length + len(glue) + len(part) > size:
            out.append(glue.join(held))
            held = [held[-1]] if overlap else []
            length = sum(map(len, held)) + len(glue) * max(0, len(held) - 1)
        length += len(part) + (len(glue) if held else 0)
        held.append(part)
    return [*out, glue.join(held)] if held else out


def split_by_size(text: str, size: int, overlap: bool) -> list[str]:
    """A short text whole; else sections at second-level headings, each packed by sentences."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sections = [s.strip() for s in re.split(r"(?m)^(?=##\s)", text)]
    return [c for s in sections if s for c in ([s] if len(s) <= size else pack((p for p in _SENTENCE.split(s) if p), size, overlap))]


def split_by_heading(text: str, level: int, size: int) -> list[tuple[str | None, str]]:
    """(heading, chunk): one chunk for each heading up to ``level``; empty ones carry into the next."""
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    carried: list[str] = []
    for line in text.split("\n"):
        m = _HEADING.match(line)
        if m and len(m[1]) <= level:
            heading, body = out[-1]
            if heading is not None and not any(x.strip() for x in body[len(carried) + 1 :]):
                carried = body
                out[-1] = (m[2].strip(), [*body, line])
            else:
                carried = []
                out.append((m[2].strip(), [line]))
        else:
            out[-1][1].append(line)
    chunks = [(h, "\n".join(b).strip()) for h, b in out]
    return [(h, c) for h, b in chunks if b for c in ([b] if len(b) <= size else split_by_size(b, size, False))]


def _per_document(docs: DataFrame, split, schema: str) -> DataFrame:
    """One pass over each text by itself; linear in its length, no shuffle. What a task holds of chunks is about PIECE characters."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            for k, t in zip(pdf.doc_id, pdf.text):
                rows += [(k, i, *row) for i, row in enumerate(split(t or ""))]
                size += len(t or "")
                if size > PIECE:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def chunk_by_size(docs: DataFrame, size: int = 1_000, overlap: bool = False) -> DataFrame:
    return _per_document(docs, lambda t: [(c,) for c in split_by_size(t, size, overlap)], "doc_id long, position long, content string")


def chunk_by_heading(docs: DataFrame, level: int = 2, size: int = 1_000) -> DataFrame:
    return _per_document(docs, lambda t: split_by_heading(t, level, size), "doc_id long, position long, heading string, content string")


def chunk_qa_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, position, question, answer) of lines that start with a question or answer mark, as pairs."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line"))
    asks = F.col("line").rlike(r"(?iuU)^\s*(q|hỏi|câu hỏi)\s*[:.]")
    answers = F.col("line").rlike(r"(?iuU)^\s*(a|đáp|trả lời)\s*[:.]")
    body = F.trim(F.regexp_replace("line", r"(?iuU)^\s*(q|a|hỏi|câu hỏi|đáp|trả lời)\s*[:.]", ""))
    order = W.partitionBy("doc_id").orderBy("at")
    marked = lines.withColumns({"pair": F.sum(asks.cast("int")).over(order), "kind": F.when(asks, "q").when(answers, "a"), "body": body})
    side = F.last("kind", ignorenulls=True).over(W.partitionBy("doc_id", "pair").orderBy("at"))

    def joined(kind: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("side") == kind, F.struct("at", "body"))))
        return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")

    pairs = marked.where(F.col("pair") > 0).withColumn("side", side).groupBy("doc_id", "pair").agg(joined("q").alias("question"), joined("a").alias("answer"))
    return pairs.where("question <> '' AND answer <> ''").select("doc_id", (F.col("pair") - 1).alias("position"), "question", "answer")


def table_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """A row as text; empty cells are nan."""
    return F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns]), " | ")


def chunk_table_rows(df: DataFrame, columns: Sequence[str], order: str, rows: int) -> DataFrame:
    """(position, rows, content): so many rows a chunk under the repeated header, in the order of a column.

    Rows are numbered by a range-partitioned sort and the sizes of the ranges, not in one task; equal ones go by their
    text. The ranges come from a sample that is drawn anew each time, so the numbers inside them are stored before the
    sizes are counted.
    """
    header = " | ".join(columns)
    placed = df.select(F.col(order).alias("__o"), table_text(df, columns).alias("line")).repartitionByRange("__o", "line").sortWithinPartitions("__o", "line")
    placed = stored(placed.select(F.spark_partition_id().alias("__p"), (F.monotonically_increasing_id() % (1 << 33)).alias("__n"), "line"))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("size"))
    before = sizes.select("__p", (F.sum("size").over(W.orderBy("__p")) - F.col("size")).alias("before"))  # a row for each range
    numbered = placed.join(F.broadcast(before), "__p").withColumn("n", F.col("before") + F.col("__n"))
    grouped = numbered.groupBy(F.floor(F.col("n") / rows).alias("position")).agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines")
    )
    label = F.concat_ws("-", (F.col("lo") + 1).cast("string"), (F.col("hi") + 1).cast("string"))
    return grouped.select("position", label.alias("rows"), F.concat(F.lit(header + "\n"), F.array_join("lines", "\n")).alias("content"))


def pack_rows_by_chars(df: DataFrame, group: str, order: str, line: str, size: int) -> DataFrame:
    """(group, position, content): rows of a group packed greedily; a row of nan cells alone forces a break."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunks, part = [], []
        for text in [*pdf.sort_values(order)[line], None]:
            if text is None or set(text.replace("|", " ").split()) == {"nan"}:
                chunks += pack(iter(part), size, glue="\n")
                part = []
            else:
                part.append(text)
        return pd.DataFrame({group: pdf[group].iloc[0], "position": range(len(chunks)), "content": chunks})

    kind = df.schema[group].dataType.simpleString()
    return df.select(group, order, line).groupBy(group).applyInPandas(run, f"{group} {kind}, position long, content string")


def chunk_whole(docs: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    cleaned = docs.select("doc_id", tx.clean_lines(F.col("text")).alias("content"))
    return cleaned.where((F.length("content") <= most) & (F.col("content") != ""))


def chunk_auto(docs: DataFrame, spec: Column, size: int = 1_000) -> DataFrame:
    """(doc_id, position, content, spec) by each document's own strategy; unknown ones go to ``rejected``."""
    marked = docs.withColumn("spec", spec)
    parts = {
        "size": chunk_by_size(marked.where("spec = 'size'"), size),
        "heading": chunk_by_heading(marked.where("spec = 'heading'"), 2, size).drop("heading"),
        "whole": chunk_whole(marked.where("spec = 'whole'")).withColumn("position", F.lit(0).cast("long")),
    }
    unknown = marked.where(~F.coalesce(F.col("spec").isin(*parts), F.lit(False)))
    out = unknown.select("doc_id", F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("content"), F.lit("rejected").alias("spec"))
    for name, df in parts.items():
        out = out.unionByName(df.withColumn("spec", F.lit(name)))
    return out


def chunking_report(chunks: DataFrame, target: int = 1_000) -> DataFrame:
    size = F.length("content")
    return chunks.groupBy("document_id").agg(
        F.count("content").alias("chunks"),
        F.min(size).cast("long").alias("shortest"),
        F.max(size).cast("long").alias("longest"),
        F.avg(size).alias("mean"),
        F.count_if(size < 50).alias("short"),
        F.count_if(size > 1.5 * target).alias("long"),
        (F.count("content") - F.countDistinct("content")).alias("repeated"),
    )


def section_label(labels: Sequence[str], heading: str) -> Column:
    """Labels outermost first, else the heading."""
    return F.coalesce(F.nullif(F.concat_ws(" · ", *labels), F.lit("")), F.col(heading))


def resequence(chunks: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Dense positions from 0 in each document."""
    return chunks.withColumn("position", (F.row_number().over(W.partitionBy("document_id").orderBy(*order)) - 1).cast("long"))


def rechunk_guard(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that may be cut anew: none of their chunks was edited by hand."""
    return documents.join(chunks.where("edited"), "document_id", "left_anti")


def dedup_by_hash(documents: DataFrame) -> DataFrame:
    """One document for each content of a source: one that did not fail, then the earliest."""
    order = W.partitionBy("source", "content_hash").orderBy(F.col("status") == "failed", "created_at", "id")
    return documents.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def dedup_normalized(docs: DataFrame) -> DataFrame:
    """The first document of each normalized text."""
    keyed = docs.select("doc_id", tx.normalized_key(F.col("text")).alias("key"))
    return keyed.groupBy(F.sha2("key", 256).alias("key")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def decontaminate(docs: DataFrame, golden: DataFrame) -> DataFrame:
    """Documents whose normalized text is none of the evaluation set's."""
    keys = golden.select(tx.normalized_key(F.col("text")).alias("key")).distinct()
    return docs.withColumn("key", tx.normalized_key(F.col("text"))).join(keys, "key", "left_anti").drop("key")


def nearest_golden(vectors: DataFrame, golden: DataFrame) -> DataFrame:
    """(vec_id, nearest): the largest cosine to an evaluation vector, whatever their number."""
    return best_cosine(vectors, golden, "vec_id").withColumnRenamed("best", "nearest")


def nearest_benchmark(docs: DataFrame, golden: DataFrame) -> DataFrame:
    """(doc_id, nearest): the largest cosine of a text's word hashes to those of a benchmark text (item_id, text)."""
    vectors = tx.hash_embed(docs, "doc_id", "text").withColumnRenamed("doc_id", "vec_id")
    return nearest_golden(vectors, tx.hash_embed(golden, "item_id", "text")).withColumnRenamed("vec_id", "doc_id")


def decontaminate_near(docs: DataFrame, golden: DataFrame, cosine: float = 0.93) -> DataFrame:
    """Documents that are neither equal to a benchmark text (normalized) nor as near to one as ``cosine``."""
    near = nearest_benchmark(docs, golden).where(F.round("nearest", 9) >= cosine)
    return decontaminate(docs, golden).join(near.select("doc_id"), "doc_id", "left_anti")


def contamination_report(docs: DataFrame, golden: DataFrame) -> DataFrame:
    """(mean, p95, max) of the documents' cosines to their nearest benchmark text, to 6 digits.

    Rounded values are counted first, so that the percentile is over at most two million of them, however many documents.
    """
    counted = nearest_benchmark(docs, golden).groupBy(F.round("nearest", 6).alias("nearest")).agg(F.count("*").alias("n"))
    value, n = F.col("nearest"), F.col("n")
    return counted.agg((F.sum(value * n) / F.sum(n)).alias("mean"), F.percentile(value, F.lit(0.95), n).alias("p95"), F.max(value).alias("max"))


def round_trip_filter(scores: DataFrame, n: int = 3) -> DataFrame:
    """Queries whose own chunk ranks at most n, with (query_id, chunk_id, own, score) rows.

    The rank is one more than the number of higher scores.
    """
    own = scores.where("own").select("query_id", F.col("score").alias("mine"))
    counted = scores.join(own, "query_id").groupBy("query_id").agg((F.count_if(F.col("score") > F.col("mine")) + 1).alias("rank"))
    return counted.where(F.col("rank") <= n)


def cap_per_chunk(questions: DataFrame, cap: int = 5) -> DataFrame:
    """Up to ``cap`` questions of a chunk; styles take turns, best score first."""
    turn = F.row_number().over(W.partitionBy("chunk_id", "style").orderBy(F.desc("score"), "query_id"))
    rank = F.row_number().over(W.partitionBy("chunk_id").orderBy("turn", "style"))
    return questions.withColumn("turn", turn).withColumn("rank", rank).where(F.col("rank") <= cap).drop("turn")


def train_val_split(questions: DataFrame, seed: int = 13) -> DataFrame:
    """``validation`` is one question of each chunk that has three or more."""
    n = F.count("*").over(W.partitionBy("chunk_id"))
    draw = F.row_number().over(W.partitionBy("chunk_id").orderBy(F.xxhash64(F.lit(seed), "query_id"), "query_id"))
    return questions.withColumns({"__n": n, "__d": draw}).withColumn("validation", (F.col("__n") >= 3) & (F.col("__d") == 1)).drop("__n", "__d")


def no_repeat_batches(pairs: DataFrame, size: int) -> DataFrame:
    """(layer, batch): batches of ``size`` in which a chunk is at most once; every pair is in one.

    A layer is the n-th pair of each chunk. Its pairs are numbered through: within ranges of a hash, each range going on
    from the sizes of those before, so that no layer is one task's work and only its last batch may be short.
    """
    layer = F.row_number().over(W.partitionBy("chunk_id").orderBy("query_id")) - 1
    dealt = pairs.withColumn("layer", layer).withColumn("range", F.pmod(F.xxhash64("chunk_id"), F.lit(64)).cast("int"))
    sizes = dealt.groupBy("layer", "range").agg(F.count("*").alias("n"))
    before = W.partitionBy("layer").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    begins = sizes.select("layer", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    place = F.row_number().over(W.partitionBy("layer", "range").orderBy("chunk_id")) - 1
    return dealt.join(begins, ["layer", "range"]).withColumn("batch", F.floor((F.col("begin") + place) / size)).select(*pairs.columns, "layer", "batch")


#: Full forms and the short ones that people type for them; percent of accented words left as Telex keys, of
#: letters mistyped and of spaces left out; the Telex keys of tones.
SHORT_FORMS = {
    "như thế nào": ("ntn",), "số điện thoại": ("sđt", "sdt"), "thế nào": ("ntn",), "bao nhiêu": ("bn", "bnh"), "bây giờ": ("bh", "bjo"),
    "mọi người": ("mn", "mng"), "trả lời": ("tl",), "tại sao": ("tại s", "ts"), "công ty": ("cty",), "thông tin": ("tt",), "hồ sơ": ("hs",),
    "điện thoại": ("đt", "dt"), "việt nam": ("vn",), "không": ("ko", "k", "hok", "kh"), "được": ("dc", "đc", "đk"), "gì": ("j",), "vậy": ("v", "z"),
    "rồi": ("r", "rùi"), "với": ("vs",), "biết": ("bít", "bik", "bt"), "người": ("ng",), "mình": ("mk", "mik"), "chưa": ("chx",), "trước": ("trc",),
    "nhiều": ("nhìu",), "cũng": ("cg",), "thôi": ("thui",), "đang": ("đg",), "làm": ("lm",), "quá": ("wá", "qá"), "sao": ("s",), "anh": ("a",),
    "em": ("e",), "chị": ("c",), "bạn": ("b",), "tôi": ("t",), "triệu": ("tr",), "nghìn": ("k",),
}
TELEX_PERCENT, TYPO_PERCENT, SPACE_PERCENT = 30, 5, 30
TONES = {"\u0301": "s", "\u0300": "f", "\u0309": "r", "\u0303": "x", "\u0323": "j"}

#: Vowels with a shape, and what is typed for them; of all letters with a tone: the letter without it, and the tone's key.
_SHAPES = {"ă": "aw", "â": "aa", "ê": "ee", "ô": "oo", "ơ": "ow", "ư": "uw", "đ": "dd"}
_SHAPES |= {x.upper(): ("DD" if x == "đ" else keys[0].upper() + keys[1]) for x, keys in _SHAPES.items()}
_TONED = {
    unicodedata.normalize("NFC", vowel + mark): (vowel, key)
    for low in "aăâeêioôơuưy" for vowel in (low, low.upper()) for mark, key in TONES.items()
}
_ACCENTED = "".join([*_TONED, *_SHAPES])
_BARE = "".join([*(_SHAPES.get(v, v)[0] for v, _ in _TONED.values()), *(keys[0] for keys in _SHAPES.values())])


def telex_keys(word: Column) -> Column:
    """What is typed for a word: shapes after their letter, its last tone at the end."""
    toned = "".join(_TONED)
    out = F.translate(word, toned, "".join(v for v, _ in _TONED.values()))
    for letter, keys in _SHAPES.items():
        out = F.replace(out, F.lit(letter), F.lit(keys))
    tone = F.translate(F.regexp_extract(word, f"([{toned}])[^{toned}]*$", 1), toned, "".join(key for _, key in _TONED.values()))
    return F.concat(out, tone)


def perturb(texts: DataFrame, names: Sequence[str], seed: int = 13) -> DataFrame:
    """(id, name, variant) of every text and perturbation; the same seed, name and text give the same variant.

    A text is hashed once for each perturbation; what happens to a place depends on that hash and the place.
    """
    t, chars = F.col("text"), F.col("__chars")

    def draw(name: str, *place) -> Column:
        return F.pmod(F.xxhash64(F.col(f"__{name}"), *place), F.lit(100))

    def abbreviated(name: str) -> Column:
        out = t
        for full in sorted(SHORT_FORMS, key=len, reverse=True):
            short = F.array(*[F.lit(x) for x in SHORT_FORMS[full]])
            chosen = F.get(short, F.pmod(draw(name, F.lit(full)), F.lit(len(SHORT_FORMS[full]))).cast("int"))
            out = F.regexp_replace(out, F.lit(rf"(?iuU)(?<!\w){full}(?!\w)"), chosen)
        return out

    def mistyped() -> Column:
        """Of the letters drawn, half change places with the letter after them, half go."""
        def swaps(i: Column) -> Column:
            letters = F.get(chars, i).rlike(r"\p{L}") & F.get(chars, i + 1).rlike(r"\p{L}")
            return F.coalesce((draw("typos", i) < TYPO_PERCENT) & (draw("typos", i, F.lit(1)) < 50) & letters, F.lit(False))

        def typed(ch: Column, i: Column) -> Column:
            swapped, taken = swaps(i) & ~swaps(i - 1), swaps(i - 1) & ~swaps(i - 2)
            gone = (draw("typos", i) < TYPO_PERCENT) & ch.rlike(r"\p{L}") & ~swaps(i)
            return F.when(taken, "").when(swapped, F.concat(F.get(chars, i + 1), ch)).when(gone, "").otherwise(ch)

        return F.array_join(F.transform(chars, typed), "")

    words = F.regexp_extract_all(t, F.lit(r"(?U)\w+|\W+"), F.lit(0))
    accented = f"[{_ACCENTED}]"
    how = {
        "no_diacritics": F.translate(t, _ACCENTED, _BARE),
        "no_spaces": F.array_join(F.transform(chars, lambda ch, i: F.when((ch == " ") & (draw("no_spaces", i) < SPACE_PERCENT), "").otherwise(ch)), ""),
        "typos": mistyped(),
        "abbreviations": abbreviated("abbreviations"),
        "telex": F.array_join(F.transform(words, lambda w, i: F.when(w.rlike(accented) & (draw("telex", i) < TELEX_PERCENT), telex_keys(w)).otherwise(w)), ""),
        "chat_mix": F.translate(abbreviated("chat_mix"), _ACCENTED, _BARE),
    }
    hashed = texts.withColumns({f"__{n}": F.xxhash64(F.lit(seed), F.lit(n), t) for n in names}).withColumn("__chars", F.split(t, ""))
    variants = F.array(*[F.struct(F.lit(n).alias("name"), how[n].alias("variant")) for n in names])
    return hashed.select("id", F.explode(variants).alias("v")).select("id", "v.name", "v.variant")


def stale_embeddings(chunks: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector, or with another model's."""
    return chunks.where(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model)))
