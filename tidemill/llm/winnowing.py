"""Document fingerprints by winnowing, in DataFrame functions alone.

Every run of GRAM tokens of a text is hashed. Of every WINDOW consecutive hashes the smallest is kept, the rightmost
one where several are equal, with its position. Two texts that share GRAM + WINDOW - 1 consecutive tokens share a
kept hash, and its positions say where. A token is a word; longer runs without white space are cut into tokens of
TOKEN characters from their start, so that scripts without spaces have more than one token.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemill.llm.common import shuffles, table

GRAM = 3
#: A power of two.
WINDOW = 4
TOKEN = 16
#: Windows that are looked at together, so that what a long text needs beside its tokens stays small.
BLOCK = 4096
#: A hash and a position in its block share 64 bits: sign, 50 bits of hash, 13 bits of position from the right.
BITS = 13
LAST = (1 << BITS) - 1


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array<struct<pos, hash>> of a text, by position.

    A text with fewer tokens than a gram is one gram; with fewer grams than a window, all of them are one window.
    Null texts, empty ones and those of white space have an empty array.
    """
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % TOKEN), F.lit(0))

    def keep(hashed: Column) -> Column:
        grams = F.greatest(F.size(hashed) - (gram - 1), F.lit(1))
        blocks = F.sequence(F.lit(0), F.floor((F.greatest(grams - window, F.lit(0))) / BLOCK).cast("int"))

        def block(j: Column) -> Column:
            begin = j * BLOCK
            here = F.least(F.lit(BLOCK + window - 1), grams - begin)

            def packed(i: Column) -> Column:
                value = F.xxhash64(*[F.get(hashed, begin + i + k) for k in range(gram)])
                return F.shiftleft(value.bitwiseAND((1 << 50) - 1), BITS).bitwiseOR((F.lit(LAST) - i).cast("long"))

            least = F.transform(F.sequence(F.lit(0), here - 1), packed)
            step = 1
            while step < window:  # least[i] becomes the smallest of twice as many
                least = _halve(least, step)
                step *= 2
            kept = F.array_distinct(F.slice(least, F.lit(1), F.greatest(here - (window - 1), F.lit(1))))
            return F.transform(
                kept,
                lambda v: F.struct(
                    (begin + LAST - v.bitwiseAND(LAST).cast("int")).alias("pos"), F.shiftright(v, BITS).alias("hash")
                ),
            )

        found = bind(F.flatten(F.transform(blocks, block)), _once)
        return F.when(F.size(hashed) > 0, found).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>"))

    return bind(F.transform(tokens, lambda t: F.xxhash64(t)), keep)


def _once(found: Column) -> Column:
    """Without the positions that end one block and begin the next."""
    return F.filter(found, lambda x, i: (i == 0) | (F.get(found, i - 1)["pos"] != x["pos"]))


def _halve(least: Column, step: int) -> Column:
    """The smaller of each element and the one step further; beyond the end, the element itself."""
    return bind(
        least,
        lambda a: F.zip_with(a, F.slice(a, F.lit(step + 1), F.greatest(F.size(a), F.lit(1))), lambda x, y: F.least(x, y)),
    )


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(fingerprint["hash"])


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two sets of hashes, 0 to 1; two empty sets are alike."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, 1.0).otherwise(shared / every)


def digest(fingerprint: Column) -> Column:
    """A short name of a whole fingerprint: its size and 128 bits over its hashes and positions."""
    halves = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(s), fingerprint))), 16, "0") for s in (1, 2)]
    return F.concat(F.size(fingerprint).cast("string"), F.lit(":"), *halves)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(key, fingerprint) of every whole text. One pass, no shuffle; repeated rows repeat, other columns go.

    Null and empty texts have an empty fingerprint; very long ones are taken whole, in blocks of an array; keys are of any
    type and may be null or equal; an empty table gives an empty one.
    """
    return docs.select(F.col(key), winnow(F.col(text), gram, window).alias("fingerprint"))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below the key, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(b) for b in bounds])
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def narrow(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        below = F.get(array, middle) < key
        return F.when(below, F.struct((middle + 1).alias("lo"), at["hi"].alias("hi"))).otherwise(
            F.struct(at["lo"].alias("lo"), middle.alias("hi"))
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.when(key.isNull(), 0).otherwise(F.aggregate(steps, start, narrow)["lo"])


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, W]:
    """Rows (bucket, guest, key, text) and a window in which the next document of each is the row after it.

    Order is by descending key, nulls last, equal keys by text; after the last comes the first. Keys are numbers (others
    fail); an empty table has no rows; rows of one key, or without any, are sorted in one task. Keys are dealt
    into ranges of about equal size, eight for each shuffle partition, by approximate quantiles. The first document
    of a range also visits the range before, as a guest at its end, so that one shuffle of the texts is enough. The
    visits are a row for each range, which bounds what is broadcast and what the driver sees.
    """
    spark = docs.sparkSession
    count = max(256, 8 * shuffles(spark))
    quantiles = F.percentile_approx(F.col(key), [i / count for i in range(1, count)], 20 * count)
    bounds = sorted(set(docs.select(key).agg(quantiles.alias("q")).first()["q"] or []))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.withColumn("bucket", _bucket(F.col("key"), bounds))
    heads = rows.groupBy("bucket").agg(F.max("key").alias("head"))
    around = W.partitionBy(F.lit(0))
    above = F.lead("bucket").over(W.orderBy("bucket"))
    visits = heads.select(
        F.col("bucket").alias("home"), "head", F.coalesce(above, F.min("bucket").over(around)).alias("visits")
    )
    there = F.broadcast(visits)
    met = rows.join(there, (F.col("bucket") == F.col("home")) & F.col("key").eqNullSafe(F.col("head")), "left")
    stays = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest")))
    goes = F.array(F.struct(F.col("visits").alias("bucket"), F.lit(1).alias("guest")))
    placed = met.select(
        F.explode(F.when(F.col("visits").isNull(), stays).otherwise(F.concat(stays, goes))).alias("at"), "key", "text"
    ).select("at.bucket", "at.guest", "key", "text")
    return placed, W.partitionBy("bucket").orderBy("guest", F.col("key").desc_nulls_last(), "text")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    placed, order = beside_next(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(text, F.lit(1), n - half), F.substr(F.col("next"), F.lit(1), half))
    printed = (
        placed.withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
        .select("bucket", "guest", "key", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), winnow(F.col("text")).alias("own"))
        .select("bucket", "guest", "key", "text", "n_chars", "own", F.sha2("edited", 256).alias("edited_sha256"), winnow(F.col("edited")).alias("changed"))
        .withColumn("next", F.lead(hashes(F.col("own"))).over(order))
    )
    return printed.where("guest = 0").select(
        F.col("key").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        digest(F.col("own")).alias("fingerprint"),
        digest(F.col("changed")).alias("edited_fingerprint"),
        likeness(hashes(F.col("own")), hashes(F.col("changed"))).alias("near_edited"),
        likeness(hashes(F.col("own")), F.col("next")).alias("near_next"),
        F.size("own").alias("n_kept"),
    )
