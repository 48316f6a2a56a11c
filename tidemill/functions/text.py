"""Text as column expressions; all but NFKC are built-in functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _latin() -> tuple[str, str]:
    """Accented Latin letters and their bases, from Unicode's decompositions."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _latin()


def fold(c: Column) -> Column:
    """Lower case without accents; đ becomes d."""
    plain = F.translate(F.lower(c), _FROM + "đĐ", _TO + "dd")
    return F.lower(F.regexp_replace(plain, r"\p{Mn}", ""))


def search_tokens(c: Column) -> Column:
    """Words of the folded text, punctuation apart; an empty array for null."""
    spaced = F.trim(F.regexp_replace(F.coalesce(fold(c), F.lit("")), r"(?U)[^\w]+", " "))
    return _words(spaced)


def _words(spaced: Column) -> Column:
    """Words between single spaces; the text is named once, so that it is worked out once."""
    return F.array_remove(F.split(spaced, " "), "")


def index_tokens(c: Column) -> Column:
    """What search_tokens gives, by a shorter way for ASCII texts, which have no accents to take off."""
    spaced = F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9_]+", " "))
    return F.when(F.octet_length(c) == F.char_length(c), _words(spaced)).otherwise(search_tokens(c))


def normalized_key(c: Column) -> Column:
    """What two texts have in common that differ in case, accents, punctuation and spacing only."""
    return F.array_join(search_tokens(c), " ")


def clean_lines(c: Column) -> Column:
    """Without blank lines and lines of table borders."""
    lines = F.split(c, r"\r?\n")
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^[\s|+:=_-]*$")), "\n")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_chat(c: Column) -> Column:
    """NFKC, without invisible characters, controls as spaces, runs of blanks and blank lines collapsed."""
    seen = F.regexp_replace(nfkc(c), r"\p{Cf}", "")
    plain = F.regexp_replace(seen, r"[\p{Cc}&&[^\n]]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, " +", " "), r" ?\n[ \n]*", "\n"))


#: Short forms of Vietnamese chat with one clear meaning, and those that mean a unit after a number.
SHORTHANDS = {
    "ko": "không", "k": "không", "hok": "không", "dc": "được", "đc": "được", "j": "gì", "v": "vậy", "z": "vậy",
    "r": "rồi", "rùi": "rồi", "vs": "với", "ntn": "như thế nào", "bnh": "bao nhiêu", "mn": "mọi người",
    "sđt": "số điện thoại", "sdt": "số điện thoại", "cty": "công ty", "vn": "Việt Nam", "bít": "biết", "bik": "biết",
    "ng": "người", "mk": "mình", "mik": "mình", "chx": "chưa", "trc": "trước", "nhìu": "nhiều", "cg": "cũng",
    "thui": "thôi", "lm": "làm", "wá": "quá", "qá": "quá",
}
AFTER_NUMBERS = ("k",)


def expand_shorthands(c: Column, words: dict[str, str] = SHORTHANDS, kept: Sequence[str] = AFTER_NUMBERS) -> Column:
    """Whole-word short forms written out, but not inside dotted or hyphenated tokens.

    Those of ``kept`` stay after a number. One search finds the texts that have any, and only they are rewritten.
    """
    flags, before, after = "(?iuU)", r"(?<!\w)(?<!\w[.\-])", r"(?!\w)(?![.\-]\w)"
    out = c
    for short, full in words.items():
        unless = r"(?<!\d\s)(?<!\d)" if short in kept else ""
        out = F.regexp_replace(out, f"{flags}{before}{unless}{short}{after}", full)
    return F.when(c.rlike(f"{flags}{before}(?:{'|'.join(words)}){after}"), out).otherwise(c)


def unaccented(c: Column, function_words: list[str], least: int = 3) -> Column:
    """Whether a text has no accents and at least so many known function words."""
    tokens = F.split(F.lower(c), r"[^a-z]+")
    known = F.size(F.filter(tokens, lambda w: w.isin(function_words)))
    return (~c.rlike(r"[^\x00-\x7F]")) & (known >= least)


def symbol_share(c: Column) -> Column:
    """Share of control and symbol characters among the visible ones; 1 for texts without any."""
    visible = F.regexp_count(c, F.lit(r"[^\s]"))
    odd = F.regexp_count(c, F.lit(r"[\p{C}\p{S}&&[^\s]]"))
    return F.when(visible > 0, odd / visible).otherwise(1.0)


def hash_embed(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, embedding): words counted into ``dim`` places by crc32, at length 1; all zero without words.

    One aggregation by key, with map-side sums of ``dim`` counters.
    """
    place = (F.crc32(F.col("w").cast("binary")) % dim).cast("int")
    words = df.select(F.col(key), F.explode_outer(search_tokens(F.col(text))).alias("w")).withColumn("p", place)
    counted = words.groupBy(key).agg(F.array(*[F.count(F.when(F.col("p") == i, 1)) for i in range(dim)]).alias("n"))
    return counted.select(key, unit(F.col("n")).alias("embedding"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; zero stays zero."""
    scaled = F.transform(  # an array of one, so that the norm is computed once
        F.array(F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("norm"))),
        lambda s: F.when(s["norm"] > 0, F.transform(s["v"], lambda x: x.cast("double") / s["norm"])).otherwise(s["v"].cast("array<double>")),
    )
    return scaled[0]
