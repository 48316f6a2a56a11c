"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, everywhere in this subpackage: a run without space, tab, LF, VT, FF or CR.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def lower_words(text: str | bytes | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, in UTF-8; null has none."""
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace")
    return data.lower().split()  # of bytes: A-Z alone, and words between space, tab, LF, VT, FF and CR


def n_words(c: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session without executors of their own may go without it; it gets a temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back.

    Lost executors can't take it with them, and what is built on it is not computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffles(spark: SparkSession) -> int:
    """How many partitions the session deals a shuffle to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Numbering(dict):
    """Gives each new key the next whole number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n
