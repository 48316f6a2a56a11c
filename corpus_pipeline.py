"""A training corpus from raw documents: five stages, each on all that the one before kept.

Toxic documents go; of each group of near duplicates one stays; passages that repeat an earlier document are cut out;
sources are mixed to target weights, documents repeating as often as the mix takes them; what is left is encoded.

Null and empty texts are not toxic, equal to nothing, have nothing to cut, are taken 0 times by the mix (they have no
words), and so end there. Rows with a null key are not compared with others. Rows that repeat a key and a text are one
document; a key with several texts keeps them. Texts are taken whole, whatever their length; ties go to the smallest key.
Columns beyond those of documents are left out, so their names don't matter. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, minhash, mixing, substrings, toxicity
from tidemill.llm.common import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, by a model of the labelled ones among them."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component, by shingles of five words and a likeness of 0.8."""
    found = minhash.near_components(docs, percent=80, size=5)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    often = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    left = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    once = left.join(often, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(often, "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those with nothing left go.

    Texts that lose nothing stay as they are.
    """
    cut = substrings.remove_repeats(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document of the mix."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Compression distance, the pivotal draws and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's result is a table in the shared folder, which the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/tidemill/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
