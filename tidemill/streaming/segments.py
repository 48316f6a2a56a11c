"""A search index that grows by segments: what a batch of changes adds is written once and never rewritten.

A batch of changes, of which the last one of each key counts, becomes one version of four tables:

    rows     index rows of the new texts (operators.search)
    changed  the keys that came, also the deleted ones: a row of an earlier version with such a key is dead
    terms    how many chunks more or fewer have each term
    sums     how many chunks and tokens more or fewer there are

Statistics of the whole are sums over versions, so that no text is read again. ``compact`` writes the rows that live as
the first version of a new generation; readers go by the newest generation that is complete.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import search
from tidemill.operators.retrieval import EPSILON
from tidemill.streaming.live import work_dir

_TABLES = ("rows", "changed", "terms", "sums")


@dataclass
class Segments:
    """The index in a folder, for keys of a Spark type."""

    spark: SparkSession
    where: str
    key_type: str = "long"

    def generation(self) -> int:
        found = self.spark.read.schema("generation long").parquet(f"{self.where}/complete") if self._begun() else None
        return found.agg(F.max("generation")).first()[0] if found is not None else 0

    def _begun(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/complete")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _schema(self, table: str) -> str:
        key = f"key {self.key_type}"
        return {
            "rows": f"{key}, length long, terms array<string>, counts array<int>, vector array<double>",
            "changed": key, "terms": "term string, df long", "sums": "n long, tokens long",
        }[table] + ", version long"

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """A table of the newest generation, of versions under ``before``."""
        path = f"{self.where}/generation={self.generation()}/{table}"
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        schema = self._schema(table)
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(path)
        return df if before is None else df.where(F.col("version") < before)

    def live(self, before: int | None = None) -> DataFrame:
        """The rows that no later version has changed."""
        later = self.read("changed", before).select(F.col("key").alias("k"), F.col("version").alias("v"))
        rows = self.read("rows", before)
        return rows.join(later, (F.col("key") == F.col("k")) & (F.col("v") > F.col("version")), "left_anti")

    def _write(self, generation: int, version: int, rows: DataFrame, changed: DataFrame, gone: DataFrame | None) -> None:
        at = {t: f"{self.where}/generation={generation}/{t}/version={version}" for t in _TABLES}
        rows.write.mode("overwrite").parquet(at["rows"])
        changed.write.mode("overwrite").parquet(at["changed"])
        new = self.spark.read.schema(rows.schema).parquet(at["rows"])
        signed = new.select("terms", "length", F.lit(1).alias("sign"))
        if gone is not None:
            signed = signed.unionByName(gone.select("terms", "length", F.lit(-1).alias("sign")))
        terms = signed.select(F.explode("terms").alias("term"), "sign").groupBy("term").agg(F.sum("sign").alias("df"))
        terms.where("df <> 0").write.mode("overwrite").parquet(at["terms"])
        sums = signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("length")), F.lit(0)).alias("tokens"))
        sums.select(F.col("n").cast("long"), F.col("tokens").cast("long")).write.mode("overwrite").parquet(at["sums"])

    def apply(self, changes: DataFrame, version: int) -> None:
        """Changes (key, text, deleted, at): the last of each key by ``at`` counts; a version that is tried again replaces itself."""
        last = changes.groupBy("key").agg(F.max_by(F.struct("text", "deleted"), F.struct("at", "text")).alias("c"))
        last = search.stored(last.select("key", "c.text", F.coalesce("c.deleted", F.lit(False)).alias("deleted")))
        keys = last.select("key")
        gone = self.live(before=version).join(keys, "key", "left_semi")
        self._write(self.generation(), version, search.index_rows(last.where("NOT deleted"), "key", "text"), keys, gone)

    def compact(self, version: int) -> None:
        """The rows that live at a version as one segment of a new generation; later versions go on in it."""
        new, alive = self.generation() + 1, self.live(before=version + 1).drop("version")
        self._write(new, version, alive, alive.select("key"), None)
        self.spark.range(new, new + 1).select(F.col("id").alias("generation")).write.mode("append").parquet(f"{self.where}/complete")

    def terms(self) -> DataFrame:
        """(term, df) of the rows that live."""
        return self.read("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def index(self) -> search.Index:
        """The index as it is now, for ``search``."""
        n, tokens = self.read("sums").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        terms = self.terms()
        raw = terms.agg(F.avg(search._raw_idf(n))).first()[0]
        return search.Index(self.live().drop("version"), terms, n, tokens / max(1, n), EPSILON * (raw or 0.0))


def keep_index(changes: DataFrame, where: str | None = None, every: int = 20) -> Segments:
    """Runs a stream of changes over the files there are. A burst of files is one version; after ``every``, a compaction."""
    spark = changes.sparkSession
    segments = Segments(spark, where or work_dir(spark), changes.schema["key"].dataType.simpleString())

    def each(df: DataFrame, batch: int) -> None:
        segments.apply(df, batch)
        if batch % every == every - 1:
            segments.compact(batch)

    query = changes.writeStream.option("checkpointLocation", f"{segments.where}/state").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return segments
