"""The daily rollup kept up to date by a stream of messages.

A batch of new messages touches some local days, however late they are; these days are computed again as a whole, from the
messages stored so far and the other facts of those days, and replace their partitions of the rollup. So a batch
that is tried again, files in any order and late messages all end in what one pass over everything gives.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import interchange, metrics
from tidemill.streaming.live import work_dir

@dataclass
class Facts:
    """What the rollup joins with messages: tables with ``created_at``, as of now."""

    handoffs: DataFrame
    steps: DataFrame
    usage: DataFrame
    prices: DataFrame


def recompute(messages: DataFrame, facts: Facts, days: list[datetime.date], path: str, zone: str = metrics.ZONE) -> None:
    """Replaces these days of the rollup at ``path``, all in one job; days without messages have no row.

    The days are a calendar's, so they are broadcast.
    """
    wanted = F.broadcast(messages.sparkSession.createDataFrame([(d,) for d in days], "__day date"))
    day = metrics.local_day(F.col("created_at"), zone)
    parts = [df.join(wanted, day == F.col("__day"), "left_semi") for df in (messages, facts.handoffs, facts.steps, facts.usage)]
    rolled = metrics.daily_rollup(*parts, facts.prices, zone)
    interchange.upsert_daily(rolled.withColumn("day", F.col("day").cast("string")), path)


def keep_rollup(messages: DataFrame, facts: Facts, zone: str = metrics.ZONE, recent: int = 2, where: str | None = None) -> DataFrame:
    """Runs a stream of messages over the files there are; the rollup with one row a local day, ``day`` as text.

    Messages are stored by day, in a folder for each batch, so that a batch reads only the days it touches. The ``recent``
    newest days are computed again with every batch, as other facts than messages may have come for them. With
    ``where``, a folder of an earlier run, the stream goes on from there.
    """
    spark = messages.sparkSession
    where = where or work_dir(spark)
    day = metrics.local_day(F.col("created_at"), zone)
    schema = messages.schema.add("day", "date").add("batch", "long")

    def stored() -> DataFrame:
        return spark.read.schema(schema).parquet(f"{where}/messages")

    def each(df: DataFrame, batch: int) -> None:
        df.withColumn("day", day).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{where}/messages/batch={batch}")
        new = stored().where(F.col("batch") == batch).select("day").distinct()
        touched = {r["day"] for r in new.toLocalIterator()}  # days, so few
        if not touched:
            return
        newest = stored().where(F.col("day").isNotNull()).agg(F.max("day")).first()[0]
        touched |= {newest - datetime.timedelta(days=i) for i in range(recent)}
        days = sorted(d for d in touched if d is not None)
        known = F.broadcast(spark.createDataFrame([(d,) for d in days], "day date"))
        recompute(stored().join(known, "day", "left_semi").drop("day", "batch"), facts, days, f"{where}/rollup", zone)

    query = messages.writeStream.option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return spark.read.option("partitionOverwriteMode", "dynamic").parquet(f"{where}/rollup").withColumn("day", F.col("day").cast("string"))
