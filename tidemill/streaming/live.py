"""Structured Streaming jobs over event files, and sinks that can be run again.

Each job is a function of a streaming DataFrame; ``finish`` runs one over all files there are and returns its
table. A batch of a sink has its own folder, so that a batch that is tried again replaces itself.
"""

from __future__ import annotations

import datetime
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late an event may be.
LATE = "1 day"


def work_dir(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share, spark.checkpoint.dir.

    Only a session without executors of its own may name none; it gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/tidemill-stream/{uuid.uuid4().hex}"


def finish(stream: DataFrame, mode: str, each: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Runs a stream over the files there are and returns what it wrote, with the batch that wrote it."""
    spark = stream.sparkSession
    where = work_dir(spark)

    def write(df: DataFrame, batch: int) -> None:
        each(df).write.mode("overwrite").parquet(f"{where}/out/batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{where}/out")


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last update of each key."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


def live_turns(events: DataFrame, most: int = 8_000) -> DataFrame:
    """Turns and handoffs for dashboards; oversize payloads are left out."""
    return events.where((F.length("props") <= most) & F.col("event_type").isin("view", "click")).select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


def usage_counters(events: DataFrame) -> DataFrame:
    """Requests and value by user and hour, updated as events come."""
    by = F.window("ts", "1 hour")
    counted = events.withWatermark("ts", LATE).groupBy(by.alias("w"), "user_id").agg(F.count("*").alias("requests"), F.sum(F.floor("value").cast("long")).alias("value"))
    return counted.select(F.unix_timestamp("w.start").alias("hour_s"), "user_id", "requests", "value")


def error_spikes(events: DataFrame, least: int = 5, share: float = 0.2) -> DataFrame:
    """(end_s, turns, errors, spike) of the last 15 minutes, every 5 minutes."""
    seen = events.withWatermark("ts", LATE).groupBy(F.window("ts", "15 minutes", "5 minutes").alias("w")).agg(F.count("*").alias("turns"), F.count_if(F.col("event_type") == "error").alias("errors"))
    spike = (F.col("errors") >= least) & (F.col("errors") >= share * F.col("turns"))
    return seen.select(F.unix_timestamp("w.end").alias("end_s"), "turns", "errors", spike.alias("spike"))


def first_binding(uses: DataFrame, key: str = "jti") -> DataFrame:
    """The first use of each key until the watermark passes it."""
    return uses.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key])


#: Seconds after which an alert that goes on is sent again.
COOL_DOWN = 6 * 3600
ALERTS = "rule string, at_s long, kind string, amount long"
CHECKS = "rule string, kind string, at_s long, firing boolean, level int, seen long, delivered boolean"


@dataclass
class AlertState:
    """What is known of a rule between checks; -1: nothing yet."""

    active: bool = False
    sent: int = -1
    month: int = -1
    level: int = 0
    seen: int = -1

    def check(self, kind: str, at: int, firing: bool, level: int, seen: int, delivered: bool) -> tuple[str, int] | None:
        """The alert that a check sends, with its level or number. One that is not delivered is due again next time."""
        if kind == "condition":
            return self._condition(at, firing, delivered)
        sent = self._level(at, level) if kind == "level" else self._count(seen)
        if sent and delivered:
            self._note(kind, at, level, seen)
            return sent
        return None

    def _condition(self, at: int, firing: bool, delivered: bool) -> tuple[str, int] | None:
        if not firing:
            was, self.active = self.active, False
            return ("resolved", 0) if was and delivered else None
        due = not self.active or self.sent < 0 or at - self.sent >= COOL_DOWN
        if not due or not delivered:
            return None
        sent = ("repeated" if self.active else "fired", 0)
        self.active, self.sent = True, at
        return sent

    def _level(self, at: int, level: int) -> tuple[str, int] | None:
        """Each level once a month; a lower one says nothing after a higher one."""
        reached = self.level if self.month == month_of(at) else 0
        return ("reached", level) if level > reached else None

    def _count(self, seen: int) -> tuple[str, int] | None:
        """What came since the last alert; the first check only remembers where it is."""
        if self.seen < 0:
            self.seen = seen
            return None
        return ("failed", seen - self.seen) if seen > self.seen else None

    def _note(self, kind: str, at: int, level: int, seen: int) -> None:
        self.sent = at
        if kind == "level":
            self.month, self.level = month_of(at), level
        else:
            self.seen = seen


def month_of(at_s: int) -> int:
    moment = datetime.datetime.fromtimestamp(at_s, datetime.timezone.utc)
    return 12 * moment.year + moment.month


def _alerts(rule: str, checks: pd.DataFrame, state: AlertState) -> pd.DataFrame:
    out = []
    for c in checks.sort_values(["at_s", "firing", "level", "seen"], na_position="first").itertuples():
        level, seen = (0 if pd.isna(x) else int(x) for x in (c.level, c.seen))
        if sent := state.check(c.kind, int(c.at_s), bool(c.firing), level, seen, bool(c.delivered)):
            out.append((rule, int(c.at_s), *sent))
    return pd.DataFrame(out, columns=["rule", "at_s", "kind", "amount"])


def alert_state(checks: DataFrame) -> DataFrame:
    """Alerts out of checks, of three kinds of rules; CHECKS has the columns.

    condition: sent when ``firing`` begins, again after the cool-down, and once when it is over.
    level:     each ``level`` (1, 2, ...) once a calendar month, UTC.
    count:     how far ``seen``, a running number of failures, went since the last alert.

    An alert that was not ``delivered`` changes nothing, so that it is tried again.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = AlertState(*state.get) if state.exists else AlertState()
        out = _alerts(key[0], pd.concat(list(batches)), own)
        state.update(astuple(own))
        yield out

    kept = "active boolean, sent long, month long, level long, seen long"
    return checks.groupBy("rule").applyInPandasWithState(run, ALERTS, kept, "append", GroupStateTimeout.NoTimeout)


def alert_state_batch(checks: DataFrame) -> DataFrame:
    """What alert_state gives for all checks at once."""
    return checks.groupBy("rule").applyInPandas(lambda pdf: _alerts(pdf.rule.iloc[0], pdf, AlertState()), ALERTS)


def overdue(tickets: DataFrame, now, cursor) -> DataFrame:
    """Open tickets that came due since the cursor."""
    return tickets.where(F.col("status").isin("open", "assigned") & (F.col("due_at") > cursor) & (F.col("due_at") <= now))
