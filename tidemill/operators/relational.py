"""Selections, joins and windows over conversations, tickets, documents and audit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemill.operators.metrics import LOW_CONFIDENCE

#: Access levels in rising order; other names are out of reach.
LEVELS = {"anonymous": 0, "user": 1, "premium": 2}
UNREACHABLE = 32_000


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order; only limit + offset rows leave the executors' tops."""
    return df.orderBy(*order).offset(offset).limit(limit)


def contains_folded(c: Column, part: str) -> Column:
    """Whether the text contains part, without regard to case; part is plain text."""
    return F.contains(F.lower(c), F.lit(part.lower()))


def searchable_chunks(chunks: DataFrame, documents: DataFrame, sources: DataFrame, today: Column) -> DataFrame:
    """Chunks with a vector, of ready, approved, enabled documents that have not ended, of enabled sources."""
    live = documents.where(
        (F.col("status") == "ready") & (F.col("review") == "approved") & F.col("enabled")
        & (F.coalesce("effective_to", F.lit("9999-12-31").cast("date")) >= today)
    )
    on = sources.where("enabled").select(F.col("name").alias("source"), "priority")
    kept = live.join(on, "source").select("document_id", "title", "source", "priority", "tier", "effective_from", "effective_to")
    return chunks.where(F.col("embedding").isNotNull()).join(kept, "document_id")


def is_visible(level: str, today: Column) -> Column:
    """Whether the caller reaches a row's tier and its validity holds today; an unknown tier is out of reach."""
    tiers = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    needed = F.coalesce(F.try_element_at(tiers, F.col("tier")), F.lit(UNREACHABLE))
    from_ = F.coalesce("effective_from", F.lit("0001-01-01").cast("date"))
    to = F.coalesce("effective_to", F.lit("9999-12-31").cast("date"))
    return (needed <= LEVELS.get(level, -1)) & (from_ <= today) & (to >= today)


def visible(rows: DataFrame, level: str, today: Column) -> DataFrame:
    """Rows that the caller may see today."""
    return rows.where(is_visible(level, today))


def in_sources(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.where(F.col("source").isin(*names)) if names else rows


def overlay(*maps: Column) -> Column:
    """Maps over each other: the last one wins (spark.sql.mapKeyDedupPolicy=LAST_WIN)."""
    return F.map_concat(*[F.coalesce(m, F.create_map().cast("map<string,string>")) for m in maps])


def with_outcome(conversations: DataFrame, messages: DataFrame, outcome: str) -> DataFrame:
    return conversations.join(messages.where(F.col("outcome") == outcome), "conv_id", "left_semi")


def owned_by(conversations: DataFrame, user: str | None, visitor: str) -> DataFrame:
    """A claimed conversation belongs to its user alone, an unclaimed one to its visitor."""
    claimed = F.col("user_id").isNotNull()
    mine = F.when(claimed, F.col("user_id").eqNullSafe(F.lit(user))).otherwise(F.col("end_user_id") == visitor)
    return conversations.where(mine)


def question_before(messages: DataFrame) -> DataFrame:
    """Assistant rows with ``question``, the latest user text at or before them: an as-of join in one shuffle."""
    rank = F.when(F.col("role") == "user", 0).otherwise(1)
    order = W.partitionBy("conv_id").orderBy("created_at", rank, "turn").rowsBetween(W.unboundedPreceding, 0)
    asked = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(order)
    return messages.withColumn("question", asked).where(F.col("role") == "assistant")


def source_counts(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Every source with the number of its documents, 0 included."""
    counted = documents.groupBy("source").agg(F.count("*").alias("documents"))
    return sources.join(counted, F.col("name") == F.col("source"), "left").select("name", F.coalesce("documents", F.lit(0)).alias("documents"))


def neighbours(chunks: DataFrame, matches: DataFrame, radius: int) -> DataFrame:
    """(chunk_id, neighbour_id, distance) of chunks of the same document at most ``radius`` positions away.

    The position range becomes equal keys, so the join is an equi-join.
    """
    at = matches.select("document_id", F.col("chunk_id"), F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("distance"), "position")
    wanted = at.where("distance <> 0").select("document_id", "chunk_id", "distance", (F.col("position") + F.col("distance")).alias("position"))
    return wanted.join(chunks.select("document_id", "position", F.col("chunk_id").alias("neighbour_id")), ["document_id", "position"]).select(
        "chunk_id", "neighbour_id", F.col("distance").cast("long").alias("distance")
    )


def working_deadline(tickets: DataFrame, hours: int, opens: int, closes: int, holidays: Sequence[str]) -> DataFrame:
    """Tickets with ``due_s``, the UTC second after ``hours`` working hours.

    Open days of a bounded calendar are numbered; a ticket's due second follows from the open seconds before its
    start, so each ticket meets two calendar rows by equal keys.
    """
    spark = tickets.sparkSession
    span = closes - opens
    bounds = tickets.agg(F.min("created_at"), F.max("created_at")).first()
    if bounds[0] is None:
        return tickets.withColumn("due_s", F.lit(None).cast("long"))
    days = spark.sql(
        "SELECT explode(sequence(to_date(:a), date_add(to_date(:b), :n))) AS day", args={"a": str(bounds[0].date()), "b": str(bounds[1].date()), "n": 30 + 7 * hours}
    )
    working = days.where((F.weekday("day") < 5) & ~F.col("day").cast("string").isin(*holidays or [""]))
    numbered = working.withColumn("n", F.row_number().over(W.orderBy("day")) - 1)  # a row for each day
    calendar = days.join(numbered, "day", "left").withColumn(
        "next_n", F.first("n", ignorenulls=True).over(W.orderBy("day").rowsBetween(0, W.unboundedFollowing))
    )
    started = tickets.withColumn("day", F.to_date("created_at")).join(F.broadcast(calendar.select("day", "n", "next_n")), "day")
    second = F.unix_timestamp("created_at") - F.unix_timestamp(F.col("day").cast("timestamp"))
    into = F.when(F.col("n").isNull(), 0).otherwise(F.least(F.greatest(second - opens * 3600, F.lit(0)), F.lit(span * 3600)))
    total = F.col("next_n") * span * 3600 + into + hours * 3600
    due_n = F.floor((total - 1) / (span * 3600))
    placed = started.withColumns({"total": total, "due_n": due_n})
    ends = numbered.select(F.col("n").alias("due_n"), F.unix_timestamp(F.col("day").cast("timestamp")).alias("day_s"))
    due = F.col("day_s") + opens * 3600 + F.col("total") - F.col("due_n") * span * 3600
    return placed.join(F.broadcast(ends), "due_n").withColumn("due_s", due).select(*tickets.columns, "due_s")


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n user and assistant rows of each conversation, without failed ones."""
    usable = messages.where(F.col("role").isin("user", "assistant") & ~F.coalesce(F.col("outcome") == "error", F.lit(False)))
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("created_at"), F.desc("turn")))
    return usable.withColumn("rank", rank).where(F.col("rank") <= n)


def repeated_no_answer(messages: DataFrame) -> DataFrame:
    """Answers that were no help, right after one that was no help either."""
    answers = messages.where(F.col("role") == "assistant")
    unhelpful = (F.col("outcome") == "blocked") | ((F.col("outcome") == "answered") & (F.col("confidence") < LOW_CONFIDENCE))
    marked = answers.withColumn("unhelpful", F.coalesce(unhelpful, F.lit(False)))
    before = F.lag("unhelpful").over(W.partitionBy("conv_id").orderBy("created_at", "turn"))
    return marked.withColumn("before", before).where("unhelpful AND before").drop("before")


def negative_streak(feedback: DataFrame) -> DataFrame:
    """Conversations whose last two rated answers are both -1."""
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("created_at"), F.desc("turn")))
    last = feedback.withColumn("rank", rank).where(F.col("rank") <= 2)
    both = last.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("rating").alias("top"))
    return both.where("n = 2 AND top = -1").select("conv_id")


def top_per_key(df: DataFrame, key: str, order: Sequence[Column | str], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def repeated_answers(messages: DataFrame) -> DataFrame:
    """Assistant rows with the same text as the assistant row before."""
    before = F.lag("content").over(W.partitionBy("conv_id").orderBy("created_at", "turn"))
    return messages.where(F.col("role") == "assistant").withColumn("before", before).where(F.col("before") == F.col("content")).drop("before")


def open_ticket_once(tickets: DataFrame) -> DataFrame:
    """Tickets that open while no earlier one of the conversation is active.

    A ticket is active until it is closed or due; so one counts if every earlier ticket of its conversation had
    ended when it came.
    """
    ends = F.when(F.col("status") == "closed", F.col("created_at")).otherwise(F.col("due_at"))
    latest = F.max("ends").over(W.partitionBy("conv_id").orderBy("created_at", "ticket_id").rowsBetween(W.unboundedPreceding, -1))
    marked = tickets.withColumn("ends", ends).withColumn("latest", latest)
    return marked.where(F.col("latest").isNull() | (F.col("latest") <= F.col("created_at"))).drop("ends", "latest")


def token_replay(uses: DataFrame) -> DataFrame:
    """Uses of a token by another visitor than its first."""
    first = F.first("visitor").over(W.partitionBy("jti").orderBy("ts", "event_id"))
    return uses.withColumn("owner", first).where("visitor <> owner")


def supersede(documents: DataFrame) -> DataFrame:
    """(document_id, effective_to) of documents that an approved later version replaces: they end the day before."""
    later = documents.where((F.col("review") == "approved") & F.col("supersedes_id").isNotNull())
    start = F.coalesce("effective_from", F.to_date("created_at"))
    ends = later.groupBy(F.col("supersedes_id").alias("document_id")).agg(F.min(F.date_sub(start, 1)).alias("until"))
    open_end = F.coalesce("effective_to", F.lit("9999-12-31").cast("date"))
    return documents.join(ends, "document_id").select("document_id", F.least(open_end, F.col("until")).alias("effective_to"))
