"""Rollups, usage, cost, traffic, knowledge health and audit figures.

All take DataFrames and return DataFrames; each is one aggregation, or a few joined on small keys. Local days and hours
come from UTC instants and a zone. Percentiles interpolate and skip nulls.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Answers under this confidence count as unsure.
LOW_CONFIDENCE = 0.35
ZONE = "Asia/Ho_Chi_Minh"


def local(ts: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(ts, zone))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def percentile(c: Column | str, p: float) -> Column:
    return F.percentile(c, p)


def micro_usd(prompt: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    """Cost in millionths of a dollar from prices per million tokens, half to even; 0 without a price."""
    exact = prompt.cast("decimal(20,0)") * price_in + completion.cast("decimal(20,0)") * price_out
    return F.coalesce(F.bround(exact, 0).cast("long"), F.lit(0))


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows with ``cost``. Prices are a row for each model, a list that people keep, so they are broadcast."""
    priced = usage.join(F.broadcast(prices), "model", "left")
    cost = micro_usd(F.col("prompt"), F.col("completion"), F.col("price_in"), F.col("price_out"))
    return priced.withColumn("cost", cost).drop("price_in", "price_out")


def daily_rollup(messages: DataFrame, handoffs: DataFrame, steps: DataFrame, usage: DataFrame, prices: DataFrame, zone: str = ZONE) -> DataFrame:
    """One row for each local day with messages: all days in one job, one aggregation for each kind of fact."""
    answers = F.col("role") == "assistant"
    day = local_day(F.col("created_at"), zone).alias("day")
    turns = messages.groupBy(day).agg(
        count_if(answers).alias("turns"),
        count_if(answers & (F.col("outcome") == "error")).alias("errors"),
        F.countDistinct("conv_id").alias("conversations"),
        percentile("latency_ms", 0.5).alias("p50_ms"),
        percentile("latency_ms", 0.95).alias("p95_ms"),
        count_if(answers & F.col("cached")).alias("cached"),
        count_if(answers & (F.col("confidence") < LOW_CONFIDENCE)).alias("low_confidence"),
    )
    tickets = handoffs.groupBy(day).agg(F.count("*").alias("handoffs"))
    first = steps.where(F.col("step") == "first_token").groupBy(day).agg(
        percentile(F.col("value").try_cast("double"), 0.95).alias("p95_first_token")
    )
    spent = with_cost(usage, prices).groupBy(day).agg(
        F.sum(F.col("prompt") + F.col("completion")).alias("tokens"), F.sum("cost").alias("cost")
    )
    joined = reduce(lambda a, b: a.join(b, "day", "left"), [tickets, first, spent], turns)
    return joined.fillna(0, ["handoffs", "tokens", "cost"])


def breakdowns(messages: DataFrame, columns: Sequence[str], zone: str = ZONE, unknown: str = "unknown") -> DataFrame:
    """(day, kind, label, n): a count for each value of each column and day, in one pass over grouping sets."""
    labelled = messages.where(F.col("role") == "assistant").select(
        local_day(F.col("created_at"), zone).alias("day"), *[F.coalesce(F.col(c), F.lit(unknown)).alias(c) for c in columns]
    )
    sets = [[F.col("day"), F.col(c)] for c in columns]
    counted = labelled.groupingSets(sets, F.col("day"), *[F.col(c) for c in columns]).agg(F.count("*").alias("n"))
    kind = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])
    return counted.select("day", kind.alias("kind"), F.coalesce(*columns).alias("label"), "n")


def step_latency(steps: DataFrame) -> DataFrame:
    """(step, p50, p95) of the steps whose text is a whole number of at most nine digits."""
    timed = steps.where(F.col("value").rlike("^[0-9]{1,9}$")).withColumn("ms", F.col("value").cast("long"))
    return timed.groupBy("step").agg(F.round(percentile("ms", 0.5), 1).alias("p50"), F.round(percentile("ms", 0.95), 1).alias("p95"))


def visitor_stats(conversations: DataFrame, messages: DataFrame, since: Column, until: Column) -> DataFrame:
    """Visitors of a period, those seen before it, signed-in ones, and conversations with one answer ever."""
    inside = conversations.where((F.col("created_at") >= since) & (F.col("created_at") < until))
    earlier = conversations.where(F.col("created_at") < since).select("end_user_id").distinct()
    answers = messages.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.count("*").alias("answers"))
    single = inside.join(answers, "conv_id").agg(count_if(F.col("answers") == 1).alias("single_turn"))
    back = inside.join(earlier, "end_user_id", "left_semi").agg(F.countDistinct("end_user_id").alias("returning"))
    every = inside.agg(
        F.countDistinct("end_user_id").alias("visitors"),
        F.countDistinct(F.when(F.col("user_id").isNotNull(), F.col("end_user_id"))).alias("signed_in"),
    )
    return every.crossJoin(back).crossJoin(single)  # one row each


def traffic(events: DataFrame, ts: Column, zone: str = ZONE) -> DataFrame:
    """(weekday 0-6 from Monday, hour, n) with every cell of the week."""
    spark = events.sparkSession
    at = local(ts, zone)
    seen = events.groupBy(F.weekday(at).cast("long").alias("weekday"), F.hour(at).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    grid = spark.range(168).select(F.floor(F.col("id") / 24).alias("weekday"), (F.col("id") % 24).alias("hour"))
    return grid.join(seen, ["weekday", "hour"], "left").fillna(0, ["n"])


def usage_by_day(costed: DataFrame) -> DataFrame:
    return costed.groupBy(F.to_date("created_at").alias("day"), "model").agg(
        F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("cost").alias("cost"), F.count("*").alias("calls")
    )


def usage_by_purpose(costed: DataFrame) -> DataFrame:
    return costed.groupBy("purpose").agg(F.sum(F.col("prompt") + F.col("completion")).alias("tokens"), F.sum("cost").alias("cost"))


def cost_by_tier(costed: DataFrame) -> DataFrame:
    return costed.groupBy(F.coalesce("tier", F.lit("anonymous")).alias("tier")).agg(F.sum("cost").alias("cost"))


def outcome_counts(messages: DataFrame, since: Column) -> DataFrame:
    kept = messages.where((F.col("role") == "assistant") & (F.col("created_at") >= since))
    return kept.groupBy(F.coalesce("outcome", F.lit("unknown")).alias("outcome")).agg(F.count("*").alias("n"))


def latency_percentiles(messages: DataFrame, since: Column) -> DataFrame:
    kept = messages.where((F.col("role") == "assistant") & (F.col("created_at") >= since))
    return kept.agg(percentile("latency_ms", 0.5).alias("p50"), percentile("latency_ms", 0.95).alias("p95"))


def usage_summary(costed: DataFrame, days: int, today: Column) -> DataFrame:
    """Totals of the last days, and of the month so far, in one pass."""
    day = F.to_date("created_at")
    recent = (day > F.date_sub(today, days)) & (day <= today)
    month = (F.trunc(day, "month") == F.trunc(today, "month")) & (day <= today)
    tokens = F.col("prompt") + F.col("completion")
    zero = F.lit(0).cast("long")
    return costed.agg(
        F.sum(F.when(recent, tokens).otherwise(zero)).alias("tokens"),
        F.sum(F.when(recent, F.col("cost")).otherwise(zero)).alias("cost"),
        count_if(recent).alias("calls"),
        F.countDistinct(F.when(recent, F.col("end_user_id"))).alias("visitors"),
        F.sum(F.when(month, F.col("cost")).otherwise(zero)).alias("month_cost"),
    )


def month_projection(costed: DataFrame, now: Column) -> DataFrame:
    """Spend so far times the month's length over what has passed, half to even; null in the month's first day."""
    start, end = F.date_trunc("month", now), F.add_months(F.trunc(F.to_date(now), "month"), 1).cast("timestamp")
    passed = F.unix_timestamp(now) - F.unix_timestamp(start)
    whole = F.unix_timestamp(end) - F.unix_timestamp(start)
    spent = costed.where((F.col("created_at") >= start) & (F.col("created_at") < now)).agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("spent"))
    exact = F.col("spent").cast("decimal(24,0)") * whole.cast("decimal(12,0)") / passed.cast("decimal(12,0)")
    return spent.select("spent", F.when(passed >= 86400, F.bround(exact, 0).cast("long")).alias("projected"))


def budget_verdicts(costed: DataFrame, day_tokens: int, month_cost: int) -> DataFrame:
    """(day, end_user_id, tokens, month_spent, verdict); anonymous use pauses at half the month's budget."""
    day = F.to_date("created_at")
    daily = costed.groupBy(day.alias("day"), "end_user_id").agg(F.sum(F.col("prompt") + F.col("completion")).alias("tokens"), F.sum("cost").alias("cost"))
    totals = daily.groupBy("day").agg(F.sum("cost").alias("day_cost"))
    running = totals.withColumn(  # a row for each day
        "month_spent", F.sum("day_cost").over(W.partitionBy(F.trunc("day", "month")).orderBy("day"))
    )
    verdict = (
        F.when(F.col("month_spent") >= month_cost, "paused")
        .when(F.col("end_user_id").isNull() & (F.col("month_spent") * 2 >= month_cost), "anonymous_paused")
        .when(F.col("tokens") >= day_tokens, "over_day")
        .otherwise("ok")
    )
    return daily.join(running, "day").select("day", "end_user_id", "tokens", "month_spent", verdict.alias("verdict"))


def limit_breaches(requests: DataFrame, scope: str, per_minute: int, per_hour: int, zone: str = ZONE) -> DataFrame:
    """Requests beyond a limit of their minute or hour, and the seconds until the last exceeded bucket ends."""
    at = local(F.col("ts"), zone)
    out = requests
    for name in ("minute", "hour"):
        out = out.withColumn(f"{name}_start", F.date_trunc(name, at))
        out = out.withColumn(f"{name}_n", F.count("*").over(W.partitionBy(scope, f"{name}_start").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)))
    ends = [
        F.when(F.col(f"{name}_n") > limit, F.unix_timestamp(f"{name}_start") + size - F.unix_timestamp(at))
        for name, limit, size in (("minute", per_minute, 60), ("hour", per_hour, 3600))
    ]
    wait = F.greatest(*ends)
    return out.where(wait.isNotNull()).select("event_id", scope, "minute_n", "hour_n", F.greatest(wait, F.lit(1)).cast("long").alias("wait_s"))


def dense_counts(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """(label, n) with a row for every label."""
    spark = df.sparkSession
    every = spark.createDataFrame([(x,) for x in labels], f"{column} string")
    return every.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])


def cited_documents(citations: DataFrame, since: Column, limit: int) -> DataFrame:
    """The documents that most answers cite; an answer counts once for a document."""
    counted = citations.where(F.col("created_at") >= since).groupBy("document_id").agg(F.countDistinct("message_id").alias("answers"))
    return counted.orderBy(F.desc("answers"), "document_id").limit(limit)


def never_cited(documents: DataFrame, citations: DataFrame, since: Column) -> DataFrame:
    live = documents.where((F.col("status") == "ready") & (F.col("review") == "approved"))
    return live.join(citations.where(F.col("created_at") >= since), "document_id", "left_anti")


def expiring(documents: DataFrame, today: Column, days: int = 30) -> DataFrame:
    return documents.where(F.col("effective_to").between(today, F.date_add(today, days)))


def scheduled(documents: DataFrame, today: Column) -> DataFrame:
    return documents.where(F.col("effective_from") > today)


AUDIT = {
    "logins": "path = '/auth/login' AND status_code < 400",
    "failed_logins": "path = '/auth/login' AND status_code IN (401, 403)",
    "logouts": "path = '/auth/logout'",
    "user_changes": "path LIKE '/users/%' AND method <> 'GET'",
    "document_changes": "path LIKE '/documents/%' AND path NOT LIKE '%/review' AND method <> 'GET'",
    "reviews": "path LIKE '%/review'",
    "setting_changes": "path LIKE '/settings%' AND method <> 'GET'",
    "key_changes": "path LIKE '/keys/%' AND method <> 'GET'",
    "server_errors": "status_code >= 500",
}


def audit_summary(audit: DataFrame) -> DataFrame:
    """Nine counts in one pass."""
    return audit.agg(*[count_if(F.expr(cond)).alias(name) for name, cond in AUDIT.items()])


def failed_login_ips(audit: DataFrame, limit: int) -> DataFrame:
    failed = audit.where(F.expr(AUDIT["failed_logins"]) & F.col("client_ip").isNotNull())
    return failed.groupBy("client_ip").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "client_ip").limit(limit)


def ingestion_stats(documents: DataFrame, now: Column) -> DataFrame:
    pending = F.col("status") == "processing"
    return documents.agg(
        count_if(pending).alias("pending"),
        count_if(pending & F.col("enabled")).alias("claimed"),
        F.max(F.when(pending, F.unix_timestamp(now) - F.unix_timestamp("created_at"))).alias("oldest_age_s"),
        F.max(F.when(F.col("status") == "ready", F.unix_timestamp("created_at"))).alias("newest_ready_s"),
    )


def history_kpis(rollup: DataFrame) -> DataFrame:
    """Figures over a rollup: sums, worst day, rates that skip days without turns."""
    by = F.struct(F.col("p95_ms"), F.col("day"))
    return rollup.agg(
        F.sum("turns").alias("turns"),
        F.sum("errors").alias("errors"),
        F.sum("cost").alias("cost"),
        F.max(by)["day"].alias("slowest_day"),
        (F.sum("errors") / F.nullif(F.sum("turns"), F.lit(0))).alias("error_rate"),
        F.avg("turns").alias("turns_per_day"),
        (1 - F.sum("handoffs") / F.nullif(F.sum("conversations"), F.lit(0))).alias("containment"),
        (F.sum("cost") / F.nullif(F.sum("conversations"), F.lit(0))).alias("cost_per_conversation"),
    )


def monthly_history(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.sum("turns").alias("turns"), F.sum("cost").alias("cost"), F.max("p95_ms").alias("worst_p95_ms"), F.avg("conversations").alias("conversations_per_day")
    )


def breakdown_share(labels: DataFrame) -> DataFrame:
    """(kind, label, n, percent) of positive entries; the total is of the kind."""
    totals = labels.where(F.col("n") > 0).groupBy("kind", "label").agg(F.sum("n").alias("n"))
    return totals.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("kind")))


def load_report(turns: DataFrame) -> DataFrame:
    ok = F.col("result") == "ok"
    return turns.groupBy("level").agg(
        count_if(ok).alias("completed"),
        (count_if(~ok) / F.count("*")).alias("refused_share"),
        percentile(F.when(ok, F.col("ttft")), 0.5).alias("ttft_p50"),
        percentile(F.when(ok, F.col("ttft")), 0.95).alias("ttft_p95"),
        percentile(F.when(ok, F.col("e2e")), 0.5).alias("e2e_p50"),
        percentile(F.when(ok, F.col("e2e")), 0.95).alias("e2e_p95"),
    )
