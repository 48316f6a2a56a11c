"""Exports, imports, counters, logs and query templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemill.functions import text as tx

BUNDLE_VERSION = 1
TIERS = ("anonymous", "user", "premium")


def chat_to_pairs(messages: DataFrame) -> DataFrame:
    """(conv_id, question, answer): the first user text and first assistant text that is not empty."""
    def first(role: str) -> Column:
        return F.min_by(F.when((F.col("role") == role) & (F.trim("text") != ""), F.col("text")), F.when((F.col("role") == role) & (F.trim("text") != ""), F.col("turn")))

    pairs = messages.groupBy("conv_id").agg(first("user").alias("question"), first("assistant").alias("answer"))
    return pairs.where("question IS NOT NULL AND answer IS NOT NULL")


def pair_columns(columns: Sequence[str]) -> tuple[str, str]:
    """The columns named like question and answer, else the first two."""
    def pick(names: set[str], other: int) -> str:
        return next((c for c in columns if c.strip().lower() in names), columns[other])

    return pick({"question", "q", "cau hoi", "câu hỏi", "hỏi"}, 0), pick({"answer", "a", "tra loi", "trả lời", "đáp"}, 1)


def qa_to_chat(df: DataFrame, system: str | None = None, seed: int = 13) -> DataFrame:
    """(line): chat JSON of question and answer rows, empty ones left out, in a seeded order."""
    q, a = pair_columns(df.columns)

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    kept = df.where((F.trim(q) != "") & (F.trim(a) != ""))
    said = [message("system", F.lit(system))] if system else []
    line = F.to_json(F.struct(F.array(*said, message("user", F.col(q)), message("assistant", F.col(a))).alias("messages")))
    return kept.orderBy(F.xxhash64(F.lit(seed), F.col(q), F.col(a)), q, a).select(line.alias("line"))


def qa_text(pairs: DataFrame, key: str) -> DataFrame:
    """(key, text): question and answer as text, blank pairs left out."""
    kept = pairs.where((F.trim("question") != "") & (F.trim("answer") != ""))
    return kept.select(key, F.format_string("Q: %s\n\nA: %s", "question", "answer").alias("text"))


def export_bundle(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, source, title, content_hash, chunks) of ready, approved documents with a hash, chunks in order."""
    kept = documents.where((F.col("status") == "ready") & (F.col("review") == "approved") & F.col("content_hash").isNotNull())
    listed = chunks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("position", "chunk_id", "content"))).alias("chunks"))
    return kept.join(listed, "document_id", "left").select("document_id", "source", "title", "tier", "content_hash", "chunks", F.lit(BUNDLE_VERSION).alias("version"))


def import_bundle(bundle: DataFrame, existing: DataFrame) -> DataFrame:
    """Bundle rows with ``result``: rejected for an unknown tier, skipped if the source has the content, else created."""
    known = existing.select("source", "content_hash").distinct().withColumn("__known", F.lit(True))
    joined = bundle.join(known, ["source", "content_hash"], "left")
    result = F.when(~F.col("tier").isin(*TIERS), "rejected").when(F.col("__known"), "skipped").otherwise("created")
    return joined.withColumn("result", result).drop("__known")


def upsert_daily(df: DataFrame, path: str) -> None:
    """Replaces the days of df in a table partitioned by day; other days stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merge_counters(stored: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums by key over stored and new counters; keys that repeat are merged too."""
    return stored.unionByName(new).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def eval_export(cases: DataFrame) -> DataFrame:
    """(line): evaluation cases as JSON, oldest first, with the first expected source."""
    doc = F.struct("query", F.try_element_at("sources", F.lit(1)).alias("expected_document"))
    return cases.orderBy("created_at", "query").select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("line"))


LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def query_logs(logs: DataFrame, level: str, part: str | None = None, limit: int = 200, most: int = 500) -> DataFrame:
    """The newest rows of at least a level, with a text in message or logger."""
    severity = F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p])
    kept = logs.where(F.coalesce(F.try_element_at(severity, F.upper("level")), F.lit(0)) >= LEVELS[level])
    if part:
        low = F.lit(part.lower())
        kept = kept.where(F.contains(F.lower("message"), low) | F.contains(F.lower("logger"), low))
    return kept.orderBy(F.desc("at"), "log_id").limit(min(limit, most))


def add_eval_cases(answers: DataFrame, existing: DataFrame, redact) -> DataFrame:
    """(question, sources) of answers whose redacted question is new; each question once, sources once in order."""
    masked = answers.select(redact(F.col("question")).alias("question"), "message_id", F.array_distinct("sources").alias("sources"))
    first = masked.withColumn("n", F.row_number().over(W.partitionBy("question").orderBy("message_id"))).where("n = 1")
    return first.join(existing.select("question"), "question", "left_anti").select("question", "message_id", "sources")


@dataclass(frozen=True)
class Template:
    """A read-only query that users may run with named arguments."""

    sql: str
    arguments: Mapping[str, str] = field(default_factory=dict)
    columns: Sequence[str] = ()
    masked: Sequence[str] = ()
    tier: str = "user"
    limit: int = 50
    #: Arguments that the runner binds, never the caller.
    bound: Sequence[str] = ()

    MOST = 200

    def __post_init__(self) -> None:
        word = self.sql.lstrip().split(None, 1)[0].lower() if self.sql.strip() else ""
        if word not in ("select", "with") or ";" in self.sql:
            raise ValueError("a template is one SELECT or WITH statement")
        if not 1 <= self.limit <= self.MOST:
            raise ValueError(f"limit is 1 to {self.MOST}")


def run_template(spark: SparkSession, template: Template, tables: Mapping[str, DataFrame], args: Mapping[str, object], tier: str, bound: Mapping[str, object] | None = None) -> DataFrame:
    """Allowed columns of a template's rows, masked ones by their last four characters, one row over the limit at most.

    Arguments go in as parameters, never as text. The row over the limit says that there are more.
    """
    if TIERS.index(tier) < TIERS.index(template.tier):
        raise PermissionError(f"{tier} may not run this template")
    unknown = set(args) - set(template.arguments)
    if unknown:
        raise ValueError(f"undeclared arguments: {', '.join(sorted(unknown))}")
    values = {n: args.get(n) for n in template.arguments} | {n: (bound or {})[n] for n in template.bound}
    rows = spark.sql(template.sql, args=values, **tables)
    kept = [F.concat(F.repeat(F.lit("*"), F.greatest(F.length(F.col(c).cast("string")) - 4, F.lit(0))), F.right(F.col(c).cast("string"), F.lit(4))).alias(c) if c in template.masked else F.col(c) for c in template.columns]
    return rows.select(*kept).limit(template.limit + 1)


def normalized_question(c: Column) -> Column:
    return tx.normalized_key(c)
