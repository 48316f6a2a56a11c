"""Retrieval and routing metrics, calibration and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_hit(results: DataFrame) -> DataFrame:
    """(query_id, rank) of the first expected one; null where there is none. Results have query_id, rank, hit."""
    return results.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("rank"))


def recall_mrr(ranks: DataFrame, ks: Sequence[int], by: str | None = None) -> DataFrame:
    """Recall at each k and MRR, by group and over all, in one pass. Null ranks are misses."""
    measures = [F.avg((F.coalesce(F.col("rank") <= k, F.lit(False))).cast("double")).alias(f"recall_{k}") for k in ks]
    measures += [F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n")]
    if by is None:
        return ranks.agg(*measures)
    return ranks.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping(by).cast("long").alias("all"), *measures)


def target_rank(scores: DataFrame) -> DataFrame:
    """(query_id, rank): one more than the number of scores over the target's, from (query_id, own, score)."""
    own = scores.where("own").groupBy("query_id").agg(F.max("score").alias("mine"))
    return scores.join(own, "query_id").groupBy("query_id").agg((F.count_if(F.col("score") > F.col("mine")) + 1).alias("rank"))


def mrr_by(scored: DataFrame, group: str, k: int) -> DataFrame:
    """(group, mrr): mean of 1 over the rank of the best hit within k."""
    best = scored.groupBy(group, "query_id").agg(F.max(F.when(F.col("hit"), F.col("score"))).alias("mine"))
    ranks = scored.join(best, [group, "query_id"]).groupBy(group, "query_id").agg((F.count_if(F.col("score") > F.col("mine")) + 1).alias("rank"), F.first("mine").alias("mine"))
    value = F.when(F.col("mine").isNotNull() & (F.col("rank") <= k), 1 / F.col("rank")).otherwise(0.0)
    return ranks.groupBy(group).agg(F.round(F.avg(value), 6).alias("mrr"))


def calibrate_threshold(cases: DataFrame) -> DataFrame:
    """(threshold, balanced_accuracy): the lowest threshold of the best balanced accuracy.

    Candidates are the smallest score, midpoints and one just over the largest. A case without a score never passes.
    Distinct scores are counted once and summed up in order: no join of scores and thresholds. The running sums
    are over distinct scores, which are rounded, so bounded.
    """
    counted = cases.where(F.col("score").isNotNull()).groupBy(F.round("score", 6).alias("s")).agg(
        F.count_if(F.col("answerable")).alias("p"), F.count_if(~F.col("answerable")).alias("n")
    )
    totals = cases.agg(F.count_if(F.col("answerable")).alias("tp"), F.count_if(~F.col("answerable")).alias("tn"))
    order = W.orderBy("s")
    below = order.rowsBetween(W.unboundedPreceding, 0)
    steps = counted.select("s", F.lead("s").over(order).alias("next"), F.sum("p").over(below).alias("pb"), F.sum("n").over(below).alias("nb"), F.lag("s").over(order).alias("before"))
    over = F.coalesce((F.col("s") + F.col("next")) / 2, F.col("s") + 1e-9)
    scored = counted.agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"))
    cuts = steps.select(over.alias("threshold"), "pb", "nb").unionByName(
        steps.where(F.col("before").isNull()).select(F.col("s").alias("threshold"), F.lit(0).cast("long").alias("pb"), F.lit(0).cast("long").alias("nb"))
    )
    every = cuts.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(scored))  # one row each
    kept = (F.col("ps") - F.col("pb")) / F.greatest(F.col("tp"), F.lit(1))
    refused = (F.col("tn") - F.col("ns") + F.col("nb")) / F.greatest(F.col("tn"), F.lit(1))
    accuracy = F.round((kept + refused) / 2, 9)
    return every.select("threshold", accuracy.alias("balanced_accuracy")).orderBy(F.desc("balanced_accuracy"), "threshold").limit(1)


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def routing_report(pairs: DataFrame, labels: Sequence[str], default: str, count: bool = False) -> DataFrame:
    """(accuracy, macro_f1, stolen): stolen are default questions that another route took; labels that never occur count 0.

    One aggregation of the confusion counts, so that the pairs are worked out once. ``count`` adds their number, n.
    """
    e, p, n = F.col("expected"), F.col("predicted"), F.col("n")

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, n)), F.lit(0))

    f1 = [F.coalesce(2 * total((e == x) & (p == x)) / F.nullif(total(e == x) + total(p == x), F.lit(0)), F.lit(0.0)) for x in labels]
    out = confusion(pairs).agg(
        (total(e == p) / F.sum("n")).alias("accuracy"),
        F.sum(F.when((e == default) & (p != default), n).otherwise(0)).alias("stolen"),
        F.round(sum(f1, F.lit(0.0)) / len(labels), 9).alias("macro_f1"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
    )
    return out if count else out.drop("n")


def grouped_accuracy(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(kind, label, n, right) for each column, in one pass over grouping sets."""
    out = pairs.groupingSets([[F.col(c)] for c in by], *[F.col(c) for c in by]).agg(
        F.count("*").alias("n"), F.count_if(F.col("expected") == F.col("predicted")).alias("right"), *[F.grouping(c).alias(f"g_{c}") for c in by]
    )
    kind = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in by])
    label = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.col(c).cast("string")) for c in by])
    return out.select(kind.alias("kind"), label.alias("label"), "n", "right")


def argument_match(calls: DataFrame) -> DataFrame:
    """(case_id, matched): whether actual arguments equal any accepted value for every name, from map columns.

    ``accepted`` maps a name to the values that count; ``actual`` maps a name to one value.
    """
    names = F.map_keys("accepted")
    every = F.forall(names, lambda n: F.coalesce(F.array_contains(F.try_element_at(F.col("accepted"), n), F.try_element_at(F.col("actual"), n)), F.lit(False)))
    same = F.size(F.array_except(F.map_keys("actual"), names)) == 0
    return calls.select("case_id", (every & same).alias("matched"))


def compare_configs(metrics: DataFrame, baseline: str) -> DataFrame:
    """(config, metric, delta, percent) against the baseline's; percent is null where that is 0 or less."""
    base = metrics.where(F.col("config") == baseline).select("metric", F.col("value").alias("base"))
    joined = metrics.where(F.col("config") != baseline).join(base, "metric")
    delta = F.col("value") - F.col("base")
    return joined.select("config", "metric", delta.alias("delta"), F.when(F.col("base") > 0, delta * 100 / F.col("base")).alias("percent"))


def regression_gate(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """(rule, failed) from one-row tables (n, recall, mrr, accuracy, cases, stolen)."""
    b = baseline.select(*[F.col(c).alias(f"b_{c}") for c in baseline.columns])
    return gate_rules(now.crossJoin(F.broadcast(b)).withColumn("base", F.struct(*[F.col(f"b_{c}").alias(c) for c in baseline.columns])))  # one row


def gate_rules(both: DataFrame) -> DataFrame:
    """(rule, failed) from a row with a run's figures and its baseline's in the struct ``base``."""
    allowed = F.greatest(F.lit(0.02), 2 / F.col("cases"))
    rules = {
        "set_changed": F.col("n") != F.col("base.n"),
        "recall_dropped": F.col("recall") < F.col("base.recall"),
        "mrr_dropped": F.col("mrr") < F.col("base.mrr") - 0.02,
        "accuracy_dropped": F.col("accuracy") < F.col("base.accuracy") - allowed,
        "stolen": F.col("stolen") > 0,
    }
    return both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("failed")) for k, v in rules.items()])).alias("r")).select("r.rule", "r.failed")


def outcome_eval(rows: DataFrame) -> DataFrame:
    """(kind, verdict, n): answered where it should be, refused where it should be, or refused another way."""
    answered = F.col("outcome") == "answered"
    verdict = F.when(answered == F.col("should_answer"), "right").when(answered, "wrong").when(F.col("outcome").isin("handoff", "denied"), "refused_other_way").otherwise("wrong")
    return rows.withColumn("verdict", F.coalesce(verdict, F.lit("wrong"))).groupBy("kind", "verdict").agg(F.count("*").alias("n"))


def embedding_drift(a: DataFrame, b: DataFrame, key: str, cosine: Column, largest: Column) -> DataFrame:
    """Mean, largest and smallest of 1 - cosine, and the largest difference of a component, over rows of both."""
    pairs = a.join(b, key).select((1 - cosine).alias("d"), largest.alias("m"))
    return pairs.agg(F.avg("d").alias("mean"), F.max("d").alias("max"), F.min("d").alias("min"), F.max("m").alias("largest"))
