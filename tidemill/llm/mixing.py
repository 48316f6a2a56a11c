"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source has the same expected number of copies, target / source size. Its whole part is given
to every document; the fractional part is rounded dependently. Two documents meet and words move from one to the
other until one of the two has a whole number of copies; which way they move is drawn so that expectations hold.
The other one goes on to the next meeting. The words of a source are kept exactly in every meeting, so in the
end a source misses its target by less than one document; long documents meet first, so by a short one.

Documents meet in groups of bounded size; what a group leaves over (one document) goes up a tree of groups, one
shuffle for each level, each level smaller by the group size. Everything is DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemill.llm.common import cut, n_words, table

#: Documents that meet in one group.
GROUP = 64
#: As many sources at most are broadcast; beyond that they are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Parts that equal rows with different numbers of copies are dealt to, by all their columns.
DEALS = 64
#: A fraction this near a whole number counts as whole.
TINY = 1e-9


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.xxhash64(*cols).bitwiseAND((1 << 52) - 1).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, n, source_size) with each source's target size.

    Sources by code point, null last, take the weights in turn; each gets its share of all words, up to cap times
    its own size. What that leaves over is shared by weight among the others. With sources ordered by size over
    weight, the capped ones come first, so one running sum finds the share of the rest. It runs over a row for
    each source, after aggregation.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighted = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    most = F.col("source_size") * F.lit(float(cap))
    rising = W.orderBy(most / F.col("w"), F.col("source").asc_nulls_last())
    before, every = rising.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    share = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    shared = weighted.withColumn("at", F.row_number().over(rising)).withColumn("share", share)
    fits = F.when(F.col("share") <= most / F.col("w"), F.struct("at", "share"))
    level = F.min(fits).over(every)["share"]
    return shared.select(
        "source", "n", "source_size", F.least(most, F.coalesce(level, F.lit(0.0)) * F.col("w")).alias("target")
    )


def _meet(a: Column, b: Column, level: int, seed: int) -> tuple[Column, Column]:
    """(whole, open) after two documents with open fractions p met."""
    a_room, b_room = (1 - a["p"]) * a["size"], (1 - b["p"]) * b["size"]
    a_has, b_has = a["p"] * a["size"], b["p"] * b["size"]
    to_a, to_b = F.least(a_room, b_has), F.least(a_has, b_room)
    draw = uniform(F.lit(seed), F.lit(level), a["then"], b["then"])
    up = draw * (to_a + to_b) < to_b

    def put(x: Column, p: Column) -> Column:
        return x.withField("p", p)

    zero, one = F.lit(0.0), F.lit(1.0)
    return (
        F.when(up, F.when(a_room <= b_has, put(a, one)).otherwise(put(b, zero))).otherwise(
            F.when(a_has <= b_room, put(a, zero)).otherwise(put(b, one))
        ),
        F.when(
            up,
            F.when(a_room <= b_has, put(b, F.greatest(zero, b["p"] - a_room / b["size"]))).otherwise(
                put(a, F.least(one, a["p"] + b_has / a["size"]))
            ),
        ).otherwise(
            F.when(a_has <= b_room, put(b, F.least(one, b["p"] + a_has / b["size"]))).otherwise(
                put(a, F.greatest(zero, a["p"] - b_room / a["size"]))
            )
        ),
    )


def _reduce_groups(items: DataFrame, keys: list[str], level: int, seed: int) -> DataFrame:
    """One row for each group: the documents made whole, and the one left open."""
    item = items.schema["item"].dataType.simpleString()
    start = F.struct(F.lit(None).cast(item).alias("open"), F.array().cast(f"array<{item}>").alias("whole"))

    def step(acc: Column, x: Column) -> Column:
        whole, rest = _meet(acc["open"], x, level, seed)
        return F.when(acc["open"].isNull(), F.struct(x.alias("open"), acc["whole"].alias("whole"))).otherwise(
            F.struct(rest.alias("open"), F.array_append(acc["whole"], whole).alias("whole"))
        )

    grouped = items.groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items"))
    return grouped.select(*keys, F.aggregate("items", start, step).alias("met"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3.0,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """How often the mix takes each document: (key, size, source, source_size, target, copies, taken).

    ``size`` is the number of words (null text: 0) of the whole text, however long, ``copies`` the times the mix takes
    the document and ``taken`` their words. Documents without words have 0 copies. Null sources are one source, null keys
    are documents like any other. Repeated rows are separate documents; rows with equal key, size and source (ties) can
    stand for each other: they are counted before anything is shuffled and told apart by a number. Copies never exceed
    ceil(cap). An empty table gives an empty table; other columns are left out, so their names don't matter.
    The same input gives the same copies, whatever the partitioning. A source or a key of any size is spread over groups
    by a hash of key, size and that number.
    """
    each = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    equal = each.groupBy("key", "source", "size").agg(F.count("*").alias("times"))
    numbered = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("same")
    sized = cut(equal.select("key", "source", "size", numbered))
    sizes = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    goals = cut(targets(sizes, weights, cap))
    n_sources, most = goals.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    side = F.broadcast(goals) if n_sources <= BROADCAST_SOURCES else goals
    ratio = F.col("target") / F.col("source_size")
    whole = F.floor(ratio + TINY)
    joined = (
        sized.alias("d")
        .join(side.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
        .select("key", "same", "d.source", "size", "n", "source_size", "target")
        .withColumn("base", F.when(F.col("size") > 0, whole).otherwise(0).cast("long"))
        .withColumn("p", F.when(F.col("size") > 0, ratio - whole).otherwise(0.0))
    )
    about = ["source", "source_size", "target", "base"]
    settled = joined.where(F.col("p") <= TINY)
    out = [settled.select("key", "size", *about, F.lit(0.0).alias("p"))]

    spread = F.xxhash64(F.lit(seed), F.col("key"), F.col("size"), F.col("same"))
    level, groups = 0, max(1, math.ceil(most / GROUP))
    items = (
        joined.where(F.col("p") > TINY)
        .withColumn("g", F.pmod(spread, F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP))))
        .select(*about, "g", F.struct((-F.col("size")).alias("order"), spread.alias("then"), "key", "same", "size", "p").alias("item"))
    )
    while True:
        met = cut(_reduce_groups(items, [*about, "g"], level, seed))
        done = met.select(*about, F.explode("met.whole").alias("item"))
        out.append(done.select("item.key", "item.size", *about, "item.p"))
        if groups == 1:
            break
        level, groups = level + 1, math.ceil(groups / GROUP)
        items = met.select(*about, F.floor(F.col("g") / GROUP).alias("g"), F.col("met.open").alias("item"))
    last = F.when(uniform(F.lit(seed), F.lit(-1), F.col("met.open.then")) < F.col("met.open.p"), 1.0).otherwise(0.0)
    out.append(met.select("met.open.key", "met.open.size", *about, last.alias("p")))
    copies = (F.col("base") + F.col("p")).cast("long")
    return reduce(DataFrame.unionByName, out).select(
        F.col("key").alias(key), "size", "source", "source_size", F.col("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def apply_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it; the columns stay.

    Of rows with equal key, source and size, some may be taken once more than others. They are numbered through: each
    task's rows by themselves, going on from the tasks before, so that equal rows are spread however many there are.
    Rows without equals are not numbered. Nulls, empty texts and empty tables are as in ``mix``.
    """
    taken = mix(docs, key=key, text=text, source=source, **how)
    got = [F.col(key).alias("__k"), F.col("source").alias("__s"), F.col("size").alias("__n")]
    same = [F.col(key).alias("__k"), F.col(source).alias("__s"), n_words(F.col(text)).alias("__n")]
    levels = taken.groupBy(*got).agg(
        F.count("*").alias("__rows"), F.min("copies").alias("__least"), F.sum("copies").alias("__all")
    )
    more = F.col("__all") - F.col("__rows") * F.col("__least")  # so many of equal rows are taken once more
    plan = levels.select("__k", "__s", "__n", "__rows", "__least", more.alias("__more"))
    own = docs.select("*", *same).alias("d")
    match = F.col("d.__k").eqNullSafe(F.col("p.__k")) & F.col("d.__s").eqNullSafe(F.col("p.__s")) & (F.col("d.__n") == F.col("p.__n"))
    each = own.join(plan.alias("p"), match).select(*[F.col(f"d.`{c}`") for c in docs.columns], "d.__k", "d.__s", "d.__n", "__least", "__more", "__rows")
    split = (F.col("__more") > 0) & (F.col("__more") < F.col("__rows"))
    times = F.col("__least") + F.when(F.col("__more") > 0, 1).otherwise(0)
    plain = each.where(~split).withColumn("__times", times)
    dealt = each.where(split).withColumn("__deal", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(DEALS)))
    ids = ["__k", "__s", "__n"]
    sizes = dealt.groupBy(*ids, "__deal").agg(F.count("*").alias("__here"))
    before = W.partitionBy(*ids).orderBy("__deal").rowsBetween(W.unboundedPreceding, -1)
    begins = sizes.select(*[F.col(c).alias(f"b{c}") for c in (*ids, "__deal")], F.coalesce(F.sum("__here").over(before), F.lit(0)).alias("__begin"))
    placed = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"b{c}")) for c in (*ids, "__deal")])
    rank = F.row_number().over(W.partitionBy(*ids, "__deal").orderBy(F.col(text))) + F.col("__begin")
    drawn = dealt.join(begins, placed).withColumn("__times", F.col("__least") + (rank <= F.col("__more")).cast("int"))
    all_rows = reduce(DataFrame.unionByName, [x.select(*[F.col(f"`{c}`") for c in docs.columns], "__times") for x in (plain, drawn)])
    repeated = all_rows.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__times").cast("int"))))
    return repeated.where(F.col("__copy") > 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, sources weighing 5, 2, 1 in turn."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )
