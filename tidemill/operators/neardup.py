"""Greedy removal of near vectors, in rounds over cells instead of in one pass over a group.

A row goes if it is too like an *earlier kept* one of its group. What is kept so is the first independent set in key
order, and it can be found in rounds: a row that no earlier row left is near to is kept; rows near to a kept one go; and
so on with the others, each round a table. Near rows meet in cells: rows of a group with equal signs of projections
on ``bits`` random directions, for a number of tables. Cells send on what is known of each row, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.search import stored

#: Rows of a cell that are meant to meet, rows of a block of a larger cell, and the chance to miss a pair at the threshold.
CELL, BLOCK, MISSED = 2_000, 4_000, 1e-9
PIECE = 512


def tables_for(largest: int, cosine: float) -> tuple[int, int]:
    """(bits, tables): cells of about CELL rows out of the largest group, and enough tables for MISSED.

    Two directions at an angle have the same sign on one side with the chance 1 - angle / pi. A group that is a
    cell by itself takes no bits and one table, and misses nothing.
    """
    bits = max(0, math.ceil(math.log2(max(1, largest) / CELL)))
    if not bits:
        return 0, 1
    same = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log1p(-same)) if same < 1 else 1


def _coded(rows: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """rows once for each table, with ``cell``, the signs of its directions."""

    def run(batches):
        planes = None
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("embedding")), len(batch))
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], bits * tables))
            signs = (x @ planes > 0).reshape(len(batch), tables, bits)
            codes = (signs << np.arange(bits)).sum(axis=2) + (np.arange(tables) << bits)
            for table in range(tables):
                yield batch.append_column("cell", pa.array(codes[:, table].astype(np.int64)))

    if not bits:
        return rows.withColumn("cell", F.lit(0).cast("long"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType())]))


def _matrix(column, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _met(coded: DataFrame) -> DataFrame:
    """Rows of large cells by pairs of blocks, so that no task holds more than two blocks."""
    sizes = coded.groupBy("part", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    block = F.pmod(F.xxhash64("key", "cell"), F.col("blocks")).cast("int")
    known = coded.join(sizes, ["part", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return known.withColumn("other", other).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("blocks", "other")


def _round(left: DataFrame, bits: int, tables: int, cosine: float, turn: int) -> DataFrame:
    """(key, gone, blocked) of the rows left: near to a kept one, or else to an earlier one that is left."""

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["place"].to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        place, kept = group["place"].to_numpy(), group["kept"].to_numpy(zero_copy_only=False)
        x = _matrix(group["embedding"], len(group))
        gone = np.zeros(len(x), bool)
        blocked = np.zeros(len(x), bool)
        for at in range(0, len(x), PIECE):  # kept rows first, as what goes can't block
            near = np.round(x[at : at + PIECE] @ x[kept].T, 12) >= cosine
            gone[at : at + PIECE] = near.any(axis=1) & ~kept[at : at + PIECE]
        open_ = ~kept & ~gone
        for at in range(0, len(x), PIECE):
            near = np.round(x[at : at + PIECE] @ x[open_].T, 12) >= cosine
            blocked[at : at + PIECE] = (near & (place[open_][None, :] < place[at : at + PIECE, None])).any(axis=1)
        mine = ~kept
        return pa.table([group["key"].filter(pa.array(mine)), pa.array(gone[mine]), pa.array((blocked & open_)[mine])], ["key", "gone", "blocked"])

    met = _met(_coded(left, bits, tables, turn))
    kind = left.schema["key"].dataType.simpleString()
    flags = met.groupBy("part", "cell", "low", "high").applyInArrow(run, f"key {kind}, gone boolean, blocked boolean")
    return flags.groupBy("key").agg(F.bool_or("gone").alias("gone"), F.bool_or("blocked").alias("blocked"))


def dedup_near(vectors: DataFrame, group: str, cosine: float = 0.95, key: str = "vec_id") -> DataFrame:
    """(key, group) of the rows that are not too like an earlier kept one of their group, in the order of keys.

    Keys are distinct and of any type that can be ordered. Equal vectors count once, by the first key. Null vectors are
    like nothing and stay; a null group is a group. Rounds follow the longest chain of near rows, not their number. A
    pair at the threshold is missed with the chance MISSED where a group is larger than CELL, else never.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(group).alias("part"), F.col("embedding").alias("embedding"))
    none, some = rows.where("embedding IS NULL").select("key", "part"), rows.where("embedding IS NOT NULL")
    first = some.groupBy("part", "embedding").agg(F.min("key").alias("key"))
    left = stored(first.select("key", "part", "embedding", F.col("key").alias("place"), F.lit(False).alias("kept")))
    largest = left.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, cosine)
    out, turn = [none], 0
    while not left.where("NOT kept").isEmpty():
        turn += 1
        flags = _round(left, bits, tables, cosine, turn)
        open_ = left.where("NOT kept").join(flags, "key").where("NOT gone")
        left = stored(open_.withColumn("kept", ~F.col("blocked")).drop("gone", "blocked"))
        out.append(left.where("kept").select("key", "part"))
    kept = out[0]
    for df in out[1:]:
        kept = kept.unionByName(df)
    return kept.select(F.col("key").alias(key), F.col("part").alias(group))
