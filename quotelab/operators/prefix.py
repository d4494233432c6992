"""Exact ordered computations that never put a whole key, or the whole table, in one task.

A table that is larger than one block is range-sorted by keys and order into blocks of about
``target_rows`` rows, however skewed the keys are.  Running sums are computed inside the blocks and
completed by what came before, which is the running sum over the blocks' totals, at most two a block: the
same computation on a much smaller table, in as many levels as it takes.  Blocks only balance the work; results do
not depend on them, and nothing but counts reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelab.session import materialize

TARGET_ROWS = 1_000_000


def block_count(df: DataFrame, target_rows: int = TARGET_ROWS) -> int:
    return max(1, math.ceil(df.count() / target_rows))


def with_block(df: DataFrame, keys: list[str], order: list[str], blocks: int, name: str = "block") -> DataFrame:
    """Number the block of every row in the order of keys and ``order``; equal rows share one.

    The result is written, so that blocks stay what they are when a task runs again.
    """
    ranged = df.repartitionByRange(blocks, *keys, *order)
    return materialize(ranged.withColumn(name, F.spark_partition_id()), "blocks")


def running(
    points: DataFrame,
    keys: list[str],
    order: str | list[str],
    sums: dict[str, str],
    latest: dict[str, str] | None = None,
    blocks: int = 1,
    inclusive: bool = False,
    ties: bool = False,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add running sums and maxima over the rows of the same keys with a smaller ``order``.

    ``points`` has one row per (keys, order).  With ``ties`` it may have several, which don't count for one
    another; ``order`` is then one long column.  ``sums`` and ``latest`` map new names to columns.  Sums
    of nothing are 0, maxima of nothing NULL.  ``inclusive`` counts the row itself too.
    """
    latest = latest or {}
    orders = [order] if isinstance(order, str) else list(order)

    def earlier(window: W) -> W:
        if ties:
            return window.orderBy(*orders).rangeBetween(W.unboundedPreceding, -1)
        return window.orderBy(*orders).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)

    if blocks < 2:
        inside = earlier(W.partitionBy(*keys))
        return points.select(
            "*",
            *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()],
            *[F.max(c).over(inside).alias(n) for n, c in latest.items()],
        )
    blocked = with_block(points, keys, orders, blocks)
    totals = blocked.groupBy(*keys, "block").agg(
        *[F.sum(c).alias(f"_of_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_of_{n}") for n, c in latest.items()],
    )
    if keys:  # only the first and the last key of a block can go on in another one
        key = F.struct(*keys)
        edges = totals.groupBy("block").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
        at_edge = key.eqNullSafe(F.col("_first")) | key.eqNullSafe(F.col("_last"))
        totals = totals.join(edges, "block").where(at_edge).drop("_first", "_last")
    # The next level numbers blocks of its own.
    totals = materialize(totals.withColumnRenamed("block", "_lower"), "totals")
    carry = running(
        totals,
        keys,
        "_lower",
        {f"_carry_{n}": f"_of_{n}" for n in sums},
        {f"_carry_{n}": f"_of_{n}" for n in latest},
        blocks=block_count(totals, max(4, target_rows)),
        target_rows=target_rows,
    ).drop(*[f"_of_{n}" for n in [*sums, *latest]])
    carry = carry.withColumnsRenamed({"_lower": "_key_block"} | {k: f"_key_{k}" for k in keys})
    inside = earlier(W.partitionBy(*keys, "block"))
    local = blocked.select(
        "*",
        *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items()],
        *[F.max(c).over(inside).alias(f"_in_{n}") for n, c in latest.items()],
    )
    same = F.col("block") == F.col("_key_block")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return local.join(carry, same, "left").select(
        *points.columns,
        *[(F.coalesce(f"_in_{n}", F.lit(0)) + F.coalesce(f"_carry_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.greatest(f"_in_{n}", f"_carry_{n}").alias(n) for n in latest],
    )


def kth_smallest(df: DataFrame, order: str, k: int, target_rows: int = TARGET_ROWS) -> tuple:
    """The k-th smallest value (1-based, repeats counted) and the number of rows below it.

    One pass over ``df`` counts equal values; only the value found reaches the driver.
    """
    counted = df.where(F.col(order).isNotNull()).groupBy(order).agg(F.count("*").alias("n"))
    points = materialize(counted, "counts")
    below = running(points, [], order, {"below": "n"}, blocks=block_count(points, target_rows), target_rows=target_rows)
    hit = below.where((F.col("below") < k) & (F.col("below") + F.col("n") >= k)).first()
    if hit is None:  # fewer than k rows: the largest value
        n = F.sum("n")
        last = points.agg(F.max(order).alias(order), F.max_by("n", order).alias("n"), n.alias("all")).first()
        return last[order], last["all"] - last["n"]
    return hit[order], hit["below"]


def medians(df: DataFrame, columns: list[str], target_rows: int = TARGET_ROWS) -> dict[str, float]:
    """Exact interpolated medians of several numeric columns in one pass over the table."""
    return medians_of_members(df, columns, [F.lit(True)], target_rows)[0][0]


def _counted(df: DataFrame, columns: list[str], members: list[Column]) -> DataFrame:
    """``feature, value, n0, n1, ...``: how many rows of each member have a value; NULL counts those without one.

    Equal values are counted in batches before the shuffle.
    """
    each = range(len(members))
    chosen = df.select(*[F.coalesce(m, F.lit(False)).cast("byte").alias(f"_m{i}") for i, m in enumerate(members)], *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(columns)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside = [np.flatnonzero(batch.column(i).to_numpy()) for i in each]
            for j, c in enumerate(columns):
                column = batch.column(len(each) + j)
                x = column.fill_null(np.nan).to_numpy(zero_copy_only=False)
                values, at = np.unique(x, return_inverse=True)  # one NaN at most
                counts = [np.bincount(at[rows], minlength=len(values)) for rows in inside]
                arrays = [pa.array([c] * len(values)), pa.array(values, from_pandas=True), *map(pa.array, counts)]
                yield pa.RecordBatch.from_arrays(arrays, names=["feature", "value", *[f"n{i}" for i in each]])

    schema = "feature string, value double, " + ", ".join(f"n{i} long" for i in each)
    return chosen.mapInArrow(of, schema).groupBy("feature", "value").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in each])


def medians_of_members(
    df: DataFrame, columns: list[str], members: list[Column], target_rows: int = TARGET_ROWS
) -> tuple[list[dict[str, float]], list[set[str]]]:
    """Medians of the rows each of the conditions ``members`` holds for, and the columns with gaps there.

    All in one pass; a value is a middle one by the number of rows below it.
    """
    if not columns:
        return [{} for _ in members], [set() for _ in members]
    each = range(len(members))
    counted = materialize(_counted(df, columns, members), "counts")
    lacking = counted.where("value IS NULL").collect()  # one row per column name
    gaps = [{r["feature"] for r in lacking if r[f"n{i}"]} for i in each]
    points = counted.where("value IS NOT NULL")
    sums = {f"below{i}": f"n{i}" for i in each}
    below = running(points, ["feature"], "value", sums, blocks=block_count(points, target_rows), target_rows=target_rows)
    # One row per column name of the table, so the broadcast cannot grow with the data.
    totals = points.groupBy("feature").agg(*[F.sum(f"n{i}").alias(f"all{i}") for i in each])
    placed = below.join(F.broadcast(totals), "feature")

    def middle(i: int) -> Column:
        low, high = F.expr(f"(all{i} + 1) div 2"), F.expr(f"all{i} div 2 + 1")
        chosen = (F.col(f"n{i}") > 0) & (F.col(f"below{i}") < high) & (F.col(f"below{i}") + F.col(f"n{i}") >= low)
        return F.when(chosen, F.col("value"))

    found = placed.groupBy("feature").agg(
        *[((F.min(middle(i)) + F.max(middle(i))) / 2).alias(f"median{i}") for i in each]
    ).collect()  # one row per column name
    return [{row["feature"]: row[f"median{i}"] for row in found if row[f"median{i}"] is not None} for i in each], gaps


def spread_rank(
    df: DataFrame, key: str, hashed: Column, name: str, blocks: int = 1, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """1-based rank of every row in the order of a hash (ties by ``key``), without a global sort."""
    ordered = df.withColumns({"_hash": hashed, "_one": F.lit(1).cast("long")})
    ranked = running(ordered, [], ["_hash", key], {name: "_one"}, blocks=blocks, inclusive=True, target_rows=target_rows)
    return ranked.drop("_hash", "_one")
