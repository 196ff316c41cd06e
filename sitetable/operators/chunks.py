"""Ordered computations that stay parallel when one key, or one order, holds most rows.

``changes`` is lag-and-count over (keys, order), done in two levels: rows are windowed
inside (keys, chunk) and only one summary row per chunk is windowed per key.
``running_total`` is a prefix sum over a global order: the order is cut into range
slices, slices are summed, and each slice starts from the total before it.
Both are exact for any choice of chunk or number of slices. ``medians`` selects by counting: ranges of values are
counted, and only the range that holds the middle is counted again, more finely.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from sitetable.session import checkpointed


def changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, chunk: Column) -> DataFrame:
    """Add ``previous`` (the value of the row before), ``changed`` and ``change_no``.

    ``order`` should be unique within a key, or ties are placed arbitrarily. ``chunk`` must not decrease along ``order``, e.g. the day of the ordering
    timestamp. ``change_no`` counts changes so far, 0 on a key's first row.
    """
    # Struct keys compare null-safely, so rows with a null key or order are kept. The plain key columns
    # are put back at the end: both uses of the shuffled rows then need the same columns and share it.
    inside = W.Window.partitionBy("_by").orderBy(*order)
    so_far = (W.Window.unboundedPreceding, W.Window.currentRow)
    rows = (df.withColumn("_by", F.struct(F.struct(*keys).alias("_key"), F.struct(chunk).alias("_chunk")))
              .drop(*keys)
              .withColumn("_row", F.row_number().over(inside))
              .withColumn("_before", F.lag(value).over(inside)))
    differs = ~F.col("_before").eqNullSafe(F.col(value))
    rows = (rows.withColumn("_changed", F.when(F.col("_row") > 1, differs).otherwise(F.lit(False)))
                .withColumn("_count", F.sum(F.col("_changed").cast("long")).over(inside.rowsBetween(*so_far))))

    along = W.Window.partitionBy("_key").orderBy("_chunk")
    edges = (rows.groupBy("_by").agg(F.min_by(value, "_row").alias("_first"), F.max_by(value, "_row").alias("_last"),
                                     F.max("_count").alias("_inside"))
                 .withColumns({"_key": F.col("_by._key"), "_chunk": F.col("_by._chunk")})
                 .withColumn("_edge", F.lag("_last").over(along))
                 .withColumn("_opens", F.row_number().over(along) > 1))
    edges = edges.withColumn("_step", (F.col("_opens") & ~F.col("_edge").eqNullSafe(F.col("_first"))).cast("long"))
    upto = F.sum(F.col("_inside") + F.col("_step")).over(along.rowsBetween(*so_far))
    edges = edges.select("_by", "_edge", (F.col("_step") == 1).alias("_edge_changed"),
                         (upto - F.col("_inside")).alias("_offset"))

    first = F.col("_row") == 1
    return (rows.join(edges, "_by")
                .withColumn("previous", F.when(first, F.col("_edge")).otherwise(F.col("_before")))
                .withColumn("changed", F.when(first, F.col("_edge_changed")).otherwise(F.col("_changed")))
                .withColumn("change_no", F.col("_offset") + F.col("_count"))
                .select(*[F.col(f"_by._key.{c}").alias(c) if c in keys else F.col(c) for c in df.columns],
                        "previous", "changed", "change_no"))


def in_slices(df: DataFrame, order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Rows in range slices of the global order, ``_slice`` numbered along it; written once, so re-reads agree."""
    ranged = (df.repartitionByRange(slices, *[F.col(c) for c in order]) if slices
              else df.repartitionByRange(*[F.col(c) for c in order]))
    return checkpointed(ranged.withColumn("_slice", F.spark_partition_id()))


def running_total(df: DataFrame, order: Sequence[str], amount: str, out: str,
                  slices: int | None = None) -> DataFrame:
    """Add the inclusive running sum of ``amount`` over the global ``order`` (rows unique in ``order``)."""
    rows = in_slices(df, order, slices)
    along = W.Window.orderBy("_slice")  # one row per slice: as many as shuffle partitions
    before = (rows.groupBy("_slice").agg(F.sum(amount).alias("_sum"))
                  .select("_slice", (F.sum("_sum").over(along) - F.col("_sum")).alias("_offset")))
    inside = W.Window.partitionBy("_slice").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    return (rows.join(before, "_slice")
                .withColumn(out, F.col("_offset") + F.sum(amount).over(inside))
                .drop("_slice", "_offset"))


STEP_BITS = 16


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): the exact lower median of a whole-number column per key; keys without a value are left out.

    Every round counts at most 2^16 ranges per key, before anything moves, so neither many distinct values nor a
    key with most rows make a large group: two rounds for 32-bit numbers, four for 64-bit ones.
    """
    kind = rows.schema[value].dataType
    bits = {T.ByteType(): 8, T.ShortType(): 16, T.IntegerType(): 32, T.LongType(): 64}.get(kind)
    if bits is None:
        raise ValueError(f"{value} is no whole number: {kind.simpleString()}")
    rows = rows.select(F.col(key).alias("_key"), F.col(value).cast("long").alias("_value")).filter("_value IS NOT NULL")
    found = None
    for shift in range(max(0, bits - STEP_BITS), -1, -STEP_BITS):
        part = F.shiftright("_value", shift)  # keeps the order of negative numbers too
        if found is None:
            counts = rows.groupBy("_key", part.alias("_part")).agg(F.count("*").alias("_n"))
            total = counts.groupBy("_key").agg(F.floor((F.sum("_n") + 1) / 2).alias("_rank"))
        else:
            inside = rows.alias("r").join(found.alias("f"), F.col("r._key").eqNullSafe(F.col("f._key")) & (
                F.shiftright("r._value", shift + STEP_BITS) == F.col("f._part")))
            counts = inside.groupBy("r._key", F.shiftright("r._value", shift).alias("_part")).agg(F.count("*").alias("_n"))
            total = found.select("_key", "_rank")
        upto = W.Window.partitionBy("_key").orderBy("_part").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
        ranked = counts.withColumn("_upto", F.sum("_n").over(upto)).alias("c").join(
            total.alias("t"), F.col("c._key").eqNullSafe(F.col("t._key")))
        before = F.col("_upto") - F.col("_n")
        found = checkpointed(ranked.filter((before < F.col("_rank")) & (F.col("_rank") <= F.col("_upto"))).select(
            "c._key", "_part", (F.col("_rank") - before).alias("_rank")))  # one row per key
    return found.select(F.col("_key").alias(key), F.col("_part").cast(kind).alias("median"))
