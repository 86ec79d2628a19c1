"""Gapless global positions and prefix sums without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.session import shared_table

PID, ROW = "__pid", "__row"


def laid_out(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df range-partitioned and sorted by order, written once; __pid and __row fix each row's place."""
    mono = F.monotonically_increasing_id()
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mono", mono)
    laid = laid.withColumn(PID, F.shiftright("__mono", 33)).withColumn(ROW, F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1)))
    return shared_table(laid.drop("__mono"), name)


def _offsets(per_pid: DataFrame, value: str) -> DataFrame:
    """Exclusive running sum of value over __pid: one row a partition, so the one task is small."""
    w = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    return per_pid.select(F.col(PID).alias("__opid"), F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long").alias("__base"))


def with_positions(df: DataFrame, order: list[Column], out: str = "pos", name: str = "positions") -> DataFrame:
    """Append out: the row's 0-based place in the order (ties in any order, fixed once written)."""
    laid = laid_out(df, order, name)
    per = laid.groupBy(PID).agg(F.count(F.lit(1)).alias("__n"))
    joined = laid.join(F.broadcast(_offsets(per, "__n")), F.col(PID) == F.col("__opid"))
    return joined.withColumn(out, F.col("__base") + F.col(ROW)).drop(PID, ROW, "__opid", "__base")


def with_prefix_sums(df: DataFrame, order: list[Column], value: str, out: str, name: str = "prefix") -> DataFrame:
    """Append out: the sum of value over all rows before this one in the order."""
    laid = laid_out(df, order, name)
    per = laid.groupBy(PID).agg(F.sum(value).alias("__n"))
    w = Window.partitionBy(PID).orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)
    inner = laid.withColumn("__in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    joined = inner.join(F.broadcast(_offsets(per, "__n")), F.col(PID) == F.col("__opid"))
    return joined.withColumn(out, (F.col("__base") + F.col("__in")).cast("long")).drop(PID, ROW, "__opid", "__base", "__in")


def carried(df: DataFrame, place: str, column: str) -> DataFrame:
    """df with each null of column replaced by the last value before it; place is a monotonically_increasing_id.

    Values are filled within a partition; what a partition inherits comes from one row each, so no task sorts all.
    """
    pid = F.shiftright(place, 33)
    rows = df.withColumn(PID, pid)
    last = rows.groupBy(PID).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(place))).alias("__last"))
    before = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    heirs = last.select(PID, F.last("__last", ignorenulls=True).over(before).alias("__heir"))
    here = F.last(column, ignorenulls=True).over(Window.partitionBy(PID).orderBy(place))
    return rows.join(F.broadcast(heirs), PID).withColumn(column, F.coalesce(here, F.col("__heir"))).drop(PID, "__heir")
