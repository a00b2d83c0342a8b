"""Ordered scans: runs, states, numbering, breaker. All are windows on the document's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], flag: Column, least: int = 2) -> DataFrame:
    """Adds island and island_size to the rows of runs of flagged rows, at least so long."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # The rows without a flag so far: one sort, and rows alike in keys, order and flag may swap.
    df = df.withColumn("_flag", flag).withColumn("island", F.count_if(~F.coalesce("_flag", F.lit(False))).over(so_far))
    size = F.count("*").over(Window.partitionBy(*keys, "_flag", "island"))
    return df.withColumn("island_size", size).where(F.col("_flag") & (F.col("island_size") >= least)).drop("_flag")


def section_state(df: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Adds in_section: whether the last opening or closing row so far was an opening one."""
    event = F.when(opens, F.lit(True)).when(closes, F.lit(False))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("in_section", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False)))


def running_number(df: DataFrame, keys: list[str], order: list[str], anchor: Column) -> DataFrame:
    """Adds number: the anchor where there is one, else one more than the row before; from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumns({"_anchor": anchor, "_rn": F.row_number().over(w)})
    df = df.withColumn("_island", F.count("_anchor").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_island = Window.partitionBy(*keys, "_island")
    base = F.when(F.col("_island") == 0, F.lit(1) - F.min("_rn").over(in_island)).otherwise(F.max("_anchor").over(in_island) - F.min("_rn").over(in_island))
    return df.withColumn("number", base + F.col("_rn")).drop("_anchor", "_rn", "_island")


def circuit_breaker(df: DataFrame, keys: list[str], order: list[str], failed: Column, limit: int = 5) -> DataFrame:
    """Adds rn and outcome: failed, done, or skipped once limit failures in a row have come."""
    w = Window.partitionBy(*keys).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_failed": failed, "rn": F.row_number().over(w)})
    df = df.withColumn("_good", F.sum(F.when(F.col("_failed"), 0).otherwise(1)).over(so_far))
    streak = F.sum(F.when(F.col("_failed"), 1).otherwise(0)).over(Window.partitionBy(*keys, "_good").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_streak", streak)
    trip = F.min(F.when(F.col("_streak") >= limit, F.col("rn"))).over(Window.partitionBy(*keys))
    return df.withColumn("outcome", F.when(F.col("rn") > trip, "skipped").when(F.col("_failed"), "failed").otherwise("done")).drop("_failed", "_good", "_streak")


def first_occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds is_first within keys."""
    return df.withColumn("is_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)
