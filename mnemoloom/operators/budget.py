"""Budgeted contexts: what fits, in order, into so many characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: list[str], order: list, size: Column) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w))


def cut_lines(df: DataFrame, group: list[str], order: list, text: str, budget: int) -> DataFrame:
    """Lines while they fit, each with its line feed."""
    return running(df, group, order, F.length(text) + 1).where(F.col("used") <= budget)


def cut_blocks(df: DataFrame, group: list[str], order: list, text: str, budget: Column) -> DataFrame:
    """Blocks up to the first that overflows; the first always stays."""
    w = Window.partitionBy(*group).orderBy(*order)
    return running(df, group, order, F.length(text)).withColumn("pos", F.row_number().over(w)).where((F.col("used") <= budget) | (F.col("pos") == 1))


def by_first_rank(df: DataFrame, group: list[str], block: str, rank: str) -> DataFrame:
    """Rows with the rank of their block's first row, so that blocks come in order of first appearance."""
    return df.withColumn("block_rank", F.min(rank).over(Window.partitionBy(*group, block)))


def depth_and_breadth(df: DataFrame, group: list[str], order: list, text: str, budget: int, breadth_share: float = 0.7) -> DataFrame:
    """Breadth rows take their share first, depth rows what is left. ``df`` has a column layer."""
    breadth = cut_blocks(df.where("layer = 'breadth'"), group, order, text, F.lit(budget * breadth_share))
    spent = breadth.groupBy(*group).agg(F.sum(F.length(text)).alias("spent"))
    depth = df.where("layer = 'depth'").join(spent, group, "left").withColumn("rest", budget - F.coalesce("spent", F.lit(0)))
    deep = cut_blocks(depth, group, order, text, F.col("rest"))
    return breadth.select(*df.columns).unionByName(deep.select(*df.columns))


def blend(a: DataFrame, b: DataFrame, group: list[str], order: list, text: str, budget: int, share: float = 0.4) -> DataFrame:
    """Two sources at ``share`` and the rest; a side that has nothing leaves all to the other. Rows get a column side."""
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    has = both.groupBy(*group).agg(F.max(F.when(F.col("side") == "a", 1).otherwise(0)).alias("has_a"), F.max(F.when(F.col("side") == "b", 1).otherwise(0)).alias("has_b"))
    j = both.join(has, group)
    part = F.when(F.col("side") == "a", F.when(F.col("has_b") == 1, share).otherwise(1.0)).otherwise(F.when(F.col("has_a") == 1, 1 - share).otherwise(1.0))
    w = Window.partitionBy(*group, "side").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kept = j.withColumn("used", F.sum(F.length(text) + 1).over(w)).where(F.col("used") <= part * budget)
    return kept.select(*a.columns, "side")
