"""Bounded work cells: small groups share a cell, large groups are cut into pairs of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign_cells(items: DataFrame, group: str, item: str, weight: str, budget: int) -> DataFrame:
    """Add ``cell``, ``block`` and ``blocks``; an item has a row for every cell that it belongs to.

    A group of weight up to ``budget`` lies whole in one cell, together with other such groups.
    A heavier one is cut by the hash of its items into blocks of about half the budget, and
    every pair of blocks (a block with itself too) is a cell, so any two items of a group meet
    in exactly one cell and no cell grows with its group.
    """
    totals = items.groupBy(group).agg(F.sum(weight).alias("_w"))
    totals = totals.withColumn("blocks", F.when(F.col("_w") <= budget, 1).otherwise(F.ceil(F.col("_w") / (budget / 2))).cast("int"))
    bins = max(1, int((totals.where("blocks = 1").agg(F.sum("_w")).first()[0] or 0) // budget) + 1)
    placed = items.join(totals.drop("_w"), group).withColumn("block", F.pmod(F.xxhash64(F.col(item), F.lit(7)), F.col("blocks")).cast("int"))
    cells = F.when(
        F.col("blocks") == 1,
        F.array(F.pmod(F.xxhash64(F.col(group), F.lit(11)), F.lit(bins))),
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda j: F.xxhash64(F.col(group), F.least(F.col("block"), j), F.greatest(F.col("block"), j)),
        )
    )
    return placed.withColumn("cell", F.explode(cells))
