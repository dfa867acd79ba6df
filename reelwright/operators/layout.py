"""Layout of contact sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(items: DataFrame, key: str, order: list[Column], columns: int, width: int, height: int, label: int, pad: int) -> DataFrame:
    """items with row, col and the upper left corner x, y of their cells, filled row by row within each key."""
    k = (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("bigint")
    placed = items.withColumn("k_", k).withColumn("row", F.expr(f"k_ div {columns}")).withColumn("col", F.col("k_") % columns)
    return placed.withColumn("x", pad + F.col("col") * (width + pad)).withColumn("y", pad + F.col("row") * (height + label + pad)).drop("k_")
