"""Fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What is added to each rank; the usual value.
DAMP = 60


def numbered(rows: DataFrame, score: str, deep: int, tie: str = "id") -> DataFrame:
    """(id, rank) of the `deep` best rows; Spark keeps that many of each partition before they meet."""
    best = rows.orderBy(F.desc(score), tie).limit(deep)
    return best.select(tie, F.row_number().over(Window.orderBy(F.desc(score), tie)).alias("rank"))


def reciprocal(sides: dict[str, DataFrame], limit: int, damp: int = DAMP) -> DataFrame:
    """(id, score, a rank a side or null) of the best by the sum of 1 / (damp + rank) over sides(id, rank); ties by id.

    Sides are as deep as their callers made them; an id that a side lacks gets nothing from it.
    """
    both = None
    for name, side in sides.items():
        part = side.select("id", F.col("rank").alias(f"{name}_rank"))
        both = part if both is None else both.join(part, "id", "full_outer")
    score = sum((F.coalesce(1 / (damp + F.col(f"{name}_rank")), F.lit(0.0)) for name in sides), F.lit(0.0))
    return both.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), "id").limit(limit)
