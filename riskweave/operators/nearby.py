"""Rows that lie near others of the same record: an interval join on bins.

A position falls into a bin as wide as the distance, so what is nearer lies in the same bin or one beside it. The
join is by (record, bin), never by record alone: a record with very many positions is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near(left: DataFrame, right: DataFrame, distance: int, key: str = "record_id", pos: str = "pos") -> DataFrame:
    """The rows of ``left`` with a row of ``right`` of the same key less than ``distance`` away; rows are not repeated.

    Null keys and positions are near nothing.
    """
    if distance < 1:
        raise ValueError("the distance is at least 1")
    bin_ = F.floor(F.col(pos) / distance)
    others = right.select(F.col(key).alias("_key"), F.col(pos).alias("_pos")).distinct().withColumn("_bin", F.explode(F.array(*(F.floor(F.col("_pos") / distance) + k for k in (-1, 0, 1)))))
    rows = left.withColumn("_own", bin_)
    hit = (F.col(key) == F.col("_key")) & (F.col("_own") == F.col("_bin")) & (F.abs(F.col(pos) - F.col("_pos")) < distance)
    return rows.join(others, hit, "left_semi").drop("_own")
