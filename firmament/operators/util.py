"""Small planning helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def top_k_per_group(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[Column],
    k: int,
    skip: int = 0,
    rank_col: str = "rank",
    salt_buckets: int = 64,
    salt_col: str | None = None,
) -> DataFrame:
    """Rows ranked ``skip+1 .. skip+k`` within each group, ``rank`` 1-based.

    Two phases so that one very large group never lands in one task: rank
    within (group, salt) and keep the first ``skip+k`` per salt bucket, then
    rank the survivors (at most ``salt_buckets * (skip+k)`` per group).
    ``order_cols`` must be a total order (end with the key).
    """
    need = skip + k
    salt = F.col(salt_col) if salt_col else F.spark_partition_id()
    salted = df.withColumn("_salt", F.pmod(F.hash(salt), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    first = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= need).drop("_r1", "_salt")
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    ranked = first.withColumn(rank_col, F.row_number().over(w2))
    return ranked.filter((F.col(rank_col) > skip) & (F.col(rank_col) <= need))
