"""Equi-join that spreads hot keys.

Keys that hold a large share of the left rows are found by a mergeable sketch
of frequent items, which never misses one. Their rows are dealt to ``salts``
groups, and the right rows of those keys are given to every group; all other
keys join as they are. So a key with a third of all rows is joined by as many
tasks as there are groups, and only the hot keys' right rows are repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot: at most 1 / share of them.
SHARE = 0.01
SALTS = 64


def hot_keys(df: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """(key, rows): keys with at least ``share`` of the rows that have one; ``rows`` may be too high by a small part of the share."""
    most = int(1 / share)
    # tracking several times as many items as can be hot keeps the counts' error a small part of the share
    top = df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {most}, {64 * most})").alias("top"))
    return top.select("n", F.inline("top")).where(F.col("count") >= F.lit(share) * F.col("n")).select(F.col("item").alias(key), F.col("count").alias("rows"))


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = SHARE, salts: int = SALTS) -> DataFrame:
    """``left.join(right, key, how)`` for ``how`` inner or left, with the hot keys of ``left`` spread over ``salts`` groups.

    Left rows without a key are spread too: they meet none."""
    # at most 1 / share rows
    hot = F.broadcast(hot_keys(left, key, share).select(F.col(key).alias("_hot")))
    # by the row's number in its partition, so that a task that is run again deals its rows alike
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    dealt = left.withColumn("_turn", turn).join(hot, F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), F.col("_turn")).otherwise(0)).drop("_hot", "_turn")
    given = right.join(hot, F.col(key) == F.col("_hot"), "left")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    given = given.withColumn("_salt", F.explode(F.when(F.col("_hot").isNotNull(), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(given, [key, "_salt"], how).drop("_salt")
