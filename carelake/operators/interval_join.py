"""Interval existence join (J6): does a row on the right fall within
[left.ts, left.ts + width] for the same key?

Spark has no range join. The plain formulation (equi key + range residual)
compares every left row with every right row of a key, and a semi join
with a range residual still scans a whole group for a probe that has no
match. Here the question is answered by sorting, not by pairing:

1. time is cut into buckets of ``width``; a probe (distinct key, ts) lives
   in its bucket, and a right row is placed in its own bucket and in the one
   before, so a probe's group holds every right row it could match;
2. per (key, bucket), rows ordered by time descending (right rows before
   probes at equal times) carry the nearest right time at or after each
   probe: ``last(right ts, ignorenulls)`` over an unbounded-preceding frame,
   which Spark evaluates incrementally;
3. a probe matches when that time is at most ``ts + width``.

A hot key is split over its buckets, each group is one sort (O(n log n)),
no pairs are formed, and the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(ts: Column, width_seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(width_seconds)).cast("long")


def exists_within(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ts: str,
    right_ts: str,
    width_seconds: int,
    flag: str = "has_match",
) -> DataFrame:
    """``left`` plus an int ``flag`` (1/0): some right row with the same key
    has ``left_ts <= right_ts <= left_ts + width``. Null keys or times never
    match. The left side's columns and rows are kept as they are."""
    rights = right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull()).select(
        F.col(key).alias("_k"),
        F.col(right_ts).alias("_t"),
        F.explode(F.array(_bucket(F.col(right_ts), width_seconds), _bucket(F.col(right_ts), width_seconds) - 1)).alias("_b"),
        F.lit(1).alias("_right"),
    )
    probes = (
        left.where(F.col(key).isNotNull() & F.col(left_ts).isNotNull())
        .select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"))
        .distinct()
        .select("_k", "_t", _bucket(F.col("_t"), width_seconds).alias("_b"), F.lit(0).alias("_right"))
    )
    seen = Window.partitionBy("_k", "_b").orderBy(F.col("_t").desc(), F.col("_right").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    nearest = F.last(F.when(F.col("_right") == 1, F.col("_t")), ignorenulls=True).over(seen)
    limit = F.col("_t") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(width_seconds))
    hits = (
        probes.unionByName(rights)
        .withColumn("_next", nearest)
        .where((F.col("_right") == 0) & F.col("_next").isNotNull() & (F.col("_next") <= limit))
        .select(F.col("_k").alias("_lk"), F.col("_t").alias("_lts"), F.lit(1).alias("_hit"))
    )
    joined = left.join(hits, (left[key] == hits["_lk"]) & (left[left_ts] == hits["_lts"]), "left")
    return joined.select(*[left[c] for c in left.columns], F.coalesce(hits["_hit"], F.lit(0)).alias(flag))
