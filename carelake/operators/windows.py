"""Window operators that stay exact when one partition key is hot.

``segmented_lag`` computes ``lag(col) OVER (PARTITION BY p ORDER BY o...)``
without putting a whole partition in one task. Rows are cut into segments
by a value that is monotone in the leading order column (e.g. the calendar
day of a timestamp):

1. lag inside each (p, segment) window -- a hot key spreads over as many
   tasks as it has segments;
2. the last row of every segment, marked in the same window pass (its
   ``lead`` is null), so the input is shuffled once and reused;
3. each segment's predecessor tail via a lag over the tails table, which has
   one row per (p, segment) -- bounded by the calendar, not by data volume;
4. the first row of each segment takes its predecessor's tail.

The result is identical to the plain window when the order is total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NULL_SEGMENT = -(2**31)


def day_segment(ts: Column) -> Column:
    """Calendar-day segment of a timestamp; null timestamps form the first
    segment (they sort first in an ascending order)."""
    return F.coalesce(F.unix_date(F.to_date(ts)), F.lit(NULL_SEGMENT))


def segmented_lag(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    lag_cols: Sequence[str],
    segment: Column,
    prefix: str = "prev_",
) -> DataFrame:
    """Adds ``prefix + c`` = lag(c, 1) for each c in lag_cols, ordered by
    ``order_by`` ascending (nulls first) within ``partition_by``.

    ``segment`` must be non-decreasing in that order and never null."""
    p = list(partition_by)
    seg = "_seg"
    key = "_pkey"
    # One key column, struct(partition keys, segment): a struct is never null
    # and struct equality matches null fields, so it groups like
    # partitionBy(p, seg) and joins back with plain equality. The exchange,
    # the window and the join back all use this one column, so the join
    # reuses the exchange instead of shuffling the staged rows again. The
    # explicit exchange also keeps the planner from reusing an upstream
    # partitioning on the key alone, where a hot key would stay in one task.
    d = df.withColumn(seg, segment).withColumn(key, F.struct(*[F.col(c) for c in p], F.col(seg))).repartition(key)
    within = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in order_by])
    staged = d.withColumn("_rn", F.row_number().over(within)).withColumn(
        "_is_last", F.lead(F.lit(1)).over(within).isNull()
    )
    for c in lag_cols:
        staged = staged.withColumn(f"_in_{c}", F.lag(c).over(within))
    # tails come from the windowed frame itself (last row of each segment); both
    # branches read the one exchange on the key
    tails = staged.where(F.col("_is_last")).select(*p, seg, key, *[F.col(c).alias(f"_t_{c}") for c in lag_cols])
    across = Window.partitionBy(*p).orderBy(F.col(seg).asc())
    carry = tails.select(
        F.col(key).alias("_ckey"),
        *[F.lag(f"_t_{c}").over(across).alias(f"_carry_{c}") for c in lag_cols],
    )
    joined = staged.join(carry, F.col(key) == F.col("_ckey"), "left")
    out = joined.select(
        *[F.col(c) for c in df.columns],
        *[
            F.when(F.col("_rn") == 1, F.col(f"_carry_{c}")).otherwise(F.col(f"_in_{c}")).alias(f"{prefix}{c}")
            for c in lag_cols
        ],
    )
    return out


def plain_lag(df: DataFrame, partition_by, order_by, lag_cols, prefix: str = "prev_") -> DataFrame:
    """Reference formulation (one window per partition key) for tests."""
    w = Window.partitionBy(*partition_by).orderBy(*[F.col(c).asc_nulls_first() for c in order_by])
    for c in lag_cols:
        df = df.withColumn(f"{prefix}{c}", F.lag(c).over(w))
    return df


def top1_per_group(df: DataFrame, group_by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """row_number() = 1 per group. Use on pre-aggregated (bounded) inputs."""
    w = Window.partitionBy(*group_by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
