"""Join helpers: size-checked broadcast and dimension lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when the optimizer's estimate is below this bound;
# above it the join stays a shuffle join (sort-merge / shuffled hash) and AQE
# may still convert it at runtime from real shuffle sizes.
DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan, or None when unavailable (e.g. Connect)."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()  # noqa: SLF001
        return size if isinstance(size, int) else int(str(size.toString()))
    except Exception:  # noqa: BLE001
        return None


def broadcast_if_small(df: DataFrame, limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only behind a size check; otherwise leave the choice to
    the planner (autoBroadcastJoinThreshold + AQE), which also checks sizes."""
    size = estimated_bytes(df)
    if size is not None and size <= limit:
        return F.broadcast(df)
    return df


def lookup(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, how: str = "left") -> DataFrame:
    """Fact -> dimension equi-join on differently named keys; the dimension key
    column is dropped from the output."""
    d = broadcast_if_small(dim)
    return fact.join(d, fact[fact_key] == d[dim_key], how).drop(d[dim_key])
