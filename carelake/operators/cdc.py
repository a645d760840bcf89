"""Change application and control-log helpers.

``apply_changes`` keeps, per key, the change with the greatest sequence
(ties broken by every other column, DESC NULLS LAST) and drops keys whose
winning change is a delete. A key's changes are reduced to one row where they
are read (``latest_per_key``). It gives the whole state anew;
``keyed_store.merge_changes`` rewrites only the buckets that a batch touches.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.operators.dedup import latest_per_key


def apply_changes(
    snapshot: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    sequence: str,
    op_col: str = "_op",
    delete_value: str = "delete",
) -> DataFrame:
    """snapshot (no op column) + changes (with op column) -> current state."""
    base = snapshot.withColumn(op_col, F.lit("upsert"))
    merged = base.unionByName(changes.select(*base.columns))
    latest = latest_per_key(merged, keys, [sequence])
    return latest.where(F.col(op_col) != delete_value).drop(op_col)


def evolved_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of frames whose schemas have drifted: columns meet by name, a column that a frame lacks is null
    in its rows, and numbers take the widest type."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
