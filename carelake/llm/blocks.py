"""All rows of an index against a stated query set, in blocks of each.

Rows are dealt to blocks and queries to groups by hash. A block of the index
is a few rows of packed bytes; it travels once to each group of queries, a
group once to each block, and the two meet in a task of their own (a cell). A
cell's memory depends on the sizes of a block and a group alone, whatever
values the rows hold, and a cell gives at most a few rows for each query.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most tasks that cells are dealt to; beyond it a task works through several cells, one after the other.
MOST_TASKS = 20_000
LONG = (-(2**63), 2**63 - 1)


def quantised(vectors: DataFrame, scale: int, *others: str) -> DataFrame:
    """Distinct (vec_id, *others, size, q): q holds floor(scale * x) for each component x as a double.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id, which
    no result can name. ``size`` is the number of components: only vectors of one size meet."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *others, F.col("embedding").cast("array<double>").alias("x"))
    x = x.where("vec_id is not null and x is not null").where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return x.select("vec_id", *others, F.size("x").alias("size"), F.transform("x", lambda v: F.floor(F.lit(float(scale)) * v)).alias("q")).distinct()


def dealt(name: str, pieces: int, *by: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(name), *by), F.lit(pieces)).cast("int").alias(name)


def pieces(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def cells(index: DataFrame, asked: DataFrame, n_blocks: int, n_groups: int, run: Callable, schema: str) -> DataFrame:
    """``run(key, index rows, query rows)`` on Arrow tables for each cell (size, block, grp).

    ``index`` has size and block, ``asked`` size and grp."""
    keys = ("size", "block", "grp")
    # hashing leaves some tasks without a cell and few with more than one
    tasks = min(4 * n_blocks * n_groups, MOST_TASKS)
    left = index.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).repartition(tasks, *keys)
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
