"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.session import checkpoint_dir, ship

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
find_words = re.compile(WORD).findall

#: Characters handled at once inside a task, so that numpy's arrays stay small
#: whatever the Arrow batch holds. A longer text is a chunk of its own.
CHUNK_CHARS = 750_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the cluster's shared folder and read them back.

    This cuts the lineage: later stages read files, which outlive executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"
    # small row groups: a task holds one in memory while it writes
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1))


def chunks(pdf: pd.DataFrame, column: str = "text", limit: int = CHUNK_CHARS) -> Iterator[pd.DataFrame]:
    """Consecutive slices of a batch with about ``limit`` characters each; null texts become empty."""
    if pdf.empty:
        return
    pdf = pdf.assign(**{column: pdf[column].fillna("")})
    part = pdf[column].str.len().cumsum() // limit
    for _, piece in pdf.groupby(part.to_numpy(), sort=True):
        yield piece.reset_index(drop=True)


def row_key(*columns: str) -> Column:
    """64-bit key of a row, the same for equal rows and for any partitioning."""
    return F.xxhash64(*columns)


def release() -> None:
    """Give a Python worker's free memory back. Workers stay for later stages, and several are kept by an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, releasing memory when the task is done."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole
