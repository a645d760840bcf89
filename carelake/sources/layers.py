"""Stored bronze and silver layers.

The landing files are loaded into bronze tables once and reports scan those
tables. Here a layer is written as Parquet on its first use in an application,
to a folder of its own below the session's shared folder, and scanned from then
on: column pruning and filters reach columnar files, and a lost executor costs
a scan, not the ingest. Layers belong to the application that wrote them; a
later one writes its own, so nothing stale is read. ``forget`` drops them, for
inputs that change while the application runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from carelake.session import checkpoint_dir

ROW_GROUP = 8 << 20

#: Where a layer is, and its columns: a scan that is told them needs no job that reads them from the files.
_written: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def layer(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The layer ``name`` over the tables in ``sf_dir``; ``build`` makes its rows on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = f"{checkpoint_dir(spark).rstrip('/')}/layers/{name}-{uuid.uuid4().hex}"
        # row groups of this size let a scan split a file, however few files the job wrote
        rows = build()
        rows.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        _written[key] = path, rows.schema
    path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)


def written(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether this application has written the layer."""
    return (spark.sparkContext.applicationId, sf_dir, name) in _written


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write rows that a job needs more than once, as they are partitioned, to a folder of its own, and read them back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget() -> None:
    _written.clear()
