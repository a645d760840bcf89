"""A table in buckets of its key, of which a change rewrites only the buckets it touches.

Rows are written as Parquet below ``data/version=v/bucket=b``, where a bucket
is a hash of the key. A version of the table is a manifest: for each bucket
the folder version that holds it, written after the data, so that a reader
sees a whole version or none of it, and a run that fails half-way leaves the
table as it was. Merging reads and writes the touched buckets alone; the files
of all others stay and are named by the next manifest as well.

A merge may carry the number of its batch. A batch that the manifest already
holds is passed over, so that a restarted job applies each batch once even
where the merge adds up.

The driver holds the manifest: one row for each bucket, a number fixed when
the table is made.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.operators.dedup import latest_per_key

MANIFEST = "version long, bucket int, data_version long, batch long"


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64) -> KeyedStore:
        """A new table without rows; the constructor opens one that is there."""
        store = cls(spark, path, schema, keys, buckets)
        store._commit(0, {}, -1)
        return store

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> tuple[int, int, dict[int, int]]:
        """(version, last batch, bucket to folder version)."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        held = rows.where(F.col("version") == rows.groupBy().agg(F.max("version")).first()[0]).collect()
        return held[0]["version"], held[0]["batch"], {r["bucket"]: r["data_version"] for r in held if r["bucket"] >= 0}

    def _commit(self, version: int, folders: dict[int, int], batch: int) -> None:
        # bucket -1 stands for a table without rows
        rows = [(version, b, v, batch) for b, v in sorted(folders.items())] or [(version, -1, 0, batch)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _scan(self, folders: dict[int, int]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The newest version, or the given buckets of it."""
        _, _, folders = self._manifest()
        return self._scan(folders if buckets is None else {b: v for b, v in folders.items() if b in set(buckets)})

    def folders(self) -> dict[int, int]:
        """Where the newest version has its buckets: bucket to folder version."""
        return self._manifest()[2]

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> int:
        """Replace the touched buckets by ``combine(their rows, changes)``; the number of buckets touched.

        ``changes`` has the key columns; ``combine`` gives rows of the table's columns."""
        version, last, folders = self._manifest()
        if batch is not None and batch <= last:
            return 0
        # as many rows as buckets at most
        touched = {r[0] for r in changes.select(self.bucket()).distinct().collect()}
        old = self._scan({b: v for b, v in folders.items() if b in touched})
        names = [f.name for f in self.schema.fields]
        new = combine(old, changes).select(*names).withColumn("bucket", self.bucket())
        data = f"{self.path}/data/version={version + 1}"
        # one exchange by bucket and key: a bucket of many rows has several tasks and files
        new.repartition("bucket", F.pmod(F.xxhash64(F.lit("file"), *self.keys), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(data)
        # a bucket that has no rows left has no folder
        written = {r[0] for r in self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(data).select("bucket").distinct().collect()} if touched else set()
        after = {b: v for b, v in folders.items() if b not in touched} | {b: version + 1 for b in written}
        self._commit(version + 1, after, last if batch is None else batch)
        return len(touched)


def merge_changes(store: KeyedStore, changes: DataFrame, sequence: str, op_col: str = "_op", delete_value: str = "delete", batch: int | None = None) -> int:
    """Apply a change feed: per key the row with the greatest sequence stays, and a delete removes its key.

    Deletes leave nothing behind: a change older than a delete must come in the same batch or an earlier one."""
    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn(op_col, F.lit("upsert")).unionByName(new.select(*old.columns, op_col))
        return latest_per_key(both, store.keys, [sequence]).where(F.col(op_col) != delete_value).drop(op_col)

    return store.merge(changes, combine, batch)


class MaterializedView:
    """An aggregation kept by key and refreshed from new rows only.

    ``partials`` maps each measure to its aggregate over rows and the way two partial results combine:
    (column, "sum" | "min" | "max"). Counts are sums of counts. ``where`` names the expectation that rows must
    meet to be counted."""

    COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}

    def __init__(self, store: KeyedStore, partials: dict[str, tuple[Column, str]], where: Column | None = None):
        self.store, self.partials, self.where = store, partials, where

    def _partial(self, rows: DataFrame) -> DataFrame:
        kept = rows if self.where is None else rows.where(self.where)
        return kept.groupBy(*self.store.keys).agg(*[column.alias(name) for name, (column, _) in self.partials.items()])

    def refresh(self, rows: DataFrame, batch: int) -> int:
        """Count ``rows`` in, once for each ``batch``; the number of buckets rewritten."""
        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.unionByName(new.select(*[F.col(f.name).cast(f.dataType) for f in self.store.schema.fields]))
            return both.groupBy(*self.store.keys).agg(*[self.COMBINE[how](name).cast(self.store.schema[name].dataType).alias(name) for name, (_, how) in self.partials.items()])

        return self.store.merge(self._partial(rows), combine, batch)

    def read(self) -> DataFrame:
        return self.store.read()
