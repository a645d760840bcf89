"""The latest row of each key, kept by a stream.

readStream over a landing folder -> watermark on the event time ->
transformWithState: a key's state is its latest row, and a timer at that row's
time plus ``idle`` marks the key as idle and drops its state -> a keyed table,
merged batch by batch. The state holds one row for each active key; late rows
and idle keys are the watermark's. A query that was stopped goes on from its
checkpoint, and the table passes over a batch that it already holds, so that
each batch counts once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from carelake.operators.keyed_store import KeyedStore, merge_changes
from carelake.session import ship

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: The watermark's column beside the rows, in which the event time is a number of microseconds.
EVENT_TIME = "_event_time"


class LatestRow(StatefulProcessor):
    """Gives a key's latest row whenever it changes, and once more, as idle, when its timer ends.

    A key's timer is known from its row, so that neither is searched for: a changed key costs one read and one write."""

    def __init__(self, schema: T.StructType, order: Sequence[str], idle_ms: int):
        self.schema, self.idle_ms = schema, idle_ms
        self.at = [schema.names.index(c) for c in order]
        self.out = Row(*schema.names, "idle")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", self.schema)

    def _rank(self, row: Sequence) -> tuple:
        return tuple((row[i] is not None, row[i]) for i in self.at)

    def _timer(self, row: Sequence) -> int:
        return row[self.at[0]] // 1000 + self.idle_ms

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        width = len(self.schema)
        top = tuple(max(rows, key=self._rank))[:width]
        held = self.latest.get()
        if held is not None and self._rank(top) <= self._rank(held):
            return
        if held is not None:
            self.handle.deleteTimer(self._timer(held))
        self.latest.update(top)
        self.handle.registerTimer(self._timer(top))
        yield self.out(*top, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.latest.get()
        if held is not None:
            yield self.out(*held, True)
            self.latest.clear()

    def close(self) -> None:
        pass


def output_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("idle", T.BooleanType())])


def run_latest(spark: SparkSession, landing_dir: str, schema: T.StructType, key: str, order: Sequence[str], store: KeyedStore, checkpoint_dir: str,
               delay: str = "1 hour", idle_ms: int = 86_400_000, max_files_per_trigger: int = 1000) -> None:
    """Work off what has landed since the last run (availableNow) and stop.

    ``order``: the event time, then what decides between equal times. ``store`` has the columns of
    ``output_schema(schema)`` and the key ``key``."""
    ship(spark)
    session = spark.newSession()  # its own settings: the caller's stay as they are
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    time = order[0]
    rows = session.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files_per_trigger)).parquet(landing_dir).withWatermark(time, delay)
    held = T.StructType([T.StructField(f.name, T.LongType()) if f.name == time else f for f in schema.fields])
    numbered = rows.select(*[F.unix_micros(time).alias(time) if c == time else c for c in schema.names], F.col(time).alias(EVENT_TIME))
    found = numbered.groupBy(key).transformWithState(LatestRow(held, order, idle_ms), output_schema(held), "Update", "EventTime")

    def merge(batch: DataFrame, number: int) -> None:
        # written once: each further read of the batch itself would run the state's changes again
        path = f"{store.path}/changes/batch={number}"
        batch.withColumn(time, F.timestamp_micros(time)).write.mode("overwrite").parquet(path)
        changes = batch.sparkSession.read.schema(store.schema).parquet(path)
        table = KeyedStore(batch.sparkSession, store.path, store.schema, store.keys, store.buckets)
        merge_changes(table, changes.withColumn("_op", F.lit("upsert")), time, batch=number)

    found.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination()
