"""Tables in key buckets, views refreshed from new rows, comparison by checksums, and the stream that keeps latest rows."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.operators import cdc, validate
from carelake.operators.keyed_store import KeyedStore, MaterializedView, merge_changes
from carelake.streaming import latest

ROW = T.StructType([T.StructField("k", T.StringType()), T.StructField("at", T.LongType()), T.StructField("v", T.StringType())])


def files(store):
    return {p: os.path.getmtime(p) for p in glob.glob(f"{store.path}/data/*/bucket=*/*.parquet")}


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def changes(spark, *given):
    return spark.createDataFrame(given, "k string, at long, v string, _op string")


def test_changes_rewrite_touched_buckets_only(spark, tmp_path):
    store = KeyedStore.create(spark, str(tmp_path / "s"), ROW, ["k"], buckets=16)
    assert store.read().collect() == [] and store.folders() == {}
    first = changes(spark, *[(f"k{i}", 1, "a", "upsert") for i in range(200)], (None, 1, "none", "upsert"))
    assert merge_changes(store, first, "at", batch=0) == 16
    before, at = files(store), store.folders()
    second = changes(spark, ("k3", 2, "b", "upsert"), ("k4", 2, None, "delete"), ("k5", 0, "older", "upsert"), ("new", 2, "c", "upsert"), ("k3", 3, "last", "upsert"))
    touched = merge_changes(store, second, "at", batch=1)
    assert 1 <= touched <= 4
    after = files(store)
    # files of the first version stay as they are, and all buckets but the touched ones are read from them
    assert all(after[p] == t for p, t in before.items())
    assert sum(at[b] != v for b, v in store.folders().items()) <= touched
    whole = cdc.apply_changes(cdc.apply_changes(spark.createDataFrame([], ROW), first, ["k"], "at"), second, ["k"], "at")
    assert rows(store.read()) == rows(whole)
    # a batch that is there already, as after a restart, changes nothing
    assert merge_changes(store, second, "at", batch=1) == 0 and files(store) == after
    assert rows(store.read(buckets=[0, 1])) == [r for r in rows(whole.withColumn("b", store.bucket()).where("b < 2").drop("b"))]
    # opened anew
    assert rows(KeyedStore(spark, store.path, ROW, ["k"], 16).read()) == rows(whole)


def test_deletes_can_empty_buckets_and_the_table(spark, tmp_path):
    store = KeyedStore.create(spark, str(tmp_path / "s"), ROW, ["k"], buckets=4)
    merge_changes(store, changes(spark, ("a", 1, "x", "upsert"), ("b", 1, "x", "upsert")), "at")
    merge_changes(store, changes(spark, ("a", 2, None, "delete"), ("b", 2, None, "delete")), "at")
    assert store.read().collect() == [] and store.folders() == {}
    assert merge_changes(store, changes(spark), "at") == 0
    merge_changes(store, changes(spark, ("a", 3, "back", "upsert")), "at")
    assert rows(store.read()) == [("a", 3, "back")]


def test_a_failed_merge_leaves_the_table(spark, tmp_path):
    store = KeyedStore.create(spark, str(tmp_path / "s"), ROW, ["k"], buckets=4)
    merge_changes(store, changes(spark, ("a", 1, "x", "upsert")), "at", batch=0)
    with pytest.raises(Exception, match="stop"):
        store.merge(changes(spark, ("a", 2, "y", "upsert")), lambda old, new: new.withColumn("v", F.raise_error(F.lit("stop")).cast("string")), batch=1)
    assert rows(store.read()) == [("a", 1, "x")]
    assert merge_changes(store, changes(spark, ("a", 2, "y", "upsert")), "at", batch=1) == 1
    assert rows(store.read()) == [("a", 2, "y")]


def test_view_refreshed_from_new_rows_equals_the_rebuild(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType()), T.StructField("total", T.DecimalType(28, 2)), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())])
    view = MaterializedView(
        KeyedStore.create(spark, str(tmp_path / "v"), schema, ["k"], buckets=8),
        {"n": (F.count(F.lit(1)), "sum"), "total": (F.sum(F.col("x").cast("decimal(18,2)")), "sum"), "low": (F.min("x"), "min"), "high": (F.max("x"), "max")},
        F.col("k").isNotNull(),
    )
    given = [[(None if i % 17 == 0 else f"k{(i * i + b) % 40}", i - 50 * b) for i in range(150)] for b in range(2)] + [[("k1", 1000)]]
    deltas = [spark.createDataFrame(g, "k string, x long") for g in given]
    touched = [view.refresh(d, b) for b, d in enumerate(deltas)]
    assert touched[2] == 1 and view.refresh(deltas[0], 0) == 0
    whole = spark.createDataFrame(sum(given, []), "k string, x long").where("k is not null").groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"), F.min("x").alias("low"), F.max("x").alias("high"))
    assert rows(view.read()) == rows(whole)


def test_comparison_by_digest_reads_unequal_buckets(spark):
    def frame(given):
        return spark.createDataFrame(given, "a string, b string, m double, n long")

    base = [(f"a{i}", None if i % 7 == 0 else "b", float(i), i) for i in range(500)]
    other = list(base)
    other[3] = (*base[3][:2], 3.5, 3)  # differs
    other[10] = (*base[10][:2], None, 10)  # null on one side
    del other[20]  # missing
    other += [("z", "b", 1.0, 1), base[30], base[30]]  # only here; a key twice, in pairs
    assert validate.unequal_buckets(frame(base), frame(base[::-1]), ["a", "b"], ["m", "n"], 64).collect() == []
    unequal = validate.unequal_buckets(frame(base), frame(other), ["a", "b"], ["m", "n"], 64).count()
    assert 2 <= unequal <= 5
    got = validate.reconcile_by_digest(frame(base), frame(other), ["a", "b"], ["m", "n"], buckets=64)
    assert rows(got) == rows(validate.reconcile_rows(frame(base), frame(other), ["a", "b"], ["m", "n"])) and got.count() >= 4
    # equal texts in other columns, and null against empty, are told apart
    assert validate.unequal_buckets(frame([("x", "", 1.0, None)]), frame([("x", None, 1.0, None)]), ["a"], ["b"], 4).count() == 1


def test_validation_of_any_type(spark):
    df = spark.sql("SELECT * FROM VALUES (1, map('a', 1), array(1, 2), 5), (1, map('a', 1), array(1, 2), 5), (2, NULL, NULL, -1), (NULL, NULL, NULL, NULL) AS t(k, m, l, row_count)")
    got = {r["check"]: (r["value"], r["passed"]) for r in validate.validate_output(df, ["k"]).collect()}
    assert got["not_empty"] == (4.0, True) and got["duplicate_ratio"] == (0.25, True) and got["grain_not_null"] == (1.0, False)
    assert got["non_negative:row_count"] == (1.0, False) and got["not_all_null:m"] == (2.0, True)
    empty = {r["check"]: r["passed"] for r in validate.validate_output(df.where("false"), ["k"]).collect()}
    assert not empty["not_empty"] and empty["not_all_null:m"]


EVENT = T.StructType([T.StructField("user", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("id", T.LongType()), T.StructField("kind", T.StringType())])


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)

    def event(user, hours, number, kind="x"):
        return (user, start + dt.timedelta(hours=hours), number, kind)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    store = KeyedStore.create(spark, str(tmp_path / "latest"), latest.output_schema(EVENT), ["user"], buckets=4)

    def run(given):
        spark.createDataFrame(given, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        latest.run_latest(spark, str(tmp_path / "landing"), EVENT, "user", ["ts", "id"], store, str(tmp_path / "checkpoint"), "1 hour", 10 * 3_600_000)
        return {r["user"]: (r["id"], r["idle"]) for r in store.read().collect()}

    first = run([event(1, 0, 1), event(1, 2, 2), event(2, 1, 3), event(2, 1, 4), event(3, 20, 5), event(1, 1, 6)])
    assert first == {1: (2, True), 2: (4, True), 3: (5, False)}  # watermark at 19 h
    # user 1 comes back, user 2 sends a row that is too late, user 3 one that is late within the delay
    second = run([event(1, 21, 7), event(2, 3, 8), event(3, 19.5, 9), event(4, 22, 10)])
    assert second == {1: (7, False), 2: (4, True), 3: (5, False), 4: (10, False)}
    # the whole state is in the checkpoint and the table: nothing new, nothing changes
    third = run([event(5, 40, 11)])
    assert third == {1: (7, True), 2: (4, True), 3: (5, True), 4: (10, True), 5: (11, False)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_stream_of_null_keys_makes_each_batch_once(spark, tmp_path, monkeypatch):
    start = dt.datetime(2024, 1, 1)
    given = [(user, start + dt.timedelta(minutes=7 * n, microseconds=n), n, None if n % 5 == 0 else "x") for n, user in enumerate([None, 1, 2, None, 3, 1, 4, None, 2, 5, 6, 1, None, 7])]
    store = KeyedStore.create(spark, str(tmp_path / "latest"), latest.output_schema(EVENT), ["user"], buckets=4)
    files, merge = [], latest.merge_changes

    def seen(table, changes, *args, **kwargs):
        files.append(len(changes.inputFiles()))
        return merge(table, changes, *args, **kwargs)

    monkeypatch.setattr(latest, "merge_changes", seen)
    spark.createDataFrame(given, EVENT).coalesce(1).write.parquet(str(tmp_path / "landing"))
    latest.run_latest(spark, str(tmp_path / "landing"), EVENT, "user", ["ts", "id"], store, str(tmp_path / "checkpoint"), "1 hour", 10 * 3_600_000)
    got = {(r["user"], r["ts"], r["id"], r["kind"], r["idle"]) for r in store.read().collect()}
    assert got == {(*row, False) for row in {row[0]: row for row in given}.values()} and store.read().count() == 8
    # a merge reads its changes twice: they come from files, not from the state
    assert files and all(files)
