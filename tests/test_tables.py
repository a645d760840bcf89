"""Saved tables: load loop, replacement, widening, control logs, findings on a target."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import types as T

from carelake.operators import control, validate
from carelake.sources import bronze


@pytest.fixture
def schema(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA {name} LOCATION '{tmp_path}/tables'")
    yield name
    spark.sql(f"DROP SCHEMA {name} CASCADE")


CONTRACT = validate.Contract("gold", ["k"], metrics=["n_count", "rate"])
PREVIOUS = T.StructType([T.StructField("k", T.StringType()), T.StructField("n_count", T.LongType()), T.StructField("gone", T.StringType())])


def _found(df):
    return {(r.check, r.subject): (r.value, r.passed) for r in df.collect()}


def test_target_findings(spark, schema):
    bronze.write_table(spark.createDataFrame([("a", "1", 0.5), ("b", "2", None)], "k string, n_count string, rate double"), f"{schema}.gold")
    got = _found(validate.target_findings(spark, f"{schema}.gold", CONTRACT, PREVIOUS, ["rate", "n_count", "days", "beds"]))
    assert got == {
        ("target_found", "gold"): (2.0, True),
        ("column_present", "k"): (None, True), ("column_present", "n_count"): (None, True), ("column_present", "rate"): (None, True),
        ("metric_is_number", "n_count"): (None, False), ("metric_is_number", "rate"): (None, True),
        ("metric_not_text", "n_count"): (None, False), ("metric_not_text", "rate"): (None, True),
        ("metric_coverage", "gold"): (0.5, True),
        ("column_kept", "k"): (None, True), ("column_kept", "n_count"): (None, False), ("column_kept", "gone"): (None, False),
    }


def test_target_findings_of_empty_and_missing_tables(spark, schema):
    bronze.write_table(spark.createDataFrame([], "k string, n_count long"), f"{schema}.none")
    got = _found(validate.target_findings(spark, f"{schema}.none", CONTRACT, PREVIOUS, ["days", "beds", "n_count"]))
    assert got["target_found", "gold"] == (0.0, True)
    assert got["column_present", "rate"] == (None, False) and got["metric_is_number", "rate"] == (None, False)
    assert got["metric_coverage", "gold"] == (pytest.approx(1 / 3), False)
    assert _found(validate.target_findings(spark, f"{schema}.nowhere", CONTRACT, PREVIOUS, [])) == {("target_found", "gold"): (None, False)}


def test_load_replaces_tables(spark, schema, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()

    def land(lines: int):
        for r in bronze.RESOURCES:
            (landing / f"{r}.ndjson").write_text("".join(f'{{"id": "{r}-{i}", "resourceType": "{r}"}}\n' for i in range(lines)))

    land(3)
    assert set(bronze.load_resources(spark, str(landing), schema).values()) == {3}
    land(2)
    counts = bronze.load_resources(spark, str(landing), schema)
    assert counts == {f"{schema}.{r.lower()}": 2 for r in bronze.RESOURCES}
    assert [r.table_name for r in bronze.list_tables(spark, schema).collect()] == sorted(r.lower() for r in bronze.RESOURCES)
    assert sorted(r.resource_id for r in spark.table(f"{schema}.claim").collect()) == ["Claim-0", "Claim-1"]
    assert bronze.table_exists(spark, f"{schema}.claim") and not bronze.table_exists(spark, f"{schema}.claims")


def test_replaced_table_takes_the_new_columns_and_is_widened(spark, schema):
    name = f"{schema}.t"
    bronze.write_table(spark.createDataFrame([(1, "x")], "a int, b string"), name)
    bronze.write_table(spark.createDataFrame([("1", 2.5)], "a string, c double"), name)
    bronze.append_evolving(spark, spark.createDataFrame([("new", "2")], "d string, a string"), name)
    assert spark.table(name).columns == ["a", "c", "d"]
    assert sorted(map(tuple, spark.table(name).collect())) == [("1", 2.5, None), ("2", None, "new")]


def test_latest_per_request_breaks_ties(spark):
    log = spark.createDataFrame([("r", "2026-01-01", 1, "z"), ("r", "2026-01-01", 2, "a"), ("q", None, 3, "b")], "request_id string, processed_at string, n int, status string")
    got = {r.request_id: r.status for r in control.latest_per_request(log, ties=["n"]).collect()}
    assert got == {"r": "a", "q": "b"}
