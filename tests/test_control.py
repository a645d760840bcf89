"""Control-data operators: lineage edges, spec checks, control logs."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import types as T

from carelake.operators import control


def test_lineage_edges_and_writers(spark):
    payload = {
        "upstreams": [
            {"notebookInfos": [{"notebook_id": "11", "url": "u1"}], "fileInfo": {"path": "/landing/a", "securable_type": "VOLUME"}},
            {"jobInfos": [{"job_id": "7", "job_name": "load"}], "pipelineInfos": [{"pipeline_id": "p", "pipeline_name": "pl"}]},
        ],
        "downstreams": [{"notebookInfos": [{"notebook_id": "22", "url": "u2"}]}],
    }
    df = spark.createDataFrame([("bronze.claim", json.dumps(payload)), ("bronze.patient", json.dumps({"upstreams": [
        {"notebookInfos": [{"notebook_id": "11", "url": "u1"}]}]}))], "table_fqn string, payload string")
    edges = control.lineage_edges(df)
    got = sorted((r.table_fqn, r.role, r.kind, r.id) for r in edges.collect())
    assert got == sorted([
        ("bronze.claim", "writer", "notebook", "11"), ("bronze.claim", "source", "file", "/landing/a"),
        ("bronze.claim", "writer", "job", "7"), ("bronze.claim", "writer", "pipeline", "p"),
        ("bronze.claim", "consumer", "notebook", "22"), ("bronze.patient", "writer", "notebook", "11"),
    ])
    assert [r.id for r in control.unique_writers(edges).collect()] == ["11"]


def test_spec_violations(spark):
    specs = spark.createDataFrame([
        ("R1", json.dumps({"request_id": "R1", "target_table": "gold.x", "bronze_sources": json.dumps(["bronze.claim", "bronze.nope"])})),
        ("R2", json.dumps({"request_id": "R2", "target_table": "", "open_questions": "none",
                           "bronze_sources": json.dumps([])})),
        ("R3", json.dumps({"request_id": "R3", "target_table": "silver.y"})),
    ], "request_id string, spec string")
    known = spark.createDataFrame([("bronze.claim",)], "table_name string")
    v = control.spec_violations(specs, known, ["request_id", "target_table", "bronze_sources"], "gold.")
    got = sorted((r.request_id, r.violation, r.detail) for r in v.collect())
    assert got == [
        ("R1", "unknown_source", "bronze.nope"),
        ("R2", "target_missing_without_question", None),
        ("R3", "missing_key", "bronze_sources"),
        ("R3", "target_prefix", "silver.y"),
    ]


def test_control_log_append_and_latest(spark):
    schema = T.StructType([T.StructField("request_id", T.StringType(), False), T.StructField("status", T.StringType()),
                           T.StructField("processed_at", T.TimestampType())])
    for rid, st, ts in [("R1", "new", "2026-10-01 10:00:00"), ("R1", "done", "2026-10-02 10:00:00"), ("R2", "new", "2026-10-01 11:00:00")]:
        control.append_control_row(spark, "intake_specs_t", {"request_id": rid, "status": st,
                                                              "processed_at": dt.datetime.fromisoformat(ts)}, schema)
    latest = {r.request_id: r.status for r in control.latest_per_request(spark.table("intake_specs_t")).collect()}
    assert latest == {"R1": "done", "R2": "new"}
