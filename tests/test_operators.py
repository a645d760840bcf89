"""Scale-safe operators vs their plain formulations on small data,
including a key that holds a large share of the rows."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from carelake.operators.dedup import latest_per_key
from carelake.operators.interval_join import exists_within
from carelake.operators.windows import day_segment, plain_lag, segmented_lag


def _events(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 40)}"
        t = None if rnd.random() < 0.03 else base + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 20))
        rows.append((key, t, i, rnd.randint(0, 5), rnd.choice([0, 1])))
    return spark.createDataFrame(rows, "k string, t timestamp, id long, v int, flag int")


def test_segmented_lag_matches_plain_window(spark):
    df = _events(spark)
    order = ["t", "id"]
    a = segmented_lag(df, ["k"], order, ["v", "flag"], day_segment(F.col("t")))
    b = plain_lag(df, ["k"], order, ["v", "flag"])
    cols = ["k", "id", "prev_v", "prev_flag"]
    assert sorted(a.select(*cols).collect()) == sorted(b.select(*cols).collect())


def test_exists_within_matches_brute_force(spark):
    left = _events(spark, 800, seed=1).select("k", F.col("t").alias("ts"), "id")
    right = _events(spark, 800, seed=2).select("k", F.col("t").alias("rts"))
    got = {r["id"]: r["hit"] for r in exists_within(left, right, "k", "ts", "rts", 6 * 3600, "hit").collect()}
    lp, rp = left.toPandas(), right.toPandas()
    for _, r in lp.iterrows():
        if pd.isna(r.ts) or r.k is None:
            want = 0
        else:
            m = rp[(rp.k == r.k) & (rp.rts >= r.ts) & (rp.rts <= r.ts + pd.Timedelta(hours=6))]
            want = int(len(m) > 0)
        assert got[r.id] == want


def test_latest_per_key_matches_row_number(spark):
    df = _events(spark, 2000, seed=3)
    a = latest_per_key(df, ["k"], ["t", "v"])
    w = Window.partitionBy("k").orderBy(F.col("t").desc_nulls_last(), F.col("v").desc_nulls_last(),
                                        F.col("id").desc_nulls_last(), F.col("flag").desc_nulls_last())
    b = df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    assert sorted(a.collect()) == sorted(b.select(*df.columns).collect())


def test_readmission_helper_equals_pairwise_join(spark, small_dir):
    from carelake.plans import readmission_helper
    from carelake.plans.model import Model
    from carelake.functions import fhir

    m = Model(spark, small_dir)
    enc, cond = m.silver("encounter"), m.silver("condition")
    fast = readmission_helper.build(spark, {"encounter": enc, "condition": cond})["readmission_risk_monthly"]
    e = enc.select(fhir.strip_prefix("patient_ref", "Patient/").alias("patient_id"), "encounter_id",
                   F.col("class_code").alias("encounter_class"), "period_start")
    c = cond.select(fhir.strip_prefix("patient_ref", "Patient/").alias("patient_id"), F.col("display").alias("condition_name"))
    slow = e.join(c, "patient_id").groupBy(
        F.date_trunc("month", F.try_to_timestamp("period_start")).cast("date").alias("month"), "condition_name", "encounter_class"
    ).agg(F.count("encounter_id").alias("encounter_count"), F.countDistinct("patient_id").alias("unique_patients"))
    assert sorted(map(repr, fast.collect())) == sorted(map(repr, slow.select(*fast.columns).collect()))


def test_profile_outliers_exact(spark):
    from carelake.operators.profile import profile_outliers

    rnd = random.Random(5)
    for vals in ([float(rnd.gauss(100, 15)) for _ in range(5000)] + [1000.0, -1000.0], [1.0, 2.0, 3.0], [7.0] * 900 + [8.0] * 100, [5.0]):
        df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
        row = profile_outliers(df, "t", ["x"]).first()
        ordered = sorted(vals)
        q1, q2, q3 = (ordered[-(-len(vals) * p // 4) - 1] for p in (1, 2, 3))
        assert (row["q1"], row["median"], row["q3"]) == (q1, q2, q3)
        assert row["outliers"] == sum(v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1) for v in vals)
        assert (row["row_count"], row["distinct_count"]) == (len(vals) + 1, len(set(vals)))
    assert profile_outliers(spark.createDataFrame([(None,)], "x double"), "t", ["x"]).first()["q1"] is None


def test_term_mentions_substring(spark):
    from carelake.operators.profile import term_mentions

    df = spark.createDataFrame([(1, "The Patient claim was paid"), (2, "nothing here")], "doc_id long, text string")
    got = sorted((r.doc_id, r.term) for r in term_mentions(df, "doc_id", "text", ["patient", "claim", "order"]).collect())
    assert got == [(1, "claim"), (1, "patient")]


def test_cdc_apply_upsert_and_delete(spark):
    from carelake.operators.cdc import apply_changes

    snap = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "k string, seq int, v int")
    ch = spark.createDataFrame([("a", 2, 11, "upsert"), ("b", 2, None, "delete"), ("c", 3, 30, "upsert")],
                               "k string, seq int, v int, _op string")
    got = sorted(tuple(r) for r in apply_changes(snap, ch, ["k"], "seq").collect())
    assert got == [("a", 2, 11), ("c", 3, 30)]


def test_evolved_union(spark):
    from carelake.operators.cdc import evolved_union

    a = spark.createDataFrame([("a", 1)], "k string, n int")
    b = spark.createDataFrame([("x", 2.5, "b")], "extra string, n double, k string")
    got = evolved_union([a, b])
    assert got.dtypes == [("k", "string"), ("n", "double"), ("extra", "string")]
    assert sorted(map(tuple, got.collect())) == [("a", 1.0, None), ("b", 2.5, "x")]


def test_expect_or_drop_quarantine(spark):
    from carelake.plans.claims_by_patient import expect_or_drop

    df = spark.createDataFrame([("p1", 1), (None, 2)], "patient_id string, n int")
    kept, q = expect_or_drop(df, {"not_null_patient_id": "patient_id IS NOT NULL"})
    assert [r.n for r in kept.collect()] == [1]
    assert [r._failed_rules for r in q.collect()] == [["not_null_patient_id"]]


def _walk(doc, path=""):
    """Plain-Python reference: every non-null scalar leaf as (path, text)."""
    if isinstance(doc, dict):
        for k, v in doc.items():
            yield from _walk(v, f"{path}.{k}" if path else k)
    elif isinstance(doc, list):
        for x in doc:
            yield from _walk(x, path + "[]")
    elif doc is not None:
        yield path, ("true" if doc is True else "false" if doc is False else str(doc))


def test_json_leaves_matches_python_walk(spark):
    import json

    from carelake.operators.profile import json_leaves

    docs = [
        ("A", "a1", {"id": "a1", "item": [{"enc": [{"ref": "E/1"}, {"ref": "E/2"}]}, {"enc": None}, {"x": 3}], "n": 7}),
        ("A", "a2", {"id": "a2", "item": [], "flag": True, "name": [{"given": ["Ann", "B"]}, {"given": None}]}),
        ("B", "b1", {"id": "b1", "period": {"start": "2024-01-02T00:00:00+00:00", "end": None}}),
        # without a type, and with fields of another shape than before
        (None, "n1", {"id": "n1", "resource.dotted": {"x": 1.50}}),
        ("B", "b2", {"id": "b2", "period": "2024", "x": {"y": 1}}),
        ("B", "b3", {"id": "b3", "period": [1, "two", [True]], "x": 2}),
    ]
    frames = [
        spark.createDataFrame([(t, i, json.dumps(d)) for t, i, d in docs if t == "A"] + [("A", "bad", "{not json"), ("A", "blank", ""), ("A", "null", None)], "resource_type string, resource_id string, raw_json string"),
        spark.createDataFrame([(t, i, json.dumps(d)) for t, i, d in docs if t != "A"], "resource_type string, resource_id string, raw_json string"),
    ]
    got = sorted((tuple(r) for r in json_leaves(frames).collect()), key=str)
    want = sorted(((t, i, p, v) for t, i, d in docs for p, v in _walk(d)), key=str)
    assert got == want


def test_json_leaves_of_deep_documents(spark):
    from carelake.operators.profile import json_leaves, profile_dates

    def nested(levels):
        return '{"a":' * levels + '"2024-01-02"' + "}" * levels

    def frame(*documents):
        return spark.createDataFrame([("A", "a", d) for d in documents], "resource_type string, resource_id string, raw_json string")

    texts = ['"{not a container}"', '{"t":"[text]","e":{},"f":[[]],"s":"{}"}', nested(8)]
    got = {(r["path"], r["value"]) for r in json_leaves(frame(*texts)).collect()}
    assert got == {("", "{not a container}"), ("t", "[text]"), ("s", "{}"), (".".join("a" * 8), "2024-01-02")}
    with pytest.raises(Exception, match="nested deeper"):
        json_leaves(frame(nested(9))).collect()
    assert json_leaves(frame(nested(9)), levels=9).count() == 1
    # parsed where it is read, counted in the same stage: one exchange, no Python
    plan = profile_dates(frame(*texts))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


def test_outliers_in_many_ranges(spark):
    """Quartiles over ranges of values, with a value that a third of all rows hold."""
    import numpy as np

    from carelake.operators.profile import profile_outliers

    rng = np.random.default_rng(3)
    values = [None] * 40 + [7.5] * 700 + [float(round(x, 3)) for x in rng.normal(10, 30, 1400)] + [1e6, -1e6, float("-0.0"), 0.0]
    frame = spark.createDataFrame([(v, None, 3) for v in values], "a double, b double, c int")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many ranges as shuffle partitions
    try:
        got = {r["column_name"]: r for r in profile_outliers(frame, "t", ["a", "b", "c"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    held = sorted(v for v in values if v is not None)
    q = [held[int(np.ceil(s * len(held))) - 1] for s in (0.25, 0.5, 0.75)]
    low, high = q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])
    a = got["a"]
    assert [a["q1"], a["median"], a["q3"]] == q and (a["low_fence"], a["high_fence"]) == (low, high)
    assert a["outliers"] == sum(v < low or v > high for v in held) and a["distinct_count"] == len(set(held)) and a["row_count"] == len(values)
    assert got["b"]["q1"] is None and got["b"]["distinct_count"] == 0 and got["b"]["null_share"] == 1 and got["b"]["outliers"] == 0
    assert (got["c"]["q1"], got["c"]["q3"], got["c"]["distinct_count"], got["c"]["outliers"]) == (3.0, 3.0, 1, 0)


def test_exists_within_boundaries_and_hot_key(spark):
    base = dt.datetime(2024, 3, 1, 12, 0)
    h = dt.timedelta(hours=1)
    left = spark.createDataFrame(
        [("a", base, 1), ("a", base, 2), ("b", base, 3), ("c", base, 4), ("d", None, 5), (None, base, 6)]
        + [("hot", base + i * h, 100 + i) for i in range(60)],
        "k string, ts timestamp, id long",
    )
    right = spark.createDataFrame(
        [("a", base), ("b", base + 24 * h), ("c", base + 24 * h + dt.timedelta(seconds=1)), ("c", base - dt.timedelta(seconds=1)),
         ("d", base)]
        + [("hot", base + (3 * i + 0.5) * h) for i in range(10)],
        "k string, rts timestamp",
    )
    got = {r["id"]: r["hit"] for r in exists_within(left, right, "k", "ts", "rts", 24 * 3600, "hit").collect()}
    # equal time and the upper bound are inside; one second outside either end is not
    assert (got[1], got[2], got[3], got[4], got[5], got[6]) == (1, 1, 1, 0, 0, 0)
    last_right = base + 27.5 * h
    for i in range(60):
        t = base + i * h
        assert got[100 + i] == int(t <= last_right), i


def test_duplicate_lines_by_digest_equals_text_grouping(spark):
    from carelake.operators import dq

    rows = [("hot", '{"id":"hot","v":1}')] * 400 + [("hot", '{"id":"hot","v":2}'), ("hot", '{"id":"hot","v":3}')]
    rows += [("a", '{"id":"a"}'), ("a", '{"id":"a" }'), ("b", '{"id":"b"}'), ("b", '{"id":"b"}'), ("c", '{"id":"c"}')]
    frame = spark.createDataFrame(rows, "resource_id string, raw_json string").repartition(5)

    class Stub:
        def bronze(self, resource):
            return frame if resource == "claim" else frame.limit(0)

    got = sorted((r["resource_id"]) for r in dq.duplicate_lines(Stub()).collect())
    want = sorted(
        r["resource_id"]
        for r in frame.groupBy("resource_id", "raw_json").count().where("count > 1").collect()
    )
    assert got == want == ["b", "hot"]


def test_segmented_lag_with_null_partition_keys(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(None if i % 3 == 0 else f"k{i % 2}", base + dt.timedelta(hours=7 * i), i, i * 10, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, t timestamp, id long, v int, flag int")
    order = ["t", "id"]
    a = segmented_lag(df, ["k"], order, ["v", "flag"], day_segment(F.col("t")))
    b = plain_lag(df, ["k"], order, ["v", "flag"])
    cols = ["k", "id", "prev_v", "prev_flag"]
    assert sorted(a.select(*cols).collect(), key=str) == sorted(b.select(*cols).collect(), key=str)


def test_every_row_rule_fires_on_the_planted_defects(spark):
    """A rule that never fires would pass any comparison; on sf0.01 each has rows, on sf0.001 some residues are beyond the keys."""
    from carelake.operators import dq
    from carelake.plans.model import Model

    found = {tuple(r) for r in dq.row_rule_detections(Model(spark, "/root/testdata/sf0.01", stored=False)).select("resource_type", "anomaly_type", "detail").distinct().collect()}
    expected = {(dq.RESOURCE_TYPES[r.resource][0], r.anomaly_type, r.detail) for r in dq.ROW_RULES}
    assert found == expected
