"""References are read by columns; documents that columns don't fit give the same leaves by the parser."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from carelake.operators import profile

DOCS = [
    '{"a": {"b": ["Pa/1", "x", {"c": "Pa/2"}], "d": {}}, "e": [], "f": "{}", "g": null, "h": 3}', '"Pa/3"', "{", None, "", "null", '["Pa/9", ["Qa/8"]]', '{"a": "Pa/1", "a": "Pa/2"}',
    '{"a": "Pa/1", "n": NaN}', '{"a": "Pa/1"} x', '{"a": "Pa/1"}{"b": "Pa/2"}', '1, "e": 2', '{"t": "2024-01-01", "r": "Pa/5"}', '{"r": {"x": "Pa/6"}}', '{"r": "Pa/7\\n"}', '{"r": "Pa/7\\nq"}',
    '{"r": "Pa/"}', '{"r": "Pa\\/é"}', '{"": {"": "Pa/1", "x": "Pa/2"}}', '{"r": "Pa/\\ud800"}', '{"n": ' + "1" * 1200 + ', "r": "Pa/1"}', '{"r": "Pa/' + "z" * 2000 + '"}', ' {"r" : "Pa/8"}\n',
    '{"r": "Pa/8",}', '{"n": 1e999, "r": "Pa/1"}', '{"n": 01, "r": "Pa/1"}', '{"r": ["Pa/1", 2]}',
]


def _frame(spark, docs):
    rows = [("AB"[i % 2] if i % 5 else None, f"{i % 7}" if i % 3 else None, d) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "resource_type string, resource_id string, raw_json string")


def _rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def _parsed(frame):
    v = F.col("value")
    leaves = profile.json_leaves(frame, keep=("resource_type",), only=lambda text: text.rlike(profile.REFERENCE))
    return leaves.select("resource_type", "path", F.regexp_extract(v, profile.REFERENCE, 1), F.regexp_extract(v, profile.REFERENCE, 2))


def test_references_by_columns_equal_parsed_ones(spark):
    good = [f'{{"r": "Pa/{i}", "t": "2024-01-01T00:00:00Z", "l": [{{"q": "Qa/{i}"}}]}}' for i in range(2500)]
    own_names = [f'{{"k{i}": "Pa/{i}"}}' for i in range(2500)]
    for docs in (DOCS * 3, good, own_names, DOCS + good):
        frame = _frame(spark, docs)
        parsed = _rows(_parsed(frame))
        assert parsed and _rows(profile.references(frame)) == parsed
    many_types = _frame(spark, good[:100]).withColumn("resource_type", F.col("raw_json"))
    assert _rows(profile.references(many_types)) == _rows(_parsed(many_types))


def test_join_keys_of_the_documents_own_ids(spark):
    frame = spark.createDataFrame(
        [("Pa", "1", '{"id": "1"}'), ("Pa", "1", '{"id": "1"}'), ("Pa", None, '{"r": "Pa/1"}'), ("Qa", "2", '{"r": "Pa/1", "s": ["Pa/3", "Ra/1"]}'), ("Qa", "3", "{"), (None, "3", '{"r": "Qa/3"}')],
        "resource_type string, resource_id string, raw_json string",
    )
    got = {(r["resource_type"], r["path"], r["target_type"]): (r["references"], r["hits"], r["hit_ratio"]) for r in profile.suggest_join_keys(frame).collect()}
    assert got == {("Pa", "r", "Pa"): (1, 1, 1.0), ("Qa", "r", "Pa"): (1, 1, 1.0), ("Qa", "s[]", "Pa"): (1, 0, 0.0), ("Qa", "s[]", "Ra"): (1, 0, 0.0), (None, "r", "Qa"): (1, 1, 1.0)}
    assert _rows(profile.suggest_join_keys(frame, frame.select("resource_type", "resource_id"))) == _rows(profile.suggest_join_keys(frame))


def test_lines_are_made_once_for_join_keys(spark, small_dir):
    plan = entry.queries()["suggest_join_keys"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Generate json_tuple\(", plan)) == 8


def test_leaves_that_all_stay_are_not_filtered_by_level(spark):
    plan = profile.profile_dates(_frame(spark, DOCS))._jdf.queryExecution().optimizedPlan().toString()
    # the text of a variant is made where a leaf is found, not for a filter at each level too
    assert plan.count("Filter") <= 2
