"""Joins on hot keys, many terms in texts, and reports as SQL texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from carelake.operators import profile, terms
from carelake.operators.skew_join import hot_keys, salted_join
from carelake.plans import sql_text


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_spread(spark, how):
    given = [("hot", i) for i in range(3000)] + [(f"k{i % 900}", i) for i in range(5000)] + [(None, i) for i in range(1000)]
    left = spark.createDataFrame(given, "k string, v long").repartition(4)
    right = spark.createDataFrame([("hot", "a"), ("hot", "b"), (None, "n")] + [(f"k{i}", "c") for i in range(0, 900, 3)], "k string, w string")
    got = salted_join(left, right, "k", how, share=0.05, salts=64)
    assert got.columns == ["k", "v", "w"] and rows(got) == rows(left.join(right, "k", how))
    assert [(r["k"], r["rows"]) for r in hot_keys(left, "k", 0.05).collect()] == [("hot", 3000)]
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        parts = salted_join(left, right, "k", how, share=0.05, salts=64).where("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
        plain = left.join(right.hint("merge"), "k", how).where("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    counts = [r["count"] for r in parts]
    assert len(plain) == 1 and len(counts) >= 14 and max(counts) <= 4 * 6000 / 16


def test_join_without_hot_keys_or_rows(spark):
    left = spark.createDataFrame([(i, i) for i in range(300)], "k long, v long")
    right = spark.createDataFrame([(i, "x") for i in range(0, 300, 2)], "k long, w string")
    assert hot_keys(left, "k", 0.05).count() == 0
    assert rows(salted_join(left, right, "k", share=0.05)) == rows(left.join(right, "k"))
    assert salted_join(left.where("false"), right, "k").count() == 0
    assert rows(salted_join(left, right.where("false"), "k", "left", share=0.05)) == rows(left.join(right.where("false"), "k", "left"))


def test_ten_thousand_terms(spark):
    rng = random.Random(5)
    listed = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(2, 7))) for _ in range(10_000)] + ["Ab", "aB", "", None, "zzzz", "é"]
    texts = [(i, "".join(rng.choice("abcdéABCD xyz") for _ in range(rng.randint(0, 300)))) for i in range(40)] + [(100, None), (101, ""), (102, "ZZZZZ"), (102, "ab")]
    got = terms.mentions(spark.createDataFrame(texts, "id long, body string"), "id", "body", spark.createDataFrame([(t,) for t in listed], "term string"))
    low = {t.lower() for t in listed if t}
    want = sorted((i, t) for i, body in texts for t in low if body and t in body.lower())
    assert rows(got) == sorted(want, key=str) and len(want) > 1000
    none = spark.createDataFrame([], "term string")
    assert terms.mentions(spark.createDataFrame(texts, "id long, body string"), "id", "body", none).count() == 0
    with pytest.raises(ValueError, match="more than 3"):
        terms.mentions(spark.createDataFrame(texts, "id long, body string"), "id", "body", spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "term string"), most=3)


def test_sql_texts_are_bound_and_faults_are_found(spark):
    sources = {"a.b": spark.createDataFrame([(1, "x"), (2, "y{z}")], "id long, v string"), "c": spark.createDataFrame([(2,)], "id long")}
    text = "SELECT t.id, v FROM {src:a.b} t JOIN {src:c} USING (id) JOIN {src:c} USING (id) WHERE v = 'y{z}'"
    assert sql_text.sources_of(text) == ["a.b", "c"]
    assert rows(sql_text.report(spark, text, sources)) == [(2, "y{z}")]
    texts = {"good": text, "lost": "SELECT * FROM {src:nope} JOIN {src:c} JOIN {src:gone}", "column": "SELECT nothing FROM {src:c}", "syntax": "SELEC 1"}
    found = rows(sql_text.findings(spark, texts, sources).select("report", "finding", "subject"))
    assert [(r, f) for r, f, _ in found] == [("column", "not analysed"), ("lost", "unknown source"), ("lost", "unknown source"), ("syntax", "not SQL")]
    assert {s for r, _, s in found if r == "lost"} == {"nope", "gone"}
    with pytest.raises(ValueError, match="nope"):
        sql_text.report(spark, texts["lost"], sources)


def test_profile_of_text_dates_and_samples(spark):
    df = spark.createDataFrame([("2024-01-02", "x", 1), ("2024-01-02T03:04", None, 2), ("01/02/2024 10:00", "2024", 3), (None, "", 4)], "a string, b string, n int")
    got = {r["column_name"]: tuple(r)[2:] for r in profile.text_dates(df, "t").collect()}
    assert got == {"a": (3, 1, 1, 1), "b": (3, 0, 0, 0)} and profile.text_dates(df.select("n"), "t") is None
    sample = profile.sample_rows(df, "t", ["n"], 2).collect()
    assert Counter(r["row_number"] for r in sample) == {1: 3, 2: 3} and {r["value"] for r in sample if r["row_number"] == 1} == {"2024-01-02", "x", "1"}
