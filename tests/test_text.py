"""Wording of features and text statistics."""

import math

from pyspark.sql import functions as F

from pulsetrace.functions.text import entropy, sentence


def test_feature_text(spark):
    cases = [("iat_cv", 0.03, "interval CV 0.03 (highly regular)"),
             ("iat_cv", 0.15, "interval CV 0.15 (irregular)"),
             ("resp_bytes_is_zero", 1.0, "response bytes 0"),
             ("resp_bytes_is_zero", 0.5, "response bytes nonzero"),
             ("dest_fanin", 2.5, "destination fan-in 2"),
             ("periodicity_score", 1.0, "periodicity score 1.00"),
             ("orig_resp_byte_ratio", 2.25, "upload/download ratio 2.2"),
             ("iat_mean", 1234.5, "iat mean 1.23e+03")]
    rows = spark.createDataFrame([(i, [n], [v]) for i, (n, v, _) in enumerate(cases)], "i int, n array<string>, v array<double>")
    got = {r.i: r.text for r in rows.select("i", sentence("n", "v").alias("text")).collect()}
    for i, (_, _, text) in enumerate(cases):
        assert got[i] == text


def test_sentence(spark):
    row = spark.createDataFrame([(["iat_cv", "pkt_ratio"], [0.03, 3.625])],
                                "n array<string>, v array<double>")
    assert row.select(sentence("n", "v")).first()[0] == \
        "interval CV 0.03 (highly regular) · pkt ratio 3.62"


def test_entropy(spark):
    words = ["", "aaaa", "abab", "example.com", "x9$.*\\d"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", entropy(F.col("w")).alias("e")).collect()
    for r in rows:
        want = -sum(r.w.count(c) / len(r.w) * math.log2(r.w.count(c) / len(r.w)) for c in set(r.w))
        assert abs(r.e - want) < 1e-9, r
