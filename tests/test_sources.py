"""Readers, sinks, cleaning and labels on files the tests write themselves."""

import gzip

import pytest
from fixtures import beacon, flows, irregular
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS, NATIVE_LOG_COLUMNS
from pulsetrace.operators import decision, labels, quality
from pulsetrace.sources import sinks
from pulsetrace.sources.flow_logs import (
    load_captures, prepare_flows, read_csv_export, read_native_log,
)

NATIVE = """#separator \\x09
#fields\tts\tuid
1600000000.5\tCa\t10.0.0.1\t50000\t10.0.0.2\t443\ttcp\t-\t0.25\t100\t0\tSF\t-\t-\t0\tShAdD\t3\t180\t1\t40\t(empty)   Malicious   C&C
1600000060.5\tCb\t10.0.0.1\t50001\t10.0.0.2\t443\ttcp\tssl\t-\tbad\t-\tSF\t-\t-\t0\tS\t3\t180.0\t1\t40\t-   Benign   -
"""


def test_native_log(spark, tmp_path):
    folder = tmp_path / "cap1"
    folder.mkdir()
    (folder / "conn.log.labeled").write_text(NATIVE)
    a, b = read_native_log(spark, str(folder)).orderBy("uid").collect()
    assert a.ts_us == 1_600_000_000_500_000 and a.orig_p == 50000 and a.detailed_label == "C&C"
    assert a.service is None and a.resp_bytes == 0 and a.capture_id == "cap1/conn.log"
    assert b.orig_bytes is None and b.duration is None and b.orig_ip_bytes == 180
    assert b.detailed_label is None and b.label == "Benign"


def test_csv_export_plain_and_gzipped(spark, tmp_path):
    names = [*NATIVE_LOG_COLUMNS[:-2], "label"]
    line = "0,1600000000.5,Ca,10.0.0.1,50000,10.0.0.2,443,tcp,-,0.25,100,NaN,SF,-,-,0,S,3,180,1,40,-,C&C"
    text = "," + ",".join(names) + "\n" + line + "\n"
    (tmp_path / "a.csv").write_text(text)
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write(text.replace("Ca", "Cb"))
    rows = read_csv_export(spark, str(tmp_path)).orderBy("uid").collect()
    assert [r.uid for r in rows] == ["Ca", "Cb"]
    assert "_c0" not in rows[0] and rows[0].detailed_label == "C&C"
    assert rows[0].resp_bytes is None and rows[0].orig_bytes == 100 and rows[0].resp_p == 443


def test_captures_are_appended(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "conn.log").write_text(NATIVE)
    names = [n for n in NATIVE_LOG_COLUMNS[:-2] if n != "history"]
    (tmp_path / "y.csv").write_text(
        ",".join([*names, "label"]) + "\n"
        + "1600000000.5,Cz,10.0.0.1,50000,10.0.0.2,443,tcp,-,0.25,100,1,SF,-,-,0,3,180,1,40,-,Benign\n")
    got = load_captures(spark, [("native", str(tmp_path / "x")), ("csv", str(tmp_path / "y.csv"))])
    assert got.count() == 3 and got.where("uid = 'Cz'").first().history is None
    with pytest.raises(ValueError):
        load_captures(spark, [])


def test_missing_columns_stop_before_any_job(spark):
    with pytest.raises(quality.MissingColumnsError, match="uid"):
        quality.check_schema(spark.createDataFrame([(1.0,)], "ts double"))


def test_dash_becomes_null(spark):
    df = spark.createDataFrame([("100",), ("-",), ("200",)], "orig_bytes string")
    assert [r[0] for r in quality.coerce_numeric(df).collect()] == [100, None, 200]
    assert quality.null_token(df).where("orig_bytes is null").count() == 1


def test_target_keeps_only_known_classes(spark):
    df = flows(spark, beacon(), irregular(), irregular(4, label="DDoS", orig="10.3.0.1"),
               irregular(3, label=" Benign ", orig="10.3.0.2"),
               irregular(2, label=None, orig="10.3.0.3"), irregular(5, label="New", orig="10.3.0.4"))
    kept = labels.binary_target(df)
    assert dict(kept.groupBy("target").count().collect()) == {1: 6, 0: 9}
    assert tuple(labels.target_accounting(df).first()) == (6, 9, 11, 26)
    assert {r.detailed_label: r.n_rows for r in labels.unrecognised_labels(df).collect()} == {
        "New": 5, "nan": 2}


def test_rare_beacons_fold(spark):
    df = flows(spark, beacon(6), beacon(3, label="C&C-Torii", port=1), irregular(2))
    got = labels.fold_rare_classes(df, DEFAULTS.with_(rare_class_min_count=5))
    assert dict(got.groupBy("multiclass_label").count().collect()) == {
        "C&C-HeartBeat": 6, "other-C&C": 3, "Benign": 2}


def test_sample_is_exact_per_label(spark):
    df = flows(spark, beacon(40), irregular(160))
    got = quality.stratified_sample(df, 50)
    assert dict(got.groupBy("detailed_label").count().collect()) == {
        "C&C-HeartBeat": 10, "Benign": 40}
    again = quality.stratified_sample(df.repartition(9), 50)
    assert {r.uid for r in got.collect()} == {r.uid for r in again.collect()}
    assert quality.stratified_sample(df, 200) is df and quality.stratified_sample(df, None) is df


def test_preparation_chain(spark):
    text = flows(spark, beacon(), irregular(4, label="DDoS")).withColumn(
        "orig_bytes", F.col("orig_bytes").cast("string"))
    ready = prepare_flows(text)
    assert ready.count() == 6 and dict(ready.dtypes)["orig_bytes"] == "bigint"
    assert ready.where("multiclass_label = 'other-C&C'").count() == 6


def test_log_thresholds_and_report_round_trip(spark, tmp_path):
    scored = spark.createDataFrame(
        [("a", "u1", "c", 0.2, 0.1, 0.3), ("b", "u2", "c", 0.9, 0.9, 0.8)],
        "session_id string, last_uid string, capture_id string, risk_score double, "
        "supervised_score double, anomaly_score double")
    log = decision.decision_log(scored, decision.Thresholds(0.4, 0.8), F.lit("because, of"))
    sinks.save_decision_log(log, str(tmp_path / "log"))
    back = sinks.read_decision_log(spark, str(tmp_path / "log"))
    assert {(r.session_id, r.action, r.explanation) for r in back.collect()} == {
        ("a", "ALLOW", "because, of"), ("b", "BLOCK", "because, of")}
    sinks.save_thresholds(scored, decision.Thresholds(0.4, 0.8), str(tmp_path / "t"))
    assert tuple(sinks.read_report(spark, str(tmp_path / "t"), "tau_low double, tau_high double"
                                   ).first()) == (0.4, 0.8)
    assert sinks.read_thresholds(spark, str(tmp_path / "t")) == decision.Thresholds(0.4, 0.8)
