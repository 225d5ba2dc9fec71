"""Sessions and features: fixture properties, edge cases, hot sessions."""

import numpy as np
import pytest
from fixtures import START, beacon, flows, irregular
from pyspark.sql import functions as F

from pulsetrace.config import (
    CONTEXT_FEATURES, DEFAULTS, NUMERIC_FEATURES, STATE_CATEGORIES, STATE_FEATURES,
)
from pulsetrace.functions.series import score_rows
from pulsetrace.operators import labels, sessions
from pulsetrace.operators.features import (
    feature_matrix, log_transform, select_tiers, session_features, tier_columns,
)


def matrix(spark, *groups, settings=DEFAULTS):
    rows = feature_matrix(labels.binary_target(flows(spark, *groups)), settings).collect()
    return {r.session_id: r for r in rows}


def test_two_sessions_and_nothing_discarded(spark):
    rate = sessions.discard_rate(flows(spark)).first()
    assert (rate.sessions_total, rate.sessions_kept, rate.discard_rate) == (2, 2, 0.0)


def test_short_session_is_dropped(spark):
    few = flows(spark, beacon(2), irregular())
    assert sessions.discard_rate(few).first().discard_rate == pytest.approx(0.25)
    for keep in (sessions.filter_short_sessions, sessions.filter_short_sessions_semi):
        assert keep(few).select("orig_h").distinct().count() == 1
        assert keep(flows(spark, beacon(3), irregular())).count() == 6
        assert keep(flows(spark, beacon(4), irregular())).count() == 10


def test_order_and_intervals(spark):
    rows = sessions.sessionize(flows(spark)).orderBy("session_id", "flow_no").collect()
    for a, b in zip(rows, rows[1:]):
        if a.session_id == b.session_id:
            assert b.ts_us >= a.ts_us and b.iat_us == b.ts_us - a.ts_us
        else:
            assert b.flow_no == 0 and b.iat_us is None


def test_beacon_and_irregular_features(spark):
    m = matrix(spark)
    b, n = m["10.1.0.5|198.51.100.7|443"], m["10.1.0.6|203.0.113.9|443"]
    assert b.iat_cv < 0.01 and b.periodicity_score == 1.0 and b.fft_dominant_power == 1.0
    assert b.iat_cv < n.iat_cv and b.session_flow_count == 6 and b.iat_median == 60.0
    assert b.iat_mad == 0.0 and b.resp_bytes_is_zero == 1.0 and n.resp_bytes_is_zero == 0.0
    assert b.session_byte_variance < n.session_byte_variance
    assert b.duty_cycle == pytest.approx(0.3 / 300) and b.session_span_hours == pytest.approx(300 / 3600)
    assert (b.hour_of_day, b.is_weekend) == (12.0, 1.0)  # 2020-09-13 12:26:40 UTC, a Sunday
    assert (b.service_mode, b.proto_mode) == ("unknown", "tcp")
    assert b.total_bytes == pytest.approx(np.log1p(6 * 220)) and b.target == 1
    assert (b.is_ephemeral_orig_port, n.is_ephemeral_orig_port) == (1.0, 0.0)
    assert (b.dest_fanin, b.src_fanout, b.dest_flow_count) == (1.0, 1.0, 6.0)


def test_series_scores_match_definition():
    rng = np.random.default_rng(5)
    for n in (2, 3, 4, 7, 50):
        x = rng.exponential(100, size=(5, n))
        x[0] = 60.0
        peak, share = score_rows(x)
        for i, row in enumerate(x):
            if n < 3:
                assert peak[i] == share[i] == 0.0
                continue
            if np.allclose(row, row.mean()):
                assert peak[i] == share[i] == 1.0
                continue
            c = row - row.mean()
            acf = np.correlate(c, c, "full")[n - 1:]
            power = np.abs(np.fft.rfft(c)) ** 2
            assert peak[i] == pytest.approx(np.max(np.abs(acf[1:] / acf[0])))
            assert share[i] == pytest.approx(power[1:].max() / power.sum())


def test_ties_in_mode_and_time(spark):
    rows = beacon(4, gap=0)
    rows = [(*r[:12], s, *r[13:]) for r, s in zip(rows, ("S0", "REJ", "REJ", "S0"))]
    r = matrix(spark, rows)["10.1.0.5|198.51.100.7|443"]
    assert r.conn_state_mode == "REJ" and r.last_uid == rows[-1][2]
    assert (r.iat_mean, r.iat_cv, r.duty_cycle) == (0.0, 0.0, 0.0)
    assert (r.periodicity_score, r.fft_dominant_power) == (1.0, 1.0)


def test_null_time_and_null_host(spark):
    rows = beacon(5)
    rows[2] = (None, None, *rows[2][2:])
    rows += [(*r[:5], None, *r[6:]) for r in irregular(4)]
    m = matrix(spark, rows)
    assert m["10.1.0.5|198.51.100.7|443"].session_flow_count == 5
    assert m["10.1.0.5|198.51.100.7|443"].iat_max == 120.0
    assert m["10.1.0.6|nan|443"].session_flow_count == 4


def test_identity_stays_out_of_the_model_columns():
    names = {*NUMERIC_FEATURES, *STATE_CATEGORIES}
    assert not names & {"orig_h", "resp_h", "uid", "capture_id", "session_id"}
    assert len(names) == 39


@pytest.fixture(scope="module")
def mixed(spark):
    groups = [beacon(90, orig="10.2.0.1"), irregular(77, 3, orig="10.2.0.2"), irregular(9, 4),
              irregular(64, 8, orig="10.2.0.3"), beacon(5), beacon(3, port=80),
              irregular(41, 9, orig="10.2.0.4")]
    groups[1] = [(*r[:1], r[1] - r[1] % 1_000_000, *r[2:]) for r in groups[1]]
    groups[6] = groups[6][:20] + [(a[0], a[1], f"T{i}", *a[3:])
                                  for i, a in enumerate(groups[6][:20])] + groups[6][20:]
    return labels.binary_target(flows(spark, *groups)).repartition(7).cache()


def test_hot_sessions_give_the_same_features(mixed):
    plain = feature_matrix(mixed).toPandas().set_index("session_id").sort_index()
    for limit in (60, 3):
        spread = feature_matrix(mixed, DEFAULTS.with_(hot_session_flows=limit))
        spread = spread.toPandas().set_index("session_id").sort_index()
        assert list(plain.index) == list(spread.index)
        for c in NUMERIC_FEATURES:
            assert np.allclose(plain[c], spread[c], rtol=1e-9, atol=1e-9), c
        for c in (*STATE_CATEGORIES, "last_uid", "detailed_label", "capture_id", "target"):
            assert (plain[c] == spread[c]).all(), c


def test_hot_sessions_give_the_same_intervals(mixed):
    def rows(limit):
        out = sessions.intervals(mixed, DEFAULTS.with_(hot_session_flows=limit))
        return {r.uid: (r.flow_no, r.iat_us) for r in out.collect()}

    def kept(limit, keep):
        return {r.uid for r in keep(mixed, DEFAULTS.with_(hot_session_flows=limit)).collect()}

    assert rows(1000) == rows(20)
    for keep in (sessions.filter_short_sessions, sessions.filter_short_sessions_semi,
                 sessions.sessionize):
        assert kept(1000, keep) == kept(20, keep)


def test_partition_count_does_not_matter(mixed):
    def table(n):
        out = session_features(mixed.repartition(n)).drop("duration_sum")
        return out.toPandas().sort_values(["orig_h", "resp_h", "resp_p"]).reset_index(drop=True)

    one, many = table(1), table(16)
    for c in one.columns:
        if one[c].dtype == float:
            assert np.allclose(one[c], many[c]), c
        else:
            assert (one[c] == many[c]).all(), c


def test_tiers(spark):
    table = feature_matrix(labels.binary_target(flows(spark)))
    chosen = select_tiers(table, ["tier1", "nothing"]).columns
    assert "iat_cv" in chosen and "total_bytes" not in chosen and "history_len" in chosen
    assert list(STATE_FEATURES) == tier_columns(table.columns, [])[:6]
    assert set(CONTEXT_FEATURES) <= set(tier_columns(table.columns, ["tier4"]))
    with pytest.raises(NotImplementedError):
        select_tiers(table, ["tier3"])


def test_log_transform_clips(spark):
    got = log_transform(spark.createDataFrame([(0.0,), (10.0,), (1000.0,), (-5.0,)], "b double"),
                        ["b"]).collect()
    assert [r.b for r in got] == pytest.approx([0.0, np.log1p(10), np.log1p(1000), 0.0])


def test_start_is_a_sunday():
    assert START % 86400 == 44800


def test_weekday_and_hour_against_spark(spark):
    days = [(float(d * 40_000), d * 40_000_000_000) for d in range(-10, 60)]
    for ts, us in days[:3]:
        assert us == int(ts * 1e6)
    rows = [(t, u, f"{t}{i}", f"10.9.{j // 250}.{j % 250}", 1, "198.51.100.1", 80, "tcp", None, 0.0,
             0, 0, "SF", None, 0, 0, 0, 0, "Benign", "c")
            for j, (t, u) in enumerate(days) for i in range(4)]
    table = session_features(flows(spark, rows), blocks=("timing",))
    clock = F.timestamp_micros("first_us")
    wrong = table.where((F.hour(clock) != F.col("hour_of_day"))
                        | ((F.weekday(clock) >= 5).cast("double") != F.col("is_weekend")))
    assert table.count() == len(days) and wrong.count() == 0


def test_context_of_the_whole_capture(spark):
    every = flows(spark, beacon(), irregular(2, orig="10.4.0.1"),
                  [(*r[:5], "198.51.100.7", *r[6:]) for r in irregular(3, orig="10.4.0.2")])
    kept = labels.binary_target(every)
    name = "10.1.0.5|198.51.100.7|443"
    own = {r.session_id: r for r in feature_matrix(kept).collect()}[name]
    whole = {r.session_id: r for r in feature_matrix(kept, context_flows=every).collect()}[name]
    assert (own.dest_fanin, own.dest_flow_count) == (1.0, 6.0)
    assert (whole.dest_fanin, whole.dest_flow_count, whole.src_fanout) == (2.0, 9.0, 1.0)


def test_missing_detailed_label_can_fall_back(spark):
    df = flows(spark, irregular(4, label=None)).withColumn("label", F.lit("Benign"))
    assert labels.binary_target(df).count() == 0
    assert labels.binary_target(df, DEFAULTS.with_(label_fallback="label")).count() == 4


def test_points_of_hot_series_are_dealt_out(spark, mixed, monkeypatch):
    from pulsetrace.operators import joins

    settings = DEFAULTS.with_(hot_session_flows=3)
    plain = session_features(mixed, settings).toPandas()
    monkeypatch.setattr(joins.lookup_join, "__defaults__", (7, None))
    dealt = session_features(mixed, settings).toPandas()
    order = ["orig_h", "resp_h", "resp_p"]
    plain, dealt = (t.sort_values(order).reset_index(drop=True) for t in (plain, dealt))
    for c in ("iat_mad", "iat_median", "periodicity_score", "fft_dominant_power"):
        assert np.allclose(plain[c], dealt[c], rtol=1e-9, atol=1e-9), c
