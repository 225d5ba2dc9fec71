"""Streams give what the same rows give as a batch; enrichment against brute force."""

import random

import numpy as np
import pytest
from fixtures import START, beacon, flows, irregular
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS
from pulsetrace.operators import asof, drift, enrich, features, sweeps
from pulsetrace.operators.labels import binary_target
from pulsetrace.session import scratch_path
from pulsetrace.streaming import live


def arrive(spark, df, parts):
    """Write the flows as one file per time slice, oldest first."""
    path = scratch_path(spark, "arrive")
    rows = df.orderBy("ts_us", "uid").collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode(
            "append").parquet(path)
    return path


def test_windows_over_a_stream(spark):
    df = flows(spark, beacon(40, gap=600), irregular(60))
    source, out = arrive(spark, df, 4), scratch_path(spark, "windows")
    stream = live.windowed_sessions(live.flow_stream(spark, source, df.schema, 1))
    live.write_stream(stream, out, scratch_path(spark, "offsets"))
    top = df.agg(F.max("ts_us")).first()[0]
    closed = live.windowed_sessions(df).where(
        (F.col("window_us") + 6 * 3_600_000_000) <= top - 3_600_000_000)
    got = {tuple(r) for r in spark.read.parquet(out).select(*closed.columns).collect()}
    assert got == {tuple(r) for r in closed.collect()} and got


def test_running_sessions_match_the_batch(spark):
    df = flows(spark, beacon(3, port=80), beacon(12), irregular(30))
    source, out = arrive(spark, df, 5), scratch_path(spark, "running")
    updates = live.partial_sessions(live.flow_stream(spark, source, df.schema, 1))
    live.keep_latest(updates, out, scratch_path(spark, "offsets"))
    got = {(r.orig_h, r.resp_p): r for r in live.current_sessions(spark, out).collect()}
    assert not got["10.1.0.5", 80].assessable and got["10.1.0.5", 80].n_flows == 3
    for key in (("10.1.0.5", 443), ("10.1.0.6", 443)):
        times = sorted(r.ts_us for r in df.collect() if (r.orig_h, r.resp_p) == key)
        gaps = np.diff(times) / 1e6
        assert got[key].assessable and got[key].n_flows == len(times) and got[key].late == 0
        assert np.isclose(got[key].iat_mean, gaps.mean()) and np.isclose(got[key].iat_std, gaps.std())


def test_out_of_order_flows_are_placed_and_late_ones_counted(spark):
    hour = 3_600
    arrivals = [[0, 60, 180, 240], [120, 300, 10 * hour], [9 * hour + 5, 30, 11 * hour], [9 * hour + 10, 10 * hour + 1]]
    source, out, offsets = (scratch_path(spark, n) for n in ("shuffled", "placed", "offsets"))
    for seconds in arrivals:
        rows = [("a", "b", 1, (START + t) * 1_000_000) for t in seconds]
        df = spark.createDataFrame(rows, "orig_h string, resp_h string, resp_p int, ts_us bigint")
        df.write.mode("append").parquet(source)
        live.keep_latest(live.partial_sessions(live.flow_stream(spark, source, df.schema)), out, offsets)
    got = live.current_sessions(spark, out).first()
    # Watermarks before the batches: none, under 0, 9 h, 10 h; late are 30 s and 9 h 10 s.
    times = [0, 60, 120, 180, 240, 300, 9 * hour + 5, 10 * hour, 10 * hour + 1, 11 * hour]
    gaps = np.diff(times)
    assert (got.n_flows, got.late) == (len(times), 2)
    assert np.isclose(got.iat_mean, gaps.mean()) and np.isclose(got.iat_std, gaps.std())


def test_late_rows_are_counted(spark):
    rows = [(0, 10), (0, 100), (1, 95), (1, 80), (2, 50), (2, 300), (3, 299), (3, 250)]
    df = spark.createDataFrame(rows, "slice_no int, ts_us bigint")
    got = {r.slice: (r.n_rows, r.n_late) for r in live.late_rows(df, F.col("slice_no"), 10).collect()}
    assert got == {0: (2, 0), 1: (2, 1), 2: (2, 1), 3: (2, 1)}


def test_latest_answer(spark):
    rng = random.Random(12)
    asks = [(f"u{i}", rng.choice("ab"), rng.choice("xy"), rng.randint(0, 5000)) for i in range(150)]
    answers = [(rng.randint(0, 5000), rng.choice("ab"), f"q{i % 7}", rng.choice("xy"))
               for i in range(80)]
    flows_df = spark.createDataFrame(asks, "uid string, orig_h string, resp_h string, ts_us bigint")
    dns = spark.createDataFrame(answers, "ts_us bigint, orig_h string, query string, answer string")
    for ranges in (None, 7):
        for gap in (None, 60):
            got = {r.uid: (r.query, r.answer_age_us)
                   for r in enrich.latest_answer(flows_df, dns, gap, ranges).collect()}
            for uid, host, dest, at in asks:
                best = max(((t, q) for t, h, q, a in answers if (h, a) == (host, dest) and t <= at),
                           default=None)
                if best and gap is not None and at - best[0] > gap:
                    best = None
                assert got[uid] == ((best[1], at - best[0]) if best else (None, None))


@pytest.mark.parametrize("combine", ["last", "max"])
@pytest.mark.parametrize("ranges", [1, 2, 9])
def test_carried_values_cross_ranges(spark, combine, ranges):
    rng = random.Random(ranges)
    # One key holds half of all rows, another is null; values are missing in long runs.
    rows = [(rng.choice(["hot", "hot", "a", None]), i // 3 if i % 40 else None, i,
             rng.randint(0, 50) if rng.random() < 0.1 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    got = {r.i: r.seen for r in asof.carried(df, ["k"], ["t", "i"], "v", "seen", combine, ranges).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    for at, (k, _, i, _) in enumerate(order):
        before = [r[3] for r in order[:at] if r[0] == k and r[3] is not None]
        want = (before[-1] if combine == "last" else max(before)) if before else None
        assert got[i] == want
    assert asof.carried(df.limit(0), ["k"], ["t"], "v", "seen", combine, ranges).count() == 0


def test_no_drift_and_drift(spark):
    base = spark.range(2000).select((F.rand(1) * 10).alias("x"))
    same = drift.drift(base, base, ["x"]).first()
    moved = drift.drift(base, base.select((F.col("x") + 3).alias("x")), ["x"]).first()
    assert abs(same.psi) < 1e-9 and abs(same.kl) < 1e-9 and moved.psi > 0.5


def test_no_jitter_changes_nothing_and_noise_is_bounded(spark):
    df = binary_target(flows(spark, beacon(50)))
    still = sweeps.inject_jitter(df, [0, 20])
    before = {r.uid: r.ts_us for r in df.collect()}
    for r in still.collect():
        limit = 60 * 1e6 * r.jitter_pct / 100
        assert abs(r.ts_us - before[r.uid]) <= limit + 1
    assert still.where("jitter_pct = 20").select("ts_us").distinct().count() > 40
    lonely = binary_target(flows(spark, beacon(1)))
    assert sweeps.inject_jitter(lonely, [50]).first().ts_us == START * 1_000_000


def test_padding_only_grows(spark):
    df = binary_target(flows(spark, beacon(50)))
    rows = sweeps.inject_padding(df, [1.0, 2.0]).collect()
    assert all(r.orig_bytes == 120 for r in rows if r.padding_factor == 1.0)
    assert all(120 <= r.orig_bytes <= 240 for r in rows) and len(rows) == 100


def test_tls_properties(spark):
    df = flows(spark, beacon(2))
    uids = [r.uid for r in df.orderBy("uid").collect()]
    tls = spark.createDataFrame(
        [(uids[0], "TLSv13", "a,b", None, 0, 3 * enrich.DAY_US, "O=x,CN=aab", "O=x,CN=aab", "j1")],
        "uid string, tls_version string, ciphers string, extensions string, not_before_us bigint, "
        "not_after_us bigint, subject string, issuer string, ja3 string")
    allowed = spark.createDataFrame([("j1",), ("j2",)], "ja3 string")
    got = {r.uid: r for r in enrich.tls_features(df, tls, allowed).collect()}
    one = got[uids[0]]
    assert (one.ja3_known_client, one.cipher_suite_count, one.extension_count) == (True, 2, 0)
    assert (one.cert_validity_days, one.cert_is_self_signed) == (3, True)
    assert abs(one.cert_subject_cn_entropy - 0.918295834) < 1e-6
    assert got[uids[1]].tls_version is None


def test_sweeps_equal_features_of_the_perturbed_flows(spark):
    df = binary_target(flows(spark, beacon(40), irregular(30, 5, label="C&C-HeartBeat"), beacon(3, port=80)))
    df = df.unionByName(df.limit(2).withColumn("ts_us", F.lit(None).cast("bigint")))
    blocks = ("timing", "periodicity", "volume", "state")
    for level, by_level, copies, built in (
            ("jitter_pct", [0, 20, 50], sweeps.inject_jitter, sweeps.jittered_sessions),
            ("padding_factor", [1.0, 2.0], sweeps.inject_padding, sweeps.padded_sessions)):
        keyed = DEFAULTS.with_(session_keys=(*DEFAULTS.session_keys, level))
        want = features.session_features(copies(df, by_level), keyed, blocks)
        for limit in (1_000_000, 35):  # gathered, and one session on the path for hot ones
            got = built(df, by_level, DEFAULTS.with_(hot_session_flows=limit), blocks)
            assert set(got.columns) == set(want.columns)
            a, b = (x.toPandas().sort_values([*keyed.session_keys]).reset_index(drop=True) for x in (got, want))
            assert len(a) == len(b) == 2 * len(by_level)
            for c in want.columns:
                if b[c].dtype == float:
                    np.testing.assert_allclose(a[c], b[c], rtol=1e-9, atol=1e-9, err_msg=c)
                else:
                    assert (a[c] == b[c]).all(), c


def streamed(spark, arrivals, **options):
    """Running sessions after batches of (host, second) rows, by host."""
    source, out, offsets = (scratch_path(spark, n) for n in ("batches", "states", "offsets"))
    for rows in arrivals:
        rows = [(h, "b", 1, None if t is None else (START * 1_000_000 + round(t * 1e6))) for h, t in rows]
        df = spark.createDataFrame(rows, "orig_h string, resp_h string, resp_p int, ts_us bigint")
        df.repartition(3).write.mode("append").parquet(source)
        live.keep_latest(live.partial_sessions(live.flow_stream(spark, source, df.schema), **options), out, offsets)
    return {r.orig_h: r for r in live.current_sessions(spark, out).collect()}


def test_a_session_with_half_of_a_batch(spark):
    rng = random.Random(8)
    hot = [[("hot", i * 900 + rng.random() * 1500) for _ in range(4000)] for i in range(3)]
    rest = [[(f"h{j}", i * 900 + rng.random() * 900) for j in range(200) for _ in range(20)] for i in range(3)]
    got = streamed(spark, [a + b for a, b in zip(hot, rest)])
    for host in ("hot", "h7", "h199"):
        times = sorted(round(t * 1e6) for part in (*hot, *rest) for h, t in part if h == host)
        gaps = np.diff(times) / 1e6
        assert (got[host].n_flows, got[host].late) == (len(times), 0)
        assert np.isclose(got[host].iat_mean, gaps.mean()) and np.isclose(got[host].iat_std, gaps.std())
    df = spark.createDataFrame([(h, "b", 1, int(t * 1e6)) for h, t in hot[0] + rest[0]],
                               "orig_h string, resp_h string, resp_p int, ts_us bigint").coalesce(1)
    assert live.minutes_of(df, DEFAULTS.session_keys).where("orig_h = 'hot'").count() <= 26


def test_flows_without_a_time_or_host_in_a_stream(spark):
    hour = 3_600
    got = streamed(spark, [[("a", 0), ("a", None), (None, 5)], [("a", 30), ("a", 20 * hour), (None, None)],
                           [("a", None), (None, 20 * hour), (None, 6)]])
    assert (got["a"].n_flows, got["a"].late, got["a"].assessable) == (5, 0, True)
    assert np.isclose(got["a"].iat_mean, 10 * hour)
    assert (got[None].n_flows, got[None].late, got[None].assessable) == (3, 1, False)


def test_idle_sessions_leave_the_state(spark):
    hour = 3_600
    got = streamed(spark, [[("a", 0), ("a", 10), ("b", 0)], [("b", 30 * hour)], [("b", 31 * hour)],
                           [("a", 31 * hour), ("b", 32 * hour)]], idle="5 hours")
    assert (got["a"].n_flows, got["a"].late) == (1, 0)
    assert (got["b"].n_flows, got["b"].late) == (4, 0)


def test_sessions_of_a_bucket_are_moved_on_together(spark):
    rng = random.Random(9)
    source, offsets = scratch_path(spark, "many"), scratch_path(spark, "offsets")
    rows = [(f"h{i % 3000}", "b", 1, int((START + rng.random() * 3000) * 1e6)) for i in range(9000)]
    df = spark.createDataFrame(rows, "orig_h string, resp_h string, resp_p int, ts_us bigint")
    df.repartition(3).write.parquet(source)
    found = []
    query = (live.partial_sessions(live.flow_stream(spark, source, df.schema)).writeStream.outputMode("update")
             .foreachBatch(lambda batch, number: found.extend(batch.collect())).option("checkpointLocation", offsets)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    states = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < max(states) <= live.BUCKETS  # 3,000 sessions
    times = {}
    for h, _, _, t in rows:
        times.setdefault(h, []).append(t)
    assert len(found) == 3000 and all(r.n_flows == 3 and r.resp_p == 1 and not r.assessable for r in found)
    for r in found:
        gaps = np.diff(sorted(times[r.orig_h])) / 1e6
        assert np.isclose(r.iat_mean, gaps.mean()) and np.isclose(r.iat_std, gaps.std())
