"""Order statistics, curves, splits, thresholds and joins against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS
from pulsetrace.operators import curves, decision, fusion, labels, quality, splits
from pulsetrace.operators.hosts import merge_feedback
from pulsetrace.operators.joins import counted_lookup, lookup_join
from pulsetrace.operators.order_stats import exact_quantiles, kth_smallest, quantile_table


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(11)
    rows = [(rng.choice("ab"), rng.choice([1.0, 1.0, 1.0, rng.gauss(0, 1), rng.gauss(0, 1e9)]),
             rng.getrandbits(60)) for _ in range(3000)]
    return spark.createDataFrame(rows, "g string, v double, h bigint").cache()


def test_kth_smallest_by_narrowing(values):
    rows = values.collect()
    for column in ("v", "h"):
        whole = sorted(r[column] for r in rows)
        ranks = [0, 1, 700, 1500, 2999]
        for gather in (100_000, 40):
            got = kth_smallest(values, column, {None: ranks}, gather=gather)[None]
            assert got == [whole[k] for k in ranks]
        per = {g: sorted(r[column] for r in rows if r.g == g) for g in "ab"}
        got = kth_smallest(values, column, {"a": [5, 900], "b": [1200]}, "g", gather=40)
        assert got == {"a": [per["a"][5], per["a"][900]], "b": [per["b"][1200]]}


def test_quantiles_interpolate(values):
    rows = values.toPandas()
    probs = [0, 0.1, 0.5, 0.955, 1]
    assert exact_quantiles(values, "v", probs)[None] == pytest.approx(np.quantile(rows.v, probs))
    for g, q in exact_quantiles(values, "v", probs, "g").items():
        assert q == pytest.approx(np.quantile(rows.v[rows.g == g], probs))


def brute(points):
    """Average precision, ROC-AUC and curve points straight from their definitions."""
    p = sum(y for y, _ in points)
    n = len(points) - p
    ap, last, pr, roc = 0.0, 0.0, [], []
    for t in sorted({s for _, s in points}, reverse=True):
        tp = sum(y for y, s in points if s >= t)
        fp = sum(1 - y for y, s in points if s >= t)
        ap += (tp / p - last) * tp / (tp + fp)
        last = tp / p
        pr.append((tp / (tp + fp), tp / p))
        roc.append((fp / n, tp / p))
    wins = sum((a > b) + 0.5 * (a == b) for ya, a in points if ya for yb, b in points if not yb)
    return ap, wins / (p * n), pr, roc


@pytest.mark.parametrize("buckets", [256, 3])
def test_curves(spark, monkeypatch, buckets):
    monkeypatch.setattr(curves, "BUCKETS", buckets)
    rng = random.Random(2)
    points = [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(points, "target int, score double").cache()
    ap, auc, pr, roc = brute(points)
    got = curves.ranking_metrics(df).first()
    assert (got.pr_auc, got.roc_auc) == pytest.approx((ap, auc))
    rows = curves.pr_curve(df).where("threshold is not null").orderBy(F.desc("threshold")).collect()
    assert [(r.precision, r.recall) for r in rows] == [pytest.approx(x) for x in pr]
    rows = curves.roc_curve(df, drop_collinear=False).where("threshold is not null").orderBy(
        F.desc("threshold")).collect()
    assert [(r.fpr, r.tpr) for r in rows] == [pytest.approx(x) for x in roc]
    kept = curves.roc_curve(df).where("threshold is not null").orderBy(F.desc("threshold")).collect()
    pos, neg = {}, {}
    for y, s in points:
        pos[s], neg[s] = pos.get(s, 0) + y, neg.get(s, 0) + 1 - y
    steps = [(neg[s], pos[s]) for s in sorted(pos, reverse=True)]
    bends = [i for i in range(len(steps))
             if i in (0, len(steps) - 1) or steps[i + 1] != steps[i]]
    assert [(r.fpr, r.tpr) for r in kept] == [pytest.approx(roc[i]) for i in bends]
    best = max((r for p, r in pr if p >= 0.35), default=0.0)
    assert curves.recall_at_precision(df, 0.35).first().recall == pytest.approx(best)


def test_single_class_gives_null_not_an_error(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4)], "target int, score double")
    assert curves.ranking_metrics(df).first().roc_auc is None
    at = curves.threshold_metrics(df, 0.3, flows_per_day=1000).first()
    assert (at.precision_at_threshold, at.recall_at_threshold) == (0.0, 0.0)
    assert at.false_positives_per_day == 500.0
    assert curves.recall_at_threshold(df, 0.3).first()[0] is None


def test_groups_are_scored_in_one_job(spark):
    rng = random.Random(4)
    rows = [(m, int(rng.random() < 0.4), rng.random()) for m in "xy" for _ in range(80)]
    got = {r.m: r.pr_auc for r in curves.average_precision(
        spark.createDataFrame(rows, "m string, target int, score double"), by=["m"]).collect()}
    for m in "xy":
        assert got[m] == pytest.approx(brute([(y, s) for k, y, s in rows if k == m])[0])


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(6)
    rows = [(f"s{i}", int(i % 9 == 0), rng.randint(0, 40) * 1_000_000,
             rng.choice(["C&C", "C&C-Torii", "C&C-Mirai"]) if i % 9 == 0 else "Benign")
            for i in range(400)]
    return spark.createDataFrame(
        rows, "session_id string, target int, first_us bigint, detailed_label string").cache()


def test_stratified_split(table):
    counts = {(r.split, r.target): r["count"]
              for r in splits.stratified_split(table).groupBy("split", "target").count().collect()}
    for target, n in ((1, 45), (0, 355)):
        first, second = round(n * 0.7), round(n * 0.85)
        assert [counts[(s, target)] for s in ("train", "val", "test")] == [
            first, second - first, n - second]


def test_temporal_split_cuts_through_ties(table):
    rows = splits.temporal_split(table).collect()
    by = {s: [r.first_us for r in rows if r.split == s] for s in ("train", "val", "test")}
    assert [len(by[s]) for s in ("train", "val", "test")] == [280, 60, 60]
    assert max(by["train"]) <= min(by["val"]) and max(by["val"]) <= min(by["test"])


def test_family_split_holds_families_out(table):
    rows = splits.held_out_family_split(table).collect()
    held = splits.held_out_families(table)
    assert len(held) == 1
    for r in rows:
        if r.target:
            assert (r.split == "test") == (r.detailed_label in held)
    assert sum(r.split == "test" for r in rows if not r.target) == math.ceil(355 * 0.3)


def test_budget_is_respected(spark):
    scores = spark.range(100_000).select((F.rand(3)).alias("risk_score"))
    settings = DEFAULTS.with_(alerts_per_day=100, flows_per_day=100_000)
    limits = decision.calibrate_thresholds(scores, settings=settings)
    actions = dict(scores.groupBy(decision.decide("risk_score", limits)).count().collect())
    assert 50 <= actions["BLOCK"] <= 200 and 150 <= actions["BLOCK"] + actions["ALERT"] <= 250
    everything = decision.calibrate_thresholds(scores, settings=DEFAULTS.with_(alerts_per_day=2000))
    assert everything.high == 0.0 and everything.low <= 0.0


def test_three_actions(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.9,), (0.4,), (0.8,)], "s double")
    got = [r[0] for r in df.select(decision.decide("s", decision.Thresholds(0.4, 0.8))).collect()]
    assert got == ["ALLOW", "ALERT", "BLOCK", "ALERT", "BLOCK"]


def test_block_cap(spark):
    rng = random.Random(8)
    rows = [(f"s{i}", rng.randint(0, 3), round(rng.random(), 1),
             rng.choice(["BLOCK", "BLOCK", "ALLOW"])) for i in range(500)]
    log = spark.createDataFrame(rows, "session_id string, day int, risk_score double, action string")
    got = {r.session_id: r.action for r in decision.cap_blocks(log, 5, F.col("day"), 7).collect()}
    for day in range(4):
        blocked = sorted((-r, s) for s, d, r, a in rows if d == day and a == "BLOCK")
        for place, (_, s) in enumerate(blocked):
            assert got[s] == ("BLOCK" if place < 5 else "ALERT")
    assert all(got[s] == "ALLOW" for s, _, _, a in rows if a == "ALLOW")


def test_unknown_fusion_is_refused():
    with pytest.raises(ValueError):
        fusion.fuse(settings=DEFAULTS.with_(fusion_method="median"))


def test_lookup_join_slices_heavy_keys(spark):
    rng = random.Random(9)
    left = spark.createDataFrame([(rng.choice("aaaab"), i) for i in range(400)] + [(None, 400)],
                                 "k string, i int")
    facts = left.groupBy("k").agg(F.count("*").alias("w"), F.max("i").alias("top"))
    plain = {tuple(r) for r in left.join(facts.drop("w"), "k", "left").collect()}
    for rows in (30, 1000):
        got = lookup_join(left, facts, ["k"], "w", ["i"], rows_per_slice=rows)
        assert {tuple(r) for r in got.collect()} == plain and got.count() == 401


def test_latest_override_wins(spark):
    scored = spark.createDataFrame([("a", 0), ("b", 1)], "session_id string, target int")
    notes = spark.createDataFrame([("a", 0, 1), ("a", 1, 5), ("a", 0, 3)],
                                  "session_id string, analyst_label int, at int")
    got = {r.session_id: (r.target, r.overridden) for r in merge_feedback(scored, notes).collect()}
    assert got == {"a": (1, True), "b": (1, False)}


def test_facts_reach_popular_and_unknown_keys(spark):
    rng = random.Random(10)
    left = spark.createDataFrame([(rng.choice("aaaabc"), i) for i in range(300)] + [(None, 300)],
                                 "k string, i int")
    facts = spark.createDataFrame([("a", 1), ("b", 2), ("z", 9)], "k string, fact int")
    plain = {tuple(r) for r in left.join(facts, "k", "left").collect()}
    got = counted_lookup(left, facts, ["k"], ["i"], rows_per_slice=20)
    assert {tuple(r) for r in got.collect()} == plain and got.count() == 301


def test_ranks_with_infinite_values_and_many_groups(spark):
    odd = [float("inf"), float("-inf"), float("nan"), 1e308, -1e308, 5e-324, 0.0]
    rng = np.random.default_rng(5)
    numbers = [*rng.normal(size=3000).tolist(), *odd]
    df = spark.createDataFrame([("a", v) for v in numbers], "g string, v double")
    ranked = sorted((v for v in numbers if v == v)) + [float("nan")]
    ranks = [0, 1, 2, 1500, len(numbers) - 4, len(numbers) - 3, len(numbers) - 2, len(numbers) - 1]
    for found in (kth_smallest(df, "v", {None: ranks}, gather=100)[None], kth_smallest(df, "v", {"a": ranks}, "g", gather=100)["a"]):
        assert [str(v) for v in found] == [str(ranked[r]) for r in ranks]
    many = spark.range(60_000).selectExpr("id % 20000 AS g", "pmod(id * 7919, 1000003) AS v")
    out = {r.g: r.q0 for r in quantile_table(many, "v", [0.5], "g").collect()}
    assert len(out) == 20_000
    for g in (0, 7, 19_999):
        assert out[g] == sorted(i * 7919 % 1000003 for i in (g, g + 20_000, g + 40_000))[1]


def test_more_groups_than_the_driver_should_list(spark):
    rows = spark.range(40_000)
    folded = labels.fold_rare_classes(
        rows.selectExpr("CASE WHEN id < 20000 THEN concat('C&C-', id) ELSE 'C&C-common' END AS detailed_label"),
        DEFAULTS.with_(rare_class_min_count=5)).groupBy("multiclass_label").count().collect()
    assert {r.multiclass_label: r["count"] for r in folded} == {"other-C&C": 20_000, "C&C-common": 20_000}
    matrix = rows.where("id < 10500").selectExpr("cast(id AS string) AS session_id", "1 AS target", "concat('f', id) AS detailed_label")
    held = splits.held_out_family_split(matrix).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in held}["test"] == round(10_500 * DEFAULTS.held_out_fraction)
    drawn = quality.stratified_sample(rows.selectExpr("cast(id AS string) AS uid", "concat('l', id % 12000) AS detailed_label"), 20_000)
    assert {r["count"] for r in drawn.groupBy("detailed_label").count().collect()} <= {1, 2}
