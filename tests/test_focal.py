"""The focal fit against differences, a plain fit and its own descent."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS
from pulsetrace.models import focal, supervised
from pulsetrace.models.supervised import focal_weights, train_classifier

KIND = "x array<double>, y int, a double"


def sample(spark, n=300, seed=5, parts=3):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.2).astype(int)
    x = rng.normal(size=(n, 3)) * [1.0, 20.0, 0.1] + y[:, None] * [1.2, -9.0, 0.0] + [0.0, 300.0, 0.0]
    a = rng.choice([0.5, 1.0, 3.0], n)
    rows = [(list(map(float, v)), int(k), float(w)) for v, k, w in zip(x, y, a)]
    return spark.createDataFrame(rows, KIND).repartition(parts), x, y, a


@pytest.mark.parametrize("gamma", [0.0, 0.5, 2.0, 5.0])
def test_row_derivatives_match_differences(gamma):
    u, h = np.linspace(-6, 6, 49), 1e-5
    _, slope, curvature = focal.row_loss(u, gamma)
    up, down = focal.row_loss(u + h, gamma), focal.row_loss(u - h, gamma)
    assert np.allclose(slope, (up[0] - down[0]) / (2 * h), atol=1e-8)
    assert np.allclose(curvature, (up[1] - down[1]) / (2 * h), atol=1e-8)
    assert all(np.isfinite(v).all() for v in focal.row_loss(np.array([-800.0, 800.0]), gamma))


def test_summed_gradient_matches_differences(spark):
    df, x, y, a = sample(spark)
    beta = np.array([0.2, -0.4, 0.01, 1.0])
    loss, gradient, curvature = focal.derivatives(df, beta, 2.0)
    near = np.concatenate([beta + 1e-6 * np.eye(4), beta - 1e-6 * np.eye(4)])
    found = focal.losses(df, near, 2.0)
    assert np.allclose(gradient, (found[:4] - found[4:]) / 2e-6, rtol=1e-4, atol=1e-4)
    margin = (2 * y - 1) * (beta[0] + x @ beta[1:])
    assert loss == pytest.approx(a @ focal.row_loss(margin, 2.0)[0])
    assert np.allclose(curvature, curvature.T)


def test_loss_falls_and_partitions_do_not_matter(spark):
    one, many = (focal.fit_focal(sample(spark, parts=p)[0], 2.0, 0.001) for p in (1, 7))
    assert len(one.losses) > 2 and all(b < a for a, b in zip(one.losses, one.losses[1:]))
    assert np.allclose(one.beta, many.beta, rtol=1e-5, atol=1e-6)


def test_without_focus_it_is_logistic_regression(spark):
    df, *_ = sample(spark)
    rows = df.rdd.map(lambda r: (Vectors.dense(r.x), r.y, r.a)).toDF(["features", "target", "weight"])
    settings = {"labelCol": "target", "weightCol": "weight"}
    plain = LogisticRegression(tol=1e-12, maxIter=500, **settings).fit(rows)
    own = focal.FocalLogistic(gamma=0.0, **settings).fit(rows)
    assert np.allclose(own.coefficients.toArray(), plain.coefficients.toArray(), rtol=1e-3, atol=1e-4)
    assert own.intercept == pytest.approx(plain.intercept, rel=1e-3)
    weights = focal_weights(rows, 2.0)
    assert weights.count() == 300 and weights.where("weight < 0 OR weight > 3").count() == 0


def test_odd_rows(spark):
    empty = spark.createDataFrame([], KIND)
    assert focal.fit_focal(empty).losses == []
    df, *_ = sample(spark)
    odd = spark.createDataFrame([(None, 1, 1.0), ([1.0, 2.0, None], 1, 1.0), ([1.0, 2.0, float("nan")], 0, 1.0),
                                 ([0.0, 0.0, 0.0], None, 1.0), ([0.0, 0.0, 0.0], 1, None)], KIND)
    assert np.allclose(focal.fit_focal(df.union(odd)).beta, focal.fit_focal(df).beta, rtol=1e-6)
    twice, heavy = df.union(df), df.withColumn("a", F.col("a") * 2)
    assert np.allclose(focal.fit_focal(twice).beta, focal.fit_focal(heavy).beta, rtol=1e-2, atol=1e-3)
    flat = df.withColumn("x", F.concat("x", F.array(F.lit(7.0))))
    fit = focal.fit_focal(flat)
    assert fit.beta[4] == 0 and np.allclose(fit.beta[:4], focal.fit_focal(df).beta, rtol=1e-5)
    ones = focal.fit_focal(df.withColumn("y", F.lit(1)), steps=8)
    assert np.isfinite(ones.beta).all() and all(b < a for a, b in zip(ones.losses, ones.losses[1:]))


def test_classifier_under_focal_loss(spark):
    df, *_ = sample(spark)
    rows = df.select(F.concat(F.lit("s"), F.xxhash64("x").cast("string")).alias("session_id"), F.col("y").alias("target"),
                     F.col("x")[0].alias("iat_cv"), F.col("x")[1].alias("iat_mean"))
    model = train_classifier("logistic_regression", rows, DEFAULTS.with_(imbalance="focal_loss", logistic_c=(1.0,)))
    scored = model.score(rows).select("target", "supervised_score").toPandas()
    assert scored["supervised_score"].between(0, 1).all()
    means = scored.groupby("target")["supervised_score"].mean()
    assert means[1] > means[0] + 0.2


def test_moments_of_parts_are_those_of_the_whole():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(1e6, 1.0, 500), rng.normal(size=500), np.full(500, 0.1)])
    n, mean, square = 0, np.zeros(0), np.zeros(0)
    for part in np.split(x, [1, 2, 130, 400]):
        n, mean, square = focal.merged((n, mean, square), focal.spread(part))
    assert n == 500 and mean[2] == 0.1 and square[2] == 0  # one value: no rounding makes a deviation of it
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(square[:2], ((x - x.mean(axis=0)) ** 2).sum(axis=0)[:2])
    margin = np.concatenate([np.linspace(-40, 40, 161), [-800.0, 800.0]])
    for gamma in (0.0, 0.5, 2.0):
        assert np.allclose(focal.plain_loss(margin, gamma), focal.row_loss(margin, gamma)[0], rtol=1e-12, atol=0)


def test_fits_of_all_folds_equal_fits_of_their_own(spark):
    df, *_ = sample(spark, parts=4)
    odd = spark.createDataFrame([(None, 1, 1.0), ([1.0, 2.0, float("nan")], 0, 1.0), ([0.0, 0.0, 0.0], None, 1.0)], KIND)
    rows = df.union(odd).withColumn("fold", F.pmod(F.xxhash64("x"), F.lit(3)).cast("int"))
    rows = rows.withColumn("x", F.concat("x", F.array(F.when(F.col("fold") == 1, F.col("x")[0]).otherwise(7.0)))).cache()
    data, fits = focal.packed(rows, 3), [(k, p) for k in (-1, 0, 1, 2) for p in (0.001, 0.1)]
    found = focal.fit_folds(data, fits, 2.0)
    for (k, penalty), fit in zip(fits, found):
        own = focal.fit_focal(rows.where(F.col("fold") != k), 2.0, penalty)
        assert np.allclose(fit.beta, own.beta, rtol=1e-5, atol=1e-7) and np.allclose(fit.losses, own.losses, rtol=1e-6)
    assert found[4].beta[4] == found[5].beta[4] == 0  # without fold 1 the last column has one value
    scores = focal.held_scores(data, {(0, 2): found[6]}).toPandas()
    assert len(scores) == rows.where("fold = 2 AND x IS NOT NULL AND y IS NOT NULL AND NOT exists(x, v -> isnan(v))").count()
    empty = focal.packed(rows.limit(0), 3)
    assert focal.fit_folds(empty, [(-1, 0.1), (0, 0.1)])[1].losses == []


def test_search_passes_over_the_rows_do_not_grow_with_its_fits(spark, monkeypatch):
    df, *_ = sample(spark)
    rows = df.rdd.map(lambda r: (f"s{r.x}", Vectors.dense(r.x), r.y, r.a)).toDF(["session_id", "features", "target", "weight"])
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("session_id"), F.lit(3)).cast("int")).cache()
    passes, written = [], []
    plain, write = focal.Packed.summed, focal.materialise
    monkeypatch.setattr(focal.Packed, "summed", lambda *args: passes.append(1) or plain(*args))
    monkeypatch.setattr(focal, "materialise", lambda df: written.append(1) or write(df))
    settings = DEFAULTS.with_(imbalance="focal_loss")
    found = supervised.tuned("logistic_regression", rows, 3, settings, 300.0, True)
    assert len(written) == 1 and len(passes) <= 2 * 50  # 16 fits, one table, two passes a step
    est = supervised.estimator("logistic_regression", settings, 300.0).estimator
    means = []
    for shape in supervised.estimator("logistic_regression", settings, 300.0).shapes:
        held = [(est.fit(rows.where(F.col("fold") != k), {est.regParam: list(shape.values())[0]}), rows.where(F.col("fold") == k)) for k in range(3)]
        means.append(sum(supervised.fold_precision(m, part, ())[0] for m, part in held) / 3)
    assert found.score == pytest.approx(max(means), abs=1e-6)
    assert list(found.params.values())[0] == pytest.approx(1 / (300 * settings.logistic_c[int(np.argmax(np.round(means, 9)))]))
    own = est.fit(rows, {est.regParam: list(found.params.values())[0]})
    assert np.allclose(found.model.coefficients.toArray(), own.coefficients.toArray(), rtol=1e-4, atol=1e-6) and len(found.fold_models) == 3
