"""Models against brute force on small frames."""

import itertools
import math
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS
from pulsetrace.models import anomaly, supervised
from pulsetrace.models.forest_attribution import forest_nodes, tree_attribution
from pulsetrace.models.sampled_attribution import sampled_attribution
from pulsetrace.models.supervised import part_of, prefix_scores, stratified_folds, train_classifier
from pulsetrace.operators.encode import assembler
from pulsetrace.operators import smote as smote_steps
from pulsetrace.operators.smote import nearest_neighbours, searched_neighbours, smote
from pulsetrace.plans import catalog, model_queries


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 240
    y = (np.arange(n) % 6 == 0).astype(int)
    x = rng.normal(size=(n, 3)) + y[:, None] * [1.5, -1.0, 0.0]
    pdf = pd.DataFrame({"session_id": [f"s{i:03d}" for i in range(n)], "target": y,
                        "iat_cv": x[:, 0], "iat_mean": x[:, 1], "pkt_ratio": x[:, 2]})
    return spark.createDataFrame(pdf).cache()


def test_neighbours_are_exact(spark, rows):
    points = rows.select("session_id", F.array("iat_cv", "iat_mean", "pkt_ratio").alias("x"))
    want = {r.session_id: np.array(r.x) for r in points.collect()}
    for per_block in (1000, 50):
        got = nearest_neighbours(points, 4, per_block).collect()
        assert len(got) == len(want)
        for r in got:
            order = sorted((float(((want[r.session_id] - v) ** 2).sum()), k)
                           for k, v in want.items() if k != r.session_id)[:4]
            assert [n["other"] for n in r.neighbours] == [k for _, k in order]


def test_pruned_neighbours_are_exact_on_clusters_and_copies(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(1500, 3)) + 40 * rng.integers(0, 6, size=(1500, 3)), 3)
    x[:400] = x[0]  # a third are copies of one row
    x[400] = 1e6
    data = [(f"s{i:04d}", p.tolist(), i % 2) for i, p in enumerate(x)] + [("odd", [float("nan"), 0.0, 1.0], 0)]
    points = spark.createDataFrame(data, "session_id string, x array<double>, fold int")
    for per in (None, "fold"):
        near, looked = searched_neighbours(points, 5, 200, per)
        got = {r.session_id: [n["other"] for n in r.neighbours] for r in near.collect()}
        assert len(got) == 1500 and looked.first().pairs < 1500 ** 2 / 10, per
        for i in [0, 7, 399, 400, *range(401, 1500, 9)]:
            gap = ((x - x[i]) ** 2).T
            gap = gap[0] + gap[1] + gap[2]
            order = sorted((g, f"s{j:04d}") for j, g in enumerate(gap) if j != i and (per is None or j % 2 == i % 2))
            assert got[f"s{i:04d}"] == [name for _, name in order[:5]]
    assert nearest_neighbours(points.limit(0), 5).count() == 0
    assert nearest_neighbours(points.limit(1), 5).count() == 0


def test_smote_balances_and_interpolates(spark, rows):
    ready = assembler(["iat_cv", "iat_mean", "pkt_ratio"]).transform(rows).select(
        "session_id", "target", "features")
    out = smote(ready, DEFAULTS)
    counts = dict(out.groupBy("target").count().collect())
    assert counts[0] == counts[1] == 200
    real = np.array([r[0].toArray() for r in ready.where("target=1").select("features").collect()])
    for r in out.where("session_id like '%#%'").limit(40).collect():
        p = r.features.toArray()
        on_segment = any(
            abs(np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b)) < 1e-9
            for a, b in itertools.combinations(real, 2))
        assert on_segment


def test_smote_fills_folds_with_one_positive(spark, rows):
    ready = assembler(["iat_cv", "iat_mean", "pkt_ratio"]).transform(rows).select("session_id", "target", "features")
    few = ready.where("target = 1").orderBy("session_id").limit(5).withColumn(
        "fold", (F.row_number().over(Window.orderBy("session_id")) - 1).cast("int"))
    some = few.unionByName(ready.where("target = 0").limit(83).withColumn("fold", F.lit(0)))
    out = smote(some, DEFAULTS, per="fold")
    assert dict(out.groupBy("target").count().collect()) == {0: 83, 1: 83}
    made = out.where("session_id like '%#%'").groupBy("fold").count().collect()
    assert {r.fold for r in made} == set(range(5))


def test_folds_keep_class_shares(rows):
    folded, k = stratified_folds(rows, DEFAULTS)
    assert k == 5
    counts = folded.groupBy("fold", "target").count().collect()
    for r in counts:
        assert r["count"] == (8 if r.target else 40)


def shapley(x, leaves, d):
    """Definition by enumerating all feature subsets."""
    def value(subset):
        total = 0.0
        for v, feats, low, high, shares in leaves:
            w = 1.0
            for f, lo, hi, s in zip(feats, low, high, shares):
                w *= float(lo < x[f] <= hi) if f in subset else s
            total += v * w
        return total

    phi = np.zeros(d)
    for j in range(d):
        others = [f for f in range(d) if f != j]
        for size in range(d):
            for s in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(d - 1 - size) / math.factorial(d)
                phi[j] += w * (value({*s, j}) - value(set(s)))
    return phi


def plain_leaves(nodes):
    """Leaves as (value per forest, features, low, high, shares), from a recursive walk."""
    trees, leaves = nodes["tree"].nunique(), []
    for _, tree in nodes.groupby("tree"):
        by_id = {n["node"]: n for n in tree.to_dict("records")}

        def walk(number, bounds):
            node = by_id[number]
            if node["left"] < 0:
                names = sorted(bounds)
                columns = np.array([bounds[f] for f in names]).reshape(-1, 3).T
                leaves.append((node["positive"] / node["weight"] / trees, np.array(names, dtype=int), *columns))
                return
            low, high, share = bounds.get(node["feature"], (-np.inf, np.inf, 1.0))
            for child, lo, hi in ((node["left"], low, min(high, node["cut"])), (node["right"], max(low, node["cut"]), high)):
                walk(child, {**bounds, node["feature"]: (lo, hi, share * by_id[child]["weight"] / node["weight"])})

        walk(0, {})
    return leaves


def gap_of(model, ready, found, base):
    total = found.select("session_id", F.aggregate(
        "attribution", F.lit(0.0), lambda a, e: a + e["attribution"]).alias("phi"))
    return model.transform(ready).select(
        "session_id", vector_to_array("probability")[1].alias("p")).join(total, "session_id").agg(
        F.count("*"), F.max(F.abs(F.col("p") - F.col("phi") - base))).first()


def test_tree_attribution_is_additive_and_exact(spark, rows):
    names = ["iat_cv", "iat_mean", "pkt_ratio"]
    ready = assembler(names).transform(rows)
    model = RandomForestClassifier(featuresCol="features", labelCol="target", numTrees=5, maxDepth=4,
                                   seed=1).fit(ready)
    nodes = forest_nodes(spark, model).toPandas()
    leaves = plain_leaves(nodes)
    for limits in ((200_000, 32_768), (20, 50)):  # one tree group and block; several of both
        found, base = tree_attribution(ready, model, names, nodes_per_group=limits[0], rows_per_block=limits[1])
        count, gap = gap_of(model, ready, found, base)
        assert count == 240 and gap < 1e-9 and 0 < base < 1
        for r in found.orderBy("session_id").limit(5).collect():
            x = np.array([e.value for e in r.attribution])
            assert np.allclose([e.attribution for e in r.attribution], shapley(x, leaves, 3))


def test_deep_paths_stay_additive(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 24))
    y = ((x * rng.normal(size=24)).sum(axis=1) + rng.normal(size=400) > 0).astype(float)
    names = [f"f{i}" for i in range(24)]
    df = spark.createDataFrame([(f"s{i:03}", Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y))], ["session_id", "features", "target"])
    model = RandomForestClassifier(featuresCol="features", labelCol="target", numTrees=30, maxDepth=30, seed=2).fit(df)
    found, base = tree_attribution(df, model, names, nodes_per_group=1000)
    assert gap_of(model, df, found, base)[1] < 1e-9


def test_components_error_matches_numpy(spark, rows):
    columns = ["iat_cv", "iat_mean", "pkt_ratio"]
    benign = rows.where("target = 0")
    model = anomaly.train_components(benign, 2, columns)
    got = {r.session_id: r.error for r in model.error(rows).select("session_id", "error").collect()}
    b = benign.select(*columns).toPandas().to_numpy()
    z = (rows.orderBy("session_id").select(*columns).toPandas().to_numpy() - b.mean(0)) / b.std(0)
    zb = (b - b.mean(0)) / b.std(0)
    _, vectors = np.linalg.eigh(zb.T @ zb)
    v = vectors[:, -2:]
    want = ((z - z @ v @ v.T) ** 2).mean(axis=1)
    assert np.allclose([got[f"s{i:03d}"] for i in range(len(z))], want)


def test_autoencoder_learns_and_repeats(spark, rows):
    settings = DEFAULTS.with_(autoencoder_epochs=30, autoencoder_rate=0.005)
    columns = ["iat_cv", "iat_mean", "pkt_ratio"]
    benign = rows.where("target = 0").coalesce(1)
    one = anomaly.train_autoencoder(benign, settings, columns)
    short = anomaly.train_autoencoder(benign, settings.with_(autoencoder_epochs=1), columns)
    assert one.validation_loss < short.validation_loss
    again = anomaly.train_autoencoder(benign.repartition(3), settings, columns)
    assert np.allclose(one.flat, again.flat)
    assert one.error(rows).where("error is null or error < 0").count() == 0


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    layers = anomaly._layers(3, (4, 2, 4))
    flat = rng.normal(size=sum(a * b + b for a, b in layers)) * 0.5
    x = rng.normal(size=(7, 3))

    def loss(w):
        return ((anomaly._forward(x, anomaly._unpack(w, layers))[-1] - x) ** 2).mean(axis=1).sum()

    got = anomaly._gradient(x, anomaly._unpack(flat, layers), np.random.default_rng(1), 0.0)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-6 - got[i]) < 1e-4


def test_isolation_forest_ranks_an_outlier_first(spark, rows):
    columns = ["iat_cv", "iat_mean", "pkt_ratio"]
    model = anomaly.train_isolation_forest(rows.where("target = 0"), 50, 64, columns=columns)
    assert model.nodes["tree"].nunique() == 50
    roots = model.nodes[model.nodes["node"] == 0]
    assert (roots["size"] <= 64).all() and (roots["size"] >= 40).all()
    far = spark.createDataFrame([("far", 0, 50.0, -50.0, 50.0)], rows.schema)
    top = model.error(rows.unionByName(far)).orderBy(F.desc("error")).first()
    assert top.session_id == "far" and top.error > 0


def test_distance_matches_numpy(spark, rows):
    columns = ["iat_cv", "iat_mean", "pkt_ratio"]
    benign = rows.where("target = 0")
    model = anomaly.train_distance(benign, 0.0, columns)
    b = benign.select(*columns).toPandas().to_numpy()
    z = (b - b.mean(0)) / b.std(0)
    inverse = np.linalg.inv(np.corrcoef(z.T))
    want = sorted(np.einsum("ij,jk,ik->i", z, inverse, z) / 3)
    got = sorted(r.error for r in model.error(benign).select("error").collect())
    assert np.allclose(got, want)


def test_unknown_names_are_refused(rows):
    with pytest.raises(ValueError):
        anomaly.train_detector("nothing", rows)
    with pytest.raises(ValueError):
        train_classifier("nothing", rows, calibrate=False)


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibrated_scores_are_probabilities(rows, method):
    settings = DEFAULTS.with_(logistic_c=(1.0,), cv_folds=2, calibration=method)
    model = train_classifier("logistic_regression", rows, settings)
    scored = model.score(rows)
    assert scored.where("supervised_score < 0 or supervised_score > 1").count() == 0
    means = dict(scored.groupBy("target").agg(F.avg("supervised_score")).collect())
    assert means[1] > means[0] + 0.2
    assert set(scored.columns) == {*rows.columns, "supervised_score"}


class LinearScore:
    """Stands in for a model whose probability is linear in the features."""

    def __init__(self, slopes):
        self.slopes = slopes

    def transform(self, df):
        value = sum((vector_to_array("features")[i] * float(w) for i, w in enumerate(self.slopes)), F.lit(0.5))
        return df.withColumn("probability", array_to_vector(F.array(1 - value, value)))


def test_sampled_attribution_of_a_linear_model(spark):
    draw = np.random.default_rng(4)
    for d in (1, 2, 3, 7):
        vectors, slopes = draw.normal(size=(30, d)), draw.normal(size=d) / 10
        df = spark.createDataFrame([(f"s{i:02}", Vectors.dense(v)) for i, v in enumerate(vectors)], ["session_id", "features"])
        names = [f"n{i}" for i in range(d)]
        found = {(r.session_id, r.feature): r.attribution
                 for r in sampled_attribution(df.limit(6), df, LinearScore(slopes), names).collect()}
        assert len(found) == 6 * d
        for i in range(6):
            want = (vectors[i] - vectors.mean(axis=0)) * slopes
            np.testing.assert_allclose([found[f"s{i:02}", n] for n in names], want, atol=1e-9)


def test_sampled_attribution_with_all_sets_is_exact(spark):
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(25, 3))
    df = spark.createDataFrame([(f"s{i:02}", Vectors.dense(v), float(v[0] + v[1] > 0)) for i, v in enumerate(vectors)],
                               ["session_id", "features", "label"])
    model, names = LogisticRegression(regParam=0.1).fit(df), ["a", "b", "c"]  # of three features every set is asked
    chance = lambda x: 1 / (1 + np.exp(-(x @ model.coefficients.toArray() + model.intercept)))
    found = {(r.session_id, r.feature): r.attribution for r in sampled_attribution(df.limit(4), df, model, names).collect()}
    for i in range(4):
        def worth(members):
            return chance(np.where(np.isin(range(3), members), vectors[i], vectors)).mean()

        for j in range(3):
            others = [k for k in range(3) if k != j]
            want = sum(math.factorial(n) * math.factorial(2 - n) / 6 * (worth([*s, j]) - worth(s))
                       for n in range(3) for s in map(list, itertools.combinations(others, n)))
            assert found[f"s{i:02}", names[j]] == pytest.approx(want, abs=1e-9)


def test_nested_ensembles_equal_models_of_their_own(rows):
    ready = assembler(["iat_cv", "iat_mean", "pkt_ratio"]).transform(rows).select("session_id", "target", "features")
    forest = RandomForestClassifier(labelCol="target", numTrees=9, maxDepth=4, seed=1).fit(ready)
    boosted = {n: GBTClassifier(labelCol="target", maxIter=n, maxDepth=3, seed=1).fit(ready) for n in (3, 6)}

    def scores(df, column="score"):
        return sorted(r[0] for r in df.select(column).collect())

    for model, sizes in ((forest, (2, 5, 9)), (boosted[6], (3, 6))):
        found = prefix_scores(model, ready, sizes)
        for n in sizes:
            own = part_of(model, 0, n) if model is forest else boosted[n]
            assert own.getNumTrees == n
            want = own.transform(ready).select(vector_to_array("probability")[1].alias("score"))
            np.testing.assert_allclose(scores(found.where(F.col("size") == n)), scores(want), atol=1e-12)


def test_search_looks_at_every_point_and_keeps_its_folds(rows):
    settings = DEFAULTS.with_(forest_trees=(3, 6), forest_depth=(2, None), forest_min_leaf=(1, 20), cv_folds=3)
    model = train_classifier("random_forest", rows, settings)
    best = model.metadata["best_params"]
    assert best["numTrees"] in (3, 6) and best["maxDepth"] in (2, 30) and best["minInstancesPerNode"] in (1, 20)
    assert 0.5 < model.metadata["cv_best_score_pr_auc"] <= 1
    assert [m.getNumTrees for m, _ in model.calibration.pairs] == [best["numTrees"]] * 3
    assert model.model.getNumTrees == best["numTrees"]


def test_sampled_attribution_of_a_logistic_model_shuffles_nothing(spark):
    draw = np.random.default_rng(6)
    vectors = draw.normal(size=(120, 7))
    df = spark.createDataFrame([(f"s{i:03}", Vectors.dense(v), float(v[0] + v[1] * v[2] > 0)) for i, v in enumerate(vectors)],
                               ["session_id", "features", "label"])
    model, names = LogisticRegression(regParam=0.01).fit(df), [f"n{i}" for i in range(7)]

    class Hidden:
        transform = staticmethod(model.transform)

    found = sampled_attribution(df, df, model, names)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    own = {(r.session_id, r.feature): r.attribution for r in found.collect()}
    asked = {(r.session_id, r.feature): r.attribution for r in sampled_attribution(df, df, Hidden(), names).collect()}
    assert own.keys() == asked.keys() and len(own) == 120 * 7
    assert max(abs(own[k] - asked[k]) for k in own) < 1e-12
    far = df.select(F.lit("far").alias("session_id"), array_to_vector(F.array(*[F.lit(1e9)] * 7)).alias("features")).limit(1)
    assert all(np.isfinite(r.attribution) for r in sampled_attribution(far, df, model, names).collect())


def test_folds_of_all_shapes_are_fitted_side_by_side(spark, rows, monkeypatch):
    meet, fits = threading.Barrier(4), itertools.count()

    class Waiting:
        def fit(self, part, params):
            if next(fits) < 4:
                meet.wait(60)
            return params

    grid = supervised.Grid(Waiting(), [{"a": 1}, {"a": 2}])
    monkeypatch.setattr(supervised, "estimator", lambda *args: grid)
    monkeypatch.setattr(supervised, "fold_precision", lambda model, held, sizes: [model["a"] / 2])
    found = supervised.tuned("any", rows.withColumn("fold", F.lit(0)), 2, DEFAULTS, 1.0, False)
    assert (found.params, found.score, found.fold_models) == ({"a": 2}, 1.0, [{"a": 2}] * 2)


def test_autoencoder_lanes_are_shuffled_once(spark, rows, monkeypatch):
    monkeypatch.setattr(anomaly, "LANE_ROWS", 20)
    frame, grouped = type(rows), []
    plain = frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda df, *keys: grouped.append(keys) or plain(df, *keys))
    settings = DEFAULTS.with_(autoencoder_epochs=4, autoencoder_hidden=(3, 2, 3))
    models = [anomaly.train_autoencoder(rows.where("target = 0").repartition(n), settings) for n in (1, 5)]
    assert len([k for k in grouped if k == ("lane",)]) == 2  # one a training of four passes
    assert np.allclose(models[0].flat, models[1].flat, rtol=1e-6) and models[0].epochs == 4
    assert all(np.isfinite(m.validation_loss) for m in models)


@pytest.mark.parametrize("query, name", [("gbt_scores", "gradient_boosting"), ("rf_scores", "random_forest")])
def test_score_queries_search_the_whole_default_grid(spark, monkeypatch, query, name):
    asked = []

    class Scores:
        score = staticmethod(lambda test: spark.createDataFrame([("s", 1, 0.5)], "session_id string, target int, supervised_score double"))

    monkeypatch.setattr(model_queries, "_parts", lambda *args: (None, None))
    monkeypatch.setattr(supervised, "train_classifier", lambda kind, train, settings=DEFAULTS: asked.append((kind, settings)) or Scores)
    catalog.QUERIES[query](spark, "anywhere")
    (kind, settings), = asked
    assert kind == name and settings == DEFAULTS
    grid = supervised.estimator(name, settings, 1.0)
    assert grid.sizes == {"gbt_scores": (200, 400), "rf_scores": (200, 400, 800)}[query] and len(grid.shapes) == 9


def test_ensembles_come_without_an_object_a_tree(spark, rows, tmp_path):
    ready = assembler(["iat_cv", "iat_mean", "pkt_ratio"]).transform(rows).select("session_id", "target", "features")
    settings = DEFAULTS.with_(forest_trees=(6,), boost_rounds=(6,))
    for name, plain in (("random_forest", RandomForestClassifier), ("gradient_boosting", GBTClassifier)):
        grid = supervised.estimator(name, settings, 1.0, weighted=False)
        model = grid.estimator.fit(ready, {grid.estimator.maxDepth: 3, grid.size: 6})
        size = {"numTrees": 6} if name == "random_forest" else {"maxIter": 6}
        want = plain(labelCol="target", maxDepth=3, seed=DEFAULTS.seed, **size).fit(ready)
        cut = part_of(model, 1, 4)
        assert "trees" not in model.__dict__ and "trees" not in cut.__dict__ and "trees" in want.__dict__
        strip = lambda text: text.split("\n", 1)[1]
        assert strip(model.toDebugString) == strip(want.toDebugString) and cut.getNumTrees == len(cut.trees) == 3
    assert spark.sparkContext.getCheckpointDir()  # rounds of boosting do not keep their whole lineage


def test_fewer_fits_side_by_side_where_rows_do_not_fit(spark):
    assert supervised.side_by_side(spark, 1000, 50, 800) == 8
    assert supervised.side_by_side(spark, 10 ** 9, 50) == 1


def test_neighbour_search_carries_ids_and_few_distances(spark):
    draw = np.random.default_rng(9)
    x = draw.normal(size=(300, 4))
    points = spark.createDataFrame([(f"s{i // 2:03d}", v.tolist()) for i, v in enumerate(x)], "session_id string, x array<double>")
    placed = smote_steps.cells(points, 3, 100)
    found = placed.searched(placed.points.select("session_id", "x", "lane", "cell"))
    assert not any(kind.startswith("array") for _, kind in found.dtypes)
    pivots = draw.normal(size=(500, 40))
    rows = draw.normal(size=(900, 40))
    parts = list(smote_steps._distances(pd.Series(list(rows)), pivots))
    assert max(len(p) for p in parts) * pivots.size <= 2_000_000
    assert np.allclose(np.concatenate(parts)[7], np.sqrt(((rows[7] - pivots) ** 2).sum(axis=1)))
    near = nearest_neighbours(points, 3).collect()  # every id comes twice
    where = {tuple(v): f"s{i // 2:03d}" for i, v in enumerate(x)}
    assert len(near) == 150 and all(len(r.neighbours) == 3 and all(where[tuple(n["y"])] == n.other != r.session_id for n in r.neighbours) for r in near)


def test_rows_are_held_in_memory_only_where_fits_leave_room(spark, rows, monkeypatch):
    seen = []

    def tuned(name, part, folds, settings, total, weighted, parallelism):
        seen.append((parallelism, part.storageLevel.useMemory))
        raise KeyError(name)

    monkeypatch.setattr(supervised, "tuned", tuned)
    for most in (3, 1):
        monkeypatch.setattr(supervised, "side_by_side", lambda *args, most=most: most)
        with pytest.raises(KeyError):
            train_classifier("logistic_regression", rows)
    assert seen == [(3, True), (1, False)]
