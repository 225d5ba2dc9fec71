"""Shapley values of forest predictions along tree paths, as a join of tree groups and row blocks.

The nodes of a fitted forest stay a table. Whole trees are dealt to groups of bounded size, rows to blocks of
bounded size, and each block meets each group once; the contributions of a row are then summed over groups. Neither
the driver nor a broadcast ever holds the forest.

Within a group a leaf is a path of distinct features, each with the interval it must lie in and the share of training
weight that takes that branch. Its weights for all numbers of known features are built by extending the path one
feature after the other, and each feature's part is read off by unwinding it again: quadratic in the path's length.
Leaves of equal length and all rows of a block go through these steps together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsetrace.session import materialise, scratch_path

NODES_PER_GROUP = 200_000
ROWS_PER_BLOCK = 32_768
#: Numbers in one working array.
CELLS = 4_000_000


def forest_nodes(spark: SparkSession, model) -> DataFrame:
    """One row per node of a fitted forest, from its saved form."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    node = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    return node.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", 0).alias("cut"), F.expr("aggregate(impurityStats, 0D, (a, x) -> a + x)").alias("weight"),
        F.get("impurityStats", 1).alias("positive"))


def base_value(nodes: DataFrame) -> float:
    """What the forest expects without knowing any feature: the mean share of positives over its roots."""
    return nodes.where("node = 0").agg(F.avg(F.col("positive") / F.col("weight"))).first()[0]


def leaf_paths(nodes: pd.DataFrame) -> dict[int, tuple[np.ndarray, ...]]:
    """Leaves of whole trees by path length: value, features, lower bounds, upper bounds, branch shares.

    A feature tested several times on a path counts once, with the meet of its intervals and the product of its shares.
    """
    found: dict[int, list] = {}
    for _, tree in nodes.groupby("tree"):
        rows = {n.node: n for n in tree.itertuples(index=False)}
        waiting = [(0, {})]
        while waiting:
            number, path = waiting.pop()
            node = rows[number]
            if node.left < 0:
                value = node.positive / node.weight if node.weight else 0.0
                if path and value:
                    found.setdefault(len(path), []).append((value, list(path), list(path.values())))
                continue
            low, high, share = path.get(node.feature, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node.left, (low, min(high, node.cut))), (node.right, (max(low, node.cut), high))):
                part = rows[child].weight / node.weight if node.weight else 0.0
                waiting.append((child, {**path, node.feature: (*bounds, share * part)}))
    out = {}
    for m, leaves in found.items():
        bounds = np.array([b for *_, b in leaves], float).reshape(len(leaves), m, 3)
        out[m] = (np.array([v for v, *_ in leaves]), np.array([f for _, f, _ in leaves], int),
                  bounds[:, :, 0], bounds[:, :, 1], bounds[:, :, 2])
    return out


def extended(taken: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Weights (rows, leaves, m + 1) of paths that know 0 to m features; ``taken`` (rows, leaves, m) is 0 or 1."""
    rows, leaves, m = taken.shape
    weights = np.ones((rows, leaves, 1))
    for j in range(m):
        size = j + 2  # the path's length with the empty start
        known = np.arange(1, size) / size
        longer = np.zeros((rows, leaves, size))
        longer[:, :, 1:] = taken[:, :, j: j + 1] * weights * known
        longer[:, :, :-1] += shares[None, :, j: j + 1] * weights * known[::-1]
        weights = longer
    return weights


def unwound(weights: np.ndarray, taken: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Sum (rows, leaves) of the weights of the same paths without one feature, given its ``taken`` and ``share``."""
    m = weights.shape[2] - 1
    size = m + 1
    one = np.zeros(weights.shape[:2])  # where the row takes the branch
    carry = weights[:, :, m]
    for i in range(m - 1, -1, -1):
        part = carry * (size / (i + 1))
        one += part
        carry = weights[:, :, i] - part * share * ((m - i) / size)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = (weights[:, :, :m] * (size / (m - np.arange(m)))).sum(axis=2) / share
    return np.where(taken > 0, one, np.where(share > 0, rest, 0.0))


def leaf_attribution(x: np.ndarray, paths: dict[int, tuple[np.ndarray, ...]]) -> np.ndarray:
    """Contributions of every feature to the sum of the trees' predictions, for all rows of ``x``."""
    out = np.zeros_like(x, dtype=np.float64)
    for m, (value, features, low, high, shares) in paths.items():
        step = max(1, CELLS // ((m + 1) * max(1, min(len(x), 4096))))
        for a in range(0, len(value), step):
            pick = slice(a, a + step)
            spot = np.zeros((features[pick].shape[0], m, x.shape[1]))
            np.put_along_axis(spot, features[pick][:, :, None], 1.0, axis=2)
            for r in range(0, len(x), 4096):
                seen = x[r: r + 4096][:, features[pick]]
                taken = ((seen > low[pick]) & (seen <= high[pick])).astype(np.float64)
                weights = extended(taken, shares[pick])
                for j in range(m):
                    share = shares[pick][:, j]
                    gain = unwound(weights, taken[:, :, j], share) * (taken[:, :, j] - share) * value[pick]
                    out[r: r + 4096] += gain @ spot[:, j]
    return out


def tree_attribution(rows: DataFrame, model, features: Sequence[str], keep: Sequence[str] = ("session_id",),
                     nodes_per_group: int = NODES_PER_GROUP, rows_per_block: int = ROWS_PER_BLOCK) -> tuple[DataFrame, float]:
    """Add ``attribution`` (array of feature, value, attribution) to rows with a ``features`` vector.

    Also returns the base value; contributions and base add up to the forest's probability.
    """
    names = list(features)
    nodes = materialise(forest_nodes(rows.sparkSession, model))
    size = nodes.agg(F.count("*").alias("nodes"), F.max("tree").alias("last")).first()
    trees, groups = size["last"] + 1, max(1, math.ceil(size["nodes"] / nodes_per_group))
    stored = materialise(rows.select(*keep, vector_to_array("features").alias("_x"), F.monotonically_increasing_id().alias("_row")))
    blocks = max(1, math.ceil(stored.count() / rows_per_block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt_nodes = nodes.withColumn("_group", F.col("tree") % groups).withColumn("_block", each(blocks))
    dealt_rows = stored.select("_row", "_x", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("_block")).withColumn("_group", each(groups))

    def explain(pdf: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(part):
            return pd.DataFrame({"_row": [], "_phi": []})
        phi = leaf_attribution(np.stack(pdf["_x"].to_numpy()), leaf_paths(part)) / trees
        return pd.DataFrame({"_row": pdf["_row"], "_phi": list(phi)})

    parts = dealt_rows.groupBy("_group", "_block").cogroup(dealt_nodes.groupBy("_group", "_block")).applyInPandas(
        explain, "_row long, _phi array<double>")
    sums = parts.groupBy("_row").agg(F.array(*[F.sum(F.get("_phi", i)) for i in range(len(names))]).alias("_phi"))
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), F.get("_x", i).alias("value"), F.get("_phi", i).alias("attribution"))
                        for i, n in enumerate(names)])
    return stored.join(sums, "_row").select(*keep, entries.alias("attribution")), base_value(nodes)
