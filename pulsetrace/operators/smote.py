"""Synthetic minority rows between a row and one of its nearest minority neighbours.

Neighbours are exact. Rows belong to the cell of their nearest pivot. A row first searches its own cell; the k-th
distance found there bounds the cells that can still hold a nearer one, by the triangle inequality and the planes between
pivots, and only those are visited. Searches run as groups of at most two blocks, however many rows a cell has or is visited by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsetrace.config import DEFAULTS, Settings
from pulsetrace.functions.hashing import hash_uniform
from pulsetrace.session import materialise

ROWS_PER_BLOCK = 5_000
#: Bounds what every task holds of the cells: a position, a radius and a count each.
MOST_PIVOTS = 4_096
#: Widens the distance bound by what rounding may take from it.
SLACK = 1e-9
#: What a search gives: no positions, which are joined to the k that are left in the end.
FOUND = "session_id string, other string, at long, distance double"


def _distances(x: pd.Series, pivots: np.ndarray) -> Iterator[np.ndarray]:
    """Distance of each row to each pivot, a few rows at a time: a task never holds those of a whole batch."""
    step = max(1, 2_000_000 // max(pivots.size, 1))
    for at in range(0, len(x), step):
        yield np.sqrt(((np.stack(x.iloc[at:at + step].to_numpy())[:, None, :] - pivots[None]) ** 2).sum(axis=2))


@dataclass(frozen=True)
class Cells:
    """Points by the cell of their nearest pivot; ``offered`` has those that can be a neighbour of any other."""

    pivots: np.ndarray
    points: DataFrame
    offered: DataFrame
    k: int
    rows_per_block: int

    def searched(self, visits: DataFrame) -> DataFrame:
        """The k best of the visited cell for each visit (``session_id``, ``x``, ``lane``, ``cell``)."""
        rows, k = self.rows_per_block, self.k
        asked = visits.groupBy("lane", "cell").agg(F.count("*").alias("asks"))
        sizes = self.offered.groupBy("lane", "cell").agg(F.count("*").alias("size"))
        blocks = lambda c: F.ceil(F.col(c) / F.lit(rows)).cast("int")
        layout = materialise(asked.join(sizes, ["lane", "cell"]).select(
            "lane", "cell", blocks("size").alias("subs"), blocks("asks").alias("parts")))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        asking = visits.join(layout, ["lane", "cell"]).select(
            "session_id", "x", "lane", "cell", dealt("session_id", "parts").alias("part"), every("subs").alias("sub"))
        offered = self.offered.join(layout, ["lane", "cell"]).select(
            "other", "at", "y", F.col("lane").alias("lane2"), F.col("cell").alias("cell2"),
            dealt("other", "subs").alias("sub2"), every("parts").alias("part2"))
        together = asking.groupBy("lane", "cell", "part", "sub").cogroup(
            offered.groupBy("lane2", "cell2", "part2", "sub2"))
        return together.applyInPandas(lambda left, right: _best(left, right, k), FOUND)

    def further(self, near: DataFrame) -> DataFrame:
        """The other cells that may hold a point nearer than the k-th in ``near`` (``session_id``, ``neighbours``)."""
        stats = self.offered.groupBy("lane", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
        radius, count = {}, {}
        for r in stats.collect():  # lanes x pivots at most
            radius.setdefault(r.lane, np.full(len(self.pivots), -np.inf))[r.cell] = r.radius
            count.setdefault(r.lane, np.zeros(len(self.pivots)))[r.cell] = r.n
        pivots, k = self.pivots, self.k

        @F.pandas_udf("array<int>")
        def reached(x: pd.Series, lane: pd.Series, cell: pd.Series, bound: pd.Series) -> pd.Series:
            out = []
            for d, z, own, limit in zip((d for part in _distances(x, pivots) for d in part), lane, cell, bound):
                most = d + radius[z]
                order = np.argsort(most)
                # Cells that together hold k others lie within the farthest of them.
                enough = np.searchsorted(np.cumsum(count[z][order]), k + 1)
                if enough < len(order):
                    limit = min(limit, most[order[enough]])
                # What is nearer to another pivot lies beyond the plane between that pivot and the own one.
                apart = np.maximum(np.sqrt(((pivots - pivots[own]) ** 2).sum(axis=1)), 1e-300)
                plane = (d * d - d[own] * d[own]) / (2 * apart)
                hit = (count[z] > 0) & (d - radius[z] <= limit + SLACK * (1 + d)) & (
                    plane <= limit + SLACK * (1 + d * d / apart))
                hit[own] = False
                out.append(np.flatnonzero(hit).astype(np.int32))
            return pd.Series(out, dtype=object)

        last = F.when(F.size("neighbours") >= k, F.sqrt(F.element_at("neighbours", -1)["distance"]))
        bounds = near.select("session_id", last.alias("bound"))
        asking = self.points.join(bounds, "session_id", "left").withColumn(
            "bound", F.coalesce("bound", F.lit(float("inf"))))
        return asking.select("session_id", "x", "lane", F.explode(reached("x", "lane", "cell", "bound")).alias("cell"))


def _best(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of ``right`` for each row of ``left``."""
    names = [part.split()[0] for part in FOUND.split(", ")]
    if left.empty or right.empty:
        return pd.DataFrame({n: pd.Series(dtype=object if n in ("session_id", "other") else float) for n in names})
    right = right.sort_values("other")
    q, r = np.stack(left["x"].to_numpy()), np.stack(right["y"].to_numpy())
    ids, others, at = left["session_id"].to_numpy(), right["other"].to_numpy(), right["at"].to_numpy()
    out = []
    for start in range(0, len(q), 256):
        part = q[start:start + 256]
        gap = np.zeros((len(part), len(r)))
        for j in range(q.shape[1]):
            gap += (part[:, j:j + 1] - r[:, j]) ** 2
        gap[ids[start:start + 256][:, None] == others[None, :]] = np.inf
        order = np.argsort(gap, axis=1, kind="stable")[:, :k]
        for i, row in enumerate(order):
            for j in row:
                if np.isfinite(gap[i, j]):
                    out.append((ids[start + i], others[j], at[j], gap[i, j]))
    return pd.DataFrame(out, columns=names)


def cells(points: DataFrame, k: int, rows_per_block: int = ROWS_PER_BLOCK, per: str | None = None) -> Cells:
    """The points in cells around about sqrt(n) pivots, the different points lowest by hash.

    Points that are not finite have no neighbours. Of equal points only the k + 1 smallest ids can be among the k
    nearest of any, so no more are offered: copies cost k + 1 distances each.
    """
    lane = F.col(per).cast("int") if per else F.lit(0)
    finite = F.forall("x", lambda v: (F.abs(v) < float("inf")) & ~F.isnan(v))
    kept = points.where(finite).select("session_id", "x", lane.alias("lane"))
    different = materialise(kept.groupBy("x").agg(F.min("session_id").alias("first")))
    number = min(MOST_PIVOTS, max(1, int(np.ceil(np.sqrt(different.count())))))
    chosen = different.orderBy(F.xxhash64("first"), "first").limit(number).select("x").collect()
    pivots = np.array([r.x for r in chosen], dtype=float)

    @F.pandas_udf("cell int, away double")
    def nearest(x: pd.Series) -> pd.DataFrame:
        cell, nearby = np.zeros(len(x), np.int32), np.zeros(len(x))
        done = 0
        for away in _distances(x, pivots):
            cell[done:done + len(away)], nearby[done:done + len(away)] = away.argmin(axis=1), away.min(axis=1)
            done += len(away)
        return pd.DataFrame({"cell": cell, "away": nearby})

    # Ids may come twice, so the rows have a number of their own.
    placed = materialise(kept.withColumn("near", nearest("x")).select(
        "session_id", "x", "lane", "near.cell", "near.away", F.monotonically_increasing_id().alias("at")))
    equal = Window.partitionBy("lane", "x").orderBy("session_id")
    offered = materialise(placed.withColumn("_copy", F.row_number().over(equal)).where(F.col("_copy") <= k + 1).select(
        F.col("session_id").alias("other"), "at", F.col("x").alias("y"), "lane", "cell", "away"))
    return Cells(pivots, placed, offered, k, rows_per_block)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each row's partial results; a group holds k rows of three numbers per visited block."""
    listed = F.slice(F.array_sort(F.collect_list(F.struct("distance", "other", "at"))), 1, k)
    return found.groupBy("session_id").agg(listed.alias("neighbours"))


def _positions(near: DataFrame, placed: Cells) -> DataFrame:
    """The neighbours and their rows with positions."""
    where = placed.offered.select("at", "y")
    listed = near.select("session_id", F.inline("neighbours")).join(where, "at").groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("distance", "other", "y"))).alias("neighbours"))
    own = placed.points.groupBy(F.col("session_id").alias("_own")).agg(F.first("x").alias("x"))
    return listed.join(own, F.col("session_id").eqNullSafe(F.col("_own"))).select("session_id", "x", "neighbours")


def nearest_neighbours(points: DataFrame, k: int, rows_per_block: int = ROWS_PER_BLOCK,
                       per: str | None = None) -> DataFrame:
    """``session_id``, ``neighbours``: the k nearest other points (id and position), nearest first.

    ``points`` has ``session_id`` and ``x`` (array<double>). With ``per`` only points of the same
    value are neighbours. Equal distances are ordered by id.
    """
    return searched_neighbours(points, k, rows_per_block, per)[0]


def searched_neighbours(points: DataFrame, k: int, rows_per_block: int = ROWS_PER_BLOCK,
                        per: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The nearest neighbours, and one row with ``pairs``: how many distances were looked at."""
    placed = cells(points, k, rows_per_block, per)
    home = placed.points.select("session_id", "x", "lane", "cell")
    near = materialise(_merged(placed.searched(home), k))
    visits = materialise(placed.further(near))
    found = near.select("session_id", F.inline("neighbours")).select("session_id", "other", "at", "distance")
    sizes = placed.offered.groupBy("lane", "cell").agg(F.count("*").alias("size"))
    asked = home.unionByName(visits).groupBy("lane", "cell").agg(F.count("*").alias("asks"))
    looked = asked.join(sizes, ["lane", "cell"]).agg(
        F.coalesce(F.sum(F.col("asks") * F.col("size")), F.lit(0)).alias("pairs"))
    return _positions(_merged(found.unionByName(placed.searched(visits)), k), placed), looked


def synthetic_points(points: DataFrame, wanted: int, k: int, seed: int,
                     per: str | None = None) -> DataFrame:
    """Exactly ``wanted`` new positions, spread evenly over the given points.

    With ``per``, a point that is alone in its part borrows its neighbours from all parts. Fewer than
    two points have no neighbours and make nothing.
    """
    total = points.count()
    if total < 2 or wanted <= 0:
        return points.limit(0).select("session_id", "x")
    near = materialise(nearest_neighbours(points, k, per=per))
    if per:
        lonely = points.join(near.select("session_id"), "session_id", "left_anti").select("session_id")
        if not lonely.isEmpty():
            near = near.unionByName(nearest_neighbours(points, k).join(lonely, "session_id", "left_semi"))
    each, rest = divmod(wanted, total)
    # The points are the minority of a bounded fit; those lowest by hash are used once more.
    more = points.select("session_id").orderBy(F.xxhash64("session_id"), "session_id").limit(rest).withColumn(
        "more", F.lit(1))
    near = near.join(more, "session_id", "left")
    copies = F.lit(each) + F.coalesce("more", F.lit(0))
    made = near.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))
                                             .otherwise(F.array().cast("array<int>"))))
    name = F.concat_ws("#", "session_id", "copy")
    pick = F.floor(hash_uniform(seed, name, "pick") * F.size("neighbours")).cast("int")
    chosen = F.get("neighbours", pick)["y"]
    step = hash_uniform(seed, name, "step")
    return made.select("session_id", name.alias("name"), chosen.alias("y"), step.alias("step"), "x"
                       ).select(F.col("name").alias("session_id"), F.zip_with(
                           "x", "y", lambda a, b: a + F.col("step") * (b - a)).alias("x"))


def smote(rows: DataFrame, settings: Settings = DEFAULTS, per: str | None = None) -> DataFrame:
    """The rows and enough synthetic positives to balance the classes.

    ``rows`` has ``session_id``, ``target`` and a vector ``features``. With ``per`` (a fold number),
    neighbours come from the same fold and the synthetic row stays in it.
    """
    counts = {r["target"]: r["count"] for r in rows.groupBy("target").count().collect()}
    minority = rows.where("target = 1").withColumn("x", vector_to_array("features"))
    n = counts.get(1, 0)
    k = min(settings.smote_neighbours, max(1, n - 1))
    new = synthetic_points(minority, counts.get(0, 0) - n, k, settings.seed, per)
    made = new.select("session_id", F.lit(1).alias("target"), array_to_vector("x").alias("features"))
    if per:
        parent = F.regexp_replace("session_id", r"#\d+$", "")
        folds = minority.select(F.col("session_id").alias("_parent"), per)
        made = made.withColumn("_parent", parent).join(folds, "_parent").drop("_parent")
    return rows.unionByName(made.select(*rows.columns))
