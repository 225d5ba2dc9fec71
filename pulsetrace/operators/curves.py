"""Ranking metrics and curves of scored rows.

Scores are first reduced to distinct values with their positive and negative counts. Running totals
over those are taken in value buckets, plus one offset per bucket, so no task orders more than its
bucket. All functions take ``by`` columns and then answer for every group in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsetrace.session import materialise

BUCKETS = 256

ACCURACY_NOTE = (
    "Accuracy and ROC-AUC are shown for completeness. With very few positives a model that never "
    "alerts has high accuracy and detects nothing; judge by PR-AUC."
)


def running_totals(df: DataFrame, score: str = "score", target: str = "target",
                   by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: ``pos``, ``neg`` at it, ``tp``, ``fp`` at or above it, class totals, and
    the counts of the next lower score (null for the lowest)."""
    by = list(by)
    totals = materialise(
        df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.sum(F.col(target).cast("bigint")).alias("pos"),
             F.sum(1 - F.col(target).cast("bigint")).alias("neg")))
    # A fixed number of border values, whatever the data size.
    borders = totals.approxQuantile("score", [i / BUCKETS for i in range(1, BUCKETS)], 0.001)
    splits = [float("-inf"), *sorted(set(borders) or {0.0}), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="score", outputCol="_b").transform(totals)
    top = F.max_by(F.struct("pos", "neg"), "score")
    # At most BUCKETS + 1 rows per group from here on.
    lower = Window.partitionBy(*by).orderBy(F.desc("_b"))
    whole = Window.partitionBy(*by)
    offsets = placed.groupBy(*by, "_b").agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), top.alias("top"))
    before = lower.rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        *by, "_b",
        F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p_above"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_above"),
        F.sum("p").over(whole).alias("n_pos"), F.sum("n").over(whole).alias("n_neg"),
        F.lead("top").over(lower).alias("after"))
    inside = Window.partitionBy(*by, "_b").orderBy(F.desc("score"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (placed.withColumns({
        "tp": F.sum("pos").over(so_far), "fp": F.sum("neg").over(so_far),
        "_next": F.lead(F.struct("pos", "neg")).over(inside)})
        .join(F.broadcast(offsets), [*by, "_b"])
        .select(*by, "score", "pos", "neg", (F.col("tp") + F.col("p_above")).alias("tp"),
                (F.col("fp") + F.col("n_above")).alias("fp"), "n_pos", "n_neg",
                F.coalesce("_next", "after").alias("following")))


def _by(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


def ranking_metrics(df: DataFrame, score: str = "score", target: str = "target",
                    by: Sequence[str] = ()) -> DataFrame:
    """``pr_auc`` (average precision, ties grouped) and ``roc_auc``; null with one class only."""
    points = running_totals(df, score, target, by)
    gain = F.try_divide("pos", "n_pos") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    both = (F.max("n_pos") > 0) & (F.max("n_neg") > 0)
    return _by(points, by).agg(
        F.sum(gain).alias("pr_auc"),
        F.when(both, F.try_divide(F.sum(area), F.max("n_pos").cast("double") * F.max("n_neg")))
        .alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "score", target: str = "target",
                      by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, target, by).drop("roc_auc")


def roc_auc(df: DataFrame, score: str = "score", target: str = "target",
            by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, target, by).drop("pr_auc")


def pr_curve(df: DataFrame, score: str = "score", target: str = "target",
             by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at every distinct score, and the closing point (1, 0)."""
    points = running_totals(df, score, target, by).select(
        *by, F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(F.try_divide("tp", "n_pos"), F.lit(1.0)).alias("recall"))
    ends = _by(points, by).agg(F.lit(None).cast("double").alias("threshold"),
                               F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(ends)


def roc_curve(df: DataFrame, score: str = "score", target: str = "target",
              by: Sequence[str] = (), drop_collinear: bool = True) -> DataFrame:
    """False and true positive rate at every distinct score, and the opening point (0, 0).

    With ``drop_collinear`` a point on a straight line between its neighbours is left out.
    """
    points = running_totals(df, score, target, by)
    if drop_collinear:
        first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
        last = F.col("following").isNull()
        bend = (F.col("following.pos") != F.col("pos")) | (F.col("following.neg") != F.col("neg"))
        points = points.where(first | last | bend)
    curve = points.select(
        *by, F.col("score").alias("threshold"), F.try_divide("fp", "n_neg").alias("fpr"),
        F.try_divide("tp", "n_pos").alias("tpr"))
    start = _by(curve, by).agg(F.lit(None).cast("double").alias("threshold"),
                               F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return curve.unionByName(start)


def recall_at_precision(df: DataFrame, precision: float, score: str = "score",
                        target: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """Best recall among thresholds whose precision is at least the given one (0 if none is)."""
    points = running_totals(df, score, target, by)
    enough = F.col("tp") / (F.col("tp") + F.col("fp")) >= F.lit(float(precision))
    return _by(points, by).agg(F.coalesce(
        F.max(F.when(enough, F.try_divide("tp", "n_pos"))), F.lit(0.0)).alias("recall"))


def threshold_metrics(df: DataFrame, threshold: float | Column, score: str = "score",
                      target: str = "target", by: Sequence[str] = (),
                      flows_per_day: int | None = None) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy at a threshold; empty ratios are 0."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    flagged, positive = F.col(score) >= limit, F.col(target) == 1
    counts = _by(df, by).agg(
        F.count_if(flagged & positive).alias("tp"), F.count_if(flagged & ~positive).alias("fp"),
        F.count_if(~flagged & positive).alias("fn"), F.count_if(~flagged & ~positive).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    out = counts.withColumns({
        "precision_at_threshold": ratio(tp, tp + fp),
        "recall_at_threshold": ratio(tp, tp + fn),
        "f1_at_threshold": ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": ratio(tp + tn, tp + fp + fn + tn)})
    if flows_per_day is not None:
        out = out.withColumn("false_positives_per_day",
                             fp / F.greatest(fp + tn, F.lit(1)) * F.lit(float(flows_per_day)))
    return out


def false_positives_per_day(df: DataFrame, threshold: float, flows_per_day: int,
                            score: str = "score", target: str = "target") -> DataFrame:
    return threshold_metrics(df, threshold, score, target, flows_per_day=flows_per_day).select(
        "false_positives_per_day")


def confusion_matrix(df: DataFrame, threshold: float, score: str = "score",
                     target: str = "target") -> DataFrame:
    """Four rows (actual, predicted, n); empty cells stay."""
    return threshold_metrics(df, threshold, score, target).selectExpr(
        "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (actual, predicted, n)")


def recall_at_threshold(df: DataFrame, threshold: float, score: str = "score",
                        target: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """Share of positive rows scored at or above the threshold; null without positives."""
    hit = F.when(F.col(target) == 1, (F.col(score) >= F.lit(float(threshold))).cast("int"))
    return _by(df, by).agg(F.avg(hit).alias("recall_at_threshold"))


def full_metrics(df: DataFrame, threshold: float, flows_per_day: int, score: str = "score",
                 target: str = "target") -> DataFrame:
    """The whole metric row of one scored set at one threshold."""
    at = threshold_metrics(df, threshold, score, target, flows_per_day=flows_per_day)
    ranks = ranking_metrics(df, score, target)
    # Both sides are single aggregate rows.
    return (at.withColumn("_one", F.lit(1)).join(ranks.withColumn("_one", F.lit(1)), "_one")
            .drop("_one").withColumn("threshold", F.lit(float(threshold))))
