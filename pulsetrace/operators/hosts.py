"""Host-level aggregation and analyst feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def host_risk(scored: DataFrame, inventory: DataFrame | None = None,
              risky: float = 0.5) -> DataFrame:
    """Highest and mean risk per inside host; ``inventory`` adds one row of facts per host."""
    hosts = scored.groupBy("orig_h").agg(
        F.max("risk_score").alias("max_risk"), F.avg("risk_score").alias("mean_risk"),
        F.count("*").alias("n_sessions"),
        F.count_if(F.col("risk_score") >= F.lit(float(risky))).alias("n_risky"))
    # Both sides have one row per host, so no key can be hot here.
    return hosts if inventory is None else hosts.join(inventory, "orig_h", "left")


def merge_feedback(scored: DataFrame, overrides: DataFrame) -> DataFrame:
    """Latest analyst label per session wins over the recorded target.

    ``overrides``: ``session_id``, ``analyst_label`` (0/1), ``at``.
    """
    latest = overrides.groupBy("session_id").agg(
        F.max_by("analyst_label", F.struct("at", "analyst_label")).alias("analyst_label"))
    return scored.join(latest, "session_id", "left").withColumns({
        "target": F.coalesce(F.col("analyst_label").cast("int"), F.col("target")),
        "overridden": F.col("analyst_label").isNotNull(),
    }).drop("analyst_label")
