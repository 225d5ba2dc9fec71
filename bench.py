"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run twice to warm the JVM up, then three times; its time is the median of the three.
Flow tables are written once beforehand, so a query's time is its own work, not the derivation of the
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from pulsetrace.operators import curves, sweeps
from pulsetrace.operators.decision import calibrate_thresholds, decide
from pulsetrace.operators.features import feature_matrix, session_features
from pulsetrace.operators.labels import binary_target
from pulsetrace.plans.flow_queries import write_csv_export
from pulsetrace.plans.inputs import add_scores, scored_sessions
from pulsetrace.session import build_session, materialise, scratch_path
from pulsetrace.sources import views
from pulsetrace.sources.flow_logs import read_csv_export

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session("bench", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    parts = int(CPUS)
    long = materialise(views.flows_long(spark, FOLDER).repartition(parts))
    short = materialise(views.flows(spark, FOLDER).repartition(parts))
    csv = scratch_path(spark, "bench-csv")
    write_csv_export(long.repartition(parts), csv)
    n_long, n_short = long.count(), short.count()
    kept_long, kept_short = binary_target(long), binary_target(short)
    scored = materialise(add_scores(session_features(kept_short, blocks=("timing", "volume", "meta"))))

    def verdicts():
        limits = calibrate_thresholds(scored)
        drain(scored.select("*", decide("risk_score", limits).alias("action")))

    def regular(sessions, settings):
        return sessions.select(
            "target", "jitter_pct", F.round(1 / (1 + F.col("iat_cv")), 6).alias("score"))

    queries = {
        "load_target_csv": (n_long, lambda: drain(binary_target(read_csv_export(spark, csv)))),
        "load_target_parquet": (n_long, lambda: drain(kept_long)),
        "session_features_long": (n_long, lambda: drain(session_features(kept_long))),
        "feature_matrix_long": (n_long, lambda: drain(feature_matrix(kept_long))),
        "feature_matrix": (n_short, lambda: drain(feature_matrix(kept_short))),
        "score_sessions": (n_short, lambda: drain(add_scores(session_features(
            kept_short, blocks=("timing", "volume", "meta"))))),
        "verdicts": (n_short, verdicts),
        "average_precision": (n_short, lambda: drain(curves.average_precision(scored, "risk_score"))),
        "jitter_curve": (n_short, lambda: drain(sweeps.jitter_curve(
            kept_short, regular, 0.85, blocks=("timing",)))),
        "flagship_from_events": (n_short, lambda: drain(scored_sessions(spark, FOLDER))),
    }
    seconds = {}
    for name, (_, run) in queries.items():
        run()
        run()
        times = []
        for _ in range(3):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    print(json.dumps({
        "metric": "headline queries, warm, median of 3", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds,
        "rows_per_sec": {n: round(queries[n][0] / s) for n, s in seconds.items()},
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "cpus": parts}))


if __name__ == "__main__":
    main()
