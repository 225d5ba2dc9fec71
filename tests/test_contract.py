"""The driver's entry points."""

import importlib.util
from pathlib import Path

from conftest import SF

from pulsetrace.config import NUMERIC_FEATURES


def entry_module():
    path = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_flagship_runs(spark):
    df = entry_module().entry(spark)
    assert df.columns == ["session_id", "iat_cv", "resp_bytes_is_zero", "risk_score", "action"]
    assert df.count() == 140


def test_every_sql_has_a_query():
    module = entry_module()
    assert set(module.oracle_sql()) <= set(module.queries()) and len(module.queries()) >= 100


def test_matrix_is_wide_and_whole(spark):
    df = entry_module().queries()["feature_matrix"](spark, SF)
    assert set(NUMERIC_FEATURES) <= set(df.columns) and df.count() == 140
    assert "orig_h" not in df.columns
