"""The driver's contract, and every query of the reference layer against DuckDB."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from verdigris import plans

NAMES = list(plans.all_queries())
#: One of each area here; the driver runs all of them.
CHECKED = ["p03_reasons", "j01_label_join", "a09_metrics_table", "c05_disagreement", "c07_arm_bands", "c12_wilson", "a19_quantile_rounded", "e10_modal", "w11_failure_runs", "t10_interval_union", "j09_either_key", "o05_scenarios", "s13_money", "e14_evidence", "e18_severity_profile", "a48_zone_summary", "l05_retention", "e07_fields", "e08_cells", "e12_items", "e24_families", "e25_split_problems", "c18_decisions", "s02_records", "s05_run_log", "s06_torn_jsonl", "s09_delimited", "s11_predictions", "s14_versioned_append", "s16_monthly_log", "a52_date_logs", "o01_mixed_sort"]


def cells(frame):
    out = []
    for row in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple("-" if pd.isna(x) else f"{float(x):.5f}" if isinstance(x, numbers.Number) else str(x) for x in row))
    return sorted(out)


def test_contract(spark, small):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 150
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", CHECKED)
def test_against_duckdb(spark, small, name):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, want = entry.queries()[name](spark, small).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_nothing_outside_imports_the_corpus_package():
    root = os.path.dirname(os.path.abspath(plans.__file__ + "/../.."))
    for path in glob.glob(f"{root}/verdigris/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "llm" not in open(path).read(), path
