"""Registered queries against their SQL on the smallest tables.

By default one query per module family; ``PLUMBLINE_ALL_QUERIES=1`` runs all.
"""

from __future__ import annotations

import os

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SOME = ["missing_total_lineitem", "duplicate_flags_orders", "near_duplicates_same_date_orders", "category_levels_part",
        "describe_lineitem", "iqr_outliers_lineitem", "spearman_lineitem", "heteroskedasticity_lineitem",
        "gap_fill_interpolate_orders", "missing_dates_orders", "pacf_daily", "kpss_trend_daily", "chow_scan_daily",
        "bai_perron_monthly", "cusum_daily", "panel_frequency_orders", "read_messy_lines_customer", "findings_executive_cards"]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SOME) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(entry.oracle_sql()) if os.environ.get("PLUMBLINE_ALL_QUERIES") else SOME)
def test_query_matches_sql(spark, con, name):
    assert oracle.differences(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None
