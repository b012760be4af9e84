"""Registered queries against their SQL oracles on the smallest tables.

All of them take about twelve minutes; by default the benchmark's headline
queries and one query per kind of sink run. TEST_ALL=1 runs every query.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from bench import HEADLINE
from compare import compare, connect

# the corpus operators have their own tests
QUERIES = {k: v for k, v in entry.queries().items() if k not in entry.LLM_QUERIES}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k not in entry.LLM_QUERIES}
# rows of these need more data than the smallest tables hold
MAY_BE_EMPTY = {"al1_sales_volume_alerts", "kv1_get_row", "fo7_one_customer", "jn5_customers_without_orders"}

ALSO = [
    "src1_read_json",
    "src12_quarantined_lines",
    "src13_validated_events",
    "snk7_batch_run",
    "snk11_insert_by_name",
    "snk14_stream_keyed_windows",
    "ddl2_dim_date",
    "ddl5_catalog_views",
    "dml1_backfill_keeps_other_dates",
    "pm7_drop_partition",
    "kv3_upserted_rows",
    "mt5_latest_metrics",
    "st6_stream_overall_windows",
    "wn14_stream_lateness",
    "wn14_stream_feed_clocks",
    "snk25_rolled_archive",
    "st8_stream_alerts_upper",
    "st8_stream_quarantine",
    "snk19_alert_archive",
    "dml7_probed_views",
    "qc2_json_reasons",
    "dp15_delivery_predicates",
    "rk3_row_keys",
    "dt2_parsed_times",
    "js4_bad_lines",
    "ded5_stream_repeats",
    "mt3_latency_sketches",
    "sa8_sketched_customers",
    "st6_stream_sketched_windows",
    "al5_failing_rules",
    "tm1_column_statistics",
    "st8_whole_job",
    "src10_stream_of_files",
    "snk9_audited_publish",
    "snk26_incremental_mart",
    "ddl3_copartitioned_sales_delivery",
    "ddl3_copartitioned_customers",
]
CHOSEN = sorted(QUERIES if os.environ.get("TEST_ALL") else {*HEADLINE, *ALSO})


@pytest.fixture(scope="module")
def con(root):
    return connect(root)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_oracle(spark, con, root, name):
    verdict, detail = compare(spark, con, root, name, QUERIES[name], ORACLES.get(name))
    allowed = {"ok", "ROWS"} | ({"EMPTY"} if name in MAY_BE_EMPTY else set())
    assert verdict in allowed, f"{verdict}: {detail}"


def test_entry_runs(spark):
    result = entry.entry(spark)
    assert "total_sales" in result.columns and result.count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
