"""Queries next to their SQL on tables with values the smallest tables do not hold."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, connect


@pytest.fixture(scope="module")
def free_purchases(tmp_path_factory, root):
    """The tables with every third purchase at a value that rounds to nothing."""
    out = tmp_path_factory.mktemp("tables")
    for file in Path(root).glob("*.parquet"):
        shutil.copyfile(file, out / file.name)
    (out / "events.parquet").unlink()
    connect(root).execute(
        "COPY (SELECT * REPLACE (CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 0.004 ELSE value END AS value) "
        f"FROM events) TO '{out}/events.parquet' (FORMAT parquet)")
    return str(out)


ZERO = [
    "qc22_order_entity_rules",
    "src13_validated_events",
    "qc9_canonical_json",
    "src15_event_count",
    "src17_stream_validated",
]


@pytest.mark.parametrize("name", ZERO)
def test_orders_without_an_amount(spark, free_purchases, name):
    verdict, detail = compare(spark, connect(free_purchases), free_purchases, name, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict == "ok", detail


@pytest.fixture(scope="module")
def many_clicks(tmp_path_factory, root):
    """A million clicks: half of the latencies, and 95 %, end at the edge of two values."""
    out = tmp_path_factory.mktemp("clicks")
    for file in Path(root).glob("*.parquet"):
        shutil.copyfile(file, out / file.name)
    (out / "events.parquet").unlink()
    connect(root).execute(
        "COPY (SELECT e.* REPLACE (i AS event_id, 'click' AS event_type) FROM range(1000000) r(i), (SELECT * FROM events LIMIT 1) e) "
        f"TO '{out}/events.parquet' (FORMAT parquet)")
    return str(out)


def test_percentiles_at_the_edge_of_two_values(spark, many_clicks):
    name = "mt3_latency"
    verdict, detail = compare(spark, connect(many_clicks), many_clicks, name, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict == "ok", detail
