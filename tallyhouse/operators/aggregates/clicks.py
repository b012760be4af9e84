"""Click metrics: overall, per day, product, page, action, customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.basics import lower_trim, present, require
from .. import typed
from .common import summarise, with_event_date

CUSTOMERS = typed.distinct("customer_id", "unique_customers")
SESSIONS = typed.distinct("session_id", "unique_sessions")
COUNT = typed.rows("click_count")


def prepare(df: DataFrame, event_type: str = "click") -> DataFrame:
    require(df, "event_type")
    out = with_event_date(typed.only_type(df, event_type))
    changes = {c: lower_trim(c) for c in present(out, ["action", "page"])}
    return out.withColumns(changes) if changes else out


def aggregate_overall(df: DataFrame) -> DataFrame:
    products = typed.distinct("product_id", "unique_products")
    return summarise(prepare(df), [], [typed.rows("total_clicks"), CUSTOMERS, SESSIONS, products])


def aggregate_daily(df: DataFrame, ordered: bool = True) -> DataFrame:
    measures = [typed.rows("total_clicks"), CUSTOMERS, SESSIONS]
    return summarise(prepare(df), ["event_date"], measures, ["event_date"], ordered=ordered)


def _by(df: DataFrame, key: str, measures: list, ordered: bool) -> DataFrame:
    order = [F.desc("click_count")]
    return summarise(prepare(df), [key], measures, order, ordered=ordered, drop_null=key)


def aggregate_by_product(df: DataFrame, ordered: bool = True) -> DataFrame:
    return _by(df, "product_id", [COUNT, CUSTOMERS, SESSIONS], ordered)


def aggregate_by_page(df: DataFrame, ordered: bool = True) -> DataFrame:
    return _by(df, "page", [COUNT, CUSTOMERS], ordered)


def aggregate_by_action(df: DataFrame, ordered: bool = True) -> DataFrame:
    return _by(df, "action", [COUNT, CUSTOMERS], ordered)


def aggregate_by_day_and_page(df: DataFrame, ordered: bool = True) -> DataFrame:
    order = ["event_date", F.desc("click_count")]
    by = ["event_date", "page"]
    return summarise(prepare(df), by, [COUNT, CUSTOMERS], order, ordered=ordered)


def aggregate_by_customer(df: DataFrame, ordered: bool = True) -> DataFrame:
    measures = [
        COUNT,
        typed.distinct("session_id", "session_count"),
        typed.distinct("product_id", "products_interacted"),
        typed.distinct("page", "pages_visited"),
    ]
    return _by(df, "customer_id", measures, ordered)


run = aggregate_overall
