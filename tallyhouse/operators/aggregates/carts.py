"""Cart metrics: overall, per day, action, product, customer, abandonment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.basics import count_when, lower_trim, require
from .. import typed
from .common import summarise, with_event_date

# --- fixed values: actions counted per outcome. The ingestion contract only
# allows created/updated/removed/abandoned; both vocabularies are accepted. ---
ACTIVE = ("add", "add_to_cart", "update")
CONVERSION = ("checkout", "purchase", "converted")
ABANDONMENT = ("abandon", "abandoned")
REMOVAL = ("remove", "removed")
CONTRACT_ACTIVE = ("created", "updated")
# --- end of fixed values ---

CARTS = typed.distinct("cart_id", "unique_carts")
CUSTOMERS = typed.distinct("customer_id", "unique_customers")
QUANTITY = typed.total("quantity", "total_quantity")


def prepare(df: DataFrame, event_type: str = "cart") -> DataFrame:
    require(df, "event_type")
    out = with_event_date(typed.only_type(df, event_type))
    changes = {}
    if "action" in out.columns:
        changes["action"] = lower_trim("action")
    if "quantity" in out.columns:
        changes["quantity"] = F.col("quantity").try_cast("long")
    return out.withColumns(changes) if changes else out


def aggregate_overall(df: DataFrame) -> DataFrame:
    measures = [
        typed.rows("total_cart_events"),
        CARTS,
        CUSTOMERS,
        typed.distinct("product_id", "unique_products"),
        typed.total("quantity", "total_items_in_cart_events"),
    ]
    return summarise(prepare(df), [], measures)


def aggregate_daily(df: DataFrame, ordered: bool = True) -> DataFrame:
    measures = [typed.rows("cart_event_count"), CARTS, CUSTOMERS, QUANTITY]
    return summarise(prepare(df), ["event_date"], measures, ["event_date"], ordered=ordered)


def aggregate_by_action(df: DataFrame, ordered: bool = True) -> DataFrame:
    measures = [typed.rows("event_count"), CARTS, CUSTOMERS, QUANTITY]
    order = [F.desc("event_count")]
    return summarise(prepare(df), ["action"], measures, order, ordered=ordered, drop_null="action")


def aggregate_by_product(df: DataFrame, ordered: bool = True) -> DataFrame:
    measures = [typed.rows("cart_event_count"), CARTS, CUSTOMERS, QUANTITY]
    order = [F.desc("cart_event_count")]
    return summarise(
        prepare(df), ["product_id"], measures, order, ordered=ordered, drop_null="product_id"
    )


def aggregate_by_customer(df: DataFrame, ordered: bool = True) -> DataFrame:
    measures = [
        typed.rows("cart_event_count"),
        typed.distinct("cart_id", "cart_count"),
        typed.distinct("product_id", "products_interacted"),
        QUANTITY,
    ]
    order = [F.desc("cart_event_count")]
    return summarise(
        prepare(df), ["customer_id"], measures, order, ordered=ordered, drop_null="customer_id"
    )


def aggregate_daily_by_action(df: DataFrame, ordered: bool = True) -> DataFrame:
    by = ["event_date", "action"]
    measures = [typed.rows("event_count"), CARTS, QUANTITY]
    return summarise(prepare(df), by, measures, by, ordered=ordered)


def calculate_abandonment_metrics(df: DataFrame, contract_actions: bool = False) -> DataFrame:
    """Counts per cart outcome; ``contract_actions`` also counts created/updated as active."""
    require(df, "action")
    action = F.col("action")
    active = ACTIVE + CONTRACT_ACTIVE if contract_actions else ACTIVE
    return prepare(df).agg(
        count_when(action.isin(*active)).alias("active_cart_events"),
        count_when(action.isin(*CONVERSION)).alias("conversion_events"),
        count_when(action.isin(*ABANDONMENT)).alias("abandonment_events"),
        count_when(action.isin(*REMOVAL)).alias("removal_events"),
    )


run = aggregate_overall
