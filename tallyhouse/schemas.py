"""Fixed schemas and vocabularies.

Every scan uses an explicit schema: nothing is inferred, so reading a large
folder never costs an extra pass over the data.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "STRING": T.StringType(),
    "TIMESTAMP": T.TimestampType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "MAP<STRING;STRING>": T.MapType(T.StringType(), T.StringType()),
    "DECIMAL(12;2)": T.DecimalType(12, 2),
    "DECIMAL(14;2)": T.DecimalType(14, 2),
    "DECIMAL(24;2)": T.DecimalType(24, 2),
}


def struct(columns: str) -> T.StructType:
    """Schema from ``name TYPE, ...`` text without a running session (imports need none)."""
    flat = columns.replace("STRING,STRING", "STRING;STRING")
    for scale in ("12", "14", "24"):
        flat = flat.replace(f"({scale},2)", f"({scale};2)")
    pairs = [part.split() for part in flat.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


EVENT_DDL = (
    "event_id STRING, event_type STRING, event_timestamp TIMESTAMP, "
    "ingestion_timestamp TIMESTAMP, customer_id STRING, session_id STRING, "
    "metadata MAP<STRING,STRING>, product_id STRING, page STRING, action STRING, "
    "cart_id STRING, quantity INT, order_id STRING, unit_price DECIMAL(12,2), "
    "total_amount DECIMAL(14,2), status STRING, delivery_id STRING, carrier STRING, "
    "estimated_delivery TIMESTAMP, actual_delivery TIMESTAMP"
)
EVENT: T.StructType = struct(EVENT_DDL)
EVENT_COLUMNS: list[str] = EVENT.fieldNames()

#: Same fields, all text: keeps what the producer sent so rules can judge it.
RAW_EVENT: T.StructType = T.StructType(
    [
        T.StructField(f.name, f.dataType if f.name == "metadata" else T.StringType())
        for f in EVENT.fields
    ]
)

WINDOW_RESULT = struct(
    "window_start TIMESTAMP, window_end TIMESTAMP, event_type STRING, event_count BIGINT, "
    "unique_customers BIGINT, total_quantity BIGINT, total_amount DECIMAL(24,2), "
    "key STRING, metadata MAP<STRING,STRING>"
)
ALERT = struct(
    "alert_id STRING, alert_type STRING, detected_at TIMESTAMP, event_timestamp TIMESTAMP, "
    "severity STRING, message STRING, event_type STRING, customer_id STRING, "
    "product_id STRING, metrics MAP<STRING,STRING>"
)
METRIC = struct(
    "name STRING, value DOUBLE, timestamp TIMESTAMP, unit STRING, tags MAP<STRING,STRING>"
)

# --- fixed values: vocabularies of the event contract ---
EVENT_TYPES = ("click", "cart", "order", "delivery")
CLICK_ACTIONS = ("view", "search", "product_view", "add_to_cart")
CART_ACTIONS = ("created", "updated", "removed", "abandoned")
ORDER_STATUSES = ("created", "confirmed", "processing", "shipped", "delivered", "cancelled")
DELIVERY_STATUSES = ("pending", "in_transit", "out_for_delivery", "delivered", "failed")
COMPLETED_STATUSES = ("completed", "delivered")
SEVERITIES = ("info", "warning", "critical")

REQUIRED_FIELDS = (
    "event_id",
    "event_type",
    "event_timestamp",
    "ingestion_timestamp",
    "customer_id",
)
COMMON_FIELDS = REQUIRED_FIELDS + ("session_id", "metadata")
FIELDS_BY_TYPE = {
    "click": COMMON_FIELDS + ("product_id", "page", "action"),
    "cart": COMMON_FIELDS + ("cart_id", "product_id", "quantity", "action"),
    "order": COMMON_FIELDS
    + ("order_id", "product_id", "quantity", "unit_price", "total_amount", "status"),
    "delivery": COMMON_FIELDS
    + ("order_id", "delivery_id", "status", "carrier", "estimated_delivery", "actual_delivery"),
}

CURATED_COLUMNS = (
    "event_id",
    "event_type",
    "event_timestamp",
    "ingestion_timestamp",
    "customer_id",
    "session_id",
    "product_id",
    "order_id",
    "cart_id",
    "delivery_id",
    "quantity",
    "unit_price",
    "total_amount",
    "status",
    "carrier",
    "page",
    "action",
    "event_date",
    "event_hour",
    "event_year",
    "event_month",
    "event_day",
    # kept in addition: later steps and the external curated table read them
    "estimated_delivery",
    "actual_delivery",
    "event_delay_seconds",
    "is_late_event",
)
# --- end of fixed values ---
