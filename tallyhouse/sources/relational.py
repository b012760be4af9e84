"""Projection of order-line, event and dimension tables onto EVENT and the star schema.

The mapping keeps every source row. The line/order join is a plain equi-join on
the order key: both sides are large, so Spark sorts and merges them (or
broadcasts when its statistics prove a side small) and AQE splits hot orders.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.basics import MONEY, PRICE
from ..schemas import EVENT, EVENT_TYPES
from .readers import to_unified

CENT = "0.01"
CLICK_KINDS = ("click", "view")
CART_KINDS = ("signup", "error")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _cents(value: str) -> Column:
    """Whole cents of an amount stored as double (primitive arithmetic, no BigDecimal)."""
    return F.floor(F.col(value) * 100 + 0.5)


def _plus_seconds(moment: str, seconds: Column) -> Column:
    """Timestamp plus seconds as long arithmetic on microseconds."""
    return F.timestamp_micros(F.unix_micros(F.col(moment)) + seconds.cast("long") * 1_000_000)


def _money(cents: Column, type_name: str) -> Column:
    return (cents.cast("decimal(14,0)") * F.lit(CENT).cast("decimal(3,2)")).cast(type_name)


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _lines_with_orders(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_returnflag",
        "l_linestatus",
        F.col("l_shipdate").cast("timestamp").alias("l_shipdate"),
    )
    orders = table(spark, root, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        "o_custkey",
        "o_orderstatus",
        F.col("o_orderdate").cast("timestamp").alias("o_orderdate"),
    )
    return spread(lines).join(orders, "l_orderkey")


def _line_id(prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}-"), _text("l_orderkey"), F.lit("-"), _text("l_linenumber"))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table with fewer splits than cores, dealt over the cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _joined(spark: SparkSession, root: str) -> DataFrame:
    cents, quantity = _cents("l_extendedprice"), F.col("l_quantity").cast("long")
    return _lines_with_orders(spark, root).withColumns({"cents": cents, "q": quantity})


def _order_fields() -> dict[str, Column]:
    status = (
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "created")
        .otherwise("processing")
    )
    return {
        "event_id": _line_id("o"),
        "event_type": F.lit("order"),
        "event_timestamp": F.col("o_orderdate"),
        "ingestion_timestamp": _plus_seconds("o_orderdate", F.col("l_linenumber") * 3),
        "customer_id": _text("o_custkey"),
        "product_id": _text("l_partkey"),
        "quantity": F.col("q").cast("int"),
        "order_id": _text("l_orderkey"),
        "unit_price": _money(F.expr("(2 * cents + q) div (2 * q)"), PRICE),
        "total_amount": _money(F.col("cents"), MONEY),
        "status": status,
    }


def _delivery_fields() -> dict[str, Column]:
    status = (
        F.when(F.col("l_linestatus") == "F", "delivered")
        .when(F.col("l_returnflag") == "R", "failed")
        .when(F.col("l_returnflag") == "A", "in_transit")
        .otherwise("pending")
    )
    return {
        "event_id": _line_id("d"),
        "event_type": F.lit("delivery"),
        "event_timestamp": F.col("l_shipdate"),
        "ingestion_timestamp": _plus_seconds("l_shipdate", F.col("l_linenumber") * 21_600),
        "customer_id": _text("o_custkey"),
        "order_id": _text("l_orderkey"),
        "status": status,
        "delivery_id": _line_id("dl"),
        "carrier": F.concat(F.lit("carrier-"), _text("l_suppkey")),
        "estimated_delivery": _plus_seconds("o_orderdate", F.lit(30 * 86_400)),
        "actual_delivery": F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")),
    }


def _events_of(joined: DataFrame, fields: dict[str, Column]) -> DataFrame:
    return to_unified(joined.select(*[column.alias(name) for name, column in fields.items()]))


def order_events(spark: SparkSession, root: str) -> DataFrame:
    return _events_of(_joined(spark, root), _order_fields())


def delivery_events(spark: SparkSession, root: str) -> DataFrame:
    return _events_of(_joined(spark, root), _delivery_fields())


def line_events(spark: SparkSession, root: str) -> DataFrame:
    """The order and the delivery event of every line, from one join of lines and orders."""

    order, delivery = _order_fields(), _delivery_fields()
    kinds = F.explode(F.array(F.lit("order"), F.lit("delivery")))
    nothing = F.lit(None)

    def either(f: T.StructField) -> Column:
        mine, other = order.get(f.name, nothing), delivery.get(f.name, nothing)
        return F.when(F.col("kind") == "order", mine.cast(f.dataType)).otherwise(other.cast(f.dataType))

    # one expression per column, so that a column nobody reads is not scanned either
    doubled = _joined(spark, root).withColumn("kind", kinds)
    return doubled.select(*[either(f).alias(f.name) for f in EVENT.fields])


def _activity(frame: DataFrame) -> DataFrame:
    return frame.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _activity_common() -> list[Column]:
    return [
        F.concat(F.lit("e-"), _text("event_id")).alias("event_id"),
        F.col("ts").alias("event_timestamp"),
        _plus_seconds("ts", F.pmod(F.col("event_id"), F.lit(20))).alias("ingestion_timestamp"),
        _text("user_id").alias("customer_id"),
        F.concat_ws("-", F.lit("s"), _text("user_id"), F.date_format("ts", "yyyyMMdd")).alias(
            "session_id"
        ),
    ]


def activity_stream(spark: SparkSession, root: str) -> DataFrame:
    """The activity table as a file stream (batch and stream share the projection)."""
    schema = table(spark, root, "events").schema
    # a glob, so that a table kept as one single file can be streamed as well
    frame = spark.readStream.schema(schema).parquet(f"{root}/events.parque[t]")
    return activity_from(frame)


def activity_events(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the activity table as EVENT: clicks, carts and small orders."""
    return activity_from(table(spark, root, "events"))


def activity_from(frame: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    is_click = kind.isin(*CLICK_KINDS)
    is_cart = kind.isin(*CART_KINDS)
    is_order = kind == "purchase"
    click_action = (
        F.when(kind == "view", "view")
        .when(F.pmod(F.col("k"), F.lit(2)) == 0, "product_view")
        .otherwise("add_to_cart")
    )
    cart_action = F.when(kind == "signup", "created").otherwise("abandoned")
    value = _money(_cents("value"), MONEY)
    return to_unified(
        _activity(frame).select(
            *_activity_common(),
            F.when(is_click, "click").when(is_cart, "cart").otherwise("order").alias("event_type"),
            F.concat(F.lit("p-"), _text("k")).alias("product_id"),
            F.when(is_click, kind).alias("page"),
            F.when(is_click, click_action).when(is_cart, cart_action).alias("action"),
            F.when(
                is_cart,
                F.concat_ws("-", F.lit("c"), _text("user_id"), F.date_format("ts", "yyyyMMdd")),
            ).alias("cart_id"),
            F.when(is_cart, F.col("k") % 12 + 1).when(is_order, F.lit(1)).alias("quantity"),
            F.when(is_order, F.concat(F.lit("e-"), _text("event_id"))).alias("order_id"),
            F.when(is_order, value).alias("unit_price"),
            F.when(is_order, value).alias("total_amount"),
            F.when(is_order, F.lit("confirmed")).alias("status"),
        )
    )


def _of_kind(spark: SparkSession, root: str, kinds: tuple[str, ...]) -> DataFrame:
    """Filter on the stored column, so that it reaches the Parquet scan."""
    return table(spark, root, "events").filter(F.col("event_type").isin(*kinds))


def click_events(spark: SparkSession, root: str) -> DataFrame:
    return activity_from(_of_kind(spark, root, CLICK_KINDS))


def cart_events(spark: SparkSession, root: str) -> DataFrame:
    return activity_from(_of_kind(spark, root, CART_KINDS))


#: Event types and the stored kinds of the activity table that become events of the type.
ACTIVITY_OF = {"click": CLICK_KINDS, "cart": CART_KINDS, "order": ("purchase",)}


def all_events(spark: SparkSession, root: str, types: Sequence[str] = EVENT_TYPES) -> DataFrame:
    """Order and delivery events of the lines plus all activity events.

    ``types`` names the event types that are wanted. A line becomes two events only where both of its
    types are, and only stored kinds that can become a wanted type are read.
    """
    of_lines = {("order",): order_events, ("delivery",): delivery_events, ("order", "delivery"): line_events}
    lines = of_lines.get(tuple(t for t in ("order", "delivery") if t in types))
    kinds = tuple(k for t in types for k in ACTIVITY_OF.get(t, ()))
    parts = [lines(spark, root)] if lines else []
    if set(types) >= set(ACTIVITY_OF):
        parts.append(activity_events(spark, root))  # a kind that is not listed is an order, too
    elif "order" in types:
        parts.append(activity_events(spark, root).filter(F.col("event_type").isin(*types)))
    elif kinds:
        parts.append(activity_from(_of_kind(spark, root, kinds)))
    return reduce(DataFrame.unionByName, parts)


def dim_customer(spark: SparkSession, root: str) -> DataFrame:
    """Customer dimension; the source has no e-mail or date, so both are derived."""
    return table(spark, root, "customer").select(
        F.col("c_custkey").alias("customer_sk"),
        _text("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
        F.lit("1995-01-01 00:00:00").cast("timestamp").alias("registration_date"),
        F.col("c_mktsegment").alias("segment"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


def dim_product(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select(
        F.col("p_partkey").alias("product_sk"),
        _text("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category_id"),
        F.col("p_brand").alias("brand"),
        _money(_cents("p_retailprice"), "decimal(18,2)").alias("price"),
        F.col("p_size").cast("long").alias("stock_quantity"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


def dim_category(spark: SparkSession, root: str) -> DataFrame:
    """Categories are the distinct product types; the key is a stable hash of the name."""
    return (
        table(spark, root, "part")
        .select(F.col("p_type").alias("category_id"))
        .distinct()
        .select(
            F.xxhash64("category_id").alias("category_sk"),
            "category_id",
            F.initcap(F.col("category_id")).alias("name"),
            F.concat(F.lit("products of type "), F.col("category_id")).alias("description"),
            F.lit(None).cast("string").alias("parent_category_id"),
            F.create_map().cast("map<string,string>").alias("metadata"),
        )
    )
