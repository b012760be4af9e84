"""Data-quality rules as columns.

Each rule is a (name, condition) pair. ``reasons`` turns a rule list into one
array column naming the broken rules, so a frame is judged in a single pass and
split into valid and quarantined rows without joins or Python code.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import (
    CART_ACTIONS,
    CLICK_ACTIONS,
    DELIVERY_STATUSES,
    EVENT_TYPES,
    FIELDS_BY_TYPE,
    ORDER_STATUSES,
)
from .basics import as_col, filled

# --- fixed values: patterns ---
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
ZONE_PATTERN = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"
UNIT_PRICE_PATTERN = r"^-?[0-9]{1,10}(\.[0-9]{1,2})?$"
TOTAL_PATTERN = r"^-?[0-9]{1,12}(\.[0-9]{1,2})?$"
MAX_ID_LENGTH = 100
MIN_QUANTITY, MAX_QUANTITY = 1, 1000
MIN_MONEY = 0.01
# --- end of fixed values ---


@dataclass(frozen=True)
class Rule:
    name: str
    holds: Column


def reasons(rules: list[Rule]) -> Column:
    """Names of the rules that do not hold (an unknown outcome does not hold)."""
    return F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(r.holds, F.lit(False)), F.lit(r.name)).cast("string")
                for r in rules
            ]
        )
    )


def only_if(condition: Column, rules: list[Rule]) -> list[Rule]:
    """The rules bind only rows where the condition is true."""
    applies = F.coalesce(condition, F.lit(False))
    return [Rule(r.name, ~applies | F.coalesce(r.holds, F.lit(False))) for r in rules]


# ---- single-value rules -------------------------------------------------
def email(value: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(as_col(value))).rlike(EMAIL_PATTERN), F.lit(False))


def one_of(value: Column | str, allowed) -> Column:
    return F.coalesce(as_col(value).isin(*allowed), F.lit(False))


def in_range(value: Column | str, minimum, maximum) -> Column:
    return F.coalesce(as_col(value).between(minimum, maximum), F.lit(False))


def temporal_order(start: Column | str, end: Column | str) -> Column:
    return F.coalesce(as_col(start) <= as_col(end), F.lit(False))


def approximately_equal(first: Column | str, second: Column | str, tolerance="0.01") -> Column:
    bound = F.lit(str(tolerance)).cast("decimal(18,6)")
    return F.coalesce(F.abs(as_col(first) - as_col(second)) <= bound, F.lit(False))


def zoned(text: Column | str) -> Column:
    """The time text names its zone (Z or an offset)."""
    return F.coalesce(F.trim(as_col(text).cast("string")).rlike(ZONE_PATTERN), F.lit(False))


def identifier(value: Column | str) -> Column:
    size = F.length(F.trim(as_col(value)))
    return F.coalesce(size.between(1, MAX_ID_LENGTH), F.lit(False))


def optional(value: Column | str, rule: Column) -> Column:
    return as_col(value).isNull() | rule


def readable_time(value: Column | str) -> Column:
    return F.try_to_timestamp(as_col(value)).isNotNull()


def whole_quantity(value: Column | str) -> Column:
    number = as_col(value).try_cast("decimal(20,4)")
    return (number == F.floor(number)) & number.between(MIN_QUANTITY, MAX_QUANTITY)


def price(value: Column | str, pattern: str) -> Column:
    text = as_col(value).cast("string")
    return text.rlike(pattern) & (text.try_cast("decimal(18,2)") >= F.lit("0.01").cast("decimal(4,2)"))


# ---- ingestion contract -------------------------------------------------
def common_rules() -> list[Rule]:
    return [
        Rule("event_type", one_of("event_type", EVENT_TYPES)),
        Rule("event_id", identifier("event_id")),
        Rule("event_timestamp", readable_time("event_timestamp")),
        Rule("ingestion_timestamp", readable_time("ingestion_timestamp")),
        Rule("customer_id", identifier("customer_id")),
        Rule("session_id", optional("session_id", identifier("session_id"))),
    ]


def click_rules() -> list[Rule]:
    return [
        Rule("product_id", identifier("product_id")),
        Rule("page", identifier("page")),
        Rule("action", one_of("action", CLICK_ACTIONS)),
    ]


def cart_rules() -> list[Rule]:
    return [
        Rule("cart_id", identifier("cart_id")),
        Rule("product_id", identifier("product_id")),
        Rule("quantity", whole_quantity("quantity")),
        Rule("action", one_of("action", CART_ACTIONS)),
    ]


def order_rules() -> list[Rule]:
    return [
        Rule("order_id", identifier("order_id")),
        Rule("product_id", identifier("product_id")),
        Rule("quantity", whole_quantity("quantity")),
        Rule("unit_price", price("unit_price", UNIT_PRICE_PATTERN)),
        Rule("total_amount", price("total_amount", TOTAL_PATTERN)),
        Rule("status", one_of("status", ORDER_STATUSES)),
    ]


def delivery_rules() -> list[Rule]:
    return [
        Rule("order_id", identifier("order_id")),
        Rule("delivery_id", identifier("delivery_id")),
        Rule("status", one_of("status", DELIVERY_STATUSES)),
        Rule("carrier", identifier("carrier")),
        Rule("estimated_delivery", optional("estimated_delivery", readable_time("estimated_delivery"))),
        Rule("actual_delivery", optional("actual_delivery", readable_time("actual_delivery"))),
    ]


TYPE_RULES = {
    "click": click_rules,
    "cart": cart_rules,
    "order": order_rules,
    "delivery": delivery_rules,
}


def contract_rules() -> list[Rule]:
    """Common rules plus those of the row's own event type."""
    rules = common_rules()
    for event_type, make in TYPE_RULES.items():
        rules += only_if(F.col("event_type") == event_type, make())
    return rules


def extra_fields_rule(line: Column | str = "_line") -> Rule:
    """No field outside the contract of the event type."""
    keys = F.json_object_keys(as_col(line))
    holds = F.lit(False)
    for event_type, fields in FIELDS_BY_TYPE.items():
        allowed = F.array(*[F.lit(f) for f in fields])
        holds = F.when(
            F.col("event_type") == event_type, F.size(F.array_except(keys, allowed)) == 0
        ).otherwise(holds)
    return Rule("extra_field", holds)


def judge(df: DataFrame, rules: list[Rule] | None = None, column: str = "reasons") -> DataFrame:
    """Add the array of broken rules."""
    return df.withColumn(column, reasons(contract_rules() if rules is None else rules))


def judge_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parse JSON lines and judge them; unreadable lines get the reason ``json``."""
    from .jsontext import parse_events

    raw = parse_events(lines, column)
    rules = contract_rules() + [extra_fields_rule("_line")]
    broken = F.col("_corrupt_record").isNotNull()
    return raw.withColumn(
        "reasons", F.when(broken, F.array(F.lit("json"))).otherwise(reasons(rules))
    )


def is_valid(column: str = "reasons") -> Column:
    return F.size(F.col(column)) == 0


def split(judged: DataFrame, column: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(valid rows without the reasons column, quarantined rows with it)."""
    valid = judged.filter(is_valid(column)).drop(column)
    return valid, judged.filter(~is_valid(column))


def split_counts(df: DataFrame, *by: str, rules: list[Rule] | None = None) -> DataFrame:
    """Rows on both sides of :func:`split` per ``by``, in one pass: a row is judged once and its reasons are not built."""
    wanted = contract_rules() if rules is None else rules
    holds = reduce(lambda a, b: a & b, [F.coalesce(r.holds, F.lit(False)) for r in wanted], F.lit(True))
    return df.groupBy(*by, holds.alias("valid")).agg(F.count(F.lit(1)).alias("n"))


# ---- event-model rules --------------------------------------------------
def base_event_rules() -> list[Rule]:
    return [
        Rule("event_id", filled("event_id")),
        Rule("event_type", filled("event_type")),
        Rule("customer_id", filled("customer_id")),
        Rule("session_id", optional("session_id", filled("session_id"))),
        Rule("ingestion_before_event", temporal_order("event_timestamp", "ingestion_timestamp")),
    ]


def order_model_rules() -> list[Rule]:
    expected = F.col("quantity") * F.col("unit_price")
    return [
        Rule("order_id", filled("order_id")),
        Rule("product_id", filled("product_id")),
        Rule("quantity", F.col("quantity") > 0),
        Rule("unit_price", F.col("unit_price") >= 0),
        Rule("total_amount", F.col("total_amount") >= 0),
        Rule("total_mismatch", approximately_equal("total_amount", expected)),
        Rule("status", filled("status")),
    ]


def delivery_model_rules() -> list[Rule]:
    """An arrival before the estimate is good news, not an error, so no rule on it."""
    return [
        Rule("order_id", filled("order_id")),
        Rule("delivery_id", filled("delivery_id")),
        Rule("status", filled("status")),
        Rule("carrier", filled("carrier")),
    ]


def cart_model_rules() -> list[Rule]:
    return [
        Rule("cart_id", filled("cart_id")),
        Rule("product_id", filled("product_id")),
        Rule("quantity", F.col("quantity") > 0),
        Rule("action", filled("action")),
    ]


def click_model_rules() -> list[Rule]:
    return [
        Rule("product_id", filled("product_id")),
        Rule("page", filled("page")),
        Rule("action", filled("action")),
    ]


# ---- dimension rules ----------------------------------------------------
def customer_rules() -> list[Rule]:
    return [
        Rule("customer_id", filled("customer_id")),
        Rule("name", filled("name")),
        Rule("email", filled("email") & F.col("email").contains("@")),
        Rule("registration_date", F.col("registration_date").isNotNull()),
        Rule("segment", filled("segment")),
    ]


def product_rules() -> list[Rule]:
    return [
        Rule("product_id", filled("product_id")),
        Rule("name", filled("name")),
        Rule("category_id", filled("category_id")),
        Rule("price", F.col("price") >= 0),
        Rule("stock_quantity", F.col("stock_quantity") >= 0),
        Rule("brand", optional("brand", filled("brand"))),
    ]


def order_entity_rules() -> list[Rule]:
    return [
        Rule("order_id", filled("order_id")),
        Rule("customer_id", filled("customer_id")),
        Rule("product_id", filled("product_id")),
        Rule("quantity", F.col("quantity") > 0),
        Rule("unit_price", F.col("unit_price") >= 0),
        Rule("status", filled("status")),
        Rule("created_at", F.col("created_at").isNotNull()),
    ]


def cart_entity_rules() -> list[Rule]:
    return [
        Rule("cart_id", filled("cart_id")),
        Rule("customer_id", filled("customer_id")),
        Rule("product_id", filled("product_id")),
        Rule("quantity", F.col("quantity") > 0),
        Rule("status", filled("status")),
        Rule("created_at", F.col("created_at").isNotNull()),
        Rule("updated_at", optional("updated_at", temporal_order("created_at", "updated_at"))),
    ]


def delivery_entity_rules() -> list[Rule]:
    return [
        Rule("delivery_id", filled("delivery_id")),
        Rule("order_id", filled("order_id")),
        Rule("status", filled("status")),
        Rule("carrier", filled("carrier")),
        Rule("estimated_delivery", temporal_order("created_at", "estimated_delivery")),
        Rule(
            "actual_delivery",
            optional("actual_delivery", temporal_order("created_at", "actual_delivery")),
        ),
    ]
