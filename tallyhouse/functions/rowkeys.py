"""Row-key expressions of the keyed tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import as_col

SEPARATOR = ":"


def build(*parts: Column | str, separator: str = SEPARATOR) -> Column:
    """Trimmed parts joined by the separator, which is replaced inside parts.

    Null when any part is null or blank: such a row has no key.
    """
    if not parts:
        raise ValueError("a row key needs at least one part")
    cleaned = [
        F.nullif(F.trim(F.replace(as_col(p).cast("string"), F.lit(separator), F.lit("_"))), F.lit(""))
        for p in parts
    ]
    return F.concat(*[c for cl in cleaned for c in (F.lit(separator), cl)][1:])


def date(value: Column | str) -> Column:
    return F.date_format(as_col(value), "yyyyMMdd")


def timestamp(value: Column | str) -> Column:
    return F.date_format(as_col(value), "yyyyMMddHHmmssSSSSSS")


def event(event_type: Column | str, event_id: Column | str) -> Column:
    return build(event_type, event_id)


def alert(alert_type: Column | str, event_id: Column | str, moment: Column | str) -> Column:
    return build(alert_type, event_id, timestamp(moment))


def sales_metric(event_date: Column | str, dimension: Column | str, key: Column | str) -> Column:
    return build(date(event_date), dimension, key)


def delivery_metric(event_date: Column | str, carrier: Column | str, order_id: Column | str) -> Column:
    return build(date(event_date), carrier, order_id)


def customer(customer_id: Column | str, moment: Column | str | None = None) -> Column:
    tail = [] if moment is None else [timestamp(moment)]
    return build(F.lit("customer"), customer_id, *tail)


def product(product_id: Column | str, moment: Column | str | None = None) -> Column:
    tail = [] if moment is None else [timestamp(moment)]
    return build(F.lit("product"), product_id, *tail)


def prefixed(prefix: str, *parts: Column | str) -> Column:
    if not prefix.strip():
        raise ValueError("prefix must not be blank")
    return build(F.lit(prefix), *parts)


def epoch_text(moment: Column | str) -> Column:
    """Epoch seconds with six decimals, from exact microseconds."""
    micros = F.unix_micros(as_col(moment))
    million = F.lit(1_000_000).cast("long")
    return F.format_string("%d.%06d", F.floor(micros / million).cast("long"), F.pmod(micros, million))


def alert_row(alert_id: Column | str, alert_type: Column | str, moment: Column | str) -> Column:
    return F.concat_ws("#", epoch_text(moment), as_col(alert_type), as_col(alert_id))


def window_row(window_start: Column | str, event_type: Column | str, key: Column | str) -> Column:
    """Key of a window result; a window without a key is ``global``."""
    owner = F.coalesce(F.nullif(as_col(key), F.lit("")), F.lit("global"))
    return F.concat_ws("#", F.lit("window"), epoch_text(window_start), as_col(event_type), owner)
