"""Alert rules as (predicate, alert columns) pairs, and queries on alert tables.

The same rules run on batch and streaming frames: they only add columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import lower_trim, seconds_between
from ..functions.guarded import Guarded, guard
from ..functions.jsontext import ISO_FORMAT
from ..functions.rowkeys import alert_row
from ..schemas import ALERT, SEVERITIES

# --- fixed values: names, thresholds and texts of the alerts ---
HIGH_SALES_VOLUME = "HIGH_SALES_VOLUME"
LARGE_ORDER_VALUE = "LARGE_ORDER_VALUE"
LATE_DELIVERY = "LATE_DELIVERY"
VOLUME_TEXT = ("Volume de vendas acima do limite: ", " eventos.")
VALUE_TEXT = ("Pedido com valor acima do limite: ", ".")
LATE_TEXT = ("Entrega apresenta atraso superior a ", " horas.")
VOLUME_THRESHOLD = 100
VALUE_THRESHOLD = "10000.00"
LATE_THRESHOLD_HOURS = 24
CLOSED_DELIVERIES = ("delivered", "failed")
# --- end of fixed values ---


@dataclass(frozen=True)
class AlertRule:
    """``fires`` may be null (then it does not fire); ``columns`` build the alert.

    Either may be guarded: a row on which it fails gets no alert of this rule and a row in :func:`failures`.
    """

    alert_type: str
    severity: str
    fires: Column | Guarded
    columns: dict[str, Column | Guarded]

    def fired(self) -> Column:
        """True where the alert is due: the rule holds and neither it nor a column of the alert failed."""
        holds = guard(self.fires)
        fired = F.coalesce(holds.value, F.lit(False))
        checks = [c.error.isNull() for c in (self.fires, *self.columns.values()) if isinstance(c, Guarded)]
        return reduce(lambda a, b: a & b, checks, fired)

    def failure(self) -> Column:
        """Why the rule could not be judged, or why its alert could not be built; null if neither."""
        holds = guard(self.fires)
        built = F.coalesce(*[guard(c).error for c in self.columns.values()], F.lit(None).cast("string"))
        return F.coalesce(holds.error, F.when(holds.value, built))

    def struct(self) -> Column:
        given = {name: guard(c).value for name, c in self.columns.items()}
        given["alert_type"] = F.lit(self.alert_type)
        given["severity"] = F.lit(self.severity)
        given["detected_at"] = F.current_timestamp()
        return F.struct(
            *[
                given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                for f in ALERT.fields
            ]
        )


def _text(parts: tuple[str, str], value: Column) -> Column:
    return F.concat(F.lit(parts[0]), value.cast("string"), F.lit(parts[1]))


def _metrics(**values: Column) -> Column:
    pairs = [x for name, v in values.items() for x in (F.lit(name), v.cast("string"))]
    return F.create_map(*pairs)


def _iso(moment: Column) -> Column:
    return F.date_format(moment, ISO_FORMAT)


def high_sales_volume(threshold: int = VOLUME_THRESHOLD, severity: str = "WARNING") -> AlertRule:
    """On window aggregates: one alert per busy window of orders or mixed events."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    end = F.col("window_end")
    return AlertRule(
        HIGH_SALES_VOLUME,
        severity,
        F.col("event_type").isin("order", "mixed") & (F.col("event_count") >= threshold),
        {
            "alert_id": F.concat(
                F.lit("alert-sales-"), F.unix_seconds(end).cast("string"), F.lit(".0")
            ),
            "event_timestamp": end,
            "message": _text(VOLUME_TEXT, F.col("event_count")),
            "event_type": F.lit("order"),
            "metrics": _metrics(
                event_count=F.col("event_count"),
                threshold=F.lit(threshold),
                window_start=_iso(F.col("window_start")),
                window_end=_iso(end),
            ),
        },
    )


def large_order_value(threshold: str = VALUE_THRESHOLD, severity: str = "HIGH") -> AlertRule:
    limit = F.lit(threshold).cast("decimal(14,2)")
    return AlertRule(
        LARGE_ORDER_VALUE,
        severity,
        (F.col("event_type") == "order") & (F.col("total_amount") >= limit),
        {
            "alert_id": F.concat(F.lit("alert-order-"), F.col("event_id")),
            "event_timestamp": F.col("event_timestamp"),
            "message": _text(VALUE_TEXT, F.col("total_amount")),
            "event_type": F.col("event_type"),
            "customer_id": F.col("customer_id"),
            "product_id": F.col("product_id"),
            "metrics": _metrics(
                total_amount=F.col("total_amount"),
                threshold=F.lit(threshold),
                order_id=F.col("order_id"),
            ),
        },
    )


def late_delivery(
    threshold_hours: int = LATE_THRESHOLD_HOURS, severity: str = "WARNING"
) -> AlertRule:
    """Open deliveries reported more than the threshold after they happened."""
    if threshold_hours <= 0:
        raise ValueError("threshold_hours must be positive")
    delay = seconds_between("event_timestamp", "ingestion_timestamp")
    limit = threshold_hours * 3600
    is_open = ~F.coalesce(F.col("status").isin(*CLOSED_DELIVERIES), F.lit(False))
    return AlertRule(
        LATE_DELIVERY,
        severity,
        (F.col("event_type") == "delivery") & is_open & (delay > limit),
        {
            "alert_id": F.concat(F.lit("alert-delivery-"), F.col("event_id")),
            "event_timestamp": F.col("event_timestamp"),
            "message": _text(LATE_TEXT, F.lit(threshold_hours)),
            "event_type": F.col("event_type"),
            "customer_id": F.col("customer_id"),
            "metrics": _metrics(
                delay_seconds=delay,
                threshold_seconds=F.lit(limit),
                order_id=F.col("order_id"),
                delivery_id=F.col("delivery_id"),
                carrier=F.col("carrier"),
            ),
        },
    )


#: What the rules of events and their alerts are made of.
EVENT_RULE_FIELDS = (
    "event_id", "event_type", "event_timestamp", "ingestion_timestamp", "customer_id", "product_id", "order_id",
    "total_amount", "status", "delivery_id", "carrier",
)


def event_rules() -> list[AlertRule]:
    return [large_order_value(), late_delivery()]


def window_rules(threshold: int = VOLUME_THRESHOLD) -> list[AlertRule]:
    return [high_sales_volume(threshold)]


def register_rule(rules: Sequence[AlertRule], rule: AlertRule) -> list[AlertRule]:
    if not isinstance(rule, AlertRule):
        raise TypeError("rule must be an AlertRule")
    return [*rules, rule]


def alerts_column(rules: Sequence[AlertRule]) -> Column:
    """All alerts of the row as an array; a rule with an unknown outcome adds none."""
    fired = [F.when(r.fired(), r.struct()) for r in rules]
    return F.array_compact(F.array(*fired))


def any_fires(rules: Sequence[AlertRule]) -> Column:
    return reduce(lambda a, b: a | b, [r.fired() for r in rules])


def has_alerts(df: DataFrame, rules: Sequence[AlertRule], column: str = "has_alerts") -> DataFrame:
    return df.withColumn(column, any_fires(rules))


def detect(df: DataFrame, rules: Sequence[AlertRule] | None = None) -> DataFrame:
    """Alerts of every row, all rules in one narrow pass.

    Rows where nothing fires are filtered first, so the predicates can reach
    the scan and alert columns are only built for the few that need them.
    """
    rules = event_rules() if rules is None else list(rules)
    return (
        df.filter(any_fires(rules))
        .select(F.explode(alerts_column(rules)).alias("_alert"))
        .select("_alert.*")
    )


def failures(df: DataFrame, rules: Sequence[AlertRule], *keys: str) -> DataFrame:
    """``keys``, alert_type and error of every row and rule that failed; the other rules of the row stand.

    Only rules of guarded expressions can fail this way. Narrow, so it runs beside :func:`detect` on a stream too.
    """
    able = [r for r in rules if any(isinstance(c, Guarded) for c in (r.fires, *r.columns.values()))]
    if not able:
        return df.select(*keys, F.lit("").alias("alert_type"), F.lit("").alias("error")).filter(F.lit(False))
    found = [
        F.when(r.failure().isNotNull(), F.struct(F.lit(r.alert_type).alias("alert_type"), r.failure().alias("error")))
        for r in able
    ]
    failed = df.select(*keys, F.array_compact(F.array(*found)).alias("_failed"))
    return failed.filter(F.size("_failed") > 0).select(*keys, F.inline("_failed"))


def outcomes(df: DataFrame, rules: Sequence[AlertRule], *keys: str) -> DataFrame:
    """``keys``, alert_type, alert_id and error: what :func:`detect` and :func:`failures` find, from one pass over the rows.

    An alert has its id and no error, a failure has its error and no id.
    """
    none = F.lit(None).cast("string")
    found = []
    for r in rules:
        kind = F.lit(r.alert_type).alias("alert_type")
        alert = guard(r.columns["alert_id"]).value.cast("string")
        found.append(F.when(r.fired(), F.struct(kind, alert.alias("alert_id"), none.alias("error"))))
        if any(isinstance(c, Guarded) for c in (r.fires, *r.columns.values())):
            why = r.failure()
            found.append(F.when(why.isNotNull(), F.struct(kind, none.alias("alert_id"), why.alias("error"))))
    return df.select(*keys, F.inline(F.array_compact(F.array(*found))))


detect_batch = detect


def detect_window(windows: DataFrame, rules: Sequence[AlertRule] | None = None) -> DataFrame:
    """Alerts of window aggregates, one per window and rule."""
    return detect(windows, window_rules() if rules is None else rules)


def count_alerts(df: DataFrame, rules: Sequence[AlertRule] | None = None) -> DataFrame:
    return detect(df, rules).agg(F.count(F.lit(1)).alias("alert_count"))


def with_row_key(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("row_key", alert_row("alert_id", "alert_type", "event_timestamp"))


def serialize(alerts: DataFrame) -> DataFrame:
    """Flat text columns of the keyed alert table: nulls as '', metrics as JSON."""
    moment = lambda c: F.coalesce(_iso(F.col(c)), F.lit("")).alias(c)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return with_row_key(alerts).select(
        "row_key",
        *[
            text(c)
            for c in (
                "alert_id",
                "alert_type",
                "severity",
                "message",
                "event_type",
                "customer_id",
                "product_id",
            )
        ],
        moment("detected_at"),
        moment("event_timestamp"),
        F.to_json("metrics").alias("metrics"),
    )


# ---- questions asked of an alert table ----------------------------------
def filter_by_type(alerts: DataFrame, alert_type: str) -> DataFrame:
    return alerts.filter(F.col("alert_type") == alert_type)


def filter_by_severity(alerts: DataFrame, severity: str) -> DataFrame:
    wanted = severity.strip().lower()
    if wanted not in SEVERITIES:
        raise ValueError(f"severity must be one of {SEVERITIES}")
    return alerts.filter(lower_trim("severity") == wanted)


def critical_alerts(alerts: DataFrame) -> DataFrame:
    return filter_by_severity(alerts, "critical")


def warning_alerts(alerts: DataFrame) -> DataFrame:
    return filter_by_severity(alerts, "warning")


def count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count(F.lit(1)).alias("alert_count"))


def count_by_severity(alerts: DataFrame) -> DataFrame:
    """One row per known severity, zeros included."""
    counts = alerts.agg(
        *[F.count(F.when(lower_trim("severity") == s, F.lit(1))).alias(s) for s in SEVERITIES]
    )
    pairs = F.array(
        *[F.struct(F.lit(s).alias("severity"), F.col(s).alias("alert_count")) for s in SEVERITIES]
    )
    return counts.select(F.inline(pairs))


def new_alerts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming alerts whose id is neither stored nor repeated in the batch."""
    from .refine import drop_duplicates

    return drop_duplicates(incoming, ["alert_id"]).join(
        existing.select("alert_id").distinct(), "alert_id", "left_anti"
    ).select(*incoming.columns)


def alerts_summary(alerts: DataFrame) -> DataFrame:
    level = lower_trim("severity")
    per = [F.count(F.when(level == s, F.lit(1))).alias(s) for s in SEVERITIES]
    types = F.array_sort(F.collect_set("alert_type")).alias("types")
    return alerts.agg(F.count(F.lit(1)).alias("total"), *per, types)


def recent_alerts(alerts: DataFrame, limit: int = 10, moment: str = "event_timestamp") -> DataFrame:
    """Latest alerts, ties by id; every task keeps only ``limit`` rows."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    return alerts.orderBy(F.desc(moment), F.asc("alert_id")).limit(limit)
