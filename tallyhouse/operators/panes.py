"""Sliding windows from panes: an event is counted once, however many windows cover it.

Time is cut into panes as wide as the greatest common divisor of size and slide. Events are
combined to one partial per pane (and key), in every task before the shuffle. The window starts
that cover a pane are one interval, so a partial is added where the interval begins and taken off
where it ends; a running sum over these change points gives the values of all windows between two of
them, and only the finished windows are laid out. Sums and counts are exact under subtraction; the
types of a window are the types whose count is above zero.

Running sums go over stretches of time of bounded length (an hour, or a few windows), and an interval
that crosses a border is cut there. So neither a hot key nor a long history meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import MONEY

STRETCH_SECONDS = 3600

#: Columns of a partial: rows, pieces, money, and rows per type; customers are counted from them.
ROWS, PIECES, CENTS, CUSTOMERS = "_n", "_q", "_a", "_customers"


def _type_names(vocabulary: Sequence[str]) -> list[str]:
    return [f"_t{k}" for k in range(len(vocabulary))]


def known_type(vocabulary: Sequence[str]) -> Column:
    """The event type; one outside the vocabulary is an error rather than a wrong answer."""
    problem = F.concat(F.lit("event type outside the vocabulary: "), F.col("event_type"))
    known = F.col("event_type").isin(*vocabulary) | F.col("event_type").isNull()
    return F.when(known, F.col("event_type")).otherwise(F.raise_error(problem))


def pane_start(ts: str, size_seconds: int, slide_seconds: int) -> Column:
    """Start of the pane of an event, in whole seconds."""
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    return seconds - F.pmod(seconds, F.lit(gcd(size_seconds, slide_seconds)))


def partials(
    df: DataFrame, keys: Sequence[str], vocabulary: Sequence[str], size_seconds: int, slide_seconds: int
) -> DataFrame:
    """One row per pane and key: the state that all windows over the pane share.

    Money is summed in whole cents; a sum beyond 64 bits is an error in ANSI mode.
    """
    cents = (F.col("total_amount").cast(MONEY) * 100).cast("long")
    events = df.filter(F.col("event_timestamp").isNotNull()).select(
        *keys,
        pane_start("event_timestamp", size_seconds, slide_seconds).alias("_pane"),
        known_type(vocabulary).alias("_type"),
        F.col("quantity").cast("long").alias("_quantity"),
        cents.alias("_cents"),
    )
    types = [F.count_if(F.col("_type") == t).alias(n) for t, n in zip(vocabulary, _type_names(vocabulary))]
    return events.groupBy(*keys, "_pane").agg(
        F.count(F.lit(1)).alias(ROWS),
        F.coalesce(F.sum("_quantity"), F.lit(0)).alias(PIECES),
        F.coalesce(F.sum("_cents"), F.lit(0)).alias(CENTS),
        *types,
    )


def stretch_seconds(size_seconds: int, slide_seconds: int) -> int:
    """Length of time that one running sum covers: at least twice a window, whole slides."""
    return slide_seconds * max(STRETCH_SECONDS // slide_seconds, 2 * (size_seconds // slide_seconds + 1))


def covered(panes: DataFrame, size_seconds: int, slide_seconds: int) -> DataFrame:
    """``_stretch``, ``_first`` and ``_after``: the window starts that cover a pane, cut at stretch borders."""
    stretch = stretch_seconds(size_seconds, slide_seconds)
    begin = lambda at: at - F.pmod(at, F.lit(stretch))
    lowest = F.col("_pane") + (gcd(size_seconds, slide_seconds) - size_seconds)
    first = lowest + F.pmod(-lowest, F.lit(slide_seconds))
    after = F.col("_pane") - F.pmod(F.col("_pane"), F.lit(slide_seconds)) + slide_seconds
    spans = panes.withColumns({"_first": first, "_after": after}).filter("_first < _after").drop("_pane")
    border = begin(F.col("_after") - 1)
    piece = lambda low, high: F.struct(begin(low).alias("_stretch"), low.alias("_first"), high.alias("_after"))
    whole = F.array(piece(F.col("_first"), F.col("_after")))
    cut = F.array(piece(F.col("_first"), border), piece(border, F.col("_after")))
    pieces = F.explode(F.when(border > F.col("_first"), cut).otherwise(whole))
    return spans.withColumn("_piece", pieces).select(
        *[c for c in spans.columns if c not in ("_first", "_after")], "_piece.*"
    )


def change_points(pieces: DataFrame, keys: Sequence[str], values: Sequence[str], points: Sequence[Column]) -> DataFrame:
    """A row per point of a piece: ``_at`` and the values times the point's sign, or zero for a sign of another group."""
    marked = pieces.select(*keys, "_stretch", *values, F.explode(F.array(*points)).alias("_p"))
    signed = [(F.col(v) * F.col("_p._sign")).alias(v) for v in values if v != CUSTOMERS]
    customers = [F.col("_p._customer").alias(CUSTOMERS)] if CUSTOMERS in values else []
    return marked.select(*keys, "_stretch", F.col("_p._at").alias("_at"), *signed, *customers)


def _point(at: Column, sign: int, customer: Column | int = 0) -> Column:
    customer = customer if isinstance(customer, Column) else F.lit(customer)
    return F.struct(at.alias("_at"), F.lit(sign).cast("long").alias("_sign"), customer.cast("long").alias("_customer"))


def running(points: DataFrame, keys: Sequence[str], values: Sequence[str], stretch: int) -> DataFrame:
    """Values that hold from ``_at`` until ``_next``, one row per moment of change."""
    order = Window.partitionBy(*keys, "_stretch").orderBy("_at")
    sums = [F.sum(v).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(v) for v in values]
    out = points.select(*keys, "_stretch", "_at", *sums, F.lead("_at").over(order).alias("_next"))
    # of the points of one moment the last has the whole sum; a stretch ends with its last value
    last = F.col("_next").isNull() | (F.col("_next") > F.col("_at"))
    until = F.coalesce("_next", F.col("_stretch") + stretch)
    return out.filter(last).withColumn("_next", until).filter(F.col("_next") > F.col("_at"))


def with_customers(pieces: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Change points per ``keys`` of pieces that are per customer, with the number of customers.

    In the order of their ends, what a piece adds to those before it begins where the last one ended:
    these parts do not overlap, and each of them counts the customer once.
    """
    owner = Window.partitionBy(*keys, "customer_id", "_stretch").orderBy("_after", "_first")
    known = F.when(F.col("customer_id").isNotNull(), 1).otherwise(0)
    fresh = F.greatest("_first", F.lag("_after").over(owner))  # a null is no bound
    pieces = pieces.select(*keys, "_stretch", "_first", "_after", *values, known.alias("_known"), fresh.alias("_fresh"))
    points = [
        _point(F.col("_first"), 1),
        _point(F.col("_fresh"), 0, F.col("_known")),
        _point(F.col("_after"), -1, -F.col("_known")),
    ]
    each = change_points(pieces.withColumn(CUSTOMERS, F.col("_known")), keys, [*values, CUSTOMERS], points)
    return each.groupBy(*keys, "_stretch", "_at").agg(*[F.sum(v).alias(v) for v in (*values, CUSTOMERS)])


def windows(
    df: DataFrame,
    keys: Sequence[str],
    vocabulary: Sequence[str],
    size_seconds: int,
    slide_seconds: int,
    single_customer: bool = False,
) -> DataFrame:
    """One row per window (and key) with an event: counts, customers, sums and types.

    ``single_customer``: each key is one customer, so customers need no counting.
    """
    names = _type_names(vocabulary)
    values = [ROWS, PIECES, CENTS, *names]
    finest = list(keys) if single_customer else [*keys, "customer_id"]
    pieces = covered(partials(df, finest, vocabulary, size_seconds, slide_seconds), size_seconds, slide_seconds)
    if single_customer:
        points = change_points(pieces, keys, values, [_point(F.col("_first"), 1), _point(F.col("_after"), -1)])
        customers = F.lit(1).cast("long")
    else:
        points, values = with_customers(pieces, keys, values), [*values, CUSTOMERS]
        customers = F.col(CUSTOMERS)
    held = running(points, keys, values, stretch_seconds(size_seconds, slide_seconds))
    starts = F.sequence("_at", F.col("_next") - slide_seconds, F.lit(slide_seconds).cast("long"))
    types = F.array_compact(F.array(*[F.when(F.col(n) > 0, F.lit(t)) for t, n in sorted(zip(vocabulary, names))]))
    money = (F.col(CENTS).cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(24,2)")
    shown = held.filter(F.col(ROWS) > 0).select(
        *keys,
        F.explode(starts).alias("_start"),
        F.col(ROWS).alias("event_count"),
        customers.alias("unique_customers"),
        F.col(PIECES).alias("total_quantity"),
        money.alias("total_amount"),
        types.alias("event_types"),
    )
    return shown.select(
        F.timestamp_seconds("_start").alias("window_start"),
        F.timestamp_seconds(F.col("_start") + size_seconds).alias("window_end"),
        *[c for c in shown.columns if c != "_start"],
    )
