"""Small Column helpers shared by every layer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"
PRICE = "decimal(12,2)"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (null counts as 0)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def filled(value: Column | str) -> Column:
    """Non-null and not blank; never null itself."""
    return F.coalesce(F.length(F.trim(as_col(value).cast("string"))) > 0, F.lit(False))


def lower_trim(value: Column | str) -> Column:
    return F.lower(F.trim(as_col(value)))


def one_of(value: Column | str, allowed: Iterable[str]) -> Column:
    """Membership after lower-casing; false for null."""
    return F.coalesce(F.lower(as_col(value)).isin(*allowed), F.lit(False))


def money(value: Column | str, type_name: str = MONEY) -> Column:
    return as_col(value).try_cast(type_name)


def _sum(value: Column | str) -> Column:
    """Exact sum as a decimal, added up in whole cents.

    An amount times 100 fits into a long, so the grouped sum is long arithmetic inside the
    generated code; a sum beyond a long is an error in ANSI mode, which is Spark's default.
    """
    cents = F.sum((money(value) * F.lit(100).cast("decimal(3,0)")).cast("long"))
    return cents.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(2,2)")


def sum_money(value: Column | str) -> Column:
    """Exact decimal sum, handed out as double."""
    return _sum(value).cast("double")


def mean_money(value: Column | str) -> Column:
    """Mean over non-null amounts, from an exact sum; null when there are none."""
    return F.try_divide(sum_money(value), F.count(money(value)))


def mean_money_2(value: Column | str) -> Column:
    """Mean rounded half-up to cents, divided in decimal so ties are exact."""
    return F.round(F.try_divide(_sum(value), F.count(money(value))), 2).cast("double")


def min_money(value: Column | str) -> Column:
    return F.min(money(value)).cast("double")


def max_money(value: Column | str) -> Column:
    return F.max(money(value)).cast("double")


def count_when(condition: Column) -> Column:
    """Rows where the condition holds; 0, not null, for an empty input."""
    return F.count(F.when(condition, F.lit(1)))


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def merge_maps(base: Column | str, extra: Column | str) -> Column:
    """Union of two maps; on a repeated key the second wins."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(
        F.coalesce(as_col(base), empty),
        F.coalesce(as_col(extra), empty),
        lambda _key, old, new: F.coalesce(new, old),
    )


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole-second difference ``end - start`` as a long."""
    return F.unix_timestamp(as_col(end)) - F.unix_timestamp(as_col(start))
