"""Equi-joins that stay balanced when a few keys hold much of the data.

By default this is Spark's own join: nothing runs while the query is built, and
AQE splits the partitions that turn out large. A caller who knows or looks up heavy
keys (:func:`find_heavy_keys`, a bounded sketch, partial per task) passes them as
``heavy``. Only those keys, and null keys of outer joins, then get a salt: their left
rows spread over ``salts`` tasks and their right rows are repeated once per salt. Which
keys are salted changes the layout, never the result, so an approximate sketch is
enough.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKETCH_ITEMS = 10_000
_SALT = "_salt"


@dataclass(frozen=True)
class SkewPolicy:
    """A key is heavy when it holds ``share`` of the rows and at least ``min_rows``."""

    min_rows: int = 1_000_000
    share: float = 0.005
    salts: int = 32


DEFAULT = SkewPolicy()


@dataclass(frozen=True)
class HeavyKeys:
    values: tuple
    nulls: bool

    def __bool__(self) -> bool:
        return bool(self.values) or self.nulls


NO_SKEW = HeavyKeys((), False)


def find_heavy_keys(df: DataFrame, key: str, policy: SkewPolicy = DEFAULT) -> HeavyKeys:
    """Every key with the policy's share of the rows, read once from the key column alone.

    The sketch is one row of fixed size. Its answer is fixed here, as literals,
    so both sides of the join and every task retry use the same keys.
    """
    # no more keys than this can hold the share each
    most = min(SKETCH_ITEMS // 10, int(1 / policy.share) if policy.share else SKETCH_ITEMS // 10)
    row = (
        df.select(F.col(key).alias("_k"))
        .agg(
            F.expr(f"approx_top_k(_k, {most}, {SKETCH_ITEMS})").alias("top"),
            F.count(F.lit(1)).alias("rows"),
            F.count("_k").alias("keyed"),
        )
        .first()
    )
    limit = max(policy.min_rows, policy.share * row["rows"])
    values = tuple(t["item"] for t in (row["top"] or []) if t["count"] >= limit)
    return HeavyKeys(values, row["rows"] - row["keyed"] >= limit)


def _row_salt(df: DataFrame, salts: int) -> Column:
    """Salt from the row's own content, so a retried task repeats it."""
    hashable = [
        F.col(f.name)
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    return F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int")


def _plain(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    return left.join(right, on=[key], how=how)


def balanced_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    heavy: HeavyKeys = NO_SKEW,
    policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """``left JOIN right USING (key)`` for inner, left, right, full, left_semi, left_anti.

    ``heavy`` are keys of the left side, of the right one for a right join. Without them this is exactly Spark's own join (broadcast where its
    statistics prove a side small, else sort-merge with AQE skew handling).
    """
    how = {
        "left_outer": "left",
        "right_outer": "right",
        "full_outer": "full",
        "outer": "full",
        "leftsemi": "left_semi",
        "leftanti": "left_anti",
    }.get(how, how)
    if how == "right":
        flipped = balanced_join(right, left, key, "left", heavy, policy)
        rest = [c for c in left.columns if c != key] + [c for c in right.columns if c != key]
        return flipped.select(key, *rest)
    if how == "full":
        if not heavy:
            return _plain(left, right, key, "full")
        kept = balanced_join(left, right, key, "left", heavy, policy)
        unmatched = balanced_join(right, left.select(key).distinct(), key, "left_anti", NO_SKEW, policy)
        blank = [
            F.lit(None).cast(f.dataType).alias(f.name)
            for f in left.schema.fields
            if f.name != key
        ]
        rest = [c for c in right.columns if c != key]
        return kept.unionByName(unmatched.select(key, *blank, *rest))
    if not heavy:
        return _plain(left, right, key, how)

    is_heavy = F.lit(False)
    if heavy.values:
        is_heavy = F.coalesce(F.col(key).isin(*heavy.values), F.lit(False))
    spread = is_heavy | F.col(key).isNull()
    salted_left = left.withColumn(
        _SALT, F.when(spread, _row_salt(left, policy.salts)).otherwise(F.lit(0))
    )
    # a null key matches nothing, so right rows without a key need no copy
    every = F.sequence(F.lit(0), F.lit(policy.salts - 1))
    one = F.array(F.lit(0))
    salted_right = right.filter(F.col(key).isNotNull()).withColumn(
        _SALT, F.explode(F.when(is_heavy, every).otherwise(one))
    )
    return salted_left.join(salted_right, on=[key, _SALT], how=how).drop(_SALT)
