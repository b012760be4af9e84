"""Expressions that carry their failure beside their value.

In ANSI mode a division by zero, a bad cast or a missing array item ends the whole job, and outside of
it the row silently becomes null. A :class:`Guarded` is a value that is null where it failed, and a text
that says why; steps built from others hand on the first failure. Both sides are plain columns, so they
stay in one projection and run alike in batch and streams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Guarded:
    """``value`` is null where ``error`` is not; ``error`` is null where all went well."""

    value: Column
    error: Column

    def __add__(self, other) -> Guarded:
        return _checked(F.try_add, self, other, "sum out of range")

    def __sub__(self, other) -> Guarded:
        return _checked(F.try_subtract, self, other, "difference out of range")

    def __mul__(self, other) -> Guarded:
        return _checked(F.try_multiply, self, other, "product out of range")

    def __truediv__(self, other) -> Guarded:
        other = guard(other)
        zero = other.value == F.lit(0)
        return _checked(F.try_divide, self, other, "quotient out of range", F.when(zero, "division by zero"))

    def __mod__(self, other) -> Guarded:
        other = guard(other)
        zero = other.value == F.lit(0)
        return _checked(F.try_mod, self, other, "remainder out of range", F.when(zero, "division by zero"))

    def __eq__(self, other) -> Guarded:  # type: ignore[override]
        return self.map(lambda a, b: a == b, other)

    def __ne__(self, other) -> Guarded:  # type: ignore[override]
        return self.map(lambda a, b: a != b, other)

    def __gt__(self, other) -> Guarded:
        return self.map(lambda a, b: a > b, other)

    def __ge__(self, other) -> Guarded:
        return self.map(lambda a, b: a >= b, other)

    def __lt__(self, other) -> Guarded:
        return self.map(lambda a, b: a < b, other)

    def __le__(self, other) -> Guarded:
        return self.map(lambda a, b: a <= b, other)

    def __and__(self, other) -> Guarded:
        """As in SQL: false decides alone, so a failure on the other side does not count then."""
        other = guard(other)
        return _decided(self, other, F.lit(False), self.value & other.value)

    def __or__(self, other) -> Guarded:
        other = guard(other)
        return _decided(self, other, F.lit(True), self.value | other.value)

    def __invert__(self) -> Guarded:
        return self.map(lambda a: ~a)

    __hash__ = None  # type: ignore[assignment]

    def map(self, fn, *others) -> Guarded:
        """A step that cannot fail by itself. It sees null for what failed, and its result is void then."""
        parts = [self, *map(guard, others)]
        error = F.coalesce(*[p.error for p in parts])
        return Guarded(F.when(error.isNull(), fn(*[p.value for p in parts])), error)

    def cast(self, kind: str) -> Guarded:
        value = self.value.try_cast(kind)
        failed = self.value.isNotNull() & value.isNull()
        text = F.concat(F.lit("not a " + kind + ": "), F.substring(self.value.cast("string"), 1, 40))
        return Guarded(value, F.coalesce(self.error, F.when(failed, text)))

    def item(self, position: int) -> Guarded:
        """Item of an array, from 1 or from the end by negative positions; one that is not there is a failure."""
        if position == 0:
            raise ValueError("positions begin at 1")
        missing = F.size(self.value) < abs(position)
        error = F.when(missing, f"no item {position}")
        return Guarded(F.try_element_at(self.value, F.lit(position)), F.coalesce(self.error, error))

    def required(self, what: str) -> Guarded:
        """A null is a failure too."""
        return Guarded(self.value, F.coalesce(self.error, F.when(self.value.isNull(), f"{what} is missing")))


def guard(value) -> Guarded:
    """A column (or plain value) that cannot fail, as the start of guarded steps."""
    if isinstance(value, Guarded):
        return value
    column = value if isinstance(value, Column) else F.lit(value)
    return Guarded(column, F.lit(None).cast("string"))


def _checked(step, left: Guarded, right, problem: str, reason: Column | None = None) -> Guarded:
    right = guard(right)
    value = step(left.value, right.value)
    both = left.value.isNotNull() & right.value.isNotNull()
    found = F.when(both & value.isNull(), F.coalesce(reason, F.lit(problem)) if reason is not None else F.lit(problem))
    return Guarded(value, F.coalesce(left.error, right.error, found))


def _decided(left: Guarded, right: Guarded, decisive: Column, both: Column) -> Guarded:
    decided = F.coalesce(
        (left.error.isNull() & (left.value == decisive)) | (right.error.isNull() & (right.value == decisive)), F.lit(False))
    error = F.when(~decided, F.coalesce(left.error, right.error))
    return Guarded(F.when(decided, decisive).otherwise(F.when(error.isNull(), both)), error)
