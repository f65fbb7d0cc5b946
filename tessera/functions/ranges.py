"""Ranges as structs (lower, upper, lower_inc, upper_inc, empty); a null bound is unbounded. Multiranges are sorted arrays of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lower: Column, upper: Column, bounds: str = "[)", step=None) -> Column:
    """A range; with step (a function to the next value) it is discrete and stored as [)."""
    low_inc, high_inc = bounds[0] == "[", bounds[1] == "]"
    if step:
        lower = lower if low_inc else step(lower)
        upper = step(upper) if high_inc else upper
        low_inc, high_inc = True, False
    meet = F.lit(low_inc and high_inc)
    empty = F.coalesce((lower > upper) | ((lower == upper) & ~meet), F.lit(False))
    shown = lambda c: F.when(~empty, c)
    return F.struct(shown(lower).alias("lower"), shown(upper).alias("upper"), (F.lit(low_inc) & lower.isNotNull() & ~empty).alias("lower_inc"), (F.lit(high_inc) & upper.isNotNull() & ~empty).alias("upper_inc"), empty.alias("empty"))


def int_range(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    return make(lower, upper, bounds, lambda c: c + 1)


def date_range(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    return make(lower, upper, bounds, lambda c: F.date_add(c, 1))


lower = lambda r: r["lower"]
upper = lambda r: r["upper"]
is_empty = lambda r: r["empty"]
lower_inc = lambda r: r["lower_inc"]
upper_inc = lambda r: r["upper_inc"]
lower_inf = lambda r: r["lower"].isNull() & ~r["empty"]
upper_inf = lambda r: r["upper"].isNull() & ~r["empty"]


def _starts_by(r: Column, x: Column) -> Column:
    return F.coalesce((r["lower"] < x) | ((r["lower"] == x) & r["lower_inc"]), F.lit(True))


def _ends_by(r: Column, x: Column) -> Column:
    return F.coalesce((r["upper"] > x) | ((r["upper"] == x) & r["upper_inc"]), F.lit(True))


def contains(r: Column, x: Column) -> Column:
    return F.when(x.isNotNull(), ~r["empty"] & _starts_by(r, x) & _ends_by(r, x))


def _lower_le(a: Column, b: Column) -> Column:
    """a starts no later than b."""
    return a["lower"].isNull() | F.coalesce((a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & (a["lower_inc"] | ~b["lower_inc"])), F.lit(False))


def _upper_le(a: Column, b: Column) -> Column:
    """a ends no later than b."""
    return b["upper"].isNull() | F.coalesce((a["upper"] < b["upper"]) | ((a["upper"] == b["upper"]) & (b["upper_inc"] | ~a["upper_inc"])), F.lit(False))


def contains_range(a: Column, b: Column) -> Column:
    return b["empty"] | (~a["empty"] & _lower_le(a, b) & _upper_le(b, a))


def left_of(a: Column, b: Column) -> Column:
    """a lies wholly before b."""
    return ~a["empty"] & ~b["empty"] & F.coalesce((a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"])), F.lit(False))


def right_of(a: Column, b: Column) -> Column:
    return left_of(b, a)


def overlaps(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & ~left_of(a, b) & ~left_of(b, a)


def extends_right_to(a: Column, b: Column) -> Column:
    """a doesn't end after b."""
    return ~a["empty"] & ~b["empty"] & _upper_le(a, b)


def extends_left_to(a: Column, b: Column) -> Column:
    """a doesn't start before b."""
    return ~a["empty"] & ~b["empty"] & _lower_le(b, a)


def adjacent(a: Column, b: Column) -> Column:
    touch = lambda x, y: F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (touch(a, b) | touch(b, a))


def _pick(first: Column, a: Column, b: Column, low: bool) -> tuple[Column, Column]:
    side = "lower" if low else "upper"
    return F.when(first, a[side]).otherwise(b[side]), F.when(first, a[f"{side}_inc"]).otherwise(b[f"{side}_inc"])


def _struct(low: tuple[Column, Column], high: tuple[Column, Column]) -> Column:
    empty = F.coalesce((low[0] > high[0]) | ((low[0] == high[0]) & ~(low[1] & high[1])), F.lit(False))
    return F.struct(F.when(~empty, low[0]).alias("lower"), F.when(~empty, high[0]).alias("upper"), (low[1] & ~empty).alias("lower_inc"), (high[1] & ~empty).alias("upper_inc"), empty.alias("empty"))


def merge(a: Column, b: Column) -> Column:
    """The least range that covers both."""
    both = _struct(_pick(_lower_le(a, b), a, b, True), _pick(_upper_le(b, a), a, b, False))
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(both)


def union(a: Column, b: Column) -> Column:
    """As merge, but an error if there is a gap."""
    near = a["empty"] | b["empty"] | overlaps(a, b) | adjacent(a, b)
    checked = F.assert_true(near, F.lit("result of range union would not be contiguous"))
    return F.when(checked.isNull(), merge(a, b))


def intersection(a: Column, b: Column) -> Column:
    both = _struct(_pick(_lower_le(b, a), a, b, True), _pick(_upper_le(a, b), a, b, False))
    return F.when(a["empty"], a).when(b["empty"], b).otherwise(both)


def difference(a: Column, b: Column) -> Column:
    """What of a isn't in b; an error if that is two ranges."""
    left = _struct((a["lower"], a["lower_inc"]), (b["lower"], ~b["lower_inc"]))
    right = _struct((b["upper"], ~b["upper_inc"]), (a["upper"], a["upper_inc"]))
    nothing = _struct((b["lower"], F.lit(False)), (b["lower"], F.lit(False)))
    from_left, to_right = _lower_le(b, a), _upper_le(a, b)
    whole = F.assert_true(~overlaps(a, b) | from_left | to_right, F.lit("result of range difference would not be contiguous"))
    return F.when(whole.isNotNull() | ~overlaps(a, b), a).when(from_left & to_right, F.when(b["lower"].isNotNull(), nothing).otherwise(_struct((a["upper"], F.lit(False)), (a["upper"], F.lit(False))))).when(from_left, right).otherwise(left)


def multirange_merge(m: Column) -> Column:
    return F.struct(F.get(m, F.lit(0))["lower"].alias("lower"), F.element_at(m, -1)["upper"].alias("upper"), F.get(m, F.lit(0))["lower_inc"].alias("lower_inc"), F.element_at(m, -1)["upper_inc"].alias("upper_inc"), F.lit(False).alias("empty"))
