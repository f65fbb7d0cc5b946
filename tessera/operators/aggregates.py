"""Aggregates with FILTER, DISTINCT and ORDER BY."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def filtered(aggregate, c: Column, condition: Column) -> Column:
    """aggregate(c) FILTER (WHERE condition)."""
    return aggregate(F.when(condition, c))


def count_rows(condition: Column | None = None) -> Column:
    return F.count("*") if condition is None else F.count(F.when(condition, F.lit(1)))


@dataclass(frozen=True)
class By:
    """A column to order a group by; nulls come last in ascending and first in descending order, unless nulls_first says otherwise."""

    column: Column
    descending: bool = False
    nulls_first: bool | None = None

    def compare(self, a: Column, b: Column) -> Column:
        """-1, 0 or 1 as a comes before b, with it or after it."""
        first = self.descending if self.nulls_first is None else self.nulls_first
        sign = -1 if self.descending else 1
        null = F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1 if first else 1).when(b.isNull(), 1 if first else -1)
        return F.when(a.isNull() | b.isNull(), null).when(a < b, -sign).when(a > b, sign).otherwise(0)


def ordered_list(c: Column, *order: Column | By) -> Column:
    """The values of a group in the order of other columns, ascending or as By says; values that tie in all of them are in no order."""
    keys = [o if isinstance(o, By) else By(o) for o in order]

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i, k in reversed(list(enumerate(keys))):
            here = k.compare(a[f"o{i}"], b[f"o{i}"])
            out = F.when(here != 0, here).otherwise(out)
        return out

    gathered = F.collect_list(F.struct(*[k.column.alias(f"o{i}") for i, k in enumerate(keys)], c.alias("v")))
    plain = not any(k.descending or k.nulls_first for k in keys) and not any(isinstance(o, By) for o in order)
    return F.transform(F.sort_array(gathered) if plain else F.array_sort(gathered, compare), lambda s: s["v"])


def ordered_text(c: Column, separator: str, *order: Column) -> Column:
    return F.array_join(ordered_list(c, *order), separator)


def distinct_sum(c: Column) -> Column:
    return F.sum_distinct(c)
