"""Predicates, conditionals and casts with full NULL semantics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eq_any(c: Column, values: Column | list) -> Column:
    """= ANY(array): true, false, or null if only a null element could make it true."""
    array = values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])
    return F.exists(array, lambda x: x == c)


def ne_all(c: Column, values: Column | list) -> Column:
    array = values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])
    return F.forall(array, lambda x: x != c)


def is_in(c: Column, values: list) -> Column:
    """IN over a list; over an empty one false, also for null."""
    return c.isin(values) if values else F.lit(False)


def not_in(c: Column, values: list) -> Column:
    return ~c.isin(values) if values else F.lit(True)


def distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def case(*branches: tuple[Column, object], otherwise: object = None) -> Column:
    out = F
    for when, then in branches:
        out = out.when(when, then if isinstance(then, Column) else F.lit(then))
    return out.otherwise(otherwise) if otherwise is not None else out


def int_div(a: Column, b: Column) -> Column:
    """Division of integers, towards zero."""
    return F.call_function("div", a, b)


def cast_rounded(c: Column, kind: str) -> Column:
    """A number as an integer by rounding, where a plain cast would cut."""
    return F.round(c).cast(kind)


def assume_not_null(c: Column) -> Column:
    """The column as one that holds no null: one that does fails when it is run."""
    return F.when(c.isNull(), F.raise_error(F.lit("a null in a column that is assumed to hold none"))).otherwise(c)


def bytes_concat(*columns: Column) -> Column:
    """|| of byte strings; null if any is."""
    return F.concat(*[c.cast("binary") for c in columns])


def like(c: Column, pattern: str, escape: str = "\\") -> Column:
    return F.like(c, F.lit(pattern), F.lit(escape))


def ilike(c: Column, pattern: str, escape: str = "\\") -> Column:
    return F.ilike(c, F.lit(pattern), F.lit(escape))


def similar_to(c: Column, pattern: str, escape: str = "\\") -> Column:
    """SIMILAR TO: the whole text, % and _ as in LIKE, with | * + ? {} () [] of regular expressions."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif ch in "%_":
            out.append(".*" if ch == "%" else ".")
        elif ch in ".^$\\":
            out.append("\\" + ch)
        else:
            out.append(ch)
        i += 1
    return c.rlike(f"(?s)^(?:{''.join(out)})$")


def binary_like(c: Column, pattern: str) -> Column:
    """LIKE on bytes: every byte is a character."""
    return F.decode(c, "ISO-8859-1").like(pattern)


def exists_in(df: DataFrame, other: DataFrame, on: Column | list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def not_exists_in(df: DataFrame, other: DataFrame, on: Column | list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")
