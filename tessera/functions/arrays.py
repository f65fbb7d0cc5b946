"""Array functions with 1-based indexes and null-safe elements, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a: Column, b: Column) -> Column:
    """Whether they share an element that isn't null."""
    return F.size(F.array_intersect(F.array_compact(a), F.array_compact(b))) > 0


def contains(a: Column, b: Column) -> Column:
    """Whether a holds every element of b; a null element is never held."""
    return (F.size(F.array_except(b, a)) == 0) & ~F.exists(b, lambda x: x.isNull())


def contained_by(a: Column, b: Column) -> Column:
    return contains(b, a)


def index(a: Column, i: Column | int) -> Column:
    """a[i] from 1; null outside."""
    return F.get(a, (i if isinstance(i, Column) else F.lit(i)) - 1)


def slice_(a: Column, start: int | None = None, end: int | None = None) -> Column:
    """a[start:end], both included; either may be left out."""
    first = max(1, start or 1)
    last = F.size(a) if end is None else F.least(F.lit(end), F.size(a))
    return F.slice(a, F.lit(first), F.greatest(last - first + 1, F.lit(0)))


def concat(a: Column, b: Column) -> Column:
    """A null array counts as empty, unless both are null."""
    return F.coalesce(F.concat(a, b), a, b)


def append(a: Column, x: Column) -> Column:
    return F.concat(F.coalesce(a, F.filter(F.array(x), lambda _: F.lit(False))), F.array(x))


def prepend(x: Column, a: Column) -> Column:
    return F.concat(F.array(x), F.coalesce(a, F.filter(F.array(x), lambda _: F.lit(False))))


def replace(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda x: F.when(x.eqNullSafe(old), new).otherwise(x))


def remove(a: Column, value: Column) -> Column:
    return F.filter(a, lambda x: ~x.eqNullSafe(value))


def dims(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.format_string("[1:%d]", F.size(a)))


def ndims(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.lit(1))


def to_string(a: Column, sep: str, null: str | None = None) -> Column:
    text = a.cast("array<string>")
    return F.array_join(text, sep) if null is None else F.array_join(text, sep, null)


def cardinality(a: Column) -> Column:
    return F.array_size(a)


def trim(a: Column, n: int) -> Column:
    """Less its last n elements; more than there are is an error."""
    return F.when(F.size(a) < n, F.raise_error(F.lit("number of elements to trim must be between 0 and the length"))).otherwise(F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0))))


def length(a: Column, dim: int = 1) -> Column:
    return F.when((F.size(a) > 0) & F.lit(dim == 1), F.size(a))


lower = lambda a, dim=1: F.when((F.size(a) > 0) & F.lit(dim == 1), F.lit(1))
upper = length


def fill(value: Column, *sizes: int) -> Column:
    out = value
    for n in reversed(sizes):
        out = F.array_repeat(out, n)
    return out


def positions(a: Column, value: Column) -> Column:
    found = F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(value), i + 1)), lambda i: i.isNotNull())
    return found


def position(a: Column, value: Column, start: int = 1) -> Column:
    """The first place from start; null if there is none. A null is found."""
    return F.get(F.filter(positions(a, value), lambda i: i >= start), F.lit(0))


def assign(a: Column, i: int, value: Column) -> Column:
    """a with element i, from 1, set."""
    return F.transform(a, lambda x, k: F.when(k == i - 1, value).otherwise(x))


def assign_slice(a: Column, start: int, values: Column) -> Column:
    return F.concat(slice_(a, 1, start - 1), values, F.slice(a, F.size(values) + start, F.greatest(F.size(a) - F.size(values) - start + 1, F.lit(0))))


def shuffle(a: Column) -> Column:
    return F.shuffle(a)


def sample(a: Column, n: int) -> Column:
    return F.slice(F.shuffle(a), 1, n)


def to_json(a: Column) -> Column:
    return F.to_json(a)
