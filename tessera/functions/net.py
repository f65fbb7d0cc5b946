"""Network addresses as text, in built-in functions over the bit groups of an address.

Version 4 has four groups of 8 bits, version 6 eight of 16; masks, networks and bit operations work on
the arrays of groups, whatever the version. What two addresses of different versions give is null, or
false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def family(a: Column) -> Column:
    return F.when(F.instr(a, ":") > 0, 6).otherwise(F.when(a.isNotNull(), 4))


def host(a: Column) -> Column:
    return F.substring_index(a, "/", 1)


def masklen(a: Column) -> Column:
    return F.when(F.instr(a, "/") > 0, F.substring_index(a, "/", -1).cast("int")).otherwise(F.when(family(a) == 6, 128).otherwise(F.when(a.isNotNull(), 32)))


def set_masklen(a: Column, n: int) -> Column:
    return F.concat(host(a), F.lit(f"/{n}"))


def same_family(a: Column, b: Column) -> Column:
    return family(a) == family(b)


def _let(x: Column, then) -> Column:
    """then(x), with x put together once however often then names it."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _width(a: Column) -> Column:
    """Bits of a group."""
    return F.when(family(a) == 6, 16).otherwise(8)


def _power(n: Column) -> Column:
    """2 to the n, as a whole number."""
    return F.pow(F.lit(2.0), n).cast("int")


def _groups(a: Column) -> Column:
    """The numbers of an address's groups, from the first; :: stands for as many zeros as are missing, and an end in dots for two groups."""
    text = host(a)
    dotted = F.transform(F.split(F.substring_index(text, ":", -1), r"\."), lambda x: x.cast("int"))
    pair = lambda i: F.lower(F.hex(dotted[i] * 256 + dotted[i + 1]))
    plain = F.when(F.instr(text, ".") > 0, F.concat(F.left(text, F.length(text) - F.length(F.substring_index(text, ":", -1))), pair(0), F.lit(":"), pair(2))).otherwise(text)
    numbers = lambda t: F.transform(F.filter(F.split(t, ":"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))
    left, right = numbers(F.substring_index(plain, "::", 1)), numbers(F.substring_index(plain, "::", -1))
    gap = F.concat(left, F.array_repeat(F.lit(0), F.greatest(8 - F.size(left) - F.size(right), F.lit(0))), right)
    six = F.when(F.instr(plain, "::") > 0, gap).otherwise(numbers(plain))
    return F.when(family(a) == 6, six).otherwise(F.transform(F.split(text, r"\."), lambda x: x.cast("int")))


def _masks(a: Column, length: Column) -> Column:
    """What each group keeps of a network of that mask length."""
    width = _width(a)
    whole = _power(width)
    kept = lambda i: F.greatest(F.least(length - i * width, width), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.when(family(a) == 6, 7).otherwise(3)), lambda i: (whole - _power(width - kept(i))).cast("int"))


def _others(a: Column, masks: Column) -> Column:
    return F.transform(masks, lambda m: (_power(_width(a)) - 1 - m).cast("int"))


def _text(a: Column, groups: Column) -> Column:
    """An address of a's version: of version 6 in small hexadecimal, the first of the longest runs of two zeros or more as ::, and one that holds an address of version 4 with that in dots."""
    joined = F.concat(F.lit(":"), F.array_join(F.transform(groups, lambda g: F.lower(F.hex(g))), ":"), F.lit(":"))

    def shorter(text: Column) -> Column:
        out = text
        for n in range(2, 9):  # the longest run is asked for last, and so wins
            zeros = ":0" * n + ":"
            at = F.instr(text, zeros)
            out = F.when(at > 0, F.concat(F.left(text, at - 1), F.lit("::"), F.substring(text, at + len(zeros), F.lit(64)))).otherwise(out)
        return out

    def dotted(g: Column) -> Column:
        holds = F.forall(F.slice(g, 1, 5), lambda x: x == 0) & (F.get(g, F.lit(5)) == 65535)
        halves = F.flatten(F.transform(F.slice(g, 7, 2), lambda x: F.array((x / 256).cast("int"), x % 256)))
        return F.when(holds, F.concat(F.lit("::ffff:"), F.array_join(halves.cast("array<string>"), ".")))

    bare = F.regexp_replace(F.regexp_replace(_let(joined, shorter), "^:(?!:)", ""), "(?<!:):$", "")
    return F.when(family(a) == 6, F.coalesce(_let(groups, dotted), bare)).otherwise(F.array_join(groups.cast("array<string>"), "."))


def _with_length(text: Column, length: Column) -> Column:
    return F.concat(text, F.lit("/"), length.cast("string"))


def _network_groups(a: Column, length: Column) -> Column:
    return F.zip_with(_groups(a), _masks(a, length), lambda x, m: x.bitwiseAND(m))


def netmask(a: Column) -> Column:
    return _text(a, _masks(a, masklen(a)))


def hostmask(a: Column) -> Column:
    return _text(a, _others(a, _masks(a, masklen(a))))


def network(a: Column) -> Column:
    return _with_length(_text(a, _network_groups(a, masklen(a))), masklen(a))


def broadcast(a: Column) -> Column:
    last = F.zip_with(_groups(a), _others(a, _masks(a, masklen(a))), lambda x, m: x.bitwiseOR(m))
    return _with_length(_text(a, last), masklen(a))


def abbrev(a: Column) -> Column:
    text = _text(a, _groups(a))
    return F.when(masklen(a) == F.when(family(a) == 6, 128).otherwise(32), text).otherwise(_with_length(text, masklen(a)))


def _within(a: Column, b: Column) -> Column:
    """Whether a's network lies in b's; false for two versions."""
    same = F.zip_with(_network_groups(a, masklen(b)), _network_groups(b, masklen(b)), lambda x, y: x == y)
    return F.when(same_family(a, b), (masklen(a) >= masklen(b)) & F.forall(same, lambda x: F.coalesce(x, F.lit(False)))).otherwise(F.when(a.isNotNull() & b.isNotNull(), False))


def contained_or_eq(a: Column, b: Column) -> Column:
    return _within(a, b)


def contained(a: Column, b: Column) -> Column:
    return _within(a, b) & (masklen(a) > masklen(b))


def contains(a: Column, b: Column) -> Column:
    return contained(b, a)


def contains_or_eq(a: Column, b: Column) -> Column:
    return contained_or_eq(b, a)


def overlaps(a: Column, b: Column) -> Column:
    return _within(a, b) | _within(b, a)


def merge(a: Column, b: Column) -> Column:
    """The least network that holds both."""
    width = _width(a)

    def equal(apart: Column) -> Column:
        """Equal bits at the start: those of whole groups, and of the first that differs."""
        first = F.array_position(F.transform(apart, lambda x: x != 0), F.lit(True)).cast("int")
        odd = F.element_at(apart, F.greatest(first, F.lit(1)))
        return F.when(first == 0, F.when(family(a) == 6, 128).otherwise(32)).otherwise(first * width - F.length(F.bin(odd)))

    length = F.least(masklen(a), masklen(b), _let(F.zip_with(_groups(a), _groups(b), lambda x, y: x.bitwiseXOR(y)), equal))
    return F.when(same_family(a, b), _let(length, lambda n: _with_length(_text(a, _network_groups(a, n)), n)))


def _bits(a: Column, b: Column, change) -> Column:
    groups = F.zip_with(_groups(a), _groups(b), change)
    text = _text(a, groups)
    return F.when(same_family(a, b), F.when(family(a) == 6, text).otherwise(_with_length(text, F.greatest(masklen(a), masklen(b)))))


def bit_and(a: Column, b: Column) -> Column:
    return _bits(a, b, lambda x, y: x.bitwiseAND(y))


def bit_or(a: Column, b: Column) -> Column:
    return _bits(a, b, lambda x, y: x.bitwiseOR(y))


def difference(a: Column, b: Column) -> Column:
    """How many addresses a is after b, for addresses whose difference is a long."""
    apart = F.zip_with(_groups(a), _groups(b), lambda x, y: (x - y).cast("long"))
    return F.when(same_family(a, b), F.aggregate(apart, F.lit(0).cast("long"), lambda s, x: s * _power(_width(a)).cast("long") + x))
