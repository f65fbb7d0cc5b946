"""N-gram Jaccard join by partitioning the universe of shingles, exact, with one row for each document.

Sets of like sizes (a size band) whose similarity reaches the threshold differ in at most H shingles.
A hash deals the shingles of the band's sets to m = H + 1 + t segments; a linked pair then has equal
subsets in at least t + 1 of them. Every set is indexed under the subset of each segment. Bands of
small sets, whose subsets would be of a shingle or two and shared by many, have H // 2 + 1 + t larger
segments instead, each indexed under its subset and that subset's one-deletion neighbourhood: at
least t + 1 of them differ by one shingle at most. A set is also indexed under the bands above its
own that a partner may be in.

Allocation by cost: a neighbourhood is taken where it is small, and subsets that many sets share
(costly), or empty ones, need not be examined as long as a set has at most t of them, for then
another subset leads to each of its partners. Sets with more are hard; pairs of two hard sets are
looked for in the costly subsets as well.

Copies are one class. In two turns the classes of each subset's group are compared with one of
them; what that leaves in one component needs no comparison, the rest is compared across components
where enough subsets are shared. The groups of costly subsets may be large, and their hard classes
are not paired: those that costly subsets lead to one another, however indirectly, are a family, and
each class of it is set against the one centre of the family. There the universe is divided again,
down to single shingles: of classes near the centre only the shingles in which they differ from it
count, of the others the whole set, and linked ones share one of their rarest shingles. These groups
are met as the first ones were, by one of their classes and then across components, there only where
the shingle's place among the rarest of both leaves room for as many shared ones as a link takes. A
parity bitmap bounds the difference from below, without error, before whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_keys, cut, shuffle_partitions, utf8
from tessera.llm.components import components

#: Larger groups of a subset are costly.
LIMIT = 24
#: Bands of sets up to so many shingles are indexed under one-deletion neighbourhoods.
NEIGHBOURHOOD = 48
#: Counters of shingles, by which the frequent ones come last, and those in a row.
COUNTERS, SLICE = 1 << 17, 1 << 10
#: Bytes hashed at once.
_PIECE = 1 << 20
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_POWER = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Measure:
    """Shingles of k words; two sets link when their Jaccard similarity is at least numerator / denominator."""

    k: int = 4
    numerator: int = 85
    denominator: int = 100

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.denominator * both >= self.numerator * (a + b - both)

    def differ(self, a: int, b: int) -> int:
        """The most shingles in which linked sets of these sizes may differ."""
        return (a + b) * (self.denominator - self.numerator) // (self.denominator + self.numerator)

    def reach(self, size: int) -> int:
        """The most shingles in which a set of this size may differ from a linked one."""
        return size * (self.denominator - self.numerator) // self.numerator

    def bands(self, size: int) -> list[tuple[int, int, int, bool]]:
        """(band, segments, slack, whether deletions count) under which a set is indexed: the band of its size, and those above that a partner may be in."""
        out = []
        for band, (low, high) in enumerate(_bands(size * self.denominator // self.numerator)):
            if high >= size and low * self.numerator <= size * self.denominator:
                h = self.differ(high, high)
                if h:  # else only copies link
                    slack, near = 1 + h // 8, high <= NEIGHBOURHOOD
                    out.append((band, (h // 2 if near else h) + 1 + slack, slack, near))
        return out


@cache
def _bands(size: int) -> list[tuple[int, int]]:
    """The bands (least, largest size) up to the one that holds size; each reaches half as far again as the one before."""
    out = [(1, 8)]
    while out[-1][1] < size:
        low = out[-1][1] + 1
        out.append((low, low + low // 2))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _MIX[0]
        x = (x ^ (x >> np.uint64(33))) * _MIX[1]
        return x ^ (x >> np.uint64(33))


_SYMBOLS = _mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, mod 2^64."""
    if not _powers or _powers["up"].size < n:
        size = max(n, _PIECE + 1)
        for name, base in (("up", _POWER), ("down", pow(_POWER, -1, 1 << 64))):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def _piece_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each word of the bytes, which start and end outside a word or at the end of the text."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_table(raw.size + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SYMBOLS[raw] * up[: raw.size], dtype=np.uint64)])
        return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased; long texts in pieces that end between words."""
    text = text.lower()
    if len(text) <= _PIECE:
        return _piece_hashes(np.frombuffer(text, np.uint8))
    out, at = [], 0
    raw = np.frombuffer(text, np.uint8)
    while at < raw.size:
        end = min(at + _PIECE, raw.size)
        while end < raw.size and not (raw[end] == 32 or 9 <= raw[end] <= 13):
            end += 1
        out.append(_piece_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The distinct hashes of the k-word shingles, sorted; of fewer words, of all of them as one; empty without words."""
    words = word_hashes(text)
    if not words.size:
        return words
    n = max(1, words.size - k + 1)
    out = np.full(n, min(k, words.size), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, words.size)):
            out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
            out ^= out >> np.uint64(32)
    return np.unique(_mix(out))


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit number of the set, signed."""
    return int(np.array(xxhash.xxh3_64_intdigest(shingles.tobytes()), np.uint64).view(np.int64))


def signatures(shingles: np.ndarray, measure: Measure) -> tuple[np.ndarray, int]:
    """The numbers of the set's subsets in every band it is indexed under, and how many more weak ones it may have before it is hard.

    Empty subsets are left out, unless there are more of them than the slack.
    """
    out, room = [], 1 << 30
    fraction, mixed = shingles >> np.uint64(32), _mix(shingles ^ np.uint64(_POWER))
    for band, segments, slack, near in measure.bands(shingles.size):
        segment = ((fraction * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)  # grows with the sorted shingles
        first = np.flatnonzero(np.diff(segment, prepend=-1))
        here, size = segment[first], np.diff(np.append(first, segment.size))
        with np.errstate(over="ignore"):
            subset = np.add.reduceat(mixed, first)
            if near:
                less = np.repeat(size, size) > 1
                subset, here = np.concatenate([subset, (np.repeat(subset, size) - mixed)[less]]), np.concatenate([here, segment[less]])
            empty = segments - first.size
            none = np.setdiff1d(np.arange(segments), segment)
            if near:  # the neighbourhood of a single shingle holds the empty subset
                none = np.concatenate([none, segment[first][size == 1]])
                empty = none.size
            if empty > slack:
                here, subset = np.concatenate([here, none]), np.concatenate([subset, np.zeros(none.size, np.uint64)])
            out.append(_mix(subset + _mix((here + (band << 32)).astype(np.uint64) + np.uint64(1))))
        room = min(room, slack - empty)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), room


def bitmap(shingles: np.ndarray) -> bytes:
    """The parities of the shingles in a power of two of bits, about as many as shingles."""
    bits = max(64, 1 << int(shingles.size - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the shingles in which two sets differ: the larger bitmap is folded to the size of the other."""
    if len(a) > len(b):
        a, b = b, a
    x, size = int.from_bytes(b, "little"), len(b)
    while size > len(a):
        size //= 2
        x = (x >> (8 * size)) ^ (x & ((1 << (8 * size)) - 1))
    return (x ^ int.from_bytes(a, "little")).bit_count()


def sketch(docs: DataFrame, measure: Measure, key: str, text: str) -> DataFrame:
    """(key, n, class, signatures, room, bits) of every row; the last three on the first row of its class in a task only. Empty sets have a null class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, numbers, found, rooms, bits = [], [], [], [], []
            for value in batch.column(1):
                shingles = shingle_set(value.as_py(), measure.k)
                number = class_of(shingles) if shingles.size else None
                first = number is not None and number not in seen
                sizes.append(shingles.size)
                numbers.append(number)
                if first:
                    seen.add(number)
                    s, room = signatures(shingles, measure)
                    found.append(s.view(np.int64))
                    rooms.append(min(room, 1 << 30))
                    bits.append(bitmap(shingles))
                else:
                    found.append(None)
                    rooms.append(None)
                    bits.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(rooms, pa.int32()), pa.array(bits, pa.binary())],
                names=["_key", "n", "class", "signatures", "room", "bits"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), utf8(text).alias("_text")).mapInArrow(run, f"_key {kind}, n long, class long, signatures array<long>, room int, bits binary")


def _groups(rows: DataFrame, limit: int) -> DataFrame:
    """(signature, class, costly) of the classes that share a signature with another; the rows stream by, sorted, and no group is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_s, held_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
        open_: tuple[int, int] | None = None  # a costly group that goes on: signature, last class

        def out(s: np.ndarray, c: np.ndarray, costly: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(s), pa.array(c), pa.array(costly)], names=["signature", "class", "costly"])

        def whole(s: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.append(first, s.size))
            each = np.repeat(size, size)
            keep = each > 1
            return out(s[keep], c[keep], each[keep] > limit)

        for batch in batches:
            s, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if open_ is not None:
                n = int(np.searchsorted(s, open_[0], side="right"))
                mine = c[:n]
                mine = mine[np.diff(mine, prepend=open_[1]) != 0]
                if mine.size:
                    yield out(np.full(mine.size, open_[0]), mine, np.ones(mine.size, bool))
                    open_ = (open_[0], int(mine[-1]))
                s, c = s[n:], c[n:]
                if not s.size:
                    continue
                open_ = None
            s, c = np.concatenate([held_s, s]), np.concatenate([held_c, c])
            fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])])[: s.size]
            s, c = s[fresh], c[fresh]
            if not s.size:
                continue
            last = int(np.searchsorted(s, s[-1], side="left"))
            if last:
                yield whole(s[:last], c[:last])
            held_s, held_c = s[last:], c[last:]
            if held_s.size > limit:
                yield whole(held_s, held_c)
                open_ = (int(held_s[0]), int(held_c[-1]))
                held_s, held_c = held_s[:0], held_c[:0]
        if held_s.size > 1:
            yield whole(held_s, held_c)

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "signature").sortWithinPartitions("signature", "class")
    return dealt.mapInArrow(run, "signature long, class long, costly boolean")


def _near(pairs: DataFrame, known: DataFrame, measure: Measure) -> DataFrame:
    """The (a, b) whose sizes and bitmaps don't rule out a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, xa, xb = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [least_difference(x, y) <= measure.differ(n, m) for n, m, x, y in zip(na, nb, xa, xb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: known.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"x{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_like("na", "nb", measure))
    return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def _texts(classes: DataFrame, docs: DataFrame, first: DataFrame, key: str, text: str) -> DataFrame:
    """(class, _text) of the first row of each class, fetched once; repeated keys give more rows."""
    wanted = cut(classes.join(first, "class").select("class", F.col("first").alias("_key")), "wanted")
    plain = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), utf8(text).alias("_text"))
    return cut(by_keys(plain, wanted, "_key", "inner").select("class", "_text"), "texts")


def _verified(pairs: DataFrame, docs: DataFrame, first: DataFrame, measure: Measure, key: str, text: str) -> DataFrame:
    """The (u, v) among pairs whose whole sets link. Texts of the classes concerned are fetched once each and compared by pairs."""
    pairs = cut(pairs, "pairs")
    texts = _texts(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), docs, first, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(batch.column(i) for i in range(4)), strict=True):
                if a.as_py() != last[0] or last[1] is None:
                    last = (a.as_py(), shingle_set(x.as_py(), measure.k))
                left, right = last[1], shingle_set(y.as_py(), measure.k)
                same = class_of(left) == a.as_py() and class_of(right) == b.as_py()  # else another row with the same key
                if not same:
                    last = (None, None)
                both = np.intersect1d(left, right, assume_unique=True).size if same else 0
                keep.append(same and measure.linked(both, left.size, right.size))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_())).rename_columns(["u", "v"])

    joined = pairs.join(texts.select(F.col("class").alias("a"), F.col("_text").alias("x")), "a").join(texts.select(F.col("class").alias("b"), F.col("_text").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "u long, v long")


def _placed(groups: DataFrame, found: DataFrame | None) -> DataFrame:
    """The rows of groups with each class's component."""
    if found is None:
        return groups.withColumn("component", F.col("class"))
    return groups.join(found.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))


def _stars(groups: DataFrame, found: DataFrame | None, turn: int) -> DataFrame:
    """The (a, b) of a class in each group, another one each turn, and the classes of other components, if they share two signatures.

    As many pairs as rows: what they link, no later step has to compare.
    """
    placed = _placed(groups.select("signature", "class"), found)
    one = F.struct(F.xxhash64("class", F.lit(turn)).alias("h"), F.col("class").alias("star"), F.col("component").alias("own"))
    centre = placed.groupBy("signature").agg(F.max(one).alias("c"), (F.min("component") < F.max("component")).alias("split")).where("split").select("signature", "c.star", "c.own")
    pairs = placed.join(centre, "signature").where("component <> own")
    counted = pairs.groupBy(F.least("class", "star").alias("a"), F.greatest("class", "star").alias("b")).agg(F.count("*").alias("shared"))
    return counted.where("shared > 1").select("a", "b")


def _across(groups: DataFrame, known: DataFrame, found: DataFrame, measure: Measure) -> DataFrame:
    """The (a, b) of different components that share as many signatures, other than costly ones, as a link takes: in each group, the classes outside its largest component against all others.

    Linked sets share more signatures than the room of either, costly ones included.
    """
    placed = _placed(groups.select("signature", "class"), found)
    sizes = placed.groupBy("signature", "component").agg(F.count("*").alias("size"))
    split = sizes.groupBy("signature").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    mixed = cut(placed.join(split, "signature").join(known.select("class", "n", "room", "weak"), "class"), "mixed")
    other = mixed.where("component <> largest").select("signature", F.col("class").alias("other"), F.col("component").alias("apart"), F.col("n").alias("m"), F.col("room").alias("room2"), F.col("weak").alias("weak2"))
    pairs = mixed.join(other, "signature").where(_like("n", "m", measure) & (F.col("component") != F.col("apart")) & ((F.col("component") == F.col("largest")) | (F.col("class") < F.col("other"))))
    takes = F.least("room", "room2") + 1 - F.least("weak", "weak2")
    counted = pairs.groupBy(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).agg(F.count("*").alias("shared"), F.max(takes).alias("takes"))
    return counted.where("shared >= takes").select("a", "b")


def _like(n: str, m: str, measure: Measure):
    """Whether sets of sizes n and m may be linked."""
    return (F.col(n) * measure.denominator >= F.col(m) * measure.numerator) & (F.col(m) * measure.denominator >= F.col(n) * measure.numerator)


def _set_against_centres(groups: DataFrame, known: DataFrame, found: DataFrame, measure: Measure) -> DataFrame:
    """(class, centre, component): each class of a split group against the centre of its family, centre null where it is far from it.

    A family is what split groups connect, its centre the class whose groups are the largest: a row
    or two for each class, however many groups it is in. Let h be the most shingles in which a
    class may differ from a linked one. Those that differ from the centre c by 3 h(c) at most are near
    it, those that differ by more than 3 h(c) - h far: a linked pair is near both or far both. The
    bitmaps rule one of the two out for most; near rows here are those they don't.
    """
    placed = cut(_placed(groups.select("signature", "class"), found), "placed")
    sizes = placed.groupBy("signature").agg(F.count("*").alias("size"), (F.min("component") < F.max("component")).alias("split")).where("split")
    split = cut(placed.join(sizes.drop("split"), "signature"), "split")
    weights = cut(split.groupBy("class", "component").agg(F.sum("size").alias("weight")), "weights")
    hubs = split.groupBy("signature").agg(F.min("class").alias("hub"))
    families = components(split.join(hubs, "signature").select(F.col("class").alias("u"), F.col("hub").alias("v")))
    members = cut(weights.join(families.select(F.col("node").alias("class"), F.col("component").alias("family")), "class"), "members")
    centres = members.groupBy("family").agg(F.max_by("class", F.struct("weight", "class")).alias("centre"))
    led = members.join(centres, "family").where("class <> centre").select("class", "centre", "component")
    side = known.select(F.col("class").alias("centre"), F.col("n").alias("m"), F.col("bits").alias("y"))
    led = led.join(known.select("class", "n", F.col("bits").alias("x")), "class").join(side, "centre")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(i).to_pylist() for i in range(3, 7))
            least = [least_difference(p, q) for p, q in zip(x, y, strict=True)]
            near = [d <= 3 * measure.reach(j) for d, j in zip(least, m, strict=True)]
            far = [d > 3 * measure.reach(j) - measure.reach(i) for d, i, j in zip(least, n, m, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near, pa.bool_()), pa.array(far, pa.bool_())], names=["class", "centre", "component", "near", "far"])

    told = led.select("class", "centre", "component", "n", "m", "x", "y").mapInArrow(run, "class long, centre long, component long, near boolean, far boolean")
    told = cut(told, "told")
    return told.where("near").select("class", "centre", "component").unionByName(told.where("far").select("class", F.lit(None).cast("long").alias("centre"), "component").distinct())


def _wide(led: DataFrame, texts: DataFrame) -> DataFrame:
    """(class, centre, component, x, y): the rows of led with the texts of the class and of the centre; centre 0, without a text, is none."""
    near, far = (led.where(f"centre {sign} 0").join(texts.select("class", F.col("_text").alias("x")), "class") for sign in ("<>", "="))
    near = near.join(texts.select(F.col("class").alias("centre"), F.col("_text").alias("y")), "centre")
    columns = ("class", "centre", "component", "x")
    return near.select(*columns, "y").unionByName(far.select(*columns, F.lit(None).cast("binary").alias("y")))


@dataclass(frozen=True)
class _Part:
    """The shingles in which a class of n shingles differs from its centre of c, or its set if the centre is 0."""

    number: int
    centre: int
    component: int
    n: int
    c: int
    elements: np.ndarray

    def near(self, measure: Measure) -> bool:
        return self.elements.size <= 3 * measure.reach(self.c)

    def far(self, measure: Measure) -> bool:
        return self.elements.size > 3 * measure.reach(self.c) - measure.reach(self.n)

    def linked(self, measure: Measure) -> bool:
        return measure.linked((self.n + self.c - self.elements.size) // 2, self.n, self.c)

    def buckets(self) -> np.ndarray:
        """The counter of each shingle, of those that count for this centre."""
        return (_mix(self.elements ^ _mix(np.array(self.centre, np.int64).view(np.uint64))) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _parts_of(batch: pa.RecordBatch, measure: Measure, last: dict[int, np.ndarray]) -> Iterator[tuple[_Part, np.ndarray]]:
    """The part of each row of _wide, and the whole set. last holds the set of the last centre."""
    for number, centre, component, x, y in zip(*(batch.column(i) for i in range(5)), strict=True):
        number, centre, component = number.as_py(), centre.as_py(), component.as_py()
        mine = shingle_set(x.as_py(), measure.k)
        if class_of(mine) != number:  # another row with the same key
            continue
        if centre == 0:
            yield _Part(number, 0, component, int(mine.size), 0, mine), mine
            continue
        if centre not in last:
            theirs = shingle_set(y.as_py(), measure.k)
            if class_of(theirs) != centre:
                continue
            last.clear()
            last[centre] = theirs
        yield _Part(number, centre, component, int(mine.size), int(last[centre].size), np.setxor1d(mine, last[centre], assume_unique=True)), mine


def _told(led: DataFrame, texts: DataFrame, measure: Measure) -> DataFrame:
    """Whether each class is near its centre, and linked with it, by whole sets; a row with the centre 0 if it is far. With them, rows without a class: the counters of the shingles that its tasks met, by slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        counts = np.zeros(COUNTERS, np.int64)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["class", "centre", "component", "linked", "slice", "counts"])

        for batch in batches:
            rows, met = [], []
            for part, mine in _parts_of(batch, measure, last):
                if part.centre and part.near(measure):
                    rows.append((part.number, part.centre, part.component, part.linked(measure), None, None))
                    met.append(part.buckets())
                if part.centre == 0 or part.far(measure):
                    rows.append((part.number, 0, part.component, False, None, None))
                    met.append(_Part(part.number, 0, part.component, part.n, 0, mine).buckets())
            if rows:
                counts += np.bincount(np.concatenate(met), minlength=COUNTERS)
                yield out(rows)
        slices = counts.reshape(-1, SLICE)
        for i in np.flatnonzero(slices.any(axis=1)):
            yield out([(None, None, None, None, int(i), slices[i].tobytes())])

    return _wide(led, texts).mapInArrow(run, "class long, centre long, component long, linked boolean, slice int, counts binary")


def _counters(told: DataFrame) -> np.ndarray:
    """The sums of the counters of all tasks: COUNTERS numbers, however large the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(counts.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    slices = told.where("slice IS NOT NULL").select("slice", "counts")
    out = np.zeros((COUNTERS // SLICE, SLICE), np.int64)
    for i, counts in slices.repartition(shuffle_partitions(told.sparkSession), "slice").mapInArrow(run, "slice int, counts binary").collect():
        out[i] = np.frombuffer(counts, np.int64)
    return out.reshape(-1)


def _rarest(led: DataFrame, texts: DataFrame, counts: np.ndarray, measure: Measure) -> DataFrame:
    """The rarest shingles of each class's part, as far as a link takes them: (class, centre, component, n, size, linked, own, all, place, element), size that of the part and place from 0.

    own, all: whether the shingle is among those that lead to any linked class which is not linked
    with the centre, and to one that is. Of linked a and b with the differences x and y from the
    centre c, b not linked with it, y > r (b + c) and |a ^ b| <= r (a + b), where
    r = (1 - t) / (1 + t): they share more than (x + r (c - a)) / 2, and y - |a ^ b| at least; of x,
    no more than |a ^ b| are not shared. Any order of the shingles of a centre does, if it is one for
    all its classes; the counters, in which several shingles may meet, put the frequent ones last.
    """
    top, bottom = measure.denominator - measure.numerator, measure.denominator + measure.numerator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            rows, own, every, places, elements = [], [], [], [], []
            for part, _ in _parts_of(batch, measure, last):
                size, linked = int(part.elements.size), False
                if part.centre:
                    linked = part.linked(measure)
                    first = min(size - (size * bottom + (part.c - part.n) * top) // (2 * bottom), measure.reach(part.n) + 1)
                    most = 0 if linked else min(size, measure.reach(part.n) + 1)
                else:
                    first = most = part.n + (-part.n * measure.numerator) // measure.denominator + 1
                take = min(size, max(first, most, 0))
                place = np.arange(take)
                elements.append(part.elements[np.lexsort((part.elements, counts[part.buckets()]))[:take]])
                own.append(place < first)
                every.append(place < most)
                places.append(place)
                rows.append((part.number, part.centre, part.component, part.n, size, linked))
            if rows:
                each = pa.array(np.repeat(np.arange(len(rows)), [e.size for e in elements]))
                columns = [pa.array([r[i] for r in rows], kind).take(each) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.concatenate(x)) for x in (own, every, places)), pa.array(np.concatenate(elements).view(np.int64))], names=["class", "centre", "component", "n", "size", "linked", "own", "all", "place", "element"])

    return _wide(led, texts).mapInArrow(run, "class long, centre long, component long, n long, size long, linked boolean, own boolean, all boolean, place long, element long")


def _crowded(groups: DataFrame, known: DataFrame, found: DataFrame, docs: DataFrame, first: DataFrame, measure: Measure, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Of the hard classes in groups of costly signatures: the (u, v) linked with their centres, and the rarest shingles that lead to the other links."""
    led = cut(_set_against_centres(groups, known, found, measure).withColumn("centre", F.coalesce("centre", F.lit(0))), "led")
    texts = _texts(led.select("class").union(led.where("centre <> 0").select("centre")).distinct(), docs, first, key, text)
    told = cut(_told(led, texts, measure), "told")
    exact = told.where("slice IS NULL").select("class", "centre", "component", "linked").distinct()
    links = told.where("linked").select(F.col("class").alias("u"), F.col("centre").alias("v"))
    rarest = _rarest(exact.drop("linked"), texts, _counters(told), measure).distinct()
    return links, cut(rarest.drop("component").withColumn("signature", F.xxhash64("centre", "element")), "rarest")


def _meet(rarest: DataFrame, found: DataFrame, measure: Measure) -> DataFrame:
    """The (a, b) of different components that share a rare enough shingle: in each group, the classes outside its largest component against all others.

    Of linked a and b with parts of x and y shingles, |a ^ b| <= r (a + b), x has at most
    (x - y + r (a + b)) / 2 that y has not, and y the like: the rarest shared one has no later place
    in either. In the smaller part that is r (a + b) / 2, half the reach of its class, at most: one of
    a pair's rows is as early (short), and two late rows, most of those of frequent shingles, never meet.
    """
    top, bottom = measure.denominator - measure.numerator, measure.denominator + measure.numerator
    placed = _placed(rarest, found).withColumn("short", F.col("place") * 2 * measure.numerator <= F.col("n") * top)
    sizes = placed.groupBy("signature", "component").agg(F.count("*").alias("size"), F.max("short").alias("short"))
    split = sizes.groupBy("signature").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.count("*").alias("parts"), F.max("short").alias("short")).where("parts > 1 AND short").select("signature", "largest")
    mixed = cut(placed.join(split, "signature").select("signature", "class", "component", "n", "size", "linked", "own", "all", "place", "short", "largest"), "mixed")
    other = mixed.where("component <> largest").select("signature", *[F.col(c).alias(f"{c}2") for c in ("class", "component", "n", "size", "linked", "own", "all", "place", "short")])
    leads = lambda x, y: F.col(f"own{x}") & ~F.col(f"linked{y}") & F.when(F.col(f"linked{x}"), F.col(f"all{y}")).otherwise(F.col(f"own{y}"))
    early = lambda x, y: (2 * F.col(f"place{x}") - F.col(f"size{x}") + F.col(f"size{y}")) * bottom <= (F.col("n") + F.col("n2")) * top
    once = (F.col("component") != F.col("component2")) & ((F.col("component") == F.col("largest")) | (F.col("class") < F.col("class2")))
    led = _like("n", "n2", measure) & once & early("", "2") & early("2", "") & (leads("", "2") | leads("2", ""))
    met = [x.join(y, "signature").where(led).select(F.least("class", "class2").alias("a"), F.greatest("class", "class2").alias("b")) for x, y in ((mixed, other.where("short2")), (mixed.where("short"), other.where("NOT short2")))]
    return met[0].unionByName(met[1]).distinct()


def link_documents(docs: DataFrame, measure: Measure | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the size of its shingle set and the least key that its links reach.

    Words are runs of other characters than space and \\x09-\\x0D, A-Z lower-cased. Null and empty
    texts, and those without words, have the size 0 and link with nothing; copies link, and so do
    sets that tie with the threshold; very long texts count whole. Rows without a key link with
    nothing and keep a null component; repeated rows are kept; an empty table gives an empty one;
    other columns are ignored, whatever their names. Shingles and sets are told apart by 64-bit
    hashes.
    """
    measure = measure or Measure()
    rows = cut(sketch(docs, measure, key, text), "sketches")
    first = cut(rows.where(F.col("class").isNotNull() & F.col("_key").isNotNull()).groupBy("class").agg(F.min("_key").alias("first")), "first")
    known = cut(rows.where(F.col("bits").isNotNull()).select("class", "n", "room", "bits").dropDuplicates(["class"]), "known")
    groups = cut(_groups(rows.where(F.col("signatures").isNotNull()).select(F.explode("signatures").alias("signature"), "class"), limit), "groups")
    pairs = groups.select("signature", "class")

    def linked(candidates: DataFrame) -> DataFrame:
        return cut(_verified(_near(candidates, known, measure), docs, first, measure, key, text), "links")

    # One class of each group against the others, first by segments, then by the rare shingles of crowded groups as well.
    edges = linked(_stars(pairs, None, 0))
    found = cut(components(edges), "found")
    weak = groups.where("costly").groupBy("class").agg(F.count("*").alias("weak"))
    known = known.join(weak, "class", "left").withColumn("weak", F.coalesce("weak", F.lit(0))).withColumn("hard", F.col("weak") > F.col("room"))
    known = cut(known, "known")
    hard = groups.where("costly").select("signature", "class").join(known.where("hard").select("class"), "class", "left_semi")
    links, rarest = _crowded(hard, known, found, docs, first, measure, key, text)
    edges = edges.unionByName(links).unionByName(linked(_stars(pairs.unionByName(rarest.select("signature", "class")), found, 1)))
    found = cut(components(edges), "found")
    # What is left in different components is compared where it may be linked.
    rest = _across(groups.where("not costly"), known, found, measure).unionByName(_meet(rarest, found, measure)).distinct()
    found = components(edges.unionByName(linked(rest)))
    least = first.join(found.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = cut(least, "least")
    named = least.join(least.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("class", "component_id")
    result = rows.select("_key", "n", "class").join(named, "class", "left")
    own = F.when(F.col("_key").isNull(), None).otherwise(F.coalesce("component_id", "_key"))
    return result.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, measure: Measure, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of linked ones: that of the least key; of repeated rows with this key, one. Rows without a key and texts without words stay."""
    linked = link_documents(docs, measure, key, text)
    linked = cut(linked, "linked")
    gone = cut(linked.where(F.col(key).isNotNull() & (F.col(key) != F.col("component_id"))).select(key).distinct(), "gone")
    again = cut(linked.where(F.col(key).isNotNull() & (F.col("n_shingles") > 0)).groupBy(key).count().where("count > 1").select(key), "again")
    stay = by_keys(docs, gone, key, "left_anti")
    if again.isEmpty():
        return stay
    return by_keys(stay, again, key, "left_anti").unionByName(by_keys(stay, again, key, "left_semi").dropDuplicates([key]))
