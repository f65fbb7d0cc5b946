"""Benchmark decontamination: CGK walks, bit-sampling LSH over windows, and exact edit distances.

The CGK walk reads a string from the left and at every step stands or moves on by a random bit that
depends on the step and the symbol read; strings at a small edit distance give sequences at a small
Hamming distance. A window of an item's size is embedded as the walks that start anew at each of its
words, so that an edit upsets the walk of its own word and few others. Each repetition samples some
steps of walks of its own (several share a beginning, which is walked once); the symbols read there
are a key, and a window is a candidate if the keys of two of its words, or one of a small item's, are
the item's at the same places. Repetitions are added until edited copies of the items, at the
greatest distance allowed, are found to the recall asked for.

Windows of a document start wherever equal keys put them. Keys are compared as they grow, so that
many are given up after a few steps; that never changes which keys are equal. Of each candidate the
whole window of the item's size is compared: a copy within the allowed edits keeps so many of the
item's grams of four bytes near their places, and those with fewer go. An edit distance then decides.

Documents are read once and in place; nothing but matches is shuffled or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import packed, raw_texts, union_all, unpacked, utf8

#: A window holds an item if its edit similarity is at least this.
SIMILARITY = 0.8
#: The share of copies at the greatest distance allowed, with edits at random places, that the repetitions must find.
RECALL = 0.99
#: By the least bytes of an item: steps and samples of a beginning, of what follows it, and how many words must agree. Shorter items are found by pieces.
WALKS = ((72, (10, 4), (26, 7), 2), (41, (10, 4), (14, 5), 1))
#: Walks of one beginning.
BRANCHES = 5
#: Items on which the recall is measured, and the most beginnings.
_MEASURED, _MOST = 200, 64
#: Items up to so many bytes are held by every task at once; more are taken in blocks.
BLOCK_BYTES = 8 << 20
#: Normalised bytes walked at once.
CHUNK = 1 << 20
_SLICE = 1 << 16
#: Bytes of a short item's piece that are looked for, and of a gram.
_SEED = 4
_GRAM_BITS = 16
#: Zeros between texts that are walked together: more than a walk has steps.
_PAD = 40
_TABLE_BITS = 18
_TO_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalise(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text with A-Z lower-cased and each run of other ASCII marks and white space as one space, none at either end, and where each stood."""
    raw = np.frombuffer(text.translate(_TO_SPACE), np.uint8)
    keep = np.ones(raw.size, dtype=bool)
    if raw.size:
        keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
        keep[0] = raw[0] != 32
    at = np.flatnonzero(keep)
    if at.size and raw[at[-1]] == 32:
        at = at[:-1]
    return raw[at], at


State = tuple[np.ndarray, np.ndarray, np.ndarray]


def begin(starts: np.ndarray) -> State:
    """(start, key, place read next) of walks that start there."""
    return starts, np.zeros(starts.size, dtype=np.uint64), starts.astype(np.int64)


@dataclass(frozen=True)
class Stretch:
    """Some steps of a walk: moves[step, symbol] is 0 or 1, sampled are the steps whose symbols go into the key."""

    moves: np.ndarray
    sampled: tuple[int, ...]

    @classmethod
    def draw(cls, seed: tuple[int, ...], steps: int, samples: int) -> Stretch:
        random = np.random.default_rng(seed)
        moves = random.integers(0, 2, (steps, 256)).astype(np.int64)
        edges = np.linspace(0, steps, samples + 1).astype(int)
        return cls(moves, tuple(int(random.integers(a, b)) for a, b in zip(edges, edges[1:], strict=False)))

    def walk(self, text: np.ndarray, state: State, tables: list[np.ndarray] | None = None, samples: int | None = None) -> State:
        """Where the walks stand after these steps, or at the last of so many samples; with tables, those alone whose growing key is in the table of each sample."""
        starts, key, at = state
        sampled = self.sampled[:samples]
        for step in range(self.moves.shape[0] if samples is None else sampled[-1] + 1):
            symbol = text.take(at, mode="clip")
            if step in sampled:
                with np.errstate(over="ignore"):
                    key = (key ^ symbol) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                if tables is not None:
                    alive = np.flatnonzero(tables[sampled.index(step)].take(_low_bits(key), mode="clip"))
                    at, key, starts, symbol = at.take(alive), key.take(alive), starts.take(alive), symbol.take(alive)
                    if not at.size:
                        break
            at = at + self.moves[step].take(symbol, mode="clip")
        return starts, key, at

    def tables(self, text: np.ndarray, state: State, ends: np.ndarray) -> list[np.ndarray]:
        """For each sample, which low bits the keys have after it, of walks that haven't come to the end of their item."""
        out = []
        for n in range(1, len(self.sampled) + 1):
            _, key, at = self.walk(text, state, samples=n)
            table = np.zeros(1 << _TABLE_BITS, dtype=bool)
            table[_low_bits(key[at < ends])] = True
            out.append(table)
        return out


def _low_bits(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)


def _grams(text: np.ndarray, size: int) -> np.ndarray:
    """The size bytes from each place as one number."""
    out = np.zeros(max(0, text.size - size + 1), dtype=np.int64)
    for i in range(size):
        out = out << 8 | text[i : i + out.size]
    return out


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the four bytes from each place."""
    return (_grams(text, 4) * 0x9E3779B1 >> 13) & ((1 << _GRAM_BITS) - 1)


def allowed_edits(size: int, similarity: float) -> int:
    return int(size * (1 - similarity) + 1e-9)


def _word_starts(text: np.ndarray) -> np.ndarray:
    """Where a word starts: after a space, or the 0 that parts two texts."""
    apart = text <= 32
    return np.flatnonzero(~apart[1:] & apart[:-1]) + 1


def edited(item: bytes, n: int, seed: int) -> bytes:
    """item with n of its bytes replaced, taken out or doubled by another, at random places."""
    random = np.random.default_rng(seed)
    out, last = [], 0
    for at, kind, new in zip(sorted(random.choice(len(item), n, replace=False).tolist()), random.integers(0, 3, n).tolist(), random.integers(97, 123, n).tolist(), strict=True):
        out += [item[last:at], (bytes([new]), b"", bytes([item[at], new]))[kind]]
        last = at + 1
    return b"".join([*out, item[last:]])


def _joined(texts: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each between zeros, and where each starts."""
    apart = bytes(pad)
    return np.frombuffer(b"\0" + b"".join(t + apart for t in texts), np.uint8), np.cumsum([1] + [len(t) + pad for t in texts])[:-1]


class _Keys:
    """The keys of walks with one beginning over the items of a class, sorted, and tables of the growing keys."""

    def __init__(self, seed: int, kind: tuple, texts: list[bytes], which: list[int]):
        self.least, first, rest, self.need = kind
        self.trunk = Stretch.draw((self.least, seed), *first)
        text, place = _joined([texts[i] for i in which], _PAD)
        starts = _word_starts(text)
        owner = np.searchsorted(place, starts, side="right") - 1
        ends = (place + np.array([len(texts[i]) for i in which], dtype=np.int64))[owner]
        offsets, items = starts - place[owner], np.array(which, dtype=np.int64)[owner]
        self.tables = self.trunk.tables(text, begin(starts), ends)
        state = self.trunk.walk(text, begin(starts))
        self.branches = []
        for n in range(BRANCHES):
            branch = Stretch.draw((self.least, seed, n), *rest)
            _, key, at = branch.walk(text, state, samples=len(branch.sampled))
            inside = np.flatnonzero(at < ends)
            order = inside[np.argsort(key[inside], kind="stable")]
            self.branches.append((branch, branch.tables(text, state, ends), key[order], items[order], offsets[order]))

    def hits(self, text: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, place where its window would start, word it was found from) for each equal key, by walks."""
        state, out = self.trunk.walk(text, begin(starts), self.tables), []
        for branch, tables, keys, items, offsets in self.branches:
            word, key, _ = branch.walk(text, state, tables, len(branch.sampled))
            left, right = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
            size = right - left
            which = np.repeat(left - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            word = np.repeat(word, size)
            out.append((items[which], word - offsets[which], word))
        return out


class Items:
    """The keys of every walk over every item, with as many walks for each class of sizes as the recall takes (or repetitions, if they are given)."""

    def __init__(self, items: list[tuple[int | None, bytes]], similarity: float = SIMILARITY, recall: float = RECALL, repetitions: int | None = None):
        self.ids, self.similarity = [i for i, _ in items], similarity
        self.texts = [normalise(t)[0].tobytes() for _, t in items]
        # An item that no walk fits is cut, between spaces, into one piece more than edits are allowed: one piece stands whole.
        self.short = [i for i, t in enumerate(self.texts) if t and len(t) < WALKS[-1][0]]
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for i in self.short:
            padded = np.frombuffer(b" " + self.texts[i] + b" ", np.uint8)
            pieces = min(allowed_edits(len(self.texts[i]), similarity) + 1, padded.size)
            size = min(_SEED, padded.size // pieces)
            seeds.setdefault(size, []).extend((int(_grams(padded[at : at + size], size)[0]), i, at) for at in (np.arange(pieces) * padded.size // pieces).tolist())
        self.seeds = {size: np.array(sorted(own), dtype=np.int64).T for size, own in seeds.items()}
        self.walks: list[_Keys] = []
        most = None
        for kind in WALKS:
            own = [i for i, t in enumerate(self.texts) if len(t) >= kind[0] and (most is None or len(t) < most)]
            most = kind[0]
            if not own:
                continue
            tried = own[:: -(-len(own) // _MEASURED)]
            text, place = _joined([edited(self.texts[i], allowed_edits(len(self.texts[i]), similarity), i) for i in tried], _PAD)
            for n in range(_MOST if repetitions is None else repetitions):
                self.walks.append(_Keys(n, kind, self.texts, own))
                which, _, word = self.hits(text)
                right = np.searchsorted(place, word, side="right") - 1
                if repetitions is None and n and np.unique(which[which == np.array(tried)[right]]).size >= recall * len(tried):
                    break

    def hits(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place where its window would start, word it was found from) of the candidates: windows with as many equal keys and grams of the item as it takes. text is padded with zeros."""
        by_need: dict[int, list[tuple[np.ndarray, ...]]] = {}
        starts = _word_starts(text)
        for first in range(0, starts.size, _SLICE):
            for made in self.walks:
                by_need.setdefault(made.need, []).extend(made.hits(text, starts[first : first + _SLICE]))
        out = [(np.zeros(0, np.int64),) * 3]
        for need, found in by_need.items():
            which, places, from_words = (np.concatenate(x) for x in zip(*found, strict=True))
            if need > 1:
                which, places, from_words = self._paired(which, places, from_words)
            keep = self._alike(text, which, places)
            out.append((which[keep], places[keep], from_words[keep]))
        which, places, from_words = (np.concatenate(x) for x in zip(*out, strict=True))
        return which, places, from_words

    def _paired(self, which: np.ndarray, places: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hits that another word's hit of the same item agrees with, up to the allowed edits."""
        order = np.lexsort((words, places, which))
        which, places, words = which[order], places[order], words[order]
        if not which.size:
            return which, places, words
        span = int(places.max() - places.min()) + 1
        allowed = np.array([allowed_edits(len(t), self.similarity) for t in self.texts], dtype=np.int64)[which]
        base, near = which * (2 * span) - places.min(), np.minimum(allowed, span // 2)
        at = base + places
        left, right = np.searchsorted(at, at - near, side="left"), np.searchsorted(at, at + near, side="right")
        changes = np.concatenate([[0], np.cumsum(words[1:] != words[:-1])])
        keep = changes[right - 1] > changes[left]
        return which[keep], places[keep], words[keep]

    def _alike(self, text: np.ndarray, which: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each window keeps as many of the item's grams, no further from their places than the allowed edits move them, as these edits leave: one edit spoils four grams at most."""
        keep = np.ones(which.size, dtype=bool)
        known = np.zeros(1 << _GRAM_BITS, dtype=bool)
        judged: dict[tuple[int, int], bool] = {}
        for n, (i, place) in enumerate(zip(which.tolist(), places.tolist(), strict=True)):
            if (i, place) not in judged:
                item = np.frombuffer(self.texts[i], np.uint8)
                allowed = allowed_edits(item.size, self.similarity)
                own, left = _gram_hashes(item), item.size - 3 - 4 * allowed
                low = max(0, place - allowed)
                window = _gram_hashes(text[low : place + item.size + allowed])
                step, held = max(allowed, 16), 0
                for at in range(0, own.size, step):
                    near = window[max(0, place + at - allowed - low) : max(0, place + at + step + allowed - low)]
                    known[near] = True
                    held += int(known[own[at : at + step]].sum())
                    known[near] = False
                judged[i, place] = held >= left
            keep[n] = judged[i, place]
        return keep

    def short_hits(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(short item, place where its window would start) for each piece of one that text holds; text and items stand between spaces."""
        found_items, found_places = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for size, (keys, items, offsets) in self.seeds.items():
            own = _grams(np.frombuffer(text, np.uint8), size)
            at = np.flatnonzero(np.isin(own, keys))
            left, right = np.searchsorted(keys, own[at], side="left"), np.searchsorted(keys, own[at], side="right")
            many = right - left
            which = np.repeat(left - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            found_items.append(items[which])
            found_places.append(np.repeat(at, many) - offsets[which])
        return np.concatenate(found_items), np.concatenate(found_places)


def find_approximate(item: bytes, text: bytes, free_start: bool = True) -> tuple[int, int]:
    """(distance, end) of the stretch of text nearest to item by edit distance, the first of equally near ones; it may start anywhere, or at 0 alone."""
    mask, top, equal = (1 << len(item)) - 1, 1 << (len(item) - 1), {}
    for i, c in enumerate(item):
        equal[c] = equal.get(c, 0) | 1 << i
    up, down, score, best, end = mask, 0, len(item), len(item), 0
    for i, c in enumerate(text):
        eq = equal.get(c, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus = down | (mask & ~(across | up))
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1 | (0 if free_start else 1)) & mask
        minus = minus << 1 & mask
        up = minus | (mask & ~(vertical | plus))
        down = plus & vertical
        if score < best:
            best, end = score, i + 1
    return best, end


def verify(item: bytes, text: bytes, least: int, most: int, similarity: float = SIMILARITY, allowed: int | None = None) -> tuple[int, int, int] | None:
    """(distance, start, end) of item in text, for windows that would start from least to most; None if none is near enough."""
    allowed = allowed_edits(len(item), similarity) if allowed is None else allowed
    low, high = max(0, least - allowed), min(len(text), most + len(item) + allowed)
    window = text[low:high]
    exact = window.find(item)
    if exact >= 0:
        return 0, low + exact, low + exact + len(item)
    distance, end = find_approximate(item, window)
    if distance > allowed:
        return None
    _, back = find_approximate(item[::-1], window[:end][::-1], free_start=False)
    return distance, low + end - back, low + end


def matches(text: bytes, items: Items, hits: tuple[np.ndarray, np.ndarray], similarity: float) -> list[tuple[int, int, int, int]]:
    """(item, distance, start, end): the nearest verified window of each item that the hits point to."""
    out = []

    def nearest(i: int, item: bytes, text: bytes, places: np.ndarray, allowed: int) -> None:
        own = np.unique(places)
        found = []
        for near in np.split(own, np.flatnonzero(np.diff(own) > allowed + 1) + 1):
            if (m := verify(item, text, int(near[0]), int(near[-1]), similarity, allowed)) is not None:
                found.append(m)
        if found:
            out.append((i, *min(found)))

    which, places = hits
    for i in np.unique(which).tolist():
        nearest(i, items.texts[i], text, places[which == i], allowed_edits(len(items.texts[i]), similarity))
    if items.short:
        # Whole words are compared: items and text stand between spaces, which don't count for the similarity.
        spaced, n_long = b" " + text + b" ", len(out)
        which, places = items.short_hits(spaced)
        for i in np.unique(which).tolist():
            nearest(i, b" " + items.texts[i] + b" ", spaced, places[which == i], allowed_edits(len(items.texts[i]), similarity))
        for n, (i, distance, start, end) in enumerate(out[n_long:], n_long):
            held = spaced[start:end]
            low, high = start + len(held) - len(held.lstrip(b" ")), end - len(held) + len(held.rstrip(b" "))
            out[n] = (i, distance, low - 1, high - 1)
    return out


def find_benchmark(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES, recall: float = RECALL) -> DataFrame:
    """(key, item, distance, start, end): each benchmark item that a document holds, at its nearest window.

    Texts are compared with A-Z lower-cased and runs of other ASCII marks and white space as one
    space; distance counts edits of UTF-8 bytes, start and end are code points of the document.
    A window counts if its distance is at most (1 - similarity) of the item; of equally near ones the
    first counts. recall is the share of copies at that distance, with edits at random places, that
    the walks' repetitions have to find; nearer copies are found nearly always. Items of up to 40
    bytes are found by their pieces, one of which every near copy holds whole, and are compared from
    space to space. Null or empty texts and items hold and are nothing; very long texts are searched
    whole, in chunks of whole documents; repeated rows give repeated results; empty tables give an
    empty one; columns other than those named are ignored, whatever their names. Items are taken in
    blocks of a bounded size, each a pass over the documents.
    """
    out = []
    for block in _blocks(items, item, item_text, block_bytes):
        out.append(_search(docs.select(key, utf8(text).alias("_text")), block, items.schema[item].dataType, key, item, similarity, recall))
    return union_all(out)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES, recall: float = RECALL) -> DataFrame:
    """docs less the rows that hold an item, by find_benchmark's rules. Rows are dropped where they are read, without a join, so those without a key go too."""
    for block in _blocks(items, item, item_text, block_bytes):
        docs = _clean(docs, block, text, similarity, recall)
    return docs


def _blocks(items: DataFrame, item: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The distinct items in blocks of a bounded size, by a hash of their texts."""
    known = items.select(F.col(item).alias("i"), utf8(item_text).alias("t")).where(F.length("t") > 0).dropDuplicates(["i", "t"])
    n_blocks = max(1, -(-(known.agg(F.sum(F.length("t"))).first()[0] or 0) // block_bytes))
    for b in range(n_blocks):
        block = known.where(F.pmod(F.xxhash64("t"), F.lit(n_blocks).cast("long")) == b).orderBy("i", "t").collect()
        yield [(r["i"], bytes(r["t"])) for r in block]


def _found(texts: pa.Array, made: Items, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, start, end in code points) of the matches in some texts, which are walked in chunks."""
    def rows(chunk: list[tuple[int, bytes, np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int, int]]:
        joined, first = _joined([n.tobytes() for _, _, n, _ in chunk], _PAD)
        which, places, from_words = made.hits(joined)
        owner = np.searchsorted(first, from_words, side="right") - 1
        out = []
        for d in range(len(chunk)) if made.short else np.unique(owner).tolist():
            row, raw, n, at = chunk[d]
            here = owner == d
            for i, distance, start, end in matches(n.tobytes(), made, (which[here], places[here] - first[d]), similarity):
                low, high = int(at[start]), int(at[end - 1]) + 1
                out.append((row, i, distance, len(raw[:low].decode("utf-8", "replace")), len(raw[:high].decode("utf-8", "replace"))))
        return out

    found, chunk, size = [], [], 0
    for row, raw in enumerate(raw_texts(texts)):
        chunk.append((row, raw, *normalise(raw)))
        size += len(raw)
        if size >= CHUNK:
            found += rows(chunk)
            chunk, size = [], 0
    return found + (rows(chunk) if chunk else [])


def _search(docs: DataFrame, items: list[tuple[int | None, bytes]], id_type: T.DataType, key: str, item: str, similarity: float, recall: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Items(shared.value, similarity, recall)
        ids = pa.array(made.ids, pa.null() if not made.ids else None)
        for batch in batches:
            found = _found(batch.column(1), made, similarity)
            column = lambda k: pa.array([f[k] for f in found], pa.int64())  # noqa: B023, E731
            named = ids.take(column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(column(0)), named, column(2), column(3), column(4)], names=[key, item, "distance", "start", "end"])

    schema = T.StructType([docs.schema[key], T.StructField(item, id_type), *(T.StructField(n, T.LongType()) for n in ("distance", "start", "end"))])
    return docs.mapInArrow(search, schema) if items else docs.sparkSession.createDataFrame([], schema)


def _clean(docs: DataFrame, items: list[tuple[int | None, bytes]], text: str, similarity: float, recall: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Items(shared.value, similarity, recall)
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[[f[0] for f in _found(batch.column(1), made, similarity)]] = False
            yield batch.filter(pa.array(keep))

    both = packed(docs, text)
    return unpacked(both.mapInArrow(clean, both.schema), docs, text) if items else docs
