"""Byte-level BPE by a global shuffle of distinct words.

Tasks split texts into pre-tokens and number the distinct ones of each block of documents. One
shuffle deals the blocks' distinct words to buckets by the word's hash, so that every distinct word
of the corpus is met in one place and encoded once; it also deals out the blocks' sequences of word
numbers (the pre-tokens' positions). The ids go back to the blocks, where the sequences are waiting
in the partitions of that same shuffle, and are put together by position. Decoding joins the ids
with the table of token bytes: a hash join in each task while the table is small, as vocabularies
are, and a shuffled join of exploded ids beyond.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, packed, shuffle_partitions, unpacked, utf8, without

#: UTF-8 bytes of text in a block, about.
BLOCK_BYTES = 2 << 20
#: Words whose ids a task remembers at once; beyond it starts anew, so that its memory is bounded however many words a bucket has.
KNOWN_WORDS = 1 << 20
#: Token tables up to so many rows and bytes are held by every task.
TABLE_ROWS, TABLE_BYTES = 1 << 20, 64 << 20
# Patterns whose matches all lie within a stretch of _CHUNK. With others texts are split whole.
CHUNKED = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}
#: A stretch of white space (Unicode's) and what follows it: no pre-token crosses its ends, whatever stands around it.
_WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_NONE = 1 << 60
_LONG = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank on each line. It is a vocabulary, of a size that is fixed."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, token): the bytes of each token."""
    return spark.createDataFrame([(i, bytearray(t)) for t, i in read_ranks(path).items()], "id int, token binary")


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the whole if it is a token, else the pair of lowest rank, leftmost first, is merged until none is left."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > _LONG:
        return _merge_long(word, ranks)
    get, ends = ranks.get, list(range(len(word) + 1))
    pairs = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pairs:
        least = min(pairs)
        if least == _NONE:
            break
        i = pairs.index(least)
        del ends[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(word[ends[i] : ends[i + 2]], _NONE)
        if i:
            pairs[i - 1] = get(word[ends[i - 1] : ends[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(ends, ends[1:], strict=False)]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and linked ends, for words of any length."""
    n = len(word)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    alive = [True] * n
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def pair(i: int) -> int | None:
        j = after[i]
        return ranks.get(word[i : after[j]]) if j < n else None

    while heap:
        rank, i = heapq.heappop(heap)
        if not alive[i] or pair(i) != rank:
            continue
        j = after[i]
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k))
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(arrays), *map(len, parts)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpack(body: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    out, at = [], 8 * (n + 1)
    for size in np.frombuffer(raw, "<i8", n, 8).tolist():
        out.append(raw[at : at + size])
        at += size
    return out


def _planes(values: np.ndarray) -> bytes:
    """Little numbers with like bytes side by side, so that they compress."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class _Block:
    """The documents gathered so far: their pre-tokens as numbers into the block's distinct chunks."""

    def __init__(self, chunked: bool) -> None:
        self.chunks: dict[str, int] = {}
        self.docs: list[np.ndarray] = []
        self.size, self.chunked = 0, chunked

    def add(self, text: bytes) -> None:
        chunks, whole = self.chunks, text.decode("utf-8", "replace")
        found = _CHUNK.findall(whole) if self.chunked else [whole] if whole else []
        self.docs.append(np.fromiter((chunks.setdefault(c, len(chunks)) for c in found), dtype=np.int64))
        self.size += len(text)

    def rows(self, keys: pa.RecordBatch, pattern: regex.Pattern, n_buckets: int) -> list[tuple[int, int, bytes]]:
        """(part, block, body): a row of distinct words for each bucket, and the sequence. Words are numbered from the most frequent."""
        words: dict[bytes, int] = {}
        split = [[words.setdefault(w.encode(), len(words)) for w in pattern.findall(c)] for c in self.chunks]
        lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        flat = np.fromiter((w for s in split for w in s), dtype=np.int64, count=int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        docs = [spread(d, starts, lengths, flat) for d in self.docs]
        sequence = np.concatenate([*docs, np.zeros(0, np.int64)])
        order = np.argsort(-np.bincount(sequence, minlength=len(words)), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(order.size)
        names = list(words)
        ranked = [names[i] for i in order.tolist()]
        bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in ranked), dtype=np.int64, count=len(ranked))
        block = xxhash.xxh3_64_intdigest(b"\0".join(ranked)) >> 1
        rows = []
        by_bucket = np.argsort(bucket, kind="stable")
        for part in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1) if ranked else []:
            mine = [ranked[i] for i in part.tolist()]
            rows.append((-1 - int(bucket[part[0]]), block, _pack(np.fromiter(map(len, mine), "<u4", len(mine)), b"".join(mine))))
        counts = np.fromiter(map(len, docs), "<i8", len(docs))
        rows.append((block, block, _pack(_to_ipc(keys), counts, _planes(rank[sequence]), bucket.astype("<u4").tobytes())))
        return rows


def spread(which: np.ndarray, starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The stretches values[starts[w] : starts[w] + lengths[w]] for each w in which, one after another."""
    size = lengths[which]
    ends = np.cumsum(size)
    total = int(ends[-1]) if size.size else 0
    return values[np.repeat(starts[which] - (ends - size), size) + np.arange(total)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns keys and ids array<int>: the tokens of each text.

    Every match of the pattern is encoded by itself, without special tokens; of pairs with the same
    rank the leftmost is merged first. Null and empty texts give no ids; very long texts are encoded
    whole, in a block of their own; repeated rows, null keys and words of any length are kept; an
    empty table gives an empty one; columns other than keys and the text are left out, and a key
    named ids is refused.
    """
    if "ids" in keys:
        raise ValueError("a key column may not be named ids")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    n_parts = shuffle_partitions(spark)
    n_buckets, chunked = 2 * n_parts, pattern in CHUNKED
    schema = T.StructType([docs.schema[k] for k in keys])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        block, held = _Block(chunked), []

        def rows() -> pa.RecordBatch:
            own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            out = block.rows(own, compiled, n_buckets)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], names=["part", "block", "body"])

        for batch in batches:
            own, first = batch.select(list(batch.schema.names[1:])), 0
            for i, value in enumerate(batch.column(0)):
                block.add(value.as_py())
                if block.size >= block_bytes:
                    held.append(own.slice(first, i + 1 - first))
                    yield rows()
                    block, first = _Block(chunked), i + 1
            if first < batch.num_rows:
                held.append(own.slice(first))
        if held:
            yield rows()

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = shared.value, {}
        for batch in batches:
            for part, block, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part >= 0:
                    continue
                sizes, raw = _unpack(body)
                at, out, lengths = 0, [], []
                for size in np.frombuffer(sizes, "<u4").tolist():
                    word = raw[at : at + size]
                    at += size
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        ids = known[word] = merge(word, ranks)
                    out += ids
                    lengths.append(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1 - part], pa.int64()), pa.array([_pack(np.array(lengths, "<u4"), _planes(np.array(out, "<u4")))], pa.binary())], names=["part", "bucket", "body"])

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = dict(zip(right.column("bucket").to_pylist(), right.column("body").to_pylist(), strict=True))
        out = []
        for part, body in zip(left.column("part").to_pylist(), left.column("body").to_pylist(), strict=True):
            if part < 0:
                continue
            own, counts, sequence, buckets = _unpack(body)
            with pa.ipc.open_stream(own) as stream:
                columns = stream.read_all().combine_chunks()
            bucket = np.frombuffer(buckets, "<u4").astype(np.int64)
            if set(np.unique(bucket).tolist()) - set(blobs):
                raise RuntimeError("a block's words changed between two reads of the input")
            order = np.argsort(bucket, kind="stable")
            parts = [_unpack(blobs[b]) for b in sorted(set(bucket.tolist()))]
            lengths, ids = np.concatenate([*(np.frombuffer(p[0], "<u4") for p in parts), np.zeros(0, "<u4")]).astype(np.int64), np.concatenate([*(_from_planes(p[1]) for p in parts), np.zeros(0, "<u4")]).astype(np.int32)
            starts, size = np.empty_like(lengths), np.empty_like(lengths)
            starts[order], size[order] = np.cumsum(lengths) - lengths, lengths
            ranks, ends = _from_planes(sequence).astype(np.int64), np.cumsum(np.frombuffer(counts, "<i8"))
            flat = spread(ranks, starts, size, ids)
            before = np.concatenate([[0], np.cumsum(size[ranks])])
            lists = pa.ListArray.from_arrays(pa.array(before[np.concatenate([[0], ends])].astype(np.int32)), pa.array(flat))
            out.append(pa.table([columns.column(k).combine_chunks() if isinstance(columns.column(k), pa.ChunkedArray) else columns.column(k) for k in keys] + [lists], names=[*keys, "ids"]))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], t) for k, t in empty})

    result = T.StructType([*schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = [(f.name, f.type) for f in to_arrow_schema(result)]
    dealt = docs.select(utf8(text).alias("_text"), *keys).mapInArrow(split, "part long, block long, body binary").repartition(n_parts, "part")
    ids = dealt.mapInArrow(encode_words, "part long, bucket long, body binary")
    # Of the words' rows nothing but their place goes on: the sequences are waiting beside them.
    waiting = dealt.select("part", "block", F.when(F.col("part") >= 0, F.col("body")).alias("body"))
    return waiting.groupBy("part").cogroup(ids.groupBy("part")).applyInArrow(together, result)


def _glue(lists: pa.Array, number: pa.Array, tokens: pa.Array) -> pa.Array:
    """For each list of ids the bytes of their tokens, one after another; null for null. number holds the tokens' ids, in order."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    at = pc.index_in(lists.flatten(), value_set=number)
    if at.null_count:
        raise ValueError("an id is not in the token table")
    found = tokens.take(at)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    offsets = np.frombuffer(found.buffers()[1], "<i8", len(found) + 1, 8 * found.offset)[ends] if len(found) else np.zeros(len(lists) + 1, "<i8")
    glued = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(offsets)), found.buffers()[2] if len(found) else pa.py_buffer(b"")])
    return pc.if_else(lists.is_valid(), glued, None)


def decode(tokens: DataFrame, table: DataFrame, ids: str = "ids", most_rows: int = TABLE_ROWS, most_bytes: int = TABLE_BYTES) -> DataFrame:
    """tokens with the column decoded: the bytes of their ids by the token table (id, token).

    Null ids give null, an empty list no bytes; an id that the table lacks is an error; very long
    lists and repeated rows are decoded whole; an empty table of rows gives an empty one; an input
    column decoded is replaced, others may have any name.
    """
    spark, tokens = tokens.sparkSession, without(tokens, "decoded")
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("token")), F.lit(0)).alias("b")).first()
    if size["n"] > most_rows or size["b"] > most_bytes:
        return _decode_by_shuffle(tokens, table, ids)
    rows = sorted((r["id"], bytes(r["token"])) for r in table.select("id", "token").collect())
    shared = spark.sparkContext.broadcast(rows)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, token = pa.array([r[0] for r in shared.value], pa.int32()), pa.array([r[1] for r in shared.value], pa.large_binary())
        for batch in batches:
            lists, at = batch.column(1), 0
            # What is decoded at once stays within some 16 MB, or is one row.
            weight = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + (1 << 20), side="right")))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns, _glue(part.column(1), number, token).cast(pa.binary())], names=["row", "text", "decoded"])
                pa.default_memory_pool().release_unused()
                at = end

    both = packed(tokens, ids)
    return unpacked(both.mapInArrow(join, T.StructType([*both.schema.fields, T.StructField("decoded", T.BinaryType())])), tokens, ids, "decoded")


def _decode_by_shuffle(tokens: DataFrame, table: DataFrame, ids: str) -> DataFrame:
    """The same by a join of exploded ids; each row gets its tokens back in order."""
    rows = cut(tokens.select(F.struct(*tokens.columns).alias("row"), F.col(ids).alias("ids"), F.monotonically_increasing_id().alias("n")), "rows")
    each = rows.select("n", F.posexplode("ids").alias("pos", "id")).join(table.select("id", F.hex("token").alias("token")), "id", "left")
    each = each.withColumn("token", F.when(F.col("token").isNull(), F.raise_error(F.lit("an id is not in the token table"))).otherwise(F.col("token")))
    glued = each.groupBy("n").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "")).alias("decoded"))
    empty = F.when(F.col("ids").isNotNull(), F.lit(b""))
    return rows.join(glued, "n", "left").select("row.*", F.coalesce("decoded", empty).alias("decoded"))
