"""Line dedup: drop lines whose key occurs in many documents, probing minimal perfect hash shards.

Distinct line keys are counted with one shuffle of 128-bit hashes, pre-summed in every task. The
frequent ones are dealt to shards by hash; each shard becomes a minimal perfect hash (levels of
collision-free bit arrays, ranked) that indexes an array of 64-bit fingerprints and one of counts.
Documents then probe these arrays in place: their texts are never shuffled.

Slots come from both hash words, fingerprints are the second word whole, so a line is mistaken for
another only if 64 bits of it and its slot agree.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SPACES, cut, packed, replaced, shuffle_partitions, unpacked, utf8, without

#: Frequent lines in one shard, on average.
SHARD_LINES = 50_000
#: Arrays up to so many bytes go to every worker; beyond it the documents' hashes go to the shards.
BROADCAST_BYTES = 64 << 20
#: Bytes of text that ask the shards together.
STRETCH_BYTES = 8 << 20
_FLUSH = 200_000
_GAMMA = 2


def line_keys(text: bytes, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and the 16-byte hash of each one's key; None where the key is too short."""
    lines = text.split(b"\n")
    digest, out = xxhash.xxh3_128_digest, []
    for line in lines:
        key = line.strip(SPACES).lower()
        long_enough = len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(digest(key) if long_enough else None)
    return lines, out


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)


def line_counts(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """(hi, lo, n_docs): in how many documents each distinct line key occurs."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            both = _words(list(seen)).view("<i8")
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(list(seen.values()), pa.int64())], names=["hi", "lo", "n"])

        for batch in batches:
            for value in batch.column(0):
                seen.update({d for d in line_keys(value.as_py(), min_chars)[1] if d is not None})
                if len(seen) > _FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select(utf8(text).alias("t")).mapInArrow(counts, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n_docs"))


def _slots(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (hi ^ (lo * np.uint64(0x9E3779B97F4A7C15))) + np.uint64((0xD1B54A32D192ED03 * (level + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash over distinct 128-bit keys, with an array of fingerprints and one of counts.

    At each level the keys that meet no other one in a bit array stay there; the rest go on to the
    next level. A key's index is the number of set bits before its own.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray):
        self.sizes, self.bits, self.fingerprints, self.counts = sizes, bits, fingerprints, counts
        self.rank = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, n_docs: np.ndarray) -> PerfectHash:
        sizes, levels, rest, level = [], [], np.arange(hi.size), 0
        while rest.size:
            size = max(64, _GAMMA * rest.size)
            at = (_slots(hi[rest], lo[rest], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, dtype=bool)
            bits[at[alone]] = True
            sizes.append(size)
            levels.append(bits)
            rest, level = rest[~alone], level + 1
        out = cls(np.array(sizes, dtype=np.int64), np.concatenate([*levels, np.zeros(0, dtype=bool)]), np.zeros(hi.size, dtype=np.uint64), np.zeros(hi.size, dtype=np.int64))
        index = out.index(hi, lo)
        out.fingerprints[index], out.counts[index] = lo, n_docs
        return out

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The place of each key; of a key that isn't in the set, any place or -1."""
        out, rest, start = np.full(hi.size, -1, dtype=np.int64), np.arange(hi.size), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not rest.size:
                break
            at = start + (_slots(hi[rest], lo[rest], level) % np.uint64(size)).astype(np.int64)
            here = self.bits[at]
            out[rest[here]] = self.rank[at[here]]
            rest, start = rest[~here], start + size
        return out

    def lookup(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The count of each key; 0 if it isn't in the set."""
        index = self.index(hi, lo)
        found = index >= 0
        found[found] = self.fingerprints[index[found]] == lo[found]
        return np.where(found, self.counts[np.where(found, index, 0)] if self.counts.size else 0, 0)


def perfect_hash_shards(frequent: DataFrame, n_shards: int) -> DataFrame:
    """One row for each shard: its number, its levels' sizes and bits, fingerprints and counts."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy()
        made = PerfectHash.build(column("hi").view(np.uint64), column("lo").view(np.uint64), column("n_docs"))
        blobs = [made.sizes.astype("<i8"), np.packbits(made.bits), made.fingerprints.astype("<u8"), made.counts.astype("<i8")]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64())} | {n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("sizes", "bits", "fingerprints", "counts"), blobs, strict=True)})

    return frequent.withColumn("shard", F.pmod(F.col("hi"), F.lit(n_shards).cast("long"))).groupBy("shard").applyInArrow(build, "shard long, sizes binary, bits binary, fingerprints binary, counts binary")


def _load(row) -> PerfectHash:
    sizes = np.frombuffer(row["sizes"], dtype="<i8")
    bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=int(sizes.sum())).astype(bool)
    return PerfectHash(sizes, bits, np.frombuffer(row["fingerprints"], dtype="<u8"), np.frombuffer(row["counts"], dtype="<i8"))


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Drop from every text the lines whose key occurs in at least min_docs documents.

    A key is the line less white space at both ends, A-Z lower-cased. Returns docs with the text
    replaced by the lines that stay, joined by \\n, and n_lines (before) and n_dropped.
    Null or empty texts hold one empty line, which stays; very long texts and lines are handled whole;
    every row counts as a document, repeated rows too, and a line that ties with the bound is dropped;
    an empty table gives an empty one; input columns n_lines and n_dropped are replaced, others may
    have any name.
    """
    spark, docs = docs.sparkSession, without(docs, "n_lines", "n_dropped")
    frequent = cut(line_counts(docs, text, min_chars).where(F.col("n_docs") >= min_docs), "lines")
    n = frequent.count()
    n_shards = max(1, -(-n // SHARD_LINES))
    shards = cut(perfect_hash_shards(frequent, n_shards), "shards")
    size = shards.select(F.sum(sum(F.length(c) for c in ("sizes", "bits", "fingerprints", "counts")))).first()[0] or 0
    if size <= broadcast_bytes:
        return _probe(docs, text, min_chars, n_shards, spark.sparkContext.broadcast({r["shard"]: r.asDict() for r in shards.collect()}))
    return _probe_by_shard(docs, text, min_chars, n_shards, shards)


def _drop(lines: list[bytes], gone: np.ndarray) -> tuple[bytes, int, int]:
    return b"\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g), len(lines), int(gone.sum())


def _probe(docs: DataFrame, text: str, min_chars: int, n_shards: int, shared) -> DataFrame:
    """Documents probe arrays that every worker holds."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = {k: _load(row) for k, row in shared.value.items()}

        def counts(digests: list[bytes]) -> np.ndarray:
            both = _words(digests)
            hi, lo = both[:, 0].copy(), both[:, 1].copy()
            shard, out = np.mod(hi.view("<i8"), n_shards), np.zeros(hi.size, dtype=np.int64)
            for k in np.unique(shard).tolist():
                if k in hashes:
                    here = shard == k
                    out[here] = hashes[k].lookup(hi[here], lo[here])
            return out

        for batch in batches:
            place = batch.schema.get_field_index(text)
            kept: list[tuple[bytes, int, int]] = []
            for value in batch.column(place):
                lines, digests = line_keys(value.as_py() or b"", min_chars)
                gone = np.zeros(len(lines), dtype=bool)
                known = [i for i, d in enumerate(digests) if d is not None]
                if known and hashes:
                    gone[known] = counts([digests[i] for i in known]) > 0
                kept.append(_drop(lines, gone))
            yield replaced(
                batch, **{text: pa.array([x[0] for x in kept], pa.binary()).cast(pa.string()), "n_lines": pa.array([x[1] for x in kept], pa.int64()), "n_dropped": pa.array([x[2] for x in kept], pa.int64())}
            )

    return docs.withColumn(text, utf8(text)).mapInArrow(probe, _schema(docs, text))


def _schema(docs: DataFrame, text: str) -> T.StructType:
    fields = [T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema.fields]
    return T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def _stretches(docs: DataFrame, text: str) -> DataFrame:
    """(row, text, stretch): each row with its text's bytes and the number of its stretch, some STRETCH_BYTES of text that a task read one after another."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            out = []
            for value in batch.column(1):
                out.append(stretch)
                size += len(value.as_py())
                if size >= STRETCH_BYTES:
                    stretch, size = stretch + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=["row", "text", "stretch"])

    both = packed(docs, text).select("row", utf8("text").alias("text"))
    return both.mapInArrow(number, T.StructType([*both.schema.fields, T.StructField("stretch", T.LongType())]))


def _probe_by_shard(docs: DataFrame, text: str, min_chars: int, n_shards: int, shards: DataFrame) -> DataFrame:
    """Arrays too large to send everywhere: the hashes of each stretch of documents go to the shards, the frequent ones come back.

    A shard's row stands before those that ask it, which stream by; what comes back meets a stretch
    of a bounded size. Neither a shard nor a stretch grows with the input.
    """
    placed = cut(_stretches(docs, text), "placed")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = {(s, d) for t, s in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) for d in line_keys(t.as_py(), min_chars)[1] if d is not None}
            both = _words([d for _, d in asked]).view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.mod(both[:, 0], n_shards)), pa.array([s for s, _ in asked], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["shard", "stretch", "hi", "lo"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made = None, None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            for first, end in zip(edges := np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1)).tolist(), [*edges[1:], shard.size], strict=True):
                part = batch.slice(first, end - first)
                if (head := part.column(4)[0].as_py()) is not None:
                    number, made = int(shard[first]), _load(head)
                    part = part.slice(1)
                if made is not None and number == shard[first] and part.num_rows:
                    found = made.lookup(part.column(2).to_numpy().view(np.uint64), part.column(3).to_numpy().view(np.uint64)) > 0
                    yield part.select([1, 2, 3]).filter(pa.array(found))

    parts = ("sizes", "bits", "fingerprints", "counts")
    heads = shards.select("shard", *[F.lit(None).cast("long").alias(c) for c in ("stretch", "hi", "lo")], F.struct(*parts).alias("arrays"))
    asked = placed.select("text", "stretch").mapInArrow(ask, "shard long, stretch long, hi long, lo long")
    met = heads.unionByName(asked.withColumn("arrays", F.lit(None).cast(heads.schema["arrays"].dataType))).repartition(shuffle_partitions(docs.sparkSession), "shard")
    known = met.sortWithinPartitions("shard", F.col("stretch").asc_nulls_first()).mapInArrow(answer, "stretch long, hi long, lo long")

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        gone_set = {h.to_bytes(8, "little", signed=True) + x.to_bytes(8, "little", signed=True) for h, x in zip(right.column("hi").to_pylist(), right.column("lo").to_pylist(), strict=True)}
        kept = []
        for value in left.column("text"):
            lines, digests = line_keys(value.as_py(), min_chars)
            kept.append(_drop(lines, np.array([d in gone_set for d in digests], dtype=bool)))
        return pa.table([left.column("row"), pa.array([x[0] for x in kept], pa.binary()).cast(pa.string()), pa.array([x[1] for x in kept], pa.int64()), pa.array([x[2] for x in kept], pa.int64())], names=["row", "text", "n_lines", "n_dropped"])

    schema = T.StructType([placed.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    done = placed.groupBy("stretch").cogroup(known.groupBy("stretch")).applyInArrow(drop, schema)
    return unpacked(done, docs, text, "n_lines", "n_dropped")
