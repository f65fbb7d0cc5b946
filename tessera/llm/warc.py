"""WARC archives written by Spark and read back with boundary-chain verification.

Every task streams the archives it was dealt, and at each place where the record magic stands emits
a candidate: its offset and the offset of the record that would follow, by the length it declares.
Pointer jumping from the start of each file, which doubles the stride in every round, keeps the
candidates that the chain of records reaches; magic within a payload is never reached.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, union_all

MAGIC = b"WARC/1.0\r\n"
_END = "\r\n\r\n"
#: Smaller payloads are always written whole.
MIN_SHARED_BYTES = 100
#: A candidate without an end of its header so far on is none, unless the chain leads to it: then the archive is refused.
_MAX_HEADER = 1 << 20
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "file string, at long, next long, kind string, id string, refers_to string, uri string, declared_digest string, payload binary"


def plan_records(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = MIN_SHARED_BYTES) -> DataFrame:
    """pages with _digest and _first: the smallest key among payloads equal to this one of at least min_bytes, if that isn't this one.

    The groups are reduced to one row for each digest before they are joined, and only those of two
    or more rows are, so that a payload with many copies is summed in every task first; the join
    itself is one that Spark splits where a digest is hot.
    """
    sized = pages.withColumn("_digest", F.sha2(F.col(payload), 256)).withColumn("_shared", F.when(F.length(payload) >= min_bytes, F.col("_digest")))
    groups = sized.where(F.col("_shared").isNotNull()).groupBy("_shared").agg(F.min(key).alias("_least"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return sized.join(groups, "_shared", "left").withColumn("_first", F.when(F.col("_least") != F.coalesce(F.col(key), F.col("_least") + 1), F.col("_least"))).drop("_shared", "_least")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", date: str = DATE, min_bytes: int = MIN_SHARED_BYTES) -> None:
    """Write a record for every page to gzip-compressed archives in path, one file for each task.

    The first page of equal payloads is a response, the others are revisits that refer to it and
    hold no payload. Null payloads are empty; a null key or url leaves its value empty; line ends in
    a url are dropped. Pages that tie, with the same least key and payload, are all responses. Very
    long payloads are written whole, in one record; an empty table makes archives without records;
    other columns are ignored, whatever their names.
    """
    plain = pages.select(F.col(key).alias("_key"), F.regexp_replace(F.coalesce(F.col(uri).cast("string"), F.lit("")), "[\r\n]", "").alias("_uri"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("_body"))
    planned = plan_records(plain, "_key", "_body", min_bytes)
    revisit = F.col("_first").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda head, c: F.concat(F.lit(head + ": "), c, F.lit("\r\n"))
    header: list[Column] = [
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("_key"))),
        line("WARC-Target-URI", F.col("_uri")),
        F.lit(f"WARC-Date: {date}\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", name(F.col("_first"))))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        F.lit("Content-Type: text/html\r\n"),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.octet_length("_body").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("_body")),
    ]
    planned.select(F.concat(*header).alias("value")).write.option("lineSep", _END).option("compression", "gzip").text(path)


def _header(raw: bytes) -> dict[str, str] | None:
    fields = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields if fields.get("content-length", "").isdigit() else None


def _inner(value: str | None, left: str = "<urn:page:", right: str = ">") -> str | None:
    return value[len(left) : -len(right)] if value and value.startswith(left) and value.endswith(right) else None


class _Candidate:
    """A place where the magic stands: bytes are fed to it until its header, and the payload if it is wanted, are whole."""

    def __init__(self, at: int, wanted: bool):
        self.at, self.wanted, self.head, self.fields, self.next, self.need, self.parts, self.done = at, wanted, b"", None, None, 0, [], False

    def feed(self, data: bytes) -> bool:
        """True when nothing more is needed; fields stays None if this is no record."""
        if self.fields is None:
            self.head += data
            end = self.head.find(_END.encode())
            if end < 0:
                if self.wanted and len(self.head) > _MAX_HEADER:
                    raise ValueError(f"the header of the record at {self.at} has no end within {_MAX_HEADER} bytes")
                return len(self.head) > _MAX_HEADER
            self.fields = _header(self.head[:end])
            if self.fields is None:
                return True
            data = self.head[end + 4 :]
            self.head = b""
            self.need = int(self.fields["content-length"])
            self.next = self.at + len(MAGIC) + end + 4 + self.need + 4
            if not self.wanted:
                return True
        if self.need and data:
            self.parts.append(data[: self.need])
            self.need -= len(self.parts[-1])
        return self.need == 0

    def row(self, file: str) -> dict:
        f = self.fields
        return {"file": file, "at": self.at, "next": self.next, "kind": f.get("warc-type"), "id": _inner(f.get("warc-record-id")), "refers_to": _inner(f.get("warc-refers-to")), "uri": f.get("warc-target-uri"), "declared_digest": (f.get("warc-payload-digest") or "").removeprefix("sha256:") or None, "payload": b"".join(self.parts) if self.wanted else None}


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each place where the magic stands and a header follows. Compressed archives aren't split: a task streams whole files in order.

    Payloads are carried where the task's own chain arrives only, so that a task holds one at most.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at, chain, open_ = None, 0, 0, []
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("kind", pa.string()), ("id", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("declared_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            rows = []
            for name, body in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if (name := name.as_py()) != file:
                    file, at, chain, open_ = name, -len(MAGIC), 0, []
                else:
                    for c in open_:
                        c.done = c.feed(MAGIC)
                    open_.append(_Candidate(at, at == chain))
                for c in open_:
                    c.done = c.done or c.feed(body)
                    if c.done and c.fields is not None:
                        rows.append(c.row(file))
                    if c.wanted and c.next is not None:
                        chain = c.next
                open_ = [c for c in open_ if not c.done]
                at += len(MAGIC) + len(body)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(scan, SCHEMA)


def reachable(links: DataFrame) -> DataFrame:
    """(file, at): the places that the chain of (file, at, next) reaches from 0 in each file, by pointer jumping.

    Round k adds the places 2^k records on from those reached and squares the pointers; pointers
    that leave their file drop out, so there are as many rounds as the longest chain has bits.
    """
    jump = links.select("file", "at", "next")
    reached = jump.where("at = 0").select("file", "at")
    while True:
        ahead = jump.join(reached, ["file", "at"]).select("file", F.col("next").alias("at"))
        landed = ahead.join(links.select("file", "at"), ["file", "at"], "left_semi")
        new = cut(landed, "reached")
        if new.isEmpty():
            return reached
        reached = union_all([reached, new])
        far = jump.select("file", F.col("at").alias("from"), F.col("next").alias("at"))
        jump = cut(far.join(jump, ["file", "at"]).select("file", F.col("from").alias("at"), "next"), "jump")


def read_archives(spark: SparkSession, path: str, digest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The records of gzip-compressed archives, verified by their boundary chain.

    digest, if any, maps the candidates to the columns that are wanted of them (file, at and next
    must stay) before anything is shuffled, so that payloads need not be. An empty folder, or one
    of empty files, gives no records.
    """
    found = candidates(spark, path)
    found = cut(digest(found) if digest else found, "candidates")
    return found.join(reachable(found.select("file", "at", "next")), ["file", "at"], "left_semi")
