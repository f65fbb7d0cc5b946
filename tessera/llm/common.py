"""Helpers shared by the corpus operators: scratch tables, column hygiene, packed columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that the word and line operators know: space and \x09-\x0D.
SPACES = b" \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; on a cluster that would break every read, so it is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_root(spark)}/tessera/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it again: short lineage that outlives any executor."""
    path = scratch_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add under those names."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


#: Rows in an Arrow batch of tables that hold whole texts.
TEXT_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def long_texts(spark: SparkSession) -> None:
    """Let Arrow batches have TEXT_ROWS rows, in this session, so that those of whole texts stay small; a smaller number that is set stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= TEXT_ROWS:
        spark.conf.set(_BATCH, str(TEXT_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    long_texts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def utf8(name: str = "text"):
    """The UTF-8 bytes of a string column; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def packed(docs: DataFrame, text: str) -> DataFrame:
    """(row, text): the other columns of docs as one struct, so that no name can clash with an operator's, and the text, which goes to the tasks once."""
    others = [c for c in docs.columns if c != text]
    return docs.select((F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("row"), F.col(text).alias("text"))


def unpacked(df: DataFrame, docs: DataFrame, text: str, *more: str) -> DataFrame:
    """The columns of docs out of (row, text), and more of df."""
    return df.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns], *more)


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column's values, one at a time; null counts as empty."""
    return (value.as_py() or b"" for value in column.cast(pa.binary()))


def replaced(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """batch with columns of those names replaced, or added at the end."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, array in columns.items():
        if name in names:
            arrays[names.index(name)] = array
        else:
            names.append(name)
            arrays.append(array)
    return pa.RecordBatch.from_arrays(arrays, names=names)


#: Key lists up to so many rows are broadcast (about 16 bytes a row in memory); longer ones meet the rows in a shuffle.
BROADCAST_KEYS = 1_000_000


def by_keys(df: DataFrame, keys: DataFrame, on: str | Column, how: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """df joined with a table that has a row for each key: broadcast if it is counted to be small, else shuffled. keys should be cut."""
    small = keys.limit(most + 1).count() <= most
    return df.join(F.broadcast(keys) if small else keys, on, how)
