"""Bulk import and export of text and CSV, sampling, snapshots and inherited tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class CopyOptions:
    """Options of a COPY; text separates by tabs and writes null as \\N, CSV by commas and as nothing."""

    format: str = "text"
    delimiter: str | None = None
    null: str | None = None
    quote: str = '"'
    escape: str = '"'
    header: bool = False
    #: Marker in the data -> the column's default value.
    default: str | None = None
    defaults: dict[str, object] = field(default_factory=dict)

    def marker(self) -> str:
        """What stands for null."""
        return self.null if self.null is not None else "" if self.format == "csv" else "\\N"

    def options(self) -> dict[str, str]:
        """Spark's options for the CSV format."""
        return {"sep": self.delimiter or ",", "nullValue": self.marker(), "header": str(self.header).lower(), "emptyValue": '""', "quote": self.quote, "escape": self.escape}


#: What the text format writes after a backslash, besides the backslash itself and the delimiter.
_ESCAPES = {"\t": "t", "\n": "n", "\r": "r", "\b": "b", "\f": "f", "\v": "v"}


def _escaped(c: Column, delimiter: str) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, letter in _ESCAPES.items():
        out = F.replace(out, F.lit(raw), F.lit(f"\\{letter}"))
    return out if delimiter in _ESCAPES else F.replace(out, F.lit(delimiter), F.lit(f"\\{delimiter}"))


def _unescaped(c: Column) -> Column:
    """Between pairs of backslashes, which stand for one, each backslash escapes the character after it."""

    def piece(part: Column) -> Column:
        for raw, letter in _ESCAPES.items():
            part = F.replace(part, F.lit(f"\\{letter}"), F.lit(raw))
        return F.replace(part, F.lit("\\"), F.lit(""))

    return F.array_join(F.transform(F.split(c, r"\\\\"), piece), "\\")


def copy_from(spark: SparkSession, path: str, schema: T.StructType, options: CopyOptions = CopyOptions()) -> DataFrame:  # noqa: B008
    """The rows of files, in the types of schema; a header must name its columns (CSV). The default marker stands for the column's default."""
    if options.format == "binary":
        return spark.read.schema(schema).parquet(path)
    if options.format == "text":
        delimiter = options.delimiter or "\t"
        # A delimiter parts columns if the backslashes before it are pairs.
        parts = F.split("value", f"(?<=(?:^|[^\\\\])(?:\\\\\\\\){{0,99}}){re.escape(delimiter)}")
        cells = spark.read.text(path).select(parts.alias("p")).select(*[F.get("p", F.lit(i)).alias(f.name) for i, f in enumerate(schema.fields)])
        raw = cells.select(*[F.when(F.col(f"`{c}`") != options.marker(), _unescaped(F.col(f"`{c}`"))).alias(c) for c in cells.columns])
    else:
        raw = spark.read.options(**options.options()).option("enforceSchema", "false" if options.header else "true").option("mode", "FAILFAST").schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])).csv(path)
    column = lambda f: F.col(f.name) if options.default is None else F.when(F.col(f.name) == options.default, F.lit(options.defaults.get(f.name)).cast("string")).otherwise(F.col(f.name))
    return raw.select(*[column(f).cast(f.dataType).alias(f.name) for f in schema.fields])


def copy_to(df: DataFrame, path: str, options: CopyOptions = CopyOptions()) -> None:  # noqa: B008
    """Rows into files: text escapes tabs, line ends, delimiters and backslashes by backslashes, CSV quotes, binary is Parquet."""
    if options.format == "binary":
        df.write.parquet(path)
    elif options.format == "text":
        delimiter = options.delimiter or "\t"
        cells = [F.coalesce(_escaped(F.col(f"`{c}`").cast("string"), delimiter), F.lit(options.marker())) for c in df.columns]
        df.select(F.concat_ws(delimiter, *cells).alias("value")).write.text(path)
    else:
        df.write.options(**options.options()).csv(path)


def shared_folder(spark: SparkSession) -> str:
    """Where tables that all executors read may be written: the folder of spark.checkpoint.dir, else the warehouse."""
    return (spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def sample(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """TABLESAMPLE BERNOULLI; SYSTEM samples rows as well, for Spark has no pages to sample."""
    return df.sample(fraction=percent / 100, seed=seed)


def inherited(parent: DataFrame, **children: DataFrame) -> DataFrame:
    """The rows of a parent table and of those that inherit from it, with _source; columns of the children alone are left out."""
    out = parent.withColumn("_source", F.lit("parent"))
    for name, child in children.items():
        out = out.unionByName(child.select(*parent.columns).withColumn("_source", F.lit(name)))
    return out


def only(df: DataFrame) -> DataFrame:
    return df.where(F.col("_source") == "parent").drop("_source")


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")


def restore(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
