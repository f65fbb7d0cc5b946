"""Window frames of every kind: ROWS and RANGE are Spark's, GROUPS and EXCLUDE are composed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNBOUNDED_PRECEDING, CURRENT, UNBOUNDED_FOLLOWING = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


def window_filter(aggregate: Callable[[Column], Column], c: Column, condition: Column, window) -> Column:
    """aggregate(c) FILTER (WHERE condition) OVER window."""
    return aggregate(F.when(condition, c)).over(window)


def _dealt(df: DataFrame, partition: list[str]) -> DataFrame:
    """df dealt by the partition's columns to all shuffle partitions, which are not merged into fewer: a task sorts no more than its share."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *partition) if partition else df


def groups_between(df: DataFrame, partition: list[str], order: list[Column], start: int, end: int, name: str, aggregate: Column) -> DataFrame:
    """aggregate over the peer groups from start to end about a row's own: a range over the groups' numbers."""
    numbered = df.withColumn("_peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)).cast("long"))
    frame = Window.partitionBy(*partition).orderBy("_peer").rangeBetween(start, end)
    return numbered.withColumn(name, aggregate.over(frame)).drop("_peer")


def excluding(df: DataFrame, partition: list[str], order: list[Column], frame: tuple[str, int, int], exclude: str, value: Column, fold: Callable[[Column], Column], name: str) -> DataFrame:
    """fold of the array of value over a frame (kind, start, end) less the current row, its group or its ties.

    The frame's values are gathered for each row, so it suits frames of bounded width and folds of
    any kind; use excluding_sums() for counts, sums and averages. A range takes one column to order by.
    """
    base = Window.partitionBy(*partition).orderBy(*order)
    numbered = _dealt(df.withColumn("_value", value), partition).withColumn("_peer", F.dense_rank().over(base).cast("long")).withColumn("_row", F.row_number().over(base).cast("long"))
    kind, start, end = frame
    ordered = Window.partitionBy(*partition).orderBy("_peer") if kind == "groups" else base
    over = ordered.rowsBetween(start, end) if kind == "rows" else ordered.rangeBetween(start, end)
    gathered = numbered.withColumn("_frame", F.collect_list(F.struct("_peer", "_row", "_value")).over(over))
    keep = {
        "current": lambda x: x["_row"] != F.col("_row"),
        "group": lambda x: x["_peer"] != F.col("_peer"),
        "ties": lambda x: (x["_peer"] != F.col("_peer")) | (x["_row"] == F.col("_row")),
        "no others": lambda x: F.lit(True),
    }[exclude]
    values = F.transform(F.filter("_frame", keep), lambda x: x["_value"])
    return gathered.withColumn(name, fold(values)).drop("_peer", "_row", "_value", "_frame")


def excluding_sums(df: DataFrame, partition: list[str], order: list[Column], frame: tuple[str, int, int], exclude: str, value: Column, count: str, total: str) -> DataFrame:
    """df with the count and the sum of the values, nulls aside, over a frame (rows, groups or range; start; end) less the current row, its group or its ties.

    Sums over the frame less those over what is excluded: no frame is gathered, so frames of any
    width do. Sums of doubles may differ in their last digits from those added up without the
    excluded rows. A range takes one numeric column to order by.
    """
    base = Window.partitionBy(*partition).orderBy(*order)
    numbered = _dealt(df.withColumn("_value", value), partition).withColumn("_peer", F.dense_rank().over(base).cast("long")).withColumn("_row", F.row_number().over(base).cast("long"))
    kind, start, end = frame
    by_row = Window.partitionBy(*partition).orderBy("_peer", "_row")  # as by _row, and the order of peers: one sort for both
    over = {"rows": by_row, "groups": Window.partitionBy(*partition).orderBy("_peer"), "range": base}[kind]
    over = over.rowsBetween(start, end) if kind == "rows" else over.rangeBetween(start, end)
    # Of a row's group, what the frame holds: by rows a part of it, else all of it or nothing.
    peers = Window.partitionBy(*partition, "_peer")
    peers = peers.orderBy("_row").rowsBetween(start, end) if kind == "rows" else peers
    inside = start <= 0 <= end
    row = lambda x: x if inside else F.lit(0)
    group = lambda x: F.coalesce(x.over(peers), F.lit(0)) if inside or kind == "rows" else F.lit(0)
    one, own = F.col("_value").isNotNull().cast("long"), F.coalesce("_value", F.lit(0))
    gone_n = {"no others": F.lit(0), "current": row(one), "group": group(F.count("_value")), "ties": group(F.count("_value")) - row(one)}[exclude]
    gone = {"no others": F.lit(0), "current": row(own), "group": group(F.sum("_value")), "ties": group(F.sum("_value")) - row(own)}[exclude]
    counted = numbered.withColumn("_n", F.count("_value").over(over) - gone_n).withColumn("_sum", F.coalesce(F.sum("_value").over(over), F.lit(0)) - gone)
    return counted.withColumn(count, F.col("_n").cast("long")).withColumn(total, F.when(F.col("_n") > 0, F.col("_sum"))).drop("_value", "_peer", "_row", "_n", "_sum")


def array_sum(values: Column) -> Column:
    """The sum of the elements that aren't null; null without any."""
    some = F.array_compact(values)
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x))


def array_count(values: Column) -> Column:
    return F.size(F.array_compact(values)).cast("long")


def without_current(aggregate: Callable[[Column], Column], join: Callable[[Column, Column], Column], c: Column, partition: list[str], order: list[Column]) -> Column:
    """An aggregate over the partition less the current row, from the frames before and after it."""
    base = Window.partitionBy(*partition).orderBy(*order)
    before, after = aggregate(c).over(base.rowsBetween(UNBOUNDED_PRECEDING, -1)), aggregate(c).over(base.rowsBetween(1, UNBOUNDED_FOLLOWING))
    return join(before, after)


def added(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
