"""An immutable query: clauses that replace or add up, applied in SQL's order when it is run."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    """filter() and or_filter() add to WHERE; having(), order(), select(), limit() and offset() replace, then_order_by() appends."""

    source: DataFrame
    where: Column | None = None
    keys: tuple = ()
    aggregates: tuple = ()
    post: Column | None = None
    columns: tuple = ()
    ordering: tuple = ()
    n: int | None = None
    skip: int = 0
    unique: bool = False
    unique_on: tuple = ()

    def filter(self, condition: Column) -> Query:
        return replace(self, where=condition if self.where is None else self.where & condition)

    def or_filter(self, condition: Column) -> Query:
        return replace(self, where=condition if self.where is None else self.where | condition)

    def find(self, key: str | tuple[str, ...], value: object) -> Query:
        keys, values = ((key,), (value,)) if isinstance(key, str) else (key, value)
        out = self
        for k, v in zip(keys, values, strict=True):
            out = out.filter(F.col(k) == v)
        return out

    def inner_join(self, other: DataFrame, on) -> Query:
        return replace(self, source=self.source.join(other, on, "inner"))

    def left_join(self, other: DataFrame, on) -> Query:
        return replace(self, source=self.source.join(other, on, "left"))

    def group_by(self, *keys: str | Column) -> Query:
        return replace(self, keys=keys)

    def aggregate(self, *aggregates: Column) -> Query:
        return replace(self, aggregates=aggregates)

    def having(self, condition: Column) -> Query:
        return replace(self, post=condition)

    def select(self, *columns: str | Column) -> Query:
        return replace(self, columns=columns)

    def order(self, *ordering: Column) -> Query:
        return replace(self, ordering=ordering)

    def then_order_by(self, *ordering: Column) -> Query:
        return replace(self, ordering=(*self.ordering, *ordering))

    def limit(self, n: int) -> Query:
        return replace(self, n=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def distinct(self) -> Query:
        return replace(self, unique=True)

    def distinct_on(self, *keys: str) -> Query:
        """The first row, in order, of those with equal keys."""
        return replace(self, unique_on=keys)

    def count(self) -> DataFrame:
        """One row with the number of rows, without order and limit."""
        return replace(self, ordering=(), n=None, skip=0, columns=()).run().agg(F.count("*").alias("count"))

    def exists(self) -> DataFrame:
        return self.limit(1).run().agg((F.count("*") > 0).alias("exists"))

    def paginate(self, page: int, size: int, total: str = "total") -> DataFrame:
        """A page of rows, each with the number of all of them. The source is read for the page and for the number: write a costly one first."""
        rows = self.run()
        return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias(total)))).orderBy(*self.ordering).offset((page - 1) * size).limit(size)  # one row

    def run(self) -> DataFrame:
        df = self.source
        if self.where is not None:
            df = df.where(self.where)
        if self.keys or self.aggregates:
            df = df.groupBy(*self.keys).agg(*self.aggregates)
        if self.post is not None:
            df = df.where(self.post)
        if self.unique_on:
            # Rows equal in order are tied by nothing: any of them may be first.
            rank = F.row_number().over(Window.partitionBy(*self.unique_on).orderBy(*(self.ordering or self.unique_on)))
            df = df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
        if self.columns:
            df = df.select(*self.columns)
        if self.unique:
            df = df.distinct()
        if self.ordering:
            df = df.orderBy(*self.ordering)
        if self.skip:
            df = df.offset(self.skip)
        return df.limit(self.n) if self.n is not None else df


def dynamic_select(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """A projection put together at run time from (column, type)."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in fields])


def try_grouped_by(parents: DataFrame, children: DataFrame, key: str, foreign: str, into: str, order: str) -> DataFrame:
    """grouped_by() that fails when it is run if a child refers to a parent that isn't there; without a reference it is left out."""
    orphan = children.where(F.col(foreign).isNotNull()).join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti").limit(1)
    refused = orphan.select(F.raise_error(F.concat(F.lit("a child refers to no parent: "), F.col(foreign).cast("string"))).cast(parents.schema[key].dataType).alias(key))
    return grouped_by(parents, children, key, foreign, into, order).join(refused, key, "left_anti")


def grouped_by(parents: DataFrame, children: DataFrame, key: str, foreign: str, into: str, order: str) -> DataFrame:
    """Each parent with the array of its children, in order; an empty one without children."""
    nested = children.groupBy(foreign).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in children.columns if c not in (order, foreign)]))).alias(into))
    joined = parents.join(nested, parents[key] == nested[foreign], "left").drop(foreign)
    return joined.withColumn(into, F.coalesce(into, F.array().cast(nested.schema[into].dataType)))
