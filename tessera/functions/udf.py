"""User-defined functions and aggregates."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.udtf import UserDefinedTableFunction


def _arrow(kind: str) -> pa.DataType:
    return to_arrow_type(T._parse_datatype_string(kind))


def declared(name: str) -> Callable[..., Column]:
    """A function that the engine knows by name, with any number of arguments."""
    return lambda *columns: F.call_function(name, *columns)


def scalar(function: Callable, kind: str, deterministic: bool = True):
    """A function of one value as one of Arrow batches; it sees nulls as None, and whole numbers beside them as such. A session must be there."""
    made = _arrow(kind)

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([function(v) for v in values.to_pylist()], made)

    return run if deterministic else run.asNondeterministic()


def constant(function: Callable, kind: str, deterministic: bool = False) -> Column:
    """A function without arguments, called for each row."""
    return scalar(lambda _: function(), kind, deterministic)(F.lit(0) if deterministic else F.monotonically_increasing_id())


def aggregate(start: Callable, step: Callable, finish: Callable, kind: str):
    """An aggregate by steps over a group, whose values meet in one task; of a group without values, finish(None). Use aggregate_by() where groups are large."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> float:
        if values.empty:
            return finish(None)
        state = start()
        for v in values:
            state = step(state, v)
        return finish(state)

    return run


#: Groups of which a task holds the states at once.
_HELD = 100_000


def aggregate_by(df: DataFrame, keys: list[str], value: Column, start: Callable, step: Callable, merge: Callable, finish: Callable, kind: str, name: str) -> DataFrame:
    """(keys, name): an aggregate with partial states: each task steps through its rows, merge() then joins a state or a few for each task and group."""
    own = T.StructType([df.schema[k] for k in keys])
    fields, made = to_arrow_schema(own), _arrow(kind)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, object] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in states], f.type) for i, f in enumerate(fields)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], names=[*keys, "_state"])

        for batch in batches:
            for *key, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(key)
                states[key] = step(states[key] if key in states else start(), v)
            if len(states) > _HELD:
                yield out()
                states.clear()
        if states:
            yield out()

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        state = reduce(merge, (pickle.loads(s) for s in table.column("_state").to_pylist()))
        return pa.table([*[pa.array([k.as_py()], f.type) for k, f in zip(key, fields, strict=True)], pa.array([finish(state)], made)], names=[*keys, name])

    states = df.select(*keys, value.alias("_value")).mapInArrow(partial, T.StructType([*own.fields, T.StructField("_state", T.BinaryType())]))
    return states.groupBy(*keys).applyInArrow(whole, T.StructType([*own.fields, T.StructField(name, T._parse_datatype_string(kind))]))


def table(function: Callable, kind: str):
    """A table function: for each call the rows, as tuples of the columns of kind, that function yields for its arguments."""

    class Run:
        def eval(self, *arguments):
            yield from function(*arguments)

    return F.udtf(Run, returnType=kind)


def register(spark: SparkSession, name: str, function) -> None:
    """Make a scalar function, an aggregate or a table function known to SQL."""
    (spark.udtf if isinstance(function, UserDefinedTableFunction) else spark.udf).register(name, function)
