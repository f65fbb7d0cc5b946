"""The tables that queries know: Parquet files of a folder, with their keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    name: str
    key: tuple[str, ...]
    #: Column -> (table, column) that it refers to.
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: Column -> value of a row that doesn't name it.
    defaults: dict[str, object] = field(default_factory=dict)


TABLES = {
    t.name: t
    for t in (
        Table("region", ("r_regionkey",)),
        Table("nation", ("n_nationkey",), {"n_regionkey": ("region", "r_regionkey")}),
        Table("customer", ("c_custkey",), {"c_nationkey": ("nation", "n_nationkey")}, {"c_acctbal": 0.0, "c_mktsegment": "NONE"}),
        Table("supplier", ("s_suppkey",), {"s_nationkey": ("nation", "n_nationkey")}),
        Table("part", ("p_partkey",)),
        Table("orders", ("o_orderkey",), {"o_custkey": ("customer", "c_custkey")}),
        Table("lineitem", ("l_orderkey", "l_linenumber"), {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}),
        Table("events", ("event_id",)),
    )
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reference(child: str, parent: str, through: str | None = None) -> Column:
    """The condition of a join that a foreign key of child names; through tells several keys apart."""
    keys = [(c, p) for c, (t, p) in TABLES[child].foreign.items() if t == parent and through in (None, c)]
    if len(keys) != 1:
        raise ValueError(f"{child} has {len(keys)} foreign keys to {parent}" + (f" by {through}" if through else ""))
    return F.col(keys[0][0]) == F.col(keys[0][1])


def join_to(spark: SparkSession, sf_dir: str, child: str, *parents: str, how: str = "inner") -> DataFrame:
    """A table joined with its parents in turn, each by a foreign key of a table that is there already."""
    out, there = load(spark, sf_dir, child), [child]
    for parent in parents:
        owners = [t for t in there if any(p == parent for p, _ in TABLES[t].foreign.values())]
        if len(owners) != 1:
            raise ValueError(f"{len(owners)} of {', '.join(there)} refer to {parent}")
        out = out.join(load(spark, sf_dir, parent), reference(owners[0], parent), how)
        there.append(parent)
    return out


def relation(spark: SparkSession, namespace: str | None, name: str) -> DataFrame:
    """A table or view whose name is known at run time only."""
    return spark.table(f"{namespace}.{name}" if namespace else name)


def describe(df: DataFrame) -> list[tuple[str, str, bool]]:
    """(column, type, nullable) of a relation, as the analyzer infers it: views and queries too."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]


def schema_diff(old: DataFrame, new: DataFrame) -> dict[str, list[str]]:
    """The columns that were added, dropped or given another type."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    return {"added": sorted(b.keys() - a.keys()), "dropped": sorted(a.keys() - b.keys()), "changed": sorted(c for c in a.keys() & b.keys() if a[c] != b[c])}
